import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.llm import multiindex

EVERY = "vec_id % 20 = 0"


def brute(ids, x, k=20):
    x, out = np.asarray(x, np.float64), {}
    for i in np.flatnonzero(np.asarray(ids) % 20 == 0):
        score = np.cumsum(x[i] * x, axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def frame(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"vec_id": ids, "v": [v.tolist() for v in x]}), "vec_id long, v array<float>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 32)).astype(np.float32)
    return np.arange(5000), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_on_vectors_without_clusters(spark, cloud):
    want, got = brute(*cloud), found(multiindex.nearest(frame(spark, *cloud), EVERY, first=200))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    exact = {q: dict(brute(*cloud, 5000)[q]) for q in list(want)[:5]}
    assert all(exact[q][i] == s for q in exact for i, s in got[q])


def test_exact_search_equals_brute_force(spark, cloud):
    ids, x = cloud[0][:1500], cloud[1][:1500] * np.linspace(0.5, 2, 1500, dtype=np.float32)[:, None]
    assert found(multiindex.nearest(frame(spark, ids, x), EVERY, first=50, exact=True, piece=64, mean_cell=8)) == brute(ids, x)


def test_few_cells_are_visited_where_there_are_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(100, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = multiindex.fit_books(x, 32)
    own = [multiindex._nearest(h, c) for h, c in zip(books.halves(x), books.centres, strict=True)]
    counts = np.zeros((32, 32), np.int64)
    np.add.at(counts, tuple(own), 1)
    seen, share = [], []
    for q in x[::200]:
        score = x @ q
        cells = {*multiindex.further_cells(books, counts, q, np.sort(score)[-21], 0.05, None).tolist(), *multiindex.first_cells(books, counts, q, 200).tolist()}
        near = np.argsort(-score)[:20]
        seen.append(np.mean([own[0][i] * 32 + own[1][i] in cells for i in near]))
        share.append(sum(counts.ravel()[list(cells)]) / len(x))
    assert np.mean(seen) > 0.95 and np.mean(share) < 0.2


def test_the_heap_takes_cells_in_order(cloud):
    books = multiindex.fit_books(cloud[1][:2000].astype(np.float64), 8)
    counts = np.ones((8, 8), np.int64)
    for q in cloud[1][:20].astype(np.float64):
        one, two = books.scores(q)
        sums = (one[:, None] + two[None, :]).ravel()
        got = multiindex.first_cells(books, counts, q, 64)
        assert sorted(got.tolist()) == list(range(64)) and (np.diff(sums[got]) <= 1e-12).all()
        assert (multiindex.first_cells(books, counts, q, 10) == got[:10]).all()


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 200)] + [(i, [0.0, 1.0]) for i in range(200, 230)]
    bad = [(300, None), (320, [0.0, 0.0]), (340, [float("nan"), 1.0]), (360, [None, 1.0]), (380, [float("inf"), 1.0]), (400, [1.0, 2.0, 3.0]), (None, [9.0, 9.0])]
    again = [(0, [1.0, 0.0]), (210, [5.0, 5.0])]
    df = spark.createDataFrame(rows + bad + again, "vec_id long, v array<float>").withColumn("rep", F.lit("x"))
    got = found(multiindex.nearest(df, EVERY, piece=3))
    assert got == brute(np.array([i for i, _ in rows]), np.array([v for _, v in rows]))
    assert multiindex.nearest(df.limit(0), EVERY).count() == 0
    assert multiindex.nearest(df.where("vec_id = 300"), EVERY).count() == 0
    assert found(multiindex.nearest(df.where("vec_id in (0, 7)"), EVERY)) == {0: [(7, 1.0)]}


def test_rows_equal_those_of_sql(same_rows):
    same_rows(multiindex.op12_nearest_vectors, multiindex.OP12_SQL)
