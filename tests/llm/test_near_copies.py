import random

import numpy as np
import pytest
import xxhash

from pagemill.llm import fingerprints, simhash, substrings
from pagemill.llm.components import connected_components


def groups(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    want = groups(200, edges)
    found = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found.get(i, i) == want[i] for i in range(200))


@pytest.mark.parametrize("size", [4096, 60])
@pytest.mark.parametrize("radius", [4, 7])
def test_trees_lose_no_link(spark, size, radius):
    rng = np.random.default_rng(1)
    base, one = rng.integers(0, 2**63, 4, dtype=np.uint64), np.uint64(1)
    flips = [np.bitwise_xor.reduce(one << rng.integers(0, 64, (200, 3), dtype=np.uint64), axis=1) for _ in base]
    points = np.unique(np.concatenate([*[b ^ f for b, f in zip(base, flips, strict=True)], rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    want = len(set(groups(len(points), zip(*np.nonzero(near), strict=True))))
    fps = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    assert len(points) - connected_components(simhash.near_edges(fps, radius, size)).count() == want


def plain(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_edges(spark):
    texts = [None, "", "A b", "a B", "a b c d e f", "É é x y z", "w " * 500, "\x1ca b"]
    for t in texts:
        assert simhash.simhash((t or "").encode()) == plain(t or "")
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "a b", "k", 1), (3, "a B", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, fp int")
    found = simhash.simhash_components(docs).collect()
    assert len(found) == 10
    assert {r.component_id for r in found if r.doc_id in (0, 1)} == {0}
    assert {r.component_id for r in found if r.doc_id in (2, 3, None)} == {2}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    other = [rng.choice(words) for _ in range(400)]
    rows = [(3, " ".join(base), "x"), (5, " ".join(near), "x"), (7, " ".join(other), "y"), (7, " ".join(other), "y"), (9, " ".join(base), None), (None, " ".join(base), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_second_group_of_a_component_goes_too(spark):
    """Versions whose changes add up: those far from the first are compared with each other as well, and their copies go."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    version = [rng.choice(words) for _ in range(400)]
    texts = []
    for k in range(60):
        texts.append(" ".join(version))
        version[(k * 7) % 400] = f"changed{k}"
    rows = [*enumerate(texts)] + [(1000 + i, texts[-1]) for i in range(20)] + [(2000, texts[30]), (None, texts[59])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near_copies([r for r in rows if r[0] is not None])
    assert len(want) >= 3
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect())
    assert kept == want
    split = dict(rows)
    assert all(jaccard(split[i], split[k]) < 0.8 for i in kept for k in kept if i < k)


def brute_near_copies(rows):
    """Ids that stay of (doc_id, text): equal texts once, then of each component of wide fingerprints, in order, those unlike all before."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    texts = sorted((i, t) for t, i in first.items())
    bits = [simhash.wide_simhash(t.encode(), 5) for _, t in texts]
    near = [(i, k) for i in range(len(texts)) for k in range(i) if sum((x ^ y).bit_count() for x, y in zip(bits[i], bits[k], strict=True)) <= simhash.COPY_RADIUS]
    component = groups(len(texts), near)
    stay = []
    for j, (i, t) in enumerate(texts):
        if not any(c == component[j] and jaccard(t.lower(), u.lower()) >= 0.8 for _, u, c in stay):
            stay.append((i, t, component[j]))
    return [i for i, _, _ in stay]


def test_edges_of_near_dedup(spark):
    """Null, empty and one-word texts, columns that clash with those inside, an empty table, one very long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, 5, "a"), (2, "", 6, "b"), (3, "word", 7, "c"), (4, "WORD", 8, "d"), (5, long, 9, "e"), (6, long + " end", 10, "f"), (None, None, 11, "g"), (7, "other", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, f0 string")
    kept = simhash.drop_near_copies(docs).collect()
    assert sorted((r.doc_id, r.key, r.f0) for r in kept if r.doc_id != 7) == [(1, 5, "a"), (3, 7, "c"), (5, 9, "e")]
    assert [r.key for r in kept if r.doc_id == 7] == [None]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_rounds_equal_one_by_one(spark):
    """One component of 400 rows, most unlike each other: more than the heads of the first three rounds."""
    rng = random.Random(4)
    sets = [rng.sample(range(10_000), 20) for _ in range(300)]
    sets += [[*rng.choice(sets)[: rng.choice([16, 18, 19])], *rng.sample(range(10_000, 20_000), 2)] for _ in range(100)]
    rows = [(1, k, (k * 37 % 400, k), s) for k, s in enumerate(sets)]
    found = simhash._like_one_before(spark.createDataFrame(rows, "component long, key long, at struct<a:int,b:int>, own array<long>"), 0.8)
    kept, gone = [], []
    for _, key, _, s in sorted(rows, key=lambda r: r[2]):
        like = any(len({*s} & k) >= 0.8 * len({*s} | k) for k in kept)
        gone.append(key) if like else kept.append({*s})
    assert len(kept) > 300 and sorted(r.key for r in found.collect()) == sorted(gone)


def test_most_near_copies_are_found(spark):
    """Pairs planted at similarities from 0.80 to 0.90; nine of ten at 0.80 are found, more above."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(150):
        text = [rng.choice(words) for _ in range(400)]
        near, goal = list(text), (0.80, 0.85, 0.90)[k % 3]
        for i in rng.sample(range(400), 400):
            word, near[i] = near[i], f"changed{i}"
            if jaccard(" ".join(text), " ".join(near)) < goal:
                near[i] = word
                break
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(150)} <= kept
    found = [sum(2 * k + 1 not in kept for k in range(g, 150, 3)) / 50 for g in range(3)]
    assert found[0] >= 0.9 and found[1] >= 0.95 and found[2] >= 0.98, found


def brute_substrings(docs, n):
    first = {}
    split = {i: (t or "").encode().split() for i, t in docs.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][k : k + n]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(20, 130))] for _ in range(6)]
    docs = {}
    for i in range(60):
        text = []
        for _ in range(rng.randrange(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.7 else [rng.choice(words) for _ in range(30)]
        docs[i * 3 % 61] = " ".join(text) + (" z" * 120 if i % 9 == 0 else "")
    docs[100], docs[101] = None, docs[0]
    table = spark.createDataFrame([(i, t, "s") for i, t in docs.items()], "doc_id long, text string, kept string").repartition(3)
    want = brute_substrings(docs, 50)
    found = {r.doc_id: r for r in substrings.dedup_substrings(table).collect()}
    assert {i: r.kept for i, r in found.items()} == want
    cut = {r.doc_id: r.text for r in substrings.cut_repeats(table).collect()}
    assert all(cut[i] == (docs[i] if found[i].n_removed == 0 else want[i]) for i in docs)


def test_substrings_without_rows_or_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup_substrings(none).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = substrings.dedup_substrings(spark.createDataFrame([(None, text), (None, text), (4, text), (4, text)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in rows] == [0, 0, 0, 0]


def test_likeness_follows_generalised_jaccard(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: 60 + 60 * (i % 4)]) for _ in range(200)) for i in range(40)] + [None, "", texts_equal := "a b a"] + ["a b a"]
    rows = fingerprints.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64).collect()
    own = {r.doc_id: r.own for r in rows}
    assert own[42] == own[43] and own[40] == own[41]
    errors = []
    for i in range(39):
        a, b = ({w: t.split().count(w) for w in t.split()} for t in texts[i : i + 2])
        true = sum(min(a.get(w, 0), b.get(w, 0)) for w in a | b) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a | b)
        errors.append(sum(x == y for x, y in zip(own[i], own[i + 1], strict=True)) / 64 - true)
    assert abs(sum(errors) / len(errors)) < 0.05 and max(map(abs, errors)) < 0.3


def test_fingerprint_query_edges(spark):
    import hashlib

    docs = spark.createDataFrame([(2, "héllo wörld"), (None, "xyz"), (2, "héllo wörld"), (9, None)], "doc_id long, text string")
    rows = sorted(fingerprints.edited_fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.doc_id for r in rows] == [None, 2, 2, 9]
    assert rows[0].edited_sha256 == hashlib.sha256("xyh".encode()).hexdigest()
    assert rows[1].edited_sha256 == hashlib.sha256("héllo ".encode()).hexdigest()
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
