"""Approximate nearest neighbours by largest inner product: an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, split_by_keys, staged

#: Vectors that the centroids are fitted on, at most; all vectors are indexed.
SAMPLE = 16_384
#: Centroids of a half, at most, and mean vectors of a cell up to that.
MAX_CENTROIDS, MEAN_CELL = 256, 12
#: Candidates of a query's first probes. Their k-th score is a bound for the others.
FIRST = 1_000
#: Share of the vectors expected above the bound that may lie in cells left out.
MISS = 0.06
#: Vectors of a piece of the index, about: what a task holds while queries stream by.
PIECE = 16_384
#: Queries scored at once.
BLOCK = 128


class Books(NamedTuple):
    """Centroids of both halves, and of each the mean squared distance of its vectors in a dimension."""

    cut: int
    centres: tuple[np.ndarray, np.ndarray]
    spread: tuple[np.ndarray, np.ndarray]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.cut], x[..., self.cut :]

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of a query's halves with the centroids."""
        return tuple(h @ c.T for h, c in zip(self.halves(q), self.centres, strict=True))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) / 2 - x @ centres.T).argmin(1)


def fit_books(sample: np.ndarray, centroids: int, rounds: int = 12) -> Books:
    """k-means of both halves of the sample's vectors; the start is the same on every run."""
    cut = (sample.shape[1] + 1) // 2
    centres, spread = [], []
    for x in (sample[:, :cut], sample[:, cut:]):
        c = x[np.random.default_rng(0).permutation(len(x))[:centroids]].copy()
        for _ in range(rounds):
            own = _nearest(x, c)
            for k in np.unique(own):
                c[k] = x[own == k].mean(0)
        own = _nearest(x, c)
        squares = np.bincount(own, ((x - c[own]) ** 2).sum(1), len(c)) / np.maximum(np.bincount(own, minlength=len(c)), 1)
        centres.append(c)
        spread.append(np.maximum(squares, squares.mean()) / max(1, x.shape[1]))
    return Books(cut, tuple(centres), tuple(spread))


def first_cells(books: Books, counts: np.ndarray, q: np.ndarray, want: int) -> np.ndarray:
    """Cells in descending order of the sum of both centroids' products, until they hold ``want`` vectors or are all.

    The heap has the pairs of ranks whose better neighbours are both taken.
    """
    one, two = books.scores(q)
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    heap, upto, found, held = [(-(one[a[0]] + two[b[0]]), 0, 0)], np.zeros(len(a) + 1, np.int64), [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        upto[i] = j + 1  # of the pairs with the i-th first half, so many are taken
        if n := counts[a[i], b[j]]:
            found.append(a[i] * len(two) + b[j])
            held += n
        if i + 1 < len(a) and upto[i + 1] == j:
            heapq.heappush(heap, (-(one[a[i + 1]] + two[b[j]]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or upto[i - 1] > j + 1):
            heapq.heappush(heap, (-(one[a[i]] + two[b[j + 1]]), i, j + 1))
    return np.array(found, np.int64)


def _tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z, within about 1 %."""
    up = np.abs(z)
    share = np.sqrt(2 / np.pi) * np.exp(-up * up / 2) / (up + np.sqrt(up * up + 8 / np.pi))
    return np.where(z < 0, 1 - share, share)


def further_cells(books: Books, counts: np.ndarray, q: np.ndarray, bound: float, miss: float, far: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Cells whose vectors may reach the bound: all but ``miss`` of those expected to, or, with the largest distances ``far``, all for certain.

    A cell's scores are taken as normal about the sum of its centroids', with the spread of the vectors about them.
    """
    one, two = books.scores(q)
    length = [float(np.linalg.norm(h)) for h in books.halves(q)]
    sums = one[:, None] + two[None, :]
    if far is not None:
        return np.flatnonzero((sums + (length[0] * far[0][:, None] + length[1] * far[1][None, :]) * (1 + 1e-9) >= bound) & (counts > 0))
    some = np.flatnonzero(counts)
    if not np.isfinite(bound):
        return some
    spread = np.sqrt(length[0] ** 2 * books.spread[0][:, None] + length[1] ** 2 * books.spread[1][None, :]).ravel()[some]
    z = (bound - sums.ravel()[some]) / np.maximum(spread, 1e-300)
    order = np.argsort(-z, kind="stable")
    left_out = np.cumsum((counts.ravel()[some] * _tail(z))[order])
    return some[order[np.searchsorted(left_out, miss * left_out[-1], "right") :]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v), one row per vec_id: vectors with an id, no null or non-finite component, not all zero, of the most frequent length."""
    inf = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (usual.n if usual else 0))
    again = staged(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    once, some = split_by_keys(rows, again, [F.col("vec_id")], [F.col("vec_id")])
    return staged(once.unionByName(some.groupBy("vec_id").agg(F.min("v").alias("v"))), "vectors")


def classes_of(rows: DataFrame, is_query: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """Equal vectors are one class: (rep, v, asked, ids), and (rep, vec_id) of the classes with several.

    rep: the least id. ids: the ``keep`` least ids, as no more can be among the nearest. A class's ids are thinned
    out in three rounds, each over fewer parts of it, so that no task sees them all.
    """
    classes = staged(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max(F.expr(is_query)).alias("asked")), "classes")
    copied = classes.where("n > 1").select("v", "rep")
    _, some = split_by_keys(rows, copied, [F.xxhash64("v")], [F.xxhash64("v")])
    copies = staged(some.join(copied.hint("merge"), "v").select("rep", "vec_id"), "copies")
    least = copies
    for parts in (64, 8, 1):
        order = Window.partitionBy("rep", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).orderBy("vec_id")
        least = least.withColumn("i", F.row_number().over(order)).where(F.col("i") <= keep).drop("i")
    lists = staged(least.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "least-ids")
    single = classes.where("n = 1").select("rep", "v", "asked", F.array("rep").alias("ids"))
    several = classes.where("n > 1").join(lists.hint("merge"), "rep").select("rep", "v", "asked", "ids")
    return single.unionByName(several), copies


class MultiIndex:
    """All classes of equal vectors with the cell of each; the counts of the cells are a table of bounded size."""

    def __init__(self, classes: DataFrame, dim: int, kind: str, sample: int = SAMPLE, mean_cell: int = MEAN_CELL, piece: int = PIECE):
        self.dim, self.kind, self.piece = dim, kind, piece
        n = classes.count()
        k = min(MAX_CENTROIDS, max(1, 2 ** round(math.log2(max(1, n / mean_cell)) / 2)))
        chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()["v"]
        self.books = books = fit_books(np.stack(chosen.to_numpy()).astype(np.float64), min(k, n))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                halves = books.halves(_matrix(batch.column("v"), dim))
                own = [_nearest(h, c) for h, c in zip(halves, books.centres, strict=True)]
                far = [np.linalg.norm(h - c[o], axis=1) for h, c, o in zip(halves, books.centres, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o.astype(np.int32)) for o in own), *map(pa.array, far)], [*batch.schema.names, "a", "b", "far_a", "far_b"])

        schema = f"rep long, v {kind}, asked boolean, ids array<long>, a int, b int, far_a double, far_b double"
        self.rows = staged(classes.select("rep", "v", "asked", "ids").mapInArrow(place, schema), "multi-index")
        sizes = len(books.centres[0]), len(books.centres[1])
        self.counts, self.far = np.zeros(sizes, np.int64), (np.zeros(sizes[0]), np.zeros(sizes[1]))
        for r in self.rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("far_a").alias("x"), F.max("far_b").alias("y")).collect():
            self.counts[r.a, r.b] = r.n
            self.far[0][r.a], self.far[1][r.b] = max(self.far[0][r.a], r.x), max(self.far[1][r.b], r.y)

    def probes(self, queries: DataFrame, cells: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
        """(rep, v, bound) → a row for each first half a that the query visits, with the second halves bs."""
        dim, width = self.dim, self.counts.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, bound = _matrix(batch.column("v"), dim), batch.column("bound").to_numpy(zero_copy_only=False)
                for i in range(0, len(x), BLOCK):
                    found = [np.sort(cells(q, t)) for q, t in zip(x[i : i + BLOCK], bound[i : i + BLOCK], strict=True)]
                    who = np.repeat(np.arange(i, i + len(found)), [len(c) for c in found])
                    a, b = np.divmod(np.concatenate(found) if found else np.zeros(0, np.int64), width)
                    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (a[1:] != a[:-1])])) if len(a) else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(a)).astype(np.int32)), pa.array(b.astype(np.int32)))
                    part = batch.take(pa.array(who[new]))
                    yield pa.RecordBatch.from_arrays([pa.array(a[new].astype(np.int32)), lists, part.column("rep"), part.column("v"), part.column("bound")], ["a", "bs", "rep", "v", "bound"])

        return queries.select("rep", "v", "bound").mapInArrow(run, f"a int, bs array<int>, rep long, v {self.kind}, bound double")

    def scan(self, probes: DataFrame, keep: int) -> DataFrame:
        """(query, rep, ids, score): of each query and piece of the index the ``keep`` best classes in its cells that reach the bound.

        The rows of a first half are cut into pieces; a query goes to each. Sorted, a piece's rows come before the
        queries, which stream by in blocks, so a task holds one piece whatever the number of queries.
        """
        dim, width = self.dim, self.counts.shape[1]
        cuts = F.array(*[F.lit(max(1, math.ceil(int(n) / self.piece))) for n in self.counts.sum(axis=1)])
        pieces = F.element_at(cuts, F.col("a") + 1)
        own = self.rows.select("a", F.pmod(F.xxhash64("rep"), pieces).cast("int").alias("p"), F.lit(0).alias("kind"), "rep", "v", F.array("b").alias("bs"), F.lit(0.0).alias("bound"), "ids")
        asked = probes.select("a", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("p"), F.lit(1).alias("kind"), "rep", "v", "bs", "bound", F.array().cast("array<long>").alias("ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, ready = None, [], None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "p", "kind")], axis=1)
                cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for i, j in zip(cut, cut[1:], strict=False):
                    if i == j:
                        continue
                    part = batch.slice(i, j - i)
                    if (here := tuple(keys[i, :2])) != at:
                        at, held, ready = here, [], None
                    if keys[i, 2] == 0:
                        held.append(part)
                    elif held:
                        if ready is None:
                            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                            ready = _matrix(table.column("v"), dim), table.column("bs").flatten().to_numpy(), table.column("rep").to_numpy(), table.column("ids")
                        for k in range(0, part.num_rows, BLOCK):
                            yield _best(part.slice(k, BLOCK), *ready, dim, width, keep)

        dealt = own.unionByName(asked).repartition("a", "p").sortWithinPartitions("a", "p", "kind")
        return dealt.mapInArrow(run, "query long, rep long, ids array<long>, score double")


def _best(part: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, rep: np.ndarray, ids: pa.Array, dim: int, width: int, keep: int) -> pa.RecordBatch:
    q, lists = _matrix(part.column("v"), dim), part.column("bs")
    visited = np.zeros((len(q), width), bool)
    visited[np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
    score = np.where(visited[:, cell], q @ rows.T, -np.inf)
    low = part.column("bound").to_numpy(zero_copy_only=False)
    if len(rows) > keep:
        low = np.maximum(low, np.partition(score, -keep, axis=1)[:, -keep])
    # products are summed again, one after the other, so that a pair's score is the same in every block
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(rows, axis=1).max()
    who, what = np.nonzero((score >= (low - slack)[:, None]) & (score > -np.inf))
    exact = np.empty(len(who))
    for i in range(0, len(who), 1 << 14):
        exact[i : i + (1 << 14)] = np.cumsum(q[who[i : i + (1 << 14)]] * rows[what[i : i + (1 << 14)]], axis=1)[:, -1]
    order = np.lexsort((rep[what], -exact, who))
    rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
    order = order[rank < keep]
    who, what = who[order], what[order]
    return pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(who)), pa.array(rep[what]), ids.take(pa.array(what)), pa.array(exact[order])], ["query", "rep", "ids", "score"])


def _first_of(found: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= keep).drop("i")


def nearest(vectors: DataFrame, is_query: str, k: int = 20, first: int = FIRST, miss: float = MISS, exact: bool = False, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query's row found, by inner product; ties to the smaller id.

    vectors: vec_id, v. is_query: a condition on vec_id, in SQL. A query first visits the cells with the largest sums until
    they hold ``first`` classes of vectors; the score of its (k + 1)-th is a bound, and then the cells that hold
    all but ``miss`` of the vectors expected to reach it. With ``exact``, no cell that can reach it is left out. Of rows with one vec_id the one with the least vector takes part; a vector that is
    null, zero, not finite, of another length than most or without id does not. Equal vectors are searched once.
    Empty table: no rows.
    """
    kind, keep = vectors.schema["v"].dataType.simpleString(), k + 1
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v"))
    head = rows.first()
    if head is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    classes, copies = classes_of(rows, is_query, keep)
    index = MultiIndex(staged(classes, "vector-classes"), len(head.v), kind, **options)
    books, counts, far = index.books, index.counts, index.far if exact else None
    none = float("-inf")
    asked = index.rows.where("asked").select("rep", "v", F.lit(none).alias("bound"))
    near = staged(_first_of(index.scan(index.probes(asked, lambda q, _: first_cells(books, counts, q, first)), keep), keep), "first-found")
    bounds = near.groupBy(F.col("query").alias("rep")).agg(F.when(F.count(F.lit(1)) >= keep, F.min("score")).otherwise(none).alias("bound"))
    again = staged(asked.drop("bound").join(bounds, "rep"), "bounds")
    rest = index.scan(index.probes(again, lambda q, bound: np.setdiff1d(further_cells(books, counts, q, bound, miss, far), first_cells(books, counts, q, first))), keep)
    best = _first_of(near.unionByName(rest), keep)
    lists = best.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("id")))))), 1, keep).alias("found"))
    ids = index.rows.where("asked and size(ids) = 1").select("rep", F.col("rep").alias("query_id")).unionByName(copies.where(is_query).select("rep", F.col("vec_id").alias("query_id")))
    each = ids.join(lists, ids["rep"] == lists["query"]).select("query_id", F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k).alias("found"))
    ranked = each.select("query_id", F.posexplode("found").alias("i", "f"))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.less")).alias("score"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each 20th vector (``nearest``)."""
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), "vec_id % 20 = 0")


#: All candidates of a query; the same rows as the search's wherever its first probes already cover the index.
OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""
