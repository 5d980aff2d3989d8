"""SimHash near-duplicates: fingerprints, linked within a radius through BK-trees, and their components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, free_name, read_table, row_key, same_row, split_by_keys, staged, text_key, utf8_list
from .components import connected_components

#: Words per shingle, and differing bits up to which fingerprints link.
SHINGLE, RADIUS = 4, 4
SEED = 42
#: Fingerprints of one tree. A larger shard is cut into pieces, and each pair of pieces is searched.
SHARD = 4096
#: Mean fingerprints of a shard up to which keys need not be longer.
MEAN_SHARD = 64
#: Near copies are looked for with wide fingerprints of WORDS x 64 bits, linked up to COPY_RADIUS differing ones.
WORDS, COPY_RADIUS = 4, 52
#: Share of the pairs of the similarity asked for that meet in a shard, and mean fingerprints of a shard.
COPY_RECALL, COPY_SHARD = 0.98, 64
#: Odd multipliers that make further hashes of a shingle out of its first.
_MULTIPLIERS = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Rows of a component decided in one round, at most.
HEADS = 128
#: Tasks over which the rows of one text are spread.
SALTS = 16


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of words, repeats included; a shorter text is one shingle; without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(end[: n - 1] + 1).tolist()]
    stops = end[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def _majority(h: np.ndarray) -> np.ndarray:
    """(words, hashes) → a word of 64 bits for each row: a bit is 1 if it is set in over half of its hashes."""
    words, n = h.shape
    ones = np.zeros((words, 64), np.int64)
    for i in range(0, n, 1 << 14):
        part = np.ascontiguousarray(h[:, i : i + (1 << 14)])
        bits = np.unpackbits(part.view(np.uint8).reshape(words, -1, 8), axis=2, bitorder="little")
        for j in range(0, bits.shape[1], 255):
            ones += np.add.reduce(bits[:, j : j + 255], axis=1, dtype=np.uint8)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).reshape(words)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the shingles' XXH64; 0 without words."""
    return int(_majority(_shingle_hashes(text, shingle)[None, :])[0])


def wide_simhash(text: bytes, shingle: int) -> list[int]:
    """WORDS fingerprints of 64 bits, each by another hash of the same shingles; 0 without words."""
    h = _shingle_hashes(text, shingle) * _MULTIPLIERS[:WORDS, None]
    return _majority(h ^ (h >> np.uint64(32))).tolist()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, key (hash of the text), fp (the 64 bits as a long) of whole texts; null text as empty. With more words f0, f1 … instead of fp."""
    names = ["fp"] if words == 1 else [f"f{j}" for j in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = [[simhash(t, shingle)] if words == 1 else wide_simhash(t, shingle) for t in utf8_list(part.column("text"))]
                bits = np.array(found, np.uint64).reshape(-1, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(words))], ["doc_id", "key", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, " + ", ".join(f"{n} long" for n in names))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of many shards at once: the children of a node have different Hamming distances to it.

    All items descend together, one level a step; of those that reach the same free place the first takes it.
    """

    def __init__(self, items: np.ndarray, shard: np.ndarray):
        """items: rows of 64-bit words. shard: ascending numbers."""
        self.items = items
        n, places = items.shape[0], 64 * items.shape[1] + 1
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        child = np.full(n * places, -1, np.int32)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        todo = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[todo]
        while len(todo):
            d = _distance(items[todo], items[at])
            slot = at * places + d
            free = np.flatnonzero(child[slot] < 0)
            taken, who = np.unique(slot[free], return_index=True)
            new = free[who]
            child[taken] = todo[new]
            parent[todo[new]], edge[todo[new]] = at[new], d[new]
            at = child[slot].astype(np.int64)
            on = at != todo
            todo, at = todo[on], at[on]
        #: children by parent
        self.below = np.argsort(parent, kind="stable")[np.count_nonzero(parent < 0) :]
        self.edge = edge[self.below]
        self.count = np.bincount(parent[parent >= 0], minlength=n)
        self.start = np.cumsum(self.count) - self.count

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int, block: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in queries, node) within the radius, in parts of at most ``block`` steps. Edges outside it aren't followed."""
        stack = [(np.arange(len(queries)), roots.astype(np.int64))]
        while stack:
            q, node = stack.pop()
            if len(q) > block:
                stack += [(q[i : i + block], node[i : i + block]) for i in range(0, len(q), block)]
                continue
            d = _distance(queries[q], self.items[node])
            hit = d <= radius
            yield q[hit], node[hit]
            n = self.count[node]
            step = np.repeat(np.arange(len(q)), n)
            at = np.repeat(self.start[node] - np.cumsum(n) + n, n) + np.arange(len(step))
            on = np.abs(self.edge[at] - d[step]) <= radius
            if on.any():
                stack.append((q[step[on]], self.below[at[on]]))


def _link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in a union-find array; roots are the least members."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _shard_edges(ids: np.ndarray, fp: np.ndarray, shard: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of ids that join, in each shard, all that is linked within the radius.

    Items with tree are nodes of the shard's BK-tree, the others are searched in it only; in a shard all of whose
    items are nodes each is searched too.
    """
    parent = np.arange(len(fp))
    nodes = np.flatnonzero(tree)
    outside = np.zeros(int(shard[-1]) + 1, bool)
    outside[shard[~tree]] = True
    queries = np.flatnonzero(~(tree & outside[shard]))
    if len(nodes):
        forest = Forest(fp[nodes], shard[nodes])
        first = np.searchsorted(shard[nodes], shard[queries])
        known = (first < len(nodes)) & (shard[nodes][np.minimum(first, len(nodes) - 1)] == shard[queries])
        queries, first = queries[known], first[known]
        for q, node in forest.near(fp[queries], first, radius):
            _link(parent, queries[q], nodes[node])
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    return ids[moved], ids[parent[moved]]


def _edges(keyed: DataFrame, key: str, bits: list[str], radius: int, shard_size: int) -> DataFrame:
    """(key, bits, b, k) → (u, v): edges of keys whose components are those of all pairs of a shard (b, k) within the radius.

    A shard's BK-tree is built and searched in one task and yields a spanning edge per item at most, not its pairs.
    A shard of over ``shard_size`` is cut into pieces by hash, and each piece's tree is searched by each other
    piece, so that no task holds more than two pieces.
    """
    # only rows that may lie in a large shard are shuffled to meet its number of pieces
    large = staged(keyed.groupBy("b", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_size).select("b", "k", F.ceil(F.col("n") / shard_size).cast("int").alias("pieces")), "large-shards")
    whole, cut = split_by_keys(keyed, large, [F.col("b"), F.col("k")], [F.col("b"), F.col("k")])
    rows = cut.join(large.hint("merge"), ["b", "k"], "left").unionByName(whole.withColumn("pieces", F.lit(1))).withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(*bits, F.lit(7)), F.col("pieces")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cells = cells.select(F.col(key).alias("id"), *bits, "b", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("tree"))
    keys = ["b", "k", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in (*keys, "id", "tree", *bits)]
            if not len(cols[0]):
                continue
            held = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)] if held else cols
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in held[:4]])) + 1
            if len(new) and new[-1] >= shard_size:
                yield edges([c[: new[-1]] for c in held])
                held = [c[new[-1] :] for c in held]
        if held:
            yield edges(held)

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        shard = np.concatenate([[0], np.cumsum(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]]))])
        u, v = _shard_edges(cols[4], np.stack(cols[6:], axis=1).view(np.uint64), shard, cols[5].astype(bool), radius)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return cells.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, "u long, v long")


def near_edges(fps: DataFrame, radius: int = RADIUS, shard_size: int = SHARD, mean_shard: int = MEAN_SHARD) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of fingerprints within the radius.

    fps: distinct fingerprints, column fp. Fingerprints within radius r agree in at least one of r + 1 blocks of
    bits, in two of r + 2, in three of r + 3; the more there are, the longer the keys. A shard holds what agrees
    in the same blocks.
    """
    n = fps.count()
    equal = next((k for k in (1, 2, 3) if n / 2 ** (64 * k // (radius + k)) <= mean_shard), 3)
    cuts = [64 * i // (radius + equal) for i in range(radius + equal + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [_signed(sum(c)) for c in combinations(blocks, equal)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.b", "s.k")
    return _edges(keyed, "fp", ["fp"], radius, shard_size)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables_of(n: int, similarity: float, recall: float = COPY_RECALL, mean_shard: int = COPY_SHARD) -> list[list[int]]:
    """Masks over WORDS x 64 bits, a row of words each: what n fingerprints must agree in to meet.

    Shingle sets of Jaccard similarity s have a cosine of 2 s / (1 + s), so a bit of theirs agrees with probability
    p = 1 - acos / pi. A table samples so many bits that a shard has ``mean_shard`` items on the average, and
    there are so many tables that a pair agrees in one of them with the probability ``recall``. Their number grows
    with n to the power of about 0.24.
    """
    p = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(48, max(12, math.ceil(math.log2(max(1, n / mean_shard)))))
    count = math.ceil(math.log(1 - recall) / math.log(1 - p**bits))
    rng, total = np.random.default_rng(SEED), 64 * WORDS
    # each permutation is dealt out to as many tables as it fills, so that all bits are used alike
    orders = [rng.permutation(total) for _ in range(-(-count // (total // bits)))]
    dealt = [o[i * bits : (i + 1) * bits] for o in orders for i in range(total // bits)]
    return [[sum(1 << int(c % 64) for c in chosen if c // 64 == j) for j in range(WORDS)] for chosen in dealt[:count]]


def copy_edges(texts: DataFrame, similarity: float, recall: float = COPY_RECALL, radius: int = COPY_RADIUS, shard_size: int = SHARD) -> DataFrame:
    """(u, v): edges of keys whose components join wide fingerprints (key, f0, f1 …) within the radius that meet in a shard.

    Shards are samples of bits (``tables_of``), so a pair of the similarity is missed with 1 - recall.
    """
    bits = [f"f{j}" for j in range(WORDS)]
    each = [F.struct(F.lit(i).alias("b"), F.xxhash64(*[F.col(f).bitwiseAND(F.lit(_signed(m))) for f, m in zip(bits, masks, strict=True)]).alias("k")) for i, masks in enumerate(tables_of(texts.count(), similarity, recall))]
    keyed = texts.select("key", *bits, F.explode(F.array(*each)).alias("s")).select("key", *bits, "s.b", "s.k")
    return _edges(keyed, "key", bits, radius, shard_size)


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, mean_shard: int = MEAN_SHARD) -> DataFrame:
    """doc_id, key, fp, component_id of each row of docs."""
    each = staged(fingerprints(docs, shingle), "fingerprints")
    fps = staged(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = connected_components(near_edges(fps.select("fp"), radius, mean_shard=mean_shard))
    named = fps.join(linked.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("c"))
    named = staged(named, "named")
    lowest = staged(named.groupBy("c").agg(F.min("first").alias("component_id")), "lowest")
    found = staged(named.join(lowest, "c").select("fp", "component_id"), "found")
    return each.join(found, "fp").select("doc_id", "key", "fp", "component_id")


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: str, shingle: int) -> Column:
    """Distinct hashes of the shingles of a column of words; few words are one shingle."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, shingle))))


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Jaccard similarity of two arrays of distinct hashes is ``similarity`` or more; sizes too far apart aren't intersected."""
    common = F.size(F.array_intersect(a, b))
    near = F.least(F.size(a), F.size(b)) >= F.lit(similarity) * F.greatest(F.size(a), F.size(b))
    return F.when(near, common >= F.lit(similarity) * (F.size(a) + F.size(b) - common)).otherwise(False)


def _like_one_before(rows: DataFrame, similarity: float) -> DataFrame:
    """(component, key, at, own), distinct keys → key of the rows like one of their component that stays and has a lesser ``at``.

    A round takes the least rows left of each component, decides among them in order, and compares the others
    only with those of them that stay. The first takes one row, later ones up to HEADS.
    """
    n, gone, left = 1, rows.select("key").limit(0), rows
    state = F.struct(F.array().cast("array<array<bigint>>").alias("kept"), F.array().cast("array<bigint>").alias("gone"))

    def step(s: Column, x: Column) -> Column:
        like = F.exists(s["kept"], lambda y: _alike(x["own"], y, similarity))
        return F.struct(F.when(like, s["kept"]).otherwise(F.array_append(s["kept"], x["own"])).alias("kept"), F.when(like, F.array_append(s["gone"], x["key"])).otherwise(s["gone"]).alias("gone"))

    while not left.isEmpty():
        least = Window.partitionBy("component").orderBy("at")
        heads = staged(left.select("component", "key", "at").withColumn("i", F.row_number().over(least)).where(F.col("i") <= n).select("component", "key"), "heads")
        texts = left.join(heads, ["component", "key"]).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "key", "own"))).alias("h"))
        decided = staged(texts.select("component", F.aggregate("h", state, step).alias("s")).select("component", "s.kept", "s.gone"), "decided")
        others = left.join(heads, ["component", "key"], "left_anti").join(decided.select("component", "kept"), "component")
        others = staged(others.select("component", "key", "at", "own", F.exists("kept", lambda y: _alike(F.col("own"), y, similarity)).alias("like")), "others")
        gone = gone.unionByName(decided.select(F.explode("gone").alias("key"))).unionByName(others.where("like").select("key"))
        left, n = others.where("not like").drop("like"), min(max(32, 2 * n), HEADS)
    return gone


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = COPY_RECALL) -> DataFrame:
    """docs without near copies: of equal texts the row with the least doc_id stays, then of each component those unlike each other.

    Components link wide fingerprints (``copy_edges``). In the order of doc_id, a row of a component goes if the
    Jaccard similarity of its distinct shingles to those of a row before it that stays is ``similarity`` or more.
    So a chain of small changes doesn't take away what has become another text, and no two rows of a component
    that stay are as like as that. Null text is empty; all empty texts are equal. Rows with one doc_id and one
    text are one. A row without doc_id stays only if no row with one is like it. Empty table: no rows. Columns
    keep their names and values, whatever they are called.
    """
    bits = [f"f{j}" for j in range(WORDS)]
    rows = staged(fingerprints(docs, shingle, WORDS), "wide-fingerprints")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    texts = staged(rows.groupBy("key").agg(F.min(at).alias("at"), F.max(at).alias("last"), F.min(F.struct(*bits)).alias("f")).select("key", "at", "last", "f.*"), "texts")
    # a text with copies meets its rows in as many tasks as there are salts
    salt = F.array(*map(F.lit, range(SALTS)))
    copied = texts.where("at <> last").select("key", F.col("at.doc_id").alias("i"), F.explode(salt).alias("salt"))
    salted = rows.select("doc_id", "key", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(SALTS)).cast("int").alias("salt"))
    copies = salted.join(copied, ["key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "key").distinct()
    linked = staged(connected_components(copy_edges(texts.select("key", *bits), similarity, recall)), "linked")
    component = linked.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(linked.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())
    first = staged(texts.join(component, "key").select("at.doc_id", "key", "component", "at"), "first")
    twice = staged(rows.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "twice")
    once = twice.isEmpty()
    _, some = split_by_keys(docs, first, row_key(), [F.col("doc_id"), F.col("key")])
    own = some.alias("d").join(first.hint("merge").alias("g"), same_row("d", "g")).select("g.component", "g.key", "g.at", _words("d.text").alias("w"))
    own = own if once else own.dropDuplicates(["key"])
    like = _like_one_before(staged(own.select("component", "key", "at", _shingles("w", shingle).alias("own")), "shingles"), similarity)
    gone = staged(copies.unionByName(first.join(like, "key").select("doc_id", "key")), "gone")
    clean, some = split_by_keys(docs, gone, row_key(), [F.col("doc_id"), F.col("key")])
    left = clean.unionByName(some.alias("d").join(gone.hint("merge").alias("g"), same_row("d", "g"), "left_anti"))
    if once:
        return left
    name = free_name(docs, "key")
    one = left.alias("d").join(twice.alias("g"), same_row("d", "g"), "left_semi").withColumn(name, text_key()).dropDuplicates(["doc_id", name]).drop(name)
    return left.alias("d").join(twice.alias("g"), same_row("d", "g"), "left_anti").unionByName(one)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document.

    Null or empty text: fingerprint zero, linked like any other. A null doc_id gets the component of its
    fingerprint and names none; rows with one doc_id each get a row. Empty table: no rows.
    """
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
