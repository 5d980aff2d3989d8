"""Ranked lexical search: MaxScore whose bounds come from precomputed intersections of pairs of terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, new_path, read_table, staged, utf8_list, word_codes

TOP = 20
#: Items searched in one pass over the documents, and bytes of their texts, about.
BLOCK_ITEMS, BLOCK_BYTES = 1_000, 4 << 20
#: Documents of an index block at most, and cells of its table of terms and documents.
BLOCK_DOCS, BLOCK_CELLS = 1_024, 4 << 20
#: An item's terms in order of weight are paired with the next ones up to this distance.
PAIR_REACH = 2
#: Intersections of more than this share of a block's documents are kept as a maximum without the list.
LIST_SHARE = 1 / 16
#: Documents of an item's intersections that a block scores for the first threshold, about.
SEEDS = 64
#: Separators as spaces, A-Z lower-cased; bytes of other letters stay.
_TERMS = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class Item(NamedTuple):
    """A query: numbers of its distinct terms, how often it has each, its pairs' numbers and the places of their terms."""

    terms: np.ndarray
    times: np.ndarray
    pairs: np.ndarray
    ends: np.ndarray


class Queries:
    """The items of one pass: their vocabulary, and after ``weigh`` weights, pairs and corpus figures."""

    def __init__(self, texts: list[bytes]):
        self.counts = [Counter(terms_of(t)) for t in texts]
        self.vocab = {t: i for i, t in enumerate(sorted(set().union(*self.counts)))}

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.vocab))], np.int64)
        self.items, pairs = [], {}
        for counts in self.counts:
            known = [(self.vocab[t], c) for t, c in sorted(counts.items()) if df.get(self.vocab[t]) and self.weight[self.vocab[t]] > 0]
            known.sort(key=lambda x: (-self.weight[x[0]] * x[1], x[0]))
            ends = [(i, j) for i in range(len(known)) for j in range(i + 1, min(len(known), i + 1 + PAIR_REACH))]
            own = [pairs.setdefault((min(known[i][0], known[j][0]), max(known[i][0], known[j][0])), len(pairs)) for i, j in ends]
            self.items.append(Item(np.array([t for t, _ in known], np.int64), np.array([c for _, c in known], np.int64), np.array(own, np.int64), np.array(ends, np.int64).reshape(-1, 2)))
        self.pairs = np.array(list(pairs), np.int64).reshape(-1, 2)

    def impact(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each occurrence of a term in the query adds, for documents of n terms."""
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * self.n_docs) // self.n_terms)))


def term_counts(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), terms and tfs (those of the vocabulary, and how often each occurs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                n, codes, words = word_codes([t.translate(_TERMS) for t in utf8_list(part.column("text"))])
                known = np.fromiter((vocab.get(w, -1) for w in words), np.int64, len(words))
                ids = known[codes] if len(codes) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(n)), n)[ids >= 0]
                key, tf = np.unique(doc * max(1, len(vocab)) + ids[ids >= 0], return_counts=True)
                doc, term = np.divmod(key, max(1, len(vocab)))
                at = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(n)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Block:
    """Posting lists of some documents, by term: documents in ascending order, and what each list adds at most."""

    def __init__(self, queries: Queries, n: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray):
        """term, doc, tf: sorted by term and document."""
        self.doc, self.impact = doc, queries.impact(term, tf, n[doc])
        self.terms, self.start = np.unique(term, return_index=True)
        self.stop = np.append(self.start[1:], len(term))
        self.most = np.maximum.reduceat(self.impact, self.start) if len(term) else np.zeros(0, np.int64)
        self.row = np.full(len(queries.vocab) + 1, -1)
        self.row[self.terms] = np.arange(len(self.terms))
        self.table = np.zeros((len(self.terms), len(n)), np.int64)
        self.table[self.row[term], doc] = self.impact

    def intersect(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs that documents of the block hold: number, joint maximum, length of the list, and all lists in a row."""
        a, b = self.row[pairs[:, 0]], self.row[pairs[:, 1]]
        found = np.flatnonzero((a >= 0) & (b >= 0))
        a, b, size = a[found], b[found], self.stop - self.start
        rare, other = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        length = size[rare]
        if not len(found):
            return found, found, found, found
        at = np.repeat(self.start[rare] - np.cumsum(length) + length, length) + np.arange(length.sum())
        also = self.table[np.repeat(other, length), self.doc[at]]
        joint = np.where(also > 0, self.impact[at] + also, 0)
        first = np.cumsum(length) - length
        most, n = np.maximum.reduceat(joint, first), np.add.reduceat(also > 0, first, dtype=np.int64)
        stored = (n > 0) & (n <= max(1, LIST_SHARE * self.table.shape[1]))
        lists = self.doc[at][np.repeat(stored, length) & (also > 0)]
        held = n > 0
        return found[held], most[held], np.where(stored, n, 0)[held], lists

    def score(self, item: Item, docs: np.ndarray) -> np.ndarray:
        row = self.row[item.terms]
        return (item.times[row >= 0, None] * self.table[row[row >= 0]][:, docs]).sum(axis=0)


class Best:
    """The highest scores of each item so far, and the threshold that they set."""

    def __init__(self, n: int, start: np.ndarray | None = None, top: int = TOP):
        self.top, self.low = top, np.ones(n, np.int64) if start is None else np.maximum(start, 1)
        self.score, self.doc = [np.zeros(0, np.int64)] * n, [pa.nulls(0)] * n

    def add(self, i: int, score: np.ndarray, doc: pa.Array) -> None:
        ids = doc if isinstance(self.doc[i], pa.NullArray) else pa.concat_arrays([self.doc[i], doc])
        score = np.concatenate([self.score[i], score])
        order = pa.RecordBatch.from_arrays([pa.array(-score), ids], ["s", "d"]).sort_by([("s", "ascending"), ("d", "ascending")]) if len(score) else None
        if order is not None:
            self.score[i], self.doc[i] = -order.column("s").to_numpy()[: self.top], order.column("d")[: self.top]
            if len(self.score[i]) == self.top:
                self.low[i] = max(self.low[i], self.score[i][-1])


def pair_bounds(item: Item, most: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the item's terms by what they add at most, and what documents with only the first 1, 2 … of them reach at most.

    most: maximum of each term (0: not in the block); joint: of each pair of the item, over documents with both.
    A document has both terms of a pair, or one of them, so the pair adds the largest of the joint maximum and the
    two alone. Pairs without a common term are combined, those first that save most against the sum of their maxima.
    """
    alone = item.times * most
    order = np.argsort(alone, kind="stable")
    steps = alone[order]
    if len(item.ends):
        i, j = item.ends[:, 0], item.ends[:, 1]
        both = np.minimum(item.times[i], item.times[j])
        highest = np.maximum(joint, np.maximum(most[i], most[j]))
        saved = both * (most[i] + most[j] - highest)
        place = np.argsort(order)
        free = np.ones(len(most), bool)
        for p in np.argsort(-saved, kind="stable"):
            if saved[p] <= 0:
                break
            if free[i[p]] and free[j[p]]:
                free[i[p]] = free[j[p]] = False
                steps[max(place[i[p]], place[j[p]])] -= saved[p]
    return order, np.cumsum(steps)


def search_block(block: Block, item: Item, joint: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block that reach the threshold, and their scores. joint: maximum of each of the item's pairs."""
    none = np.zeros(0, np.int64)
    row = block.row[item.terms]
    most = np.where(row >= 0, block.most[row] if len(block.most) else 0, 0)
    order, bound = pair_bounds(item, most, joint)
    spare = int(np.searchsorted(bound, low))  # the first terms, which alone don't reach the threshold
    if spare == len(order):
        return none, none
    score = np.zeros(block.table.shape[1], np.int64)
    for t in order[spare:]:
        own = slice(block.start[row[t]], block.stop[row[t]])
        score[block.doc[own]] += item.times[t] * block.impact[own]
    docs = np.flatnonzero((score > 0) & (score + (bound[spare - 1] if spare else 0) >= low))
    score = score[docs]
    for k in range(spare - 1, -1, -1):
        if not len(docs):
            break
        if row[order[k]] >= 0:
            score += item.times[order[k]] * block.table[row[order[k]], docs]
        stay = score + (bound[k - 1] if k else 0) >= low
        docs, score = docs[stay], score[stay]
    return docs, score


_INDEX = "docs array<{kind}>, n array<long>, size array<int>, terms array<int>, doc array<int>, tf array<int>, pairs array<int>, joint array<long>, listed array<int>, lists array<int>, seed_item array<int>, seed array<long>"


def build_index(counts: DataFrame, queries: Queries) -> DataFrame:
    """A row per block of documents: posting lists, pair intersections with joint maxima, and scores of some of their documents."""
    size = max(1, min(BLOCK_DOCS, BLOCK_CELLS // max(1, len(queries.vocab))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.items))
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                yield _indexed(batch.slice(i, size), queries, best)

    return counts.mapInArrow(run, _INDEX.format(kind=counts.schema["doc_id"].dataType.simpleString()))


def _indexed(part: pa.RecordBatch, queries: Queries, best: Best) -> pa.RecordBatch:
    n = part.column("n").to_numpy()
    doc = np.repeat(np.arange(len(n)), part.column("terms").value_lengths().to_numpy())
    term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
    order = np.lexsort((doc, term))
    order = order[queries.weight[term[order]] > 0]
    doc, term, tf = doc[order], term[order], tf[order]
    block = Block(queries, n, term, doc, tf)
    pairs, joint, listed, lists = block.intersect(queries.pairs)
    at = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))
    first = np.cumsum(listed) - listed
    seed_item, seed = [], []
    for i, item in enumerate(queries.items):
        own = [at[p] for p in item.pairs.tolist() if p in at]
        some = np.zeros(0, np.int64)
        for p in sorted((p for p in own if listed[p]), key=lambda p: -joint[p]):
            some = np.union1d(some, lists[first[p] : first[p] + listed[p]])
            if len(some) >= SEEDS:
                break
        if len(some):
            score = block.score(item, some)
            new = np.sort(score[score >= best.low[i]])[::-1][:TOP]
            best.add(i, new, pa.nulls(len(new), pa.int64()))
            seed_item += [i] * len(new)
            seed.append(new)
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    sizes = block.stop - block.start
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")), one(n, pa.int64()), one(sizes.astype(np.int32), pa.int32()), one(block.terms.astype(np.int32), pa.int32()),
            one(doc.astype(np.int32), pa.int32()), one(tf.astype(np.int32), pa.int32()), one(pairs.astype(np.int32), pa.int32()), one(joint, pa.int64()), one(listed.astype(np.int32), pa.int32()),
            one(lists.astype(np.int32), pa.int32()), one(seed_item, pa.int32()), one(np.concatenate(seed) if seed else [], pa.int64()),
        ],
        ["docs", "n", "size", "terms", "doc", "tf", "pairs", "joint", "listed", "lists", "seed_item", "seed"],
    )


def search_index(index: DataFrame, queries: Queries, kind: str, top: int = TOP) -> DataFrame:
    """(item, doc_id, score) of documents that may be among the ``top`` of an item: all of these, and few others."""
    seeds = index.select(F.explode(F.arrays_zip("seed_item", "seed")).alias("s")).select("s.*")
    ranked = seeds.withColumn("i", F.row_number().over(Window.partitionBy("seed_item").orderBy(F.desc("seed")))).where(F.col("i") == top)
    start = np.ones(len(queries.items), np.int64)
    for r in ranked.collect():
        start[r.seed_item] = r.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.items), start, top)
        for batch in batches:
            for b in range(batch.num_rows):
                take = lambda c: batch.column(c)[b].values  # noqa: B023, E731
                terms, size = (take(c).to_numpy().astype(np.int64) for c in ("terms", "size"))
                doc, tf = (take(c).to_numpy().astype(np.int64) for c in ("doc", "tf"))
                block = Block(queries, take("n").to_numpy(), np.repeat(terms, size), doc, tf)
                joint = np.zeros(len(queries.pairs), np.int64)
                joint[take("pairs").to_numpy()] = take("joint").to_numpy()
                for i, item in enumerate(queries.items):
                    if len(item.terms):
                        docs, score = search_block(block, item, joint[item.pairs], int(best.low[i]))
                        if len(docs):
                            best.add(i, score, take("docs").take(pa.array(docs)))
        for i, (score, doc) in enumerate(zip(best.score, best.doc, strict=True)):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), doc, pa.array(score)], ["item", "doc_id", "score"])

    return index.select("docs", "n", "size", "terms", "doc", "tf", "pairs", "joint").mapInArrow(run, f"item int, doc_id {kind}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the documents of the ``top`` highest scores above 0 of each item; ties to the smaller doc_id.

    Items are searched in blocks of about BLOCK_ITEMS, each of which reads the documents twice: once for the
    counts of its terms, from which the corpus figures follow, and once, as an index of blocks, for the search.
    Thresholds start at the ``top``-th best score of documents found in pair intersections, so no document that
    belongs in the result is skipped. Null text has no terms. Rows with one doc_id are documents each; a null
    doc_id ranks last among ties. Of rows with one item_id the one with the least text counts. Without items or
    without documents: no rows.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    items = items.groupBy("item_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(size[0] / BLOCK_ITEMS), math.ceil(size[1] / BLOCK_BYTES))
    path, schema = new_path(spark, "ranked"), f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind}, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect(), key=lambda r: (r.item_id is None, r.item_id))
        queries = Queries([r.text.encode() for r in rows])
        if not queries.vocab:
            continue
        counts = staged(term_counts(docs, queries.vocab), "term-counts")
        total = counts.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total[0]:
            continue
        df = {r.term: r["count"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        queries.weigh(df, *total)
        index = staged(build_index(counts, queries), "pair-index")
        found = search_index(index, queries, kind, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, {schema.split(',')[0]}")
        ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item (``rank_documents``)."""
    return rank_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM doc_terms WHERE t IN (SELECT t FROM item_terms) GROUP BY doc_id, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, corpus GROUP BY t, docs),
impacts AS (
  SELECT f.doc_id, f.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))) AS impact
  FROM tfs f JOIN weights USING (t) JOIN lengths l ON l.doc_id = f.doc_id, corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
  FROM (SELECT item_id, t, count(*) AS times FROM item_terms GROUP BY item_id, t) JOIN impacts USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
