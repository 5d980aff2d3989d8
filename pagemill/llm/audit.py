"""Filter interaction audit: which filters remove the same documents, in every order of applying them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, read_table, split_by_keys, staged, text_key, utf8_list

#: The filters; each has the bit of its place.
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))


def text_failures(text: bytes, n_chars: int) -> int:
    """Bits of A (few words), B (few distinct words), C (many capitals) and D (a symbol)."""
    words = text.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > MAX_CAPITALS_PERCENT * n_chars) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), part (source, null as empty) and mask of the conditions on the text alone, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                n_chars = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_pylist()
                masks = np.fromiter(map(text_failures, utf8_list(part.column("text")), n_chars), np.int32, part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "part")), pa.array(masks)], ["doc_id", "key", "part", "mask"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("key"), F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, key long, part string, mask int")


def repeated_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (doc_id, key, part) of docs whose text a smaller doc_id has too.

    known: (doc_id, key) of all rows. Only texts whose hash occurs under two ids are moved. The first id of each
    text is found by a partial aggregation, so a text with many copies meets one row, not its copies; the copies
    themselves are on the side of the semi-join that Spark can split.
    """
    shared = staged(known.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"), "shared-texts")
    _, some = split_by_keys(docs, shared, [text_key()], [F.col("key")])
    rows = some.select("doc_id", text_key().alias("key"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    first = rows.groupBy("key", "text").agg(F.min("doc_id").alias("first"))
    same = (F.col("r.key") == F.col("f.key")) & (F.col("r.text") == F.col("f.text")) & (F.col("f.first") < F.col("r.doc_id"))
    return rows.alias("r").join(first.hint("merge").alias("f"), same, "left_semi").select("doc_id", "key", "part")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask → n documents, good and toxic ones among them."""
    own = staged(failures(docs), "failures")
    again = repeated_texts(docs, own.select("doc_id", "key"))
    bits = own.withColumn("n", F.lit(1)).unionByName(again.withColumns({"mask": F.lit(1 << FILTERS.index("E")), "n": F.lit(0)}))
    rows = bits.groupBy("doc_id", "key", "part").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(known, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.coalesce(c, F.lit(0))), F.lit(0))
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def _steps() -> Column:
    """All steps of all orders: the order, the step, its filter's bit and the bits of the filters before it."""
    found = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            found.append(F.struct(F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*found)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part's documents are first counted by their combination of failures, 32 at most, so the orders are counted
    on those. In shapley, a document that fails k filters is removed by each of them in 120 / k orders.
    Null text is empty; a null source is the part of an empty name; a null doc_id repeats none and none repeats
    it; rows with one doc_id are documents each and repeat each other's text in no way; a doc_id with several
    labels is good or toxic if one says so. No documents: no rows. Other columns don't matter.
    """
    counted = combinations(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("all"))
    each = counted.select("part", "all", F.explode(_steps()).alias("s")).select("part", "all", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(measure: str, cond) -> Column:
        return F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(cond(x["mask"]), x[measure]).otherwise(0))

    removed = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    orders = F.lit(120)
    return each.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(bit) != 0, x["n"] * (orders / F.greatest(F.bit_count(x["mask"]), F.lit(1))).cast("long")).otherwise(0)).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents (``audit_filters``)."""
    return audit_filters(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), read_table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
masks AS (
  SELECT part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
         + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first < doc_id, false) AS INT) AS mask,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND toxic = 1) AS toxic
  FROM words JOIN firsts USING (t)),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
found AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN mask & (bit | coalesce(before, 0)::INT) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM found
"""
