"""Mix sources to target weights by nested hash thresholds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, free_name, read_table, staged

#: Bits of each histogram level; two levels single out one 16,777,216th of a source.
BITS = 12
#: Bits of the hash that orders the documents of a source.
HASH_BITS = 60


def order_hash(key: Column) -> Column:
    """60 bits of MD5 of the key's text: the order in which a source's documents are taken."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) → + weight, target.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. No target
    exceeds cap times its source: with sources in order of cap * size / weight, those before the first whose
    share fits are capped and the rest share what is left by weight, which is what resharing the excess again
    and again ends in. One row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    w = sizes.withColumn("rank", rank).withColumn("weight", choose).withColumn("limit", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    every = Window.partitionBy()
    level = (
        w.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("share", F.col("left") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("fits", F.when(F.col("share") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "rank", "share")))
        .withColumn("share", F.min("fits").over(every)["share"])
    )
    target = F.least("limit", F.col("weight") * F.coalesce("share", F.lit(0.0)))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _boundary(hist: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The first bucket of each key whose sizes no longer fit the budget, with what is left of the budget before it."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    run = hist.withColumn("upto", F.sum("n").over(w))
    over = run.where(F.col("upto") > F.col("budget"))
    first = over.withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select(*keys, bucket, (F.col("budget") - F.col("upto") + F.col("n")).alias("budget"))


def mix_thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: copies that every document gets, and the hash up to which documents get one more.

    rows: source, size, u. A histogram of sizes over the first 12 bits of u finds the boundary bucket of the
    remaining budget; only that bucket is refined by 12 more bits, and only the boundary bucket of that by
    document. A document at the boundary is taken if more than half of it fits. Documents with equal ids have
    equal hashes and are taken together.
    """
    low = HASH_BITS - BITS
    rows = rows.withColumn("b1", F.shiftright("u", low)).withColumn("b2", F.shiftright("u", low - BITS).bitwiseAND((1 << BITS) - 1))
    budget = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    budget = budget.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))

    def refine(part: DataFrame, known: DataFrame, keys: list[str], bucket: str) -> DataFrame:
        on = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        hist = part.groupBy(*keys, bucket).agg(F.sum("size").alias("n"))
        return hist.alias("r").join(known.alias("k"), on).select(*[f"r.{k}" for k in keys], f"r.{bucket}", "r.n", "k.budget")

    def inside(known: DataFrame, keys: list[str]) -> DataFrame:
        on = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        return rows.alias("r").join(known.alias("k"), on, "left_semi")

    first = _boundary(refine(rows, budget, ["source"], "b1"), ["source"], "b1")
    first = staged(first, "mix-bucket")
    second = _boundary(refine(inside(first, ["source", "b1"]), first, ["source", "b1"], "b2"), ["source", "b1"], "b2")
    second = staged(second, "mix-bucket")
    keys = ["source", "b1", "b2"]
    docs = refine(inside(second, keys), second, keys, "u")
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("u"))
    last = docs.withColumn("fits", upto - F.col("n") / 2 <= F.col("budget")).groupBy(*keys).agg(F.max(F.when(F.col("fits"), F.col("u"))).alias("u"))
    start = F.shiftleft("b1", low) + F.shiftleft("b2", low - BITS)
    bound = last.select("source", F.coalesce("u", start - 1).alias("threshold"))
    return (
        budget.alias("s")
        .join(bound.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
        .select("s.source", "s.source_size", "s.target", "s.copies", F.coalesce("t.threshold", F.lit(-1).cast("long")).alias("threshold"))
    )


#: Sources up to which the plan, one row each, is sent to every task instead of shuffling documents by source.
BROADCAST_SOURCES = 100_000


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """rows: source, size, u, a written table → source, source_size, target, copies, threshold.

    rows are read once for the totals and three times for histograms. No row is sorted but those of one bucket
    in 16,777,216, and no source passes through one task.
    """
    totals = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = staged(mix_thresholds(rows.select("source", "size", "u"), staged(source_targets(totals, weights, cap), "mix-targets")), "mix-plan")
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _taken(u: Column) -> Column:
    return F.col("p.copies") + F.when(u <= F.col("p.threshold"), 1).otherwise(0)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and the order hash of each document, written once."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_RE)).cast("long")
    return staged(docs.select("doc_id", "source", size.alias("size"), order_hash(F.col("doc_id")).alias("u")), "mix-sizes")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The documents that the mix takes, each as many times as it takes them, with the columns of docs.

    A document's copies follow from its source and the hash of its id alone, so docs joins the plan, one row
    per source, and no text is shuffled for it.
    """
    plan = mix_plan(sized(docs), weights, cap)
    names = [f"d.{c}" for c in docs.columns]
    name, copies = free_name(docs, "copy"), F.array_repeat(F.lit(0), _taken(order_hash(F.col("d.doc_id"))))
    return docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(*names, F.explode(copies).alias(name)).drop(name)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document: doc_id, size, source_size, target, taken.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last. Null doc_id: the hash of
    an empty text. Rows with one doc_id get the same number of copies. Empty table: no rows.
    """
    rows = sized(read_table(spark, sf_dir, "documents"))
    mixed = rows.alias("r").join(mix_plan(rows).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return mixed.select("r.doc_id", "r.size", "p.source_size", F.round("p.target", 6).alias("target"), (F.col("r.size") * _taken(F.col("r.u"))).alias("taken"))


OP2_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS u
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sizes GROUP BY source),
-- resharing: each round gives the free sources their shares and caps those above three times their size
rounds AS (
  SELECT 0 AS i, source, source_size, weight, false AS capped, sum(source_size) OVER () AS total FROM totals
  UNION ALL
  SELECT i + 1, source, source_size, weight,
         capped OR weight * greatest(total - coalesce(sum(3.0 * source_size) FILTER (capped) OVER (), 0), 0)
                   / nullif(sum(weight) FILTER (NOT capped) OVER (), 0) > 3.0 * source_size, total
  FROM rounds WHERE i < (SELECT count(*) FROM totals)),
final AS (SELECT * FROM rounds WHERE i = (SELECT max(i) FROM rounds)),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN 3.0 * source_size
              ELSE weight * (total - coalesce(sum(3.0 * source_size) FILTER (capped) OVER (), 0))
                   / sum(weight) FILTER (NOT capped) OVER () END AS target
  FROM final),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM targets),
ranked AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.copies, s.u,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u RANGE UNBOUNDED PRECEDING)
         - sum(s.size) OVER (PARTITION BY s.source, s.u) / 2.0 AS middle,
         b.target - b.copies * b.source_size AS budget
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(size * (copies + CASE WHEN middle <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
