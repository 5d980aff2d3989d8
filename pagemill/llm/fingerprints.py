"""Document fingerprints by consistent weighted sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

#: Samples of a fingerprint.
SAMPLES = 24
_NO_ID = -(1 << 63)


def weighted_terms(text: Column) -> Column:
    """Sorted hashes of the words of a text, repeats included."""
    return F.sort_array(F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)))


def _starts(terms: Column) -> Column:
    """Where a new term begins in sorted hashes."""
    return F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))


def _unit(x: Column, bits: int) -> Column:
    return (x + 0.5) / float(1 << bits)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th sample's race value of a weighted term, the term and its step in the low half; the least wins.

    r and c are Gamma(2, 1), beta uniform, all three functions of the term and k alone. With
    t = floor(ln w / r + beta) and y = exp(r (t - beta)), the term with the least a = c / (y e^r) is sampled with
    its t, and two weighted sets sample the same pair with the probability of their generalised Jaccard
    similarity. ln a is kept to 2**-25 in the high half; equal pairs have equal values.
    """
    x, y = F.xxhash64(term, F.lit(k)), F.xxhash64(term, F.lit(k), F.lit(1))
    r = -F.log(_unit(F.shiftrightunsigned(x, 43), 21) * _unit(F.shiftrightunsigned(x, 22).bitwiseAND((1 << 21) - 1), 21))
    beta = _unit(x.bitwiseAND((1 << 22) - 1), 22)
    c = -F.log(_unit(F.shiftrightunsigned(y, 32), 32) * _unit(y.bitwiseAND((1 << 32) - 1), 32))
    t = F.floor(log_weight / r + beta)
    log_a = F.log(c) - r * (t - beta + 1)
    race = F.least(F.greatest((log_a + 2048.0) * float(1 << 19), F.lit(0.0)), F.lit(float((1 << 31) - 1))).cast("long")
    pair = term.bitwiseXOR(t * 0x9E3779B1).bitwiseAND((1 << 32) - 1)
    return F.shiftleft(race, 32).bitwiseOR(pair)


def fingerprint(rows: DataFrame, keys: list[str], keep: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys, keep, s array<long>: a fingerprint for each value of keys, without a shuffle if rows are dealt by one of them.

    Rows with equal keys hold one text. keep: long columns that are equal in a key's rows. Terms are sorted and
    counted within their row; the least of each race is kept. A text without words has an array of zeros.
    """
    terms = rows.select(*keys, *keep, weighted_terms(F.col(text)).alias("terms"))
    begun = terms.withColumn("starts", F.when(F.size("terms") > 0, _starts(F.col("terms"))))
    each = F.transform("starts", lambda p, j: F.struct(F.get("terms", p).alias("term"), (F.coalesce(F.get("starts", j + 1), F.size("terms")) - p).alias("n")))
    flat = begun.select(*keys, *keep, F.explode_outer(each).alias("e")).select(*keys, *keep, F.col("e.term").alias("term"), F.log(F.col("e.n").cast("double")).alias("lw"))
    won = flat.groupBy(*keys).agg(*[F.min(c).alias(c) for c in keep], *[F.min(sample(F.col("term"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)])
    low = [F.coalesce(F.col(f"s{k}").bitwiseAND((1 << 32) - 1), F.lit(0)) for k in range(samples)]
    return won.select(*keys, *keep, F.array(*low).alias("s"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, ...) with distinct keys → + next struct of the row with the next key; after the last comes the first.

    Rows are dealt by range of key; only a row per range passes through one task.
    """
    columns = ids.columns
    dealt = staged(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "dealt")
    row = F.struct(*columns)
    first = dealt.groupBy("part").agg(F.min(row).alias("first"))
    parts = Window.orderBy("part")
    ring = first.select("part", F.coalesce(F.lead("first").over(parts), F.min("first").over(Window.partitionBy())).alias("after"))
    lead = dealt.withColumn("next", F.lead(row).over(Window.partitionBy("part").orderBy("key")))
    return lead.join(ring, "part").select(*columns, F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, own, edited, next: fingerprints of the text, its edit and the next document.

    A text is shuffled once, by doc_id, and the part of it that the document before needs once more; terms,
    samples and minima follow in the stage that joins them. Documents are distinct doc_ids, null first; if rows
    with one doc_id differ, the one with the least hash is the document that the one before gets.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), text.alias("text"), F.xxhash64(text).alias("d"))
    ids = staged(rows.groupBy("key", "d").agg(F.count(F.lit(1)).cast("int").alias("times"), F.max(F.char_length("text")).cast("long").alias("n_chars")), "ids")
    ring = staged(next_ids(ids.groupBy("key").agg(F.min("d").alias("d"), F.max("n_chars").alias("most"))), "ring")
    gives = ring.select(F.col("next.key").alias("key"), F.col("next.d").alias("first_d"), F.col("key").alias("to"), F.floor(F.col("most") / 2).cast("int").alias("need"))
    # d is compared without becoming a join key, so that both joins deal the texts by key and share one shuffle
    first = F.col("d").bitwiseXOR(F.col("first_d")) == 0
    heads = rows.join(gives, "key").where(first).select(F.col("to").alias("key"), F.substring("text", F.lit(1), F.col("need")).alias("head"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edit = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("head", F.lit(1), half))
    pair = rows.join(heads, "key").select("key", "d", "text", edit.alias("edit"))
    sha = F.sha2(F.col("edit"), 256)
    digest = [F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"h{i}") for i in range(5)]
    either = F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edit").alias("text")))
    both = pair.select("key", "d", *digest, F.explode(either).alias("e")).select("key", "d", *[f"h{i}" for i in range(5)], "e.which", "e.text")
    signed = staged(fingerprint(both, ["key", "d", "which"], [f"h{i}" for i in range(5)], samples=samples), "samples")
    own = signed.where("which = 0").select("key", "d", F.col("s").alias("own"))
    edited = signed.where("which = 1").select("key", "d", F.col("s").alias("edited"), *[f"h{i}" for i in range(5)])
    after = own.select(F.col("key").alias("nk"), F.col("d").alias("nd"), F.col("own").alias("next"))
    found = ids.join(own, ["key", "d"]).join(edited, ["key", "d"]).join(ring.select("key", F.col("next.key").alias("nk"), F.col("next.d").alias("nd")), "key").join(after, ["nk", "nd"])
    hexed = F.concat(*[F.lpad(F.lower(F.hex(f"h{i}")), 15 if i < 4 else 4, "0") for i in range(5)])
    return found.select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), "n_chars", hexed.alias("edited_sha256"), "own", "edited", "next", F.explode(F.array_repeat(F.lit(0), F.col("times")))
    ).drop("col")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document, of its edit by the next one, and how like they are.

    Null text: empty; two texts without words have likeness 1. A null doc_id comes first; rows with one doc_id
    each get a row. One document: it is its own next. Empty table: no rows.
    """
    found = edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
