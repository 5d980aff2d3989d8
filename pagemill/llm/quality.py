"""Quality rules: base counts, and divergence of a document's histograms from language references."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, read_table, same_row, staged, text_key, utf8_list, word_codes

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "en": "the of and to in a is that it was for on are as with be at by this from or an not have",
    "es": "el la de que y en un los se del las por con una su para es al lo como más o pero le",
    "fr": "le la de et les des en un une du que est pour dans qui sur par au ne se pas plus il ce",
}
CLASSES = ("lower", "upper", "digit", "space", "newline", "point", "symbol", "other")
SYMBOLS = "#*$%&|<>"
#: A histogram is compared only if it holds so many characters or words.
MIN_CHARS, MIN_WORDS = 200, 60
#: Largest Jensen-Shannon distance (square root, base 2: 0 to 1) from the nearest language reference.
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.18, 0.30
MIN_TOTAL_WORDS, MAX_REPEAT_PERCENT = 10, 20


@cache
def _class_table() -> np.ndarray:
    """The class of each code point of the basic plane; the last entry is that of all others."""
    def of(c: str) -> int:
        kind = unicodedata.category(c)
        if c == "\n":
            return 4
        if c.isspace():
            return 3
        if c in SYMBOLS or kind[0] == "S":
            return 6
        return {"Ll": 0, "Lo": 0, "Lm": 0, "Lu": 1, "Lt": 1}.get(kind, 2 if kind[0] == "N" else 5 if kind[0] == "P" else 7)

    return np.array([of(chr(i)) for i in range(0x10000)] + [7], np.uint8)


def _vocabulary(words: dict[str, str]) -> dict[bytes, list[int]]:
    """Place in the word histogram of each common word: each language has its own bins, the last is for the rest."""
    at: dict[bytes, list[int]] = {}
    for i, lang in enumerate(sorted(words)):
        for j, w in enumerate(words[lang].split()):
            at.setdefault(w.encode(), []).append((i, j))
    return at


def measure(docs: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """Base counts, character classes, and counts of each language's common words, in one pass over whole texts.

    doc_id, key (hash of the text), lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars array<int>, common
    array<array<int>> (a histogram for each language of ``words``, rest last). Null text: all zero. Windows of
    five words are compared by word, not by hash: pairs of codes are numbered, then pairs of pairs.
    """
    words = words or COMMON_WORDS
    langs = sorted(words)
    width = [len(words[k].split()) + 1 for k in langs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, place = _class_table(), _vocabulary(words)
        symbol = np.frombuffer(SYMBOLS.encode(), np.uint8)
        is_symbol = np.isin(np.arange(0x10001), symbol)
        is_space = np.isin(np.arange(0x10001), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                texts = utf8_list(part.column("text"))
                n = len(texts)
                count, codes, vocab = word_codes(texts)
                doc = np.repeat(np.arange(n), count)
                repeat = _repeated(codes, doc, n)
                chars = np.zeros((n, len(CLASSES)), np.int32)
                symbols, inside, dup = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i, t in enumerate(texts):
                    points = np.minimum(np.frombuffer(t.decode().encode("utf-32-le"), np.uint32), 0x10000)
                    chars[i] = np.bincount(table[points], minlength=len(CLASSES))
                    symbols[i] = np.count_nonzero(is_symbol[points])
                    inside[i] = len(points) - np.count_nonzero(is_space[points])
                    lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                    dup[i] = len(lines) - len(set(lines))
                bins = [np.zeros((n, w), np.int32) for w in width]
                low = [place.get(w.decode().lower().strip(".,;:!?\"'()").encode(), ()) for w in vocab]
                for k, w in enumerate(width):
                    bin_of = np.array([next((j for i, j in x if i == k), w - 1) for x in low] or [0], np.int64)
                    if len(codes):
                        bins[k] = np.bincount(doc * w + bin_of[codes], minlength=n * w).reshape(n, w).astype(np.int32)
                common = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * len(langs)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.tile(width, n))]).astype(np.int32)), pa.array(np.concatenate(bins, axis=1).reshape(-1))),
                )
                hist = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(CLASSES)), pa.array(chars.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), part.column("lang"), *map(pa.array, (count, inside, symbols, dup, repeat)), hist, common],
                    ["doc_id", "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "lang", "text").mapInArrow(
        run, f"doc_id {kind}, key long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, common array<array<int>>"
    )


def _repeated(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each document that lie in a window of five words found twice or more in it."""
    m = len(codes) - 4
    if m < 1:
        return np.zeros(n, np.int64)
    top = int(codes.max()) + 1
    two = pd.factorize(codes[:-1] * top + codes[1:])[0].astype(np.int64)
    four = pd.factorize(two[:-2] * (int(two.max()) + 1) + two[2:])[0].astype(np.int64)
    five = pd.factorize(four[:m] * top + codes[4:])[0].astype(np.int64)
    start = np.flatnonzero(doc[:m] == doc[4:])
    window, _ = pd.factorize(five[start] * n + doc[start])
    twice = start[np.bincount(window)[window] > 1] if len(start) else start
    edge = np.zeros(len(codes) + 1, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n).astype(np.int64)


def _share(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    return F.transform(hist, lambda x: x / F.greatest(total, F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares."""
    half = F.zip_with(
        p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)
    )
    return F.sqrt(F.greatest(F.aggregate(half, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def language_references(measured: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """Mean histograms of each language over all documents of it that are long enough: lang, chars, common.

    Each document weighs the same, so that neither long texts nor one source's copies of long texts set the
    reference. At most one row per language of ``words``; a language without such a document has none.
    """
    langs = sorted(words or COMMON_WORDS)
    index = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
    long = measured.where(F.col("lang").isin(langs) & (F.col("n_words") >= MIN_WORDS) & ~base_failed())
    shares = long.select("lang", _share(F.col("chars")).alias("c"), _share(F.element_at("common", index)).alias("w"))
    width = max(len((words or COMMON_WORDS)[k].split()) for k in langs) + 1
    means = shares.groupBy("lang").agg(
        F.array(*[F.avg(F.col("c")[i]) for i in range(len(CLASSES))]).alias("chars"), F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(width)]).alias("common")
    )
    return means.select("lang", "chars", F.array_compact("common").alias("common"), (F.array_position(F.array(*map(F.lit, langs)), F.col("lang"))).cast("int").alias("i"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_TOTAL_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(measured: DataFrame, references: DataFrame, max_chars: float = MAX_CHARS_DISTANCE, max_words: float = MAX_WORDS_DISTANCE) -> DataFrame:
    """measured + chars_distance, words_distance, base_failed, kept.

    The distance is that of the language whose reference is nearest in characters and words together. A document
    is rejected if its characters, or its common words, are too far from it; a histogram below the minimum
    length isn't compared, and without any reference nothing is. references: a row per language of the word lists
    at most, so they are collected and stand in the expression.
    """
    rows = sorted(references.collect(), key=lambda r: r["i"])
    refs = F.array(*[F.struct(F.lit(r["i"]).alias("i"), F.array(*map(F.lit, r["chars"])).alias("chars"), F.array(*map(F.lit, r["common"])).alias("common")) for r in rows])
    each = F.transform(refs, lambda r: F.struct(js_distance(F.col("c"), r["chars"]).alias("chars"), js_distance(_share(F.element_at("common", r["i"])), r["common"]).alias("words")))
    pair = F.transform(each, lambda p: F.struct((p["chars"] + p["words"]).alias("both"), p["chars"].alias("chars"), p["words"].alias("words")))
    nearest = F.array_min(pair) if rows else F.lit(None).cast("struct<both: double, chars: double, words: double>")
    near = measured.withColumn("c", _share(F.col("chars"))).withColumn("near", nearest)
    n_chars = F.aggregate("chars", F.lit(0), lambda a, x: a + x)
    far = ((n_chars >= MIN_CHARS) & (F.coalesce("near.chars", F.lit(0.0)) > max_chars)) | ((F.col("n_words") >= MIN_WORDS) & (F.coalesce("near.words", F.lit(0.0)) > max_words))
    return near.select(
        *measured.columns, F.col("near.chars").alias("chars_distance"), F.col("near.words").alias("words_distance"), base_failed().alias("base_failed"), (~base_failed() & ~far).alias("kept")
    )


def score_quality(docs: DataFrame) -> DataFrame:
    measured = staged(measure(docs), "quality")
    return judge(measured, staged(language_references(measured), "quality-references"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, columns and rows as they are."""
    good = staged(score_quality(docs).where("kept").select("doc_id", "key").distinct(), "good")
    return docs.alias("d").join(good.alias("g"), same_row("d", "g"), "left_semi")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each document.

    Null or empty text: no words, base_failed. Null language: judged like any other, but part of no reference.
    Rows with one doc_id each get a row. Empty table: no rows.
    """
    scored = score_quality(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "words_distance")
