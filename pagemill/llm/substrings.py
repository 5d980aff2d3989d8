"""Substring dedup: winnowed anchors seed repeated passages, runs and windows around them extend the seeds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, free_name, read_table, staged, utf8_list, word_codes

#: Words of a window, and of the seed that every window has.
WINDOW, SEED_WORDS = 50, 12
#: Bytes of text whose windows are held at once; each byte takes about 30 in a worker.
SLICE = 1 << 20
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any runs of words."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(up)[:n])])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length, np.uint64))


class Passages:
    """Windows, their anchors and runs of anchors of some texts, by position in the row of all their words."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, seed: int = SEED_WORDS):
        self.window = window
        self.count, codes, vocab = word_codes(texts)
        self.first = np.cumsum(self.count) - self.count
        hashes = [np.fromiter((xxhash.xxh64_intdigest(w, s) for w in vocab), np.uint64, len(vocab))[codes] if len(codes) else np.zeros(0, np.uint64) for s in (1, 2)]
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.one, self.two = (Rolling(h, b) for h, b in zip(hashes, _BASE, strict=True))
        #: starts of all windows
        n = len(codes) - window + 1
        self.starts = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(self.starts):
            self.run_at = self.run_len = self.starts
            self.anchor = self.key = np.zeros(0, np.uint64)
            return
        # the anchor of a window is its least seed, the last of equals
        seeds = self.one(np.arange(len(codes) - seed + 1), seed)
        place = np.arange(len(seeds), dtype=np.uint64)
        least = (seeds >> np.uint64(26) << np.uint64(26)) | (np.uint64((1 << 26) - 1) - place % np.uint64(1 << 26))
        span, width = window - seed + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])[self.starts]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(self.starts) != 1)])
        at = np.flatnonzero(new)
        self.run_at = self.starts[at]
        self.run_len = np.diff(np.append(at, len(least)))
        offset = (np.uint64((1 << 26) - 1) - (least[at] & np.uint64((1 << 26) - 1))).astype(np.int64)
        place_of = self.run_at + (offset - self.run_at) % (1 << 26)
        self.anchor = self.one(place_of, seed)
        self.key = self.two(self.run_at, self.run_len + window - 1)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of the chosen runs, and the run of each."""
        run = np.repeat(np.flatnonzero(chosen), self.run_len[chosen])
        base = np.cumsum(self.run_len[chosen]) - self.run_len[chosen]
        return self.run_at[run] + np.arange(len(run)) - np.repeat(base, self.run_len[chosen]), run


def _columns(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Positions of the first of equal rows."""
    order = np.lexsort(columns[::-1])
    same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    return order[np.concatenate([[True], ~same])] if len(order) else order


def _packed(docs: DataFrame) -> DataFrame:
    """docs with its texts compressed, for the shuffle; null text as empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                columns = part.columns
                columns[at] = pa.array([pack.compress(t) for t in utf8_list(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema))


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batch with their texts, about SLICE bytes each (a longer text stands alone)."""
    raw = zstandard.ZstdDecompressor()
    first, texts, held = 0, [], 0
    for i, t in enumerate(batch.column("text")):
        text = raw.decompress(t.as_py())
        if texts and held + len(text) > SLICE:
            yield batch.slice(first, i - first), texts
            first, texts, held = i, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield batch.slice(first), texts


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[DataFrame, DataFrame]:
    """What to remove: (doc_id, anchor, key) of whole runs, and (doc_id, anchor, key) of single windows.

    A window belongs to the least of its seeds; neighbouring windows with the same seed in one place are a run.
    Equal windows have equal anchors, so only runs whose anchor starts in two documents matter. Seeds extend
    both ways in two steps. A run whose words equal those of a run in an earlier document is covered as a whole.
    Of each other run every window is compared with those of all such runs: the earliest document of equal
    windows keeps them. A covered run's windows all lie in the run that covers it, so nothing is lost. Documents
    join documents through the hash of an anchor, run or window and the least doc_id of it, never in pairs.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                p = Passages(utf8_list(part.column("text")), window, seed)
                ids = np.asarray(part.column("doc_id").to_numpy(zero_copy_only=False))[p.doc[p.run_at]]
                one = _distinct(ids, p.anchor, p.key)
                yield _columns(doc_id=ids[one].astype(np.int64), anchor=p.anchor[one], key=p.key[one])

    every = staged(docs.select("doc_id", "text").mapInArrow(runs, "doc_id long, anchor long, key long"), "runs")
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    seeded = staged(every.join(staged(shared, "anchors"), "anchor").select("doc_id", "anchor", "key"), "seeded")
    first = staged(seeded.groupBy("anchor", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "first-runs")
    covered = seeded.join(first.where("first < last"), ["anchor", "key"]).where("doc_id > first").select("doc_id", "anchor", "key")

    # the rest: one row per document with its runs, to meet the text again
    lists = first.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("key").alias("keys"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _unpack(batch):
                p = Passages(texts, window, seed)
                want = part.column("keys")
                chosen = _member(p.doc[p.run_at], p.key, want)
                at, run = p.windows(chosen)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[p.doc[at]]
                anchor, key = p.anchor[run], p.two(at, window)
                one = _distinct(ids, anchor, key)
                yield _columns(doc_id=ids[one].astype(np.int64), anchor=anchor[one], key=key[one])

    texts = _packed(docs.select("doc_id", "text")).join(staged(lists, "run-lists"), "doc_id")
    single = staged(texts.mapInArrow(windows, "doc_id long, anchor long, key long"), "windows")
    earliest = staged(single.groupBy("anchor", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "first-windows")
    late = single.join(earliest, ["anchor", "key"]).where("doc_id > first").select("doc_id", "anchor", "key")
    return staged(covered, "covered"), staged(late, "late")


def _member(doc: np.ndarray, key: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each (doc, key) is in the list of its document."""
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(lists.values) else np.zeros(0, np.uint64)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lists)), lengths)
    values = values[offsets[0] : offsets[-1]]
    return np.isin(_mix(key ^ _mix(doc.astype(np.uint64) + np.uint64(1))), _mix(values ^ _mix(owner.astype(np.uint64) + np.uint64(1))))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, joined: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words kept, joined by one space), kept_sha256, rest for each row of docs.

    Unless ``joined``, kept is the text as it was where nothing is removed. rest: a struct of the other columns of docs. Windows with a null doc_id neither cover others nor are covered.
    Rows with one doc_id are one document's: none covers the other. Texts are shuffled twice, compressed; the
    rest is hashes of anchors.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))
    known = named.where("doc_id is not null")
    covered, late = repeated_windows(known, window, seed)
    marks = covered.select("doc_id", F.lit(0).alias("w"), "key").unionByName(late.select("doc_id", F.lit(1).alias("w"), "key"))
    lists = staged(marks.groupBy("doc_id").agg(F.collect_list(F.when(F.col("w") == 0, F.col("key"))).alias("runs"), F.collect_list(F.when(F.col("w") == 1, F.col("key"))).alias("windows")), "marks")
    empty = F.array().cast("array<long>")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _unpack(batch):
                yield _kept(part, texts, window, seed, joined)

    schema = f"doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, rest {named.schema['rest'].dataType.simpleString()}"
    marked = _packed(known).join(lists, "doc_id", "left").select("doc_id", "text", F.coalesce("runs", empty).alias("runs"), F.coalesce("windows", empty).alias("windows"), "rest")
    nameless = _packed(named.where("doc_id is null")).select("doc_id", "text", empty.alias("runs"), empty.alias("windows"), "rest")
    return marked.unionByName(nameless).mapInArrow(keep, schema)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated windows cut out of text, and n_chars counted again where text changed; other columns as they are.

    A text that loses nothing stays as it is, white space included.
    """
    name = free_name(docs, "text")
    found = dedup_substrings(docs.withColumn(name, F.col("text").isNull()), joined=False)
    changed = F.col("n_removed") > 0
    text = F.when(~F.col("rest")[name], F.col("kept"))
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return found.select(*[own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def _kept(part: pa.RecordBatch, texts: list[bytes], window: int, seed: int, joined: bool) -> pa.RecordBatch:
    marked = np.diff(part.column("runs").offsets.to_numpy()) + np.diff(part.column("windows").offsets.to_numpy()) > 0
    kept, total, removed = [], [], []
    some = [t if m else b"" for t, m in zip(texts, marked, strict=True)]
    p = Passages(some, window, seed) if marked.any() else None
    gone = np.zeros(len(p.doc) + 1, np.int32) if p else None
    if p:
        whole = _member(p.doc[p.run_at], p.key, part.column("runs"))
        np.add.at(gone, p.run_at[whole], 1)
        np.add.at(gone, p.run_at[whole] + p.run_len[whole] + window - 1, -1)
        at = p.starts
        hit = at[_member(p.doc[at], p.two(at, window), part.column("windows"))]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
    for i, t in enumerate(texts):
        words = t.split()
        total.append(len(words))
        if marked[i]:
            stay = ~gone[p.first[i] : p.first[i] + p.count[i]]
            removed.append(int(len(words) - stay.sum()))
            words = [words[j] for j in np.flatnonzero(stay)]
        else:
            removed.append(0)
        kept.append(b" ".join(words) if joined or removed[-1] else t)
    digest = [hashlib.sha256(k).hexdigest() for k in kept]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array(digest, pa.string()), part.column("rest")],
        ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "rest"],
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from each document, and the digest of those kept.

    Null or empty text, or under 50 words: nothing removed. Empty table: no rows.
    """
    return dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept", "rest")


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM late),
each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
"""
