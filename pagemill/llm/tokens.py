"""Token ids as a Parquet table: encode, write in document order, read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, new_path, read_table

#: Token lists are delta-encoded (data pages v2, no dictionary), small metadata columns keep dictionaries.
#: Small pages give the page index something to skip; row groups are sized for one task's memory.
FORMAT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#tokens.list.element": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Distinct words whose ids a Python worker keeps; the memory bound of its cache.
CACHE_WORDS = 800_000
#: Words encoded in one call; the library holds some 130 bytes a token while it does.
JOINED_WORDS = 16_384
#: Characters that begin a part of their own.
OWN_START = "\n.,"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Encoder:
    """Encodes a column of texts, each distinct word once.

    The byte-level pre-tokenizer starts a new piece at a space or newline that follows a character other than
    white space, and at a comma or point that follows a letter or digit, so the ids of the parts cut there,
    joined, are the ids of the whole. Texts where white space stands before a space or newline, or anything but
    a letter or digit before a comma or point, are encoded as a whole, and so are texts with one of the
    vocabulary's special strings. Words are cut, numbered and their ids gathered column-wise; the ids of up to CACHE_WORDS words stay.
    """

    _SPACE = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

    def __init__(self, path: str, end_id: int):
        import re

        self.tok = _tokenizer(path)
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"[{self._SPACE}][ \\n]", r"[^\pL\pN][.,]", *special])
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token)
        self.end = np.array([end_id], np.int32)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.ends, self.n_words = [self.end], [np.array([0, 1])], 1  # slot 0 is the end id

    def _put(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of the next slots, one after the other."""
        self.ids.append(ids)
        self.ends.append(ends + self.ends[-1][-1])
        self.n_words += len(ends)

    def _add(self, words: list[str]) -> None:
        """Ids of new words: many in one call, cut where the tokens' bytes add up to the words' bytes."""
        for k in range(0, len(words), JOINED_WORDS):
            part = words[k : k + JOINED_WORDS]
            ids = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int32)
            size = pc.binary_length(pa.array(part)).to_numpy().astype(np.int64)
            self.slot.update(zip(part, range(self.n_words, self.n_words + len(part)), strict=True))
            self._put(ids, np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size)) + 1)

    def _add_whole(self, texts: list[str]) -> range:
        """Slots of texts that are encoded one by one."""
        slots = range(self.n_words, self.n_words + len(texts))
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        if ids:
            self._put(np.array([i for x in ids for i in x], np.int32), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
        return slots

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False), bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        for mark in OWN_START:
            plain = pc.replace_substring(plain, mark, " " + mark)
        words = pc.split_pattern(plain, " ")
        coded = words.values.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        at = words.offsets.to_numpy()
        first = at[:-1]
        if self.n_words + 2 * len(names) > CACHE_WORDS:
            self.clear()
        # the first word of a text has no space before it, nor has one that begins with such a mark
        keys = [w if w[:1] in OWN_START and w else " " + w for w in names]
        heads = [names[c] for c in codes[first]]
        new = [k for k in keys if k not in self.slot]
        joined = [k for k in new if k[0] in " \n" and not k[-1:].isspace()]
        if joined:
            self._add(joined)
        # heads of texts, words that begin with a mark and words that end in white space stand by themselves
        alone = [*(k for k in new if k[0] not in " \n" or k[-1:].isspace()), *dict.fromkeys(h for h in heads if h and h not in self.slot)]
        self.slot.update(zip(alone, self._add_whole(alone), strict=True))
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))[codes]
        slots[first] = [self.slot[h] if h else -1 for h in heads]
        slots[first[odd]] = self._add_whole(texts.filter(pa.array(odd)).to_pylist())
        slots = np.insert(slots, at[1:], 0)
        empty = slots < 0
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate([self.ends[0], *(e for e in self.ends[1:])])]
        table = pa.LargeListArray.from_arrays(pa.array(self.ends[0]), pa.array(self.ids[0]))
        taken = table.take(pa.array(slots, mask=empty))
        offsets = taken.offsets.to_numpy()[np.concatenate([[0], at[1:] + np.arange(1, len(at))])]
        return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), taken.values.slice(offsets[0], offsets[-1] - offsets[0]))


@cache
def _encoder(path: str, end_id: int) -> _Encoder:
    return _Encoder(path, end_id)


def encode_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per document: id_col, n_tokens, tokens array<int> with end_id appended. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, end_id)
        for batch in batches:
            for part in byte_slices(batch, "text", 8 << 20):
                tokens = encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pc.cast(pc.list_value_length(tokens), pa.int64()), tokens], ["id", "n_tokens", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, tokens array<int>").withColumnRenamed("id", id_col)


def write_tokens(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode docs and write the token table in ascending id order (nulls first), one file per range of ids.

    ``part`` numbers the files in that order, so that file totals and positions in a file are enough to place
    each document. One shuffle: the texts, by range of ids.
    """
    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    encode_tokens(ordered, path, id_col, text_col, end_id).withColumn("part", F.spark_partition_id()).write.options(**FORMAT).parquet(out)


def read_tokens(spark: SparkSession, out: str, columns: list[str] | None = None, ids: tuple | None = None, id_col: str = "doc_id") -> DataFrame:
    """Columns of a token table, for a range of ids if given: column chunks, row groups and pages outside are skipped."""
    df = spark.read.parquet(out)
    if ids:
        df = df.where(F.col(id_col).between(*ids))
    return df.select(*(columns or [id_col, "n_tokens", "tokens"]))


def token_index(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before it), n_tokens, ids_crc32, all taken from the written files.

    Offsets are a sum over files (one row per file) plus a running sum within a file; no sort spans files.
    Rows that share an id follow each other in order of checksum.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], ["part", "id", "n_tokens", "ids_crc32"])

    table = spark.read.parquet(out)
    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select("part", F.col(id_col).alias("id"), "tokens").mapInArrow(digest, f"part int, id {kind}, n_tokens long, ids_crc32 long")
    files = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(before, "part")
        .select(F.col("id").alias(id_col), (F.col("before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
    )


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back: doc_id, start, n_tokens, ids_crc32.

    Null text: the end id alone. Empty table: no rows. Equal doc_ids: each row counts, in order of checksum.
    Columns of documents other than doc_id and text are not read.
    """
    out = new_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), out, tokenizer_file())
    return token_index(spark, out)
