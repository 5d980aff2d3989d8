r"""Chat formatting: whole conversations as one text with a loss mask, built by columnar byte assembly.

The template of a turn is ``<turn>role`` + newline + text + ``</turn>`` + newline. In roles and texts every
backslash becomes two and ``<turn`` and ``</turn`` get a backslash before them; in roles a newline becomes
``\n``. So a mark that is not preceded by a backslash is a turn's own, and the escape is undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, new_path, read_table

OPEN, BETWEEN, CLOSE = b"<turn>", b"\n", b"</turn>\n"
_TURN = re.compile(r"<turn>((?:[^\\\n]+|\\.)*)\n((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Bytes of formatted text assembled at once.
BLOCK = 4 << 20


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    for plain, safe in ((("\\", "\\\\"), ("<turn", "\\<turn"), ("</turn", "\\</turn")) + ((("\n", "\\n"),) if role else ())):
        column = pc.replace_substring(column, plain, safe)
    return column


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and code-point span of the escaped text of each turn."""
    return [(unescape(m[1], True), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and offsets into them."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def assemble(columns: list[pa.Array | bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the columns row by row: one preallocated byte buffer and the offset of each row.

    Lengths of all segments give cumulative offsets; then, column by column, the index of each source byte
    plus the distance to its place is the place it is scattered to.
    """
    parts = [(np.frombuffer(c, np.uint8), None) if isinstance(c, bytes) else _buffer(c) for c in columns]
    lengths = np.stack([np.full(rows, len(d)) if o is None else np.diff(o) for d, o in parts], axis=1) if rows else np.zeros((0, len(parts)), np.int64)
    ends = np.cumsum(lengths.reshape(-1)).reshape(lengths.shape)
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    starts = ends - lengths
    for j, (data, offsets) in enumerate(parts):
        if offsets is None:
            out[(starts[:, j, None] + np.arange(len(data))).reshape(-1)] = np.tile(data, rows)
        else:
            n = lengths[:, j]
            out[np.arange(offsets[0], offsets[-1]) + np.repeat(starts[:, j] - offsets[:-1], n)] = data[offsets[0] : offsets[-1]]
    return out, np.concatenate([[0], ends[:, -1]]) if rows else np.zeros(1, np.int64)


def _format(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole conversations (sorted by id, turn) → one row each."""
    n = batch.num_rows
    role, text = (pc.fill_null(batch.column(c), "") for c in ("role", "text"))
    roles, texts = escape(role, True), escape(text)
    data, at = assemble([OPEN, roles, BETWEEN, texts, CLOSE], n)
    first = np.flatnonzero(_first(batch.column("conv_id")))
    ends = np.append(first[1:], n)
    # code points before and in each turn's text, for the loss mask
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    head = len(OPEN) + pc.utf8_length(roles).to_numpy(zero_copy_only=False).astype(np.int64) + len(BETWEEN)
    turn = head + chars + len(CLOSE)
    before = np.cumsum(turn) - turn
    start = before - np.repeat(before[first], ends - first) + head
    learn = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(learn)])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at[np.append(first, n)].astype(np.int64)), pa.py_buffer(data))
    spans = pa.StructArray.from_arrays([pa.array(start[learn]), pa.array((start + chars)[learn])], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(upto[np.append(first, n)].astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(first)), formatted.cast(pa.string()), loss], ["conv_id", "formatted", "loss"])


def _first(ids: pa.Array) -> np.ndarray:
    """Where a row's conversation differs from that of the row before."""
    codes = pc.fill_null(pc.rank(ids, tiebreaker="min"), 0).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0)
    return np.concatenate([[True], codes[1:] != codes[:-1]])[: len(ids)]


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) → conv_id, formatted, loss array<struct<start,end>>.

    loss holds the code-point spans of assistant texts in ``formatted``. One shuffle, by conversation; a task
    keeps the rows of the conversation that it is reading and at most a block of finished ones. Turns with the
    same number follow each other by role and text. Null role, text: empty. Null conv_id: one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in byte_slices(batch, "text", BLOCK):
                new = np.flatnonzero(_first(part.column("conv_id")))
                same = bool(held) and held[-1].column("conv_id")[-1].as_py() == part.column("conv_id")[0].as_py()
                if not same and held:
                    yield _format(_joined(held))
                    held = []
                last = int(new[-1])
                if last:  # all but the last conversation are complete
                    yield _format(_joined([*held, part.slice(0, last)]))
                    held = []
                held.append(part.slice(last))
        if held:
            yield _format(_joined(held))

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, loss array<struct<start:long,end:long>>")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest them: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                everything = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
                out.append((len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The added conversation, whose texts hold marks of common templates.
TRICKY = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, written, read back and digested.

    Empty table: conversation -7 alone. Null texts and roles: empty. Rows of conv_id null: one conversation.
    """
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    out = new_path(spark, "chat")
    format_chat(turns.unionByName(added)).write.option("compression", "zstd").parquet(out)
    return chat_digests(spark.read.parquet(out))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), chr(10), '\n') AS r,
         replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS t
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(t) + 15) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
