"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

The vocabulary is a BPE one. A sequence of pieces is the BPE encoding of a text exactly if every two neighbours
are, so an encoding is a path over pieces in the max-plus semiring with weights 0 (neighbours agree) and minus
infinity (they don't), and there is one such path. The state at a cut is the piece that holds the last character
before it. A chunk yields a matrix from the states at its left cut to those at its right cut; matrices combine
associatively; the states chosen then fix each chunk's pieces by themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, read_table, staged

#: Code points from which a document is cut into chunks of about CHUNK.
GIANT, CHUNK = 32_768, 16_384
#: Code points of each side's context at a cut, the length of the longest piece.
CONTEXT = 16
SPACE = "▁"
NO_PATH = -np.inf


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def _without_prefix(model: bytes) -> bytes:
    """The model with normalizer_spec (field 3) add_dummy_prefix (field 3 in it) off; later fields win."""
    out, at = b"", 0
    while at < len(model):
        tag, body = _varint(model, at)
        assert tag & 7 == 2, "a model's fields are messages"
        size, body = _varint(model, body)
        field = model[body : body + size]
        if tag >> 3 == 3:
            field += b"\x18\x00"
            head, n = bytes([tag]), len(field)
            while n > 127:
                head, n = head + bytes([n & 127 | 128]), n >> 7
            out += head + bytes([n]) + field
        else:
            out += model[at : body + size]
        at = body + size
    return out


class Pieces:
    """A model: encoding of parts of a normalised text, lengths in code points, and decoding by table."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.sp = sentencepiece.SentencePieceProcessor(model_proto=_without_prefix(f.read()))
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.byte = np.array([self.sp.is_byte(i) for i in range(n)])
        special = np.array([self.sp.is_control(i) or self.sp.is_unknown(i) for i in range(n)])
        value = [int(p[3:-1], 16) if b else 0 for p, b in zip(pieces, self.byte, strict=True)]
        #: code points that a piece begins: a byte begins one unless it continues a UTF-8 sequence
        self.length = np.array([int(v & 0xC0 != 0x80) if b else 0 if s else len(p) for p, b, s, v in zip(pieces, self.byte, special, value, strict=True)])
        self.raw = [bytes([v]) if b else b"" if s else p.replace(SPACE, " ").encode() for p, b, s, v in zip(pieces, self.byte, special, value, strict=True)]
        self.known = {p for p, b, s in zip(pieces, self.byte, special, strict=True) if not b and not s and len(p) > 1}
        #: no piece holds a space mark after another character: before each word is a certain boundary
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.known)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def edges(self, ids: list[int]) -> tuple[int, int, int, int]:
        """Code points and ids of the first and of the last piece (a character in bytes is one piece)."""
        first = 1
        while first < len(ids) and self.length[ids[first]] == 0:
            first += 1
        last = 1
        while last < len(ids) and self.length[ids[-last]] == 0:
            last += 1
        return int(self.length[ids[0]]), first, int(self.length[ids[-last]]), last

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """Pieces that may hold the last character of left: code points before and after the cut."""
        found = [(1, 0)]
        for s in range(1, min(CONTEXT, len(left)) + 1):
            for e in range(min(CONTEXT - s, len(right)) + 1):
                if s + e > 1 and left[-s:] + right[:e] in self.known:
                    found.append((s, e))
        return found

    def transfer(self, left: str, body: str, right: str) -> list[tuple[int, int, list[int]]]:
        """Pairs of states that a path joins, and the pieces that the chunk adds on it.

        An empty left or right context means a certain boundary, with one state. Pieces are those after the
        left cut's state, up to and with the right cut's.
        """
        ins = self.states(left, body[:CONTEXT]) if left else [(0, 0)]
        outs = self.states((left + body)[-CONTEXT:], right) if right else [(0, 0)]
        full = left + body + right
        spans = {(s, e) for s, _ in ins for _, e in outs}
        order = sorted(spans)
        encoded = dict(zip(order, self.encode([full[len(left) - s : len(left) + len(body) + e] for s, e in order]), strict=True))
        found = []
        for i, (s, e) in enumerate(ins):
            for j, (u, v) in enumerate(outs):
                ids = encoded[s, v]
                n, n_ids, m, _ = self.edges(ids)
                if (not left or n == s + e) and (not right or m == u + v):
                    found.append((i, j, ids[n_ids:] if left else ids))
        return found


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def cut(text: str, chunk: int, certain: bool) -> list[tuple[str, str, str]]:
    """Left context, body and right context of each chunk: cut before the last word begun in the chunk's second half."""
    out, at, left = [], 0, ""
    while at < len(text):
        end = min(at + chunk, len(text))
        right = ""
        if end < len(text):
            p = text.rfind(SPACE, at + chunk // 2, end) if certain else -1
            while p > at + chunk // 2 and text[p - 1] == SPACE:
                p -= 1
            if p > at + chunk // 2:
                end = p
            else:
                right = text[end : end + CONTEXT]
        out.append((left, text[at:end], right))
        left = text[max(0, end - CONTEXT) : end] if right else ""
        at = end
    return out


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halves."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = scan([compose(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], matrices[i]))
    return out


def choose(options: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """For each chunk the pair of states on the one path: those that can be reached from both ends."""
    heights = [1 + max(i for i, _ in o) for o in options]
    widths = [*(max(1 + max(j for _, j in o), h) for o, h in zip(options, heights[1:], strict=False)), 1]
    matrices = []
    for o, h, w in zip(options, [1, *widths[:-1]], widths, strict=True):
        m = np.full((h, w), NO_PATH)
        for i, j in o:
            m[i, j] = 0
        matrices.append(m)
    before = scan(matrices)
    after = [m.T for m in scan([m.T for m in reversed(matrices)])][::-1]
    at = [0, *(int(np.argmax(p[0] + s[:, 0])) for p, s in zip(before, after[1:], strict=False)), 0]
    return list(zip(at, at[1:], strict=False))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.list_(pa.int32()))


#: Bytes of texts that a task encodes at once; their ids take about ten times as much in Python.
SLICE = 1 << 20
#: Columns that decoding adds.
DECODED = ("decoded", "ids_crc32")


def _decoded(model: Pieces, lists: pa.ListArray) -> list[pa.Array]:
    """Of each list of ids its text, and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    ids, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    texts = [model.decode(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
    return [pa.array(texts, pa.string()), pa.array(crc, pa.int64())]


def encode_pieces(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK, decode: bool = False) -> DataFrame:
    """docs + pieces array<int>, the ids of its whole text as the model's own library gives them.

    Documents under ``giant`` code points are encoded where they are read. Chunks of larger ones are dealt out
    anew, so that one document is encoded by many tasks: each writes its transfer matrix with the pieces of its
    paths. The scan of a document reads the states of its matrices alone; the states it chooses join the chunks,
    which give their pieces each by itself, and these are gathered in the document's row. Null text: no pieces. A
    column named pieces is replaced. With decode, the columns of ``decode_pieces`` too: where a document is encoded in
    its task, they are made there, so that no second Python worker runs beside the first.
    """
    docs = docs.drop("pieces", *DECODED) if decode else docs.drop("pieces")
    names, fields = docs.columns, docs.schema

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                lists = _lists(model.encode([SPACE + t if t else "" for t in part.column("text").to_pylist()]))
                more = _decoded(model, lists) if decode else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], [*part.schema.names, "pieces", *DECODED[: len(more)]])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = _pieces(path).words_apart
        for batch in batches:
            for part in byte_slices(batch, "text", 1):
                text = SPACE + part.column("text")[0].as_py().replace(" ", SPACE)
                parts = cut(text, chunk, apart)
                n = len(parts)
                key = pa.array([0] * n)
                columns = [part.column("key").take(key), pa.array(range(n), pa.int32()), *(pa.array(c, pa.string()) for c in zip(*parts, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "left", "body", "right"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("ids", pa.list_(pa.int32()))]))
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [[{"i": i, "j": j, "ids": x} for i, j, x in model.transfer(*row)] for row in zip(*(part.column(c).to_pylist() for c in ("left", "body", "right")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), pa.array(found, kind)], ["key", "n", "options"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.drop_duplicates("n").sort_values("n")
        path = choose([list(zip(i, j, strict=True)) for i, j in zip(rows["i"], rows["j"], strict=True)])
        return pd.DataFrame({"key": pdf["key"].iloc[0], "n": rows["n"].to_numpy(), "a": [a for a, _ in path], "b": [b for _, b in path]})

    length = F.char_length(F.coalesce("text", F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", pieces array<int>" + (", decoded string, ids_crc32 long" if decode else "")
    small = docs.where(length < giant).mapInArrow(ordinary, schema)
    # texts that are equal have equal pieces: the digest of the text is the key, whatever the other columns hold
    large = docs.where(length >= giant).select(F.struct(*names).alias("row"), F.sha2("text", 256).alias("key"))
    parts = large.select("key", "row.text").dropDuplicates(["key"]).mapInArrow(chunks, "key string, n int, left string, body string, right string").repartition("key", "n")
    option = staged(parts.mapInArrow(transfers, "key string, n int, options array<struct<i:int,j:int,ids:array<int>>>"), "transfers")
    matrices = option.select("key", "n", F.transform("options", lambda o: o["i"]).alias("i"), F.transform("options", lambda o: o["j"]).alias("j"))
    taken = matrices.groupBy("key").applyInPandas(states, "key string, n int, a int, b int")
    ids = F.get(F.filter("options", lambda o: (o["i"] == F.col("a")) & (o["j"] == F.col("b"))), F.lit(0))["ids"]
    chosen = option.join(taken, ["key", "n"]).select("key", "n", ids.alias("ids")).dropDuplicates(["key", "n"])
    whole = chosen.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("pieces"))
    joined = large.join(whole, "key").select(*[F.col("row")[c].alias(c) for c in names], "pieces")
    return small.unionByName(decode_pieces(joined, path) if decode else joined)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """encoded + decoded (the text of its pieces), ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, *_decoded(model, part.column("pieces"))], [*part.schema.names, *DECODED])

    encoded = encoded.drop(*DECODED)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string, ids_crc32 long"
    return encoded.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document, and whether they decode to its text.

    Null or empty text: no pieces, decoded to an empty text. A text that holds U+2581 decodes to one with
    spaces in its place, as the model has one symbol for both. Rows with one doc_id each get a row.
    """
    path = model_file()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = encode_pieces(docs, path, decode=True)
    return found.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "ids_crc32", (F.col("decoded") == F.col("text")).alias("round_trip"))
