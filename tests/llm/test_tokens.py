import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import tokens

ODD = ["", "a", "<|endoftext|>x", " a  b\n\nc ", "x\n", "\nx", " ", "a \nb \n", "é　 b\x1c c", "it's 'tis don't\nI'll", "a\tb\t\tc d", None, "\n\n", "x. y", ".x", ",", "a,b.c", "3.14, x", "e...", "q .x", "(a). b", "&&&", ". a", "x,\ny", "é.", "٣,x"]


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("tokenizers")
    return tokens._tokenizer(tokens.tokenizer_file())


def test_words_joined_give_the_ids_of_the_text(tokenizer):
    encode = tokens._Encoder(tokens.tokenizer_file(), 0)
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(ODD, encode(pa.array(ODD)).to_pylist(), strict=True):
            assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_index_of_written_files(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(i * 7 % 26, t, "x") for i, t in enumerate(ODD)] + [(5, "again", "x")], "doc_id long, text string, n_tokens string")
    out = str(tmp_path / "tokens")
    tokens.write_tokens(docs, out, tokens.tokenizer_file())
    rows = sorted(tokens.token_index(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    by_id = {r.doc_id: r for r in rows if r.doc_id != 5}
    for d in docs.where("doc_id <> 5").collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert by_id[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    some = tokens.read_tokens(spark, out, ["doc_id", "n_tokens"], (3, 4))
    assert {r.doc_id for r in some.collect()} == {3, 4}


def test_empty_table(spark, tmp_path):
    out = str(tmp_path / "none")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out, tokens.tokenizer_file())
    assert tokens.token_index(spark, out).count() == 0
