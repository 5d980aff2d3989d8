"""Registered queries without SQL, against plain versions on the smallest tables."""

import re
import zlib

import numpy as np
import pytest
import xxhash

from pagemill.llm import registry, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op10_rows_equal_brute_force(spark, texts):
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op10_simhash_dedup"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_op1_rows_equal_the_library(spark, texts):
    pytest.importorskip("tokenizers")
    encode, at, want = tokens._tokenizer(tokens.tokenizer_file()).encode, 0, {}
    for i in sorted(texts):
        ids = [*encode(texts[i], add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.queries()["op1_token_ids"](spark, SF).collect()}
    assert got == want
