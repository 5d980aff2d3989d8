import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=20):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs]
    n_docs, total = sum(n > 0 for *_, n in tfs), sum(n for *_, n in tfs)
    out = {}
    for item, text in items:
        found = []
        for i, c, n in tfs:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x, _ in tfs) + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * n_docs) // total)))
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found)[:top], 1):
            out[item, rank] = (i, -score)
    return out


def rows(df):
    got = df.collect()
    assert len({(r.item_id, r.rank) for r in got}) == len(got)
    return {(r.item_id, r.rank): (r.doc_id, r.score) for r in got}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"W{i}" for i in range(120)] + ["Été", "ÀB", "x_y", "a-b", "3D"]
    draw = lambda n: " ".join(rng.choice(words[: int(rng.paretovariate(0.4)) % len(words) + 1]) for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 60))) for i in range(300)]
    docs += [(i + 300, docs[i][1]) for i in range(40)] + [(7, "w1 w2"), (None, docs[3][1]), (800, None), (801, ""), (802, "--- !"), (803, "w5 " * 20000)]
    items = [(i, draw(rng.randrange(1, 25))) for i in range(30)] + [(90, "W1 w1 W1 w2"), (91, None), (92, "unseen terms"), (93, "")]
    return docs, items


@pytest.mark.parametrize(("size", "passes"), [(1024, 1000), (16, 9)])
def test_ranks_equal_brute_force(spark, monkeypatch, corpus, size, passes):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", size)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", passes)
    docs = spark.createDataFrame([(i, t, "x") for i, t in corpus[0]], "doc_id long, text string, n string")
    items = spark.createDataFrame([(i, t, 1) for i, t in [*corpus[1], (5, "~")]], "item_id long, text string, rank int").where("item_id <> 5 or text <> '~'")
    assert rows(lexical.rank_documents(docs, items)) == brute(*corpus)


def test_pair_bounds_hold_and_are_tighter(corpus):
    texts = [(t or "").encode() for _, t in corpus[0]]
    q = lexical.Queries([(t or "").encode() for _, t in corpus[1]])
    found = [Counter(lexical.terms_of(t)) for t in texts]
    df = Counter(q.vocab[t] for c in found for t in c if t in q.vocab)
    n = np.array([sum(c.values()) for c in found])
    q.weigh(df, int((n > 0).sum()), int(n.sum()))
    post = sorted((q.vocab[t], d, c) for d, x in enumerate(found) for t, c in x.items() if t in q.vocab and q.weight[q.vocab[t]] > 0)
    term, doc, tf = (np.array(x, np.int64) for x in zip(*post, strict=True))
    block = lexical.Block(q, n, term, doc, tf)
    numbers, most, listed, lists = block.intersect(q.pairs)
    joint = np.zeros(len(q.pairs), np.int64)
    joint[numbers] = most
    at = 0
    for p, size in zip(numbers, listed, strict=True):
        a, b = (block.table[block.row[t]] for t in q.pairs[p])
        both = np.flatnonzero((a > 0) & (b > 0))
        assert joint[p] == (a + b)[both].max() and size in (0, len(both)) and lists[at : at + size].tolist() == both[:size].tolist()
        at += size
    tighter = 0
    for item in q.items:
        row = block.row[item.terms]
        highest = np.where(row >= 0, block.most[row], 0)
        order, bound = lexical.pair_bounds(item, highest, joint[item.pairs])
        alone = np.cumsum((item.times * highest)[order])
        each = (item.times[:, None] * block.table[row])[order]
        for k in range(1, len(order) + 1):
            assert each[:k].sum(axis=0).max() <= bound[k - 1] <= alone[k - 1]
        tighter += bool(len(order) and bound[-1] < alone[-1])
    assert tighter > 20


def test_no_documents_or_items(spark, corpus):
    docs, items = spark.createDataFrame(corpus[0][:3], "doc_id long, text string"), spark.createDataFrame(corpus[1][:3], "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.Best(1).low[0] == 1 and isinstance(lexical.Best(1).doc[0], pa.Array)


def test_rows_equal_those_of_sql(same_rows):
    same_rows(lexical.op11_rank_documents, lexical.OP11_SQL)
