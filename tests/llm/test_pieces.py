import random

import pytest

from pagemill.llm import pieces as P

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_file())


def by_chunks(text, chunk):
    model = P._pieces(P.model_file())
    options = [model.transfer(*part) for part in P.cut(P.SPACE + text.replace(" ", P.SPACE), chunk, model.words_apart)]
    path = P.choose([[(i, j) for i, j, _ in o] for o in options])
    return [x for o, p in zip(options, path, strict=True) for x in next(ids for i, j, ids in o if (i, j) == p)]


@pytest.mark.parametrize("alphabet", ["abcdefghij theing ", "aabb", "etaoinshrdlu", "é😀xの\n a", "internationalization"])
@pytest.mark.parametrize("chunk", [37, 64, 100])
def test_chunks_give_the_library_s_pieces(library, alphabet, chunk):
    """Texts without spaces too, where a piece may span a cut and the states at it matter."""
    rng = random.Random(f"{alphabet}{chunk}")
    for _ in range(5):
        text = "".join(rng.choice([*alphabet, "the", "ing", "tion"]) for _ in range(300))
        ids = by_chunks(text, chunk)
        assert ids == library.encode(text)
        assert P._pieces(P.model_file()).decode(ids) == text


def test_scan_is_the_product_of_all_before():
    import numpy as np

    rng = np.random.default_rng(0)
    m = [rng.integers(-5, 5, (3, 3)).astype(float) for _ in range(7)]
    want, got = m[0], P.scan(m)
    for i in range(1, 7):
        want = P.compose(want, m[i])
        assert (got[i] == want).all()


def test_edges(spark, library):
    long = "word " * 500 + "x" * 3000
    rows = [(1, None, "a"), (2, "", "b"), (3, " a  b \n", "c"), (4, long, "d"), (4, long, "e"), (None, "\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    found = P.encode_pieces(docs, P.model_file(), giant=1000, chunk=400).collect()
    assert len(found) == 6 and {r.key for r in found} == {"a", "b", "c", "d", "e", None}
    for r in found:
        assert r.pieces == library.encode(r.text or "")
    assert P.encode_pieces(docs.limit(0), P.model_file()).count() == 0


def test_a_task_runs_one_python_worker(spark, library):
    """Encoding and decoding in one task are one step: a second worker beside it took an executor's memory."""
    rows = [(1, None), (2, ""), (3, " a  b \n"), (4, "word " * 500 + "x" * 3000), (4, "é😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = P.encode_pieces(docs, P.model_file(), giant=1000, chunk=400, decode=True)
    apart = P.decode_pieces(P.encode_pieces(docs, P.model_file(), giant=1000, chunk=400), P.model_file())
    assert both.columns == apart.columns and sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))

    def workers(plan):
        below = plan.children()
        return (plan.nodeName() == "MapInArrow") + max([workers(below.apply(i)) for i in range(below.size())], default=0)

    assert workers(P.op7_sentencepiece(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()) == 1
