import random
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from pagemill.llm import chat, licenses, mixing, quality, registry, toxicity

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_sql(name, same_rows):
    same_rows(registry.queries()[name], SQL[name])


def test_chat_round_trip(spark):
    texts = [chat.TRICKY, "", None, "\\", "<turn", "</turn>\n<turn>assistant\n", "é\\n\n", "\\<turn>", "x" * 5000]
    turns = [(c, i, r, t, "z") for c in (1, 2, None) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "<turn>\n\\x", None) for t in texts)]
    random.Random(1).shuffle(turns)
    rows = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, formatted string")).collect()
    assert len(rows) == 3
    for row in rows:
        mine = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == row.conv_id)
        assert [(r, t) for r, t, _, _ in chat.parse(row.formatted)] == [(r, t) for _, r, t in mine]
        learned = [chat.unescape(row.formatted[s.start : s.end]) for s in row.loss]
        assert learned == [t for _, r, t in mine if r == "assistant"]


def test_mix_edges(spark):
    rows = [(1, "a b c", None), (2, None, "s"), (3, "", "s"), (4, "x " * 50, "t"), (4, "x " * 50, "t"), (None, "y", "u")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    plan = {r.source: r for r in mixing.mix_plan(mixing.sized(docs)).collect()}
    assert plan["t"].source_size == 100 and plan[None].source_size == 3 and plan["s"].target == 0
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in plan.values())
    assert abs(sum(r.target for r in plan.values()) - 104) < 1e-6 or sum(3 * r.source_size for r in plan.values()) < 104
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.collect() if r.doc_id == 1).values(), default=0) <= 3
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_license_edges(spark):
    notice = "Released under the MIT License."
    long = "word " * 3000 + notice + " word" * 3000
    docs = spark.createDataFrame([(1, notice, "x"), (2, long, "x"), (3, None, "x"), (4, "", "x"), (None, notice.upper(), "x"), (5, "Released under a license", "x"), (1, notice, "x")], "doc_id long, text string, license_id string")
    found = {(r.doc_id, r.license_id) for r in licenses.license_matches(docs).collect()}
    assert found == {(1, "mit"), (2, "mit"), (None, "mit")}
    assert licenses.license_matches(docs.limit(0)).count() == 0


def plain_counts(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(inside)


def test_base_counts(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "é#b\n é#b\né#b", "x y z\x1cq", *[" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) + "\n" * rng.randrange(3) for _ in range(40)], "one two three four five " * 400]
    docs = spark.createDataFrame([(i, t, None, "c") for i, t in enumerate(texts)], "doc_id long, text string, lang string, chars string")
    for r in quality.score_quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id] or "")
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_shouting_is_far_from_its_language(spark):
    rng = random.Random(7)
    common = quality.COMMON_WORDS["en"].split()

    def prose():
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("aeiounst") for _ in range(6)) for _ in range(150)) + "."

    rows = [(i, prose(), "en") for i in range(60)] + [(100, prose().upper().replace(" ", "!! "), "en")]
    found = {r.doc_id: r.kept for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not found.pop(100) and all(found.values())


def test_distance_of_equal_and_of_disjoint_shares(spark):
    from pyspark.sql import functions as F

    p, q = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    row = spark.range(1).select(quality.js_distance(p, p).alias("a"), quality.js_distance(p, q).alias("b")).first()
    assert (row.a, row.b) == (0.0, 1.0)


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good = np.stack([np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02) for _ in range(4)], axis=1)
    votes = np.hstack([good, good[:, :1], (rng.random(4000) < 0.3)[:, None]]).astype(float)
    model = toxicity.fit_label_model(votes, 0.2, np.where(votes[:, :4].sum(axis=1) > 1, 0.9, 0.05))
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95
    assert model.weights[0] < model.weights[1] and model.weights[4] < model.weights[2]  # the copy shares its weight
    rates = model.rates[1] - model.rates[0]
    assert rates[:4].min() > 0.5 > abs(rates[5])


def test_held_out_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = ["".join(rng.choice("aeioulnstr") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
        if bad:
            words[10], words[30] = rng.choice(["grobian", "schuft"]), rng.choice(["grobiane", "lump"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "x")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    stems, weights = toxicity.train(docs, marks.where(toxicity.remainder(F.col("doc_id")) != 1))
    got = {r.doc_id: r.score for r in toxicity.score(docs, stems, weights).collect()}
    assert len(got) == 903 and all(0 <= v <= 1 for v in got.values())
    import zlib

    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 6 == 0) for i in held]) > 0.97
    none = toxicity.train(docs, marks.limit(0))
    assert len({r.score for r in toxicity.score(docs, *none).collect()}) == 1


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in before.collect()}
    found = cp.run(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in before.collect())
    assert all(r.round_trip and r.text == texts[r.doc_id] for r in found)


def test_pipeline_equals_brute_force(spark):
    """Stages one to four against plain Python, given the quality verdicts and the mix's copies."""
    import corpus_pipeline as cp
    from test_near_copies import brute_near_copies, brute_substrings

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id: r.text for r in cp.quality_rules(spark, docs, SF).collect()}
    ids = sorted(good)
    kept = brute_near_copies(list(good.items()))
    table = docs.where(docs.doc_id.isin(ids))
    single = cp.near_dedup(spark, table, SF)
    assert sorted(r.doc_id for r in single.collect()) == kept
    want = brute_substrings({i: good[i] for i in kept}, 50)
    for r in cp.substring_dedup(spark, docs.where(docs.doc_id.isin(kept)), SF).collect():
        assert r.text in (good[r.doc_id], want[r.doc_id]) and r.text.encode().split() == want[r.doc_id].encode().split()


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those inside, null texts, ids and sources, repeated rows and an empty table pass all stages."""
    import corpus_pipeline as cp

    text = " ".join(f"word{i % 50}x{i}" for i in range(80))
    rows = [(1, text, "en", "s", 10, 1, "t", "k"), (1, text, "en", "s", 10, 1, "t", "k"), (2, None, None, None, None, 2, "t", "k"), (None, text + " more", "en", "s", 10, 3, "t", "k"), (3, "", "en", "s", 0, 4, "t", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy_0 int, text_0 string, key string")
    for name, stage in cp.STAGES[:-1]:
        after, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert after.columns == docs.columns, name
        assert none.columns == docs.columns and none.count() == 0, name
        found = after.collect()
        assert all((r.copy_0, r.text_0, r.key) in {(i, "t", "k") for i in range(1, 5)} for r in found), name
    assert cp.sentencepiece(spark, docs.limit(0), SF).count() == 0


def test_a_repeated_id_is_learned_from_once(spark, monkeypatch):
    """300 texts of one labelled doc_id are one row to learn from, so that labels bound the rows."""
    rows = [(1, f"text number {i}") for i in range(300)] + [(i, "one more text") for i in range(2, 12)]
    learned = []
    monkeypatch.setattr(toxicity, "learn_stems", lambda r: learned.extend(r.collect()) or [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, toxic int"))
    assert len(learned) == 11 and sum(r.text.startswith("text number") for r in learned) == 1
