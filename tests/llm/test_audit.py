from itertools import permutations

import pytest

from pagemill.llm import audit

LONG = " ".join(f"w{i}" for i in range(60))
SAME = " ".join(["same"] * 60)
ROWS = [
    (1, LONG, "a", 0), (2, LONG, "a", 1), (2, LONG, "b", 2), (3, SAME, None, 3), (4, SAME, "", 4), (5, None, "a", 5), (6, "", "b", 6), (7, "A#B", "b", 7),
    (None, LONG, "a", 8), (8, LONG + " # A", "a", 9), (8, "X " * 5000, "c", 10), (9, LONG.upper(), "c", 11), (9, LONG.upper(), "c", 11), (10, "É" * 300, "c", 12),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (7, 1, None), (9, 1, 1), (None, 1, 1)]


def brute(rows, labels):
    firsts = {}
    for i, t, *_ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    docs = []
    for i, t, s, _ in rows:
        t, w = t or "", (t or "").split()
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and firsts[t] < i}
        good, toxic = (any(j == i and i is not None and v == 1 for j, v in lab) for lab in ([(j, q) for j, q, _ in labels], [(j, x) for j, _, x in labels]))
        docs.append((s or "", {f for f in fails if fails[f]}, good, toxic))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                row = [sum(f not in d[1] for d in left), len(now), sum(f in d[1] for d in gone), sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in now), sum(d[3] for d in now)]
                left, gone = [d for d in left if f not in d[1]], gone + now
                shapley[part, f] = shapley.get((part, f), 0) + len(now)
                out.append(((part, order, step), row))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out}


def test_audit_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, key int").withColumnRenamed("key", "mask")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(docs, labels).collect()
    want = brute(ROWS, LABELS)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in ROWS})
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == want


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "a")], docs.schema)
    assert audit.audit_filters(one, labels).where("removed = 1 and step = 1 and filter_order like 'A%'").count() == 24


def test_equal_hashes_of_unlike_texts_are_no_repeats(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(audit, "text_key", lambda: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "x")], "doc_id long, text string, source string")
    assert [r.doc_id for r in audit.repeated_texts(docs, docs.select("doc_id", audit.text_key().alias("key"))).collect()] == [3]


@pytest.mark.parametrize("name", ["op13_filter_audit"])
def test_rows_equal_those_of_sql(name, same_rows):
    same_rows(audit.op13_filter_audit, audit.OP13_SQL)
