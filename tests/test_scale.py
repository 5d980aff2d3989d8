"""Operators on groups that hold most rows: equal to a plain version, and spread over tasks."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions.segments import Segments
from pagemill.operators import corpus


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_segments_equal_windows(spark, width):
    rng = random.Random(width)
    rows = [("hot" if rng.random() < 0.8 else f"d{rng.randrange(4)}", rng.randrange(-50, 400), i, rng.choice([None, 1, 5, -2])) for i in range(600)]
    df = spark.createDataFrame(rows, "deck_id string, at int, n int, v int")
    seg, w = Segments(["deck_id"], ["at", "n"], width), Window.partitionBy("deck_id").orderBy("at", "n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = df
    for name, value in (("lead", "v"), ("lag", "v"), ("last_value", "v"), ("running_sum", "v")):
        got = getattr(seg, name)(got, F.col(value), name)
    got = seg.row_number(got, "number")
    want = df.select("*", F.lead("v").over(w), F.lag("v").over(w), F.last("v", True).over(upto), F.coalesce(F.sum("v").over(upto), F.lit(0)), F.row_number().over(w))
    nulls = lambda r: tuple(("~" if x is None else x) for x in r)
    mine = {r.n: nulls((r.lead, r.lag, r.last_value, r.running_sum or 0, r.number)) for r in got.collect()}
    assert mine == {r.n: nulls(r[4:]) for r in want.collect()}


def packed(rows, most):
    """The fold: (section, chunk, characters, first page, last page)."""
    out, at, cur = [], None, None
    for section, page, _, text in sorted(rows):
        if section == at and cur[2] + 2 + len(text) <= most:
            cur[2], cur[4] = cur[2] + 2 + len(text), page
        else:
            cur = [section, 1 if section != at else cur[1] + 1, len(text), page, page]
            out.append(cur)
        at = section
    return sorted(map(tuple, out))


@pytest.mark.parametrize("width", [8, 1024])
def test_chunks_equal_the_fold(spark, monkeypatch, width):
    monkeypatch.setattr(corpus.chunk_starts, "__defaults__", (width,))
    rng, rows = random.Random(5), []
    for section, n in enumerate([1, 2, 30, 700, 2500]):
        page = 0
        for i in range(n):
            page += rng.choice([1, 1, 3]) if i % 7 == 0 else 0
            rows.append((f"s{section}", page, i % 7, "x" * rng.choice([1, 5, 30, 80, 200, 598, 599, 600, 700, 1198, 1199, 1200, 1201, 1500])))
    units = spark.createDataFrame([("b", *r) for r in rows], "book_id string, section_id string, page int, pos int, text string")
    got = corpus.chunks(units).select("section_id", "chunk_index", "text_chars", "page_start", "page_end")
    assert sorted(map(tuple, got.collect())) == packed(rows, 1200)
    cases = spark.createDataFrame([("b", "s", 1, i, t) for i, t in enumerate(["aaaa", "bbbb", "cccc", "x" * 14, "e"])], units.schema)
    assert [r.text for r in corpus.chunks(cases, 10).orderBy("chunk_index").collect()] == ["aaaa\n\nbbbb", "cccc", "x" * 14, "e"]
    assert corpus.chunks(units.limit(0)).count() == 0


def key(rng, words):
    return "".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))


def test_titles_within_titles_equal_brute_force(spark):
    from pagemill.operators import sections

    rng = random.Random(2)
    words = ["ab", "c", "拥塞", "defgh", "ij", "x", "控制理论", "klmnopqrstuvwxyz" * 3]
    titles = [("d", i, key(rng, words)) for i in range(300)] + [("e", i, key(rng, words)) for i in range(40)]
    keys = sorted({("d", key(rng, words)) for _ in range(250)} | {("e", t) for _, _, t in titles[300:320]} | {("d", t[:-1]) for _, _, t in titles[:50]})
    keys = [(d, k) for d, k in keys if len(k) >= 4]
    outline = [(d, r, k) for r, (d, k) in enumerate(keys, 1)]
    like = lambda a, b: a == b or ((a in b or b in a) and min(len(a), len(b)) >= 0.72 * max(len(a), len(b)))
    pages = spark.createDataFrame(titles, "deck_id string, slide_id int, title string")
    listed = spark.createDataFrame(outline, "deck_id string, rank int, key string")
    got = {tuple(r) for r in sections.outline_matches(pages, listed).select("deck_id", "slide_id", "rank").collect()}
    assert got == {(d, i, r) for d, i, t in titles for e, r, k in outline if d == e and like(t, k)} and len(got) > 100
    bodies = [(d, i, "".join(rng.choice(words) for _ in range(60))) for d, i, _ in titles]
    shown = sections.titles_shown(spark.createDataFrame(bodies, "deck_id string, slide_id int, k string"), listed)
    want = {(d, i): n for d, i, b in bodies if (n := sum(e == d and k in b for e, _, k in outline))}
    assert {(r.deck_id, r.slide_id): r.shown for r in shown.collect()} == want and want


def test_neighbours_and_front_of_a_long_deck(spark):
    from pagemill.operators import sections

    rows = [("d", 5 * i, i < 700) for i in range(3000)] + [("e", 1, True), ("f", 1, False)]
    pages = spark.createDataFrame(rows, "deck_id string, slide_id int, is_front boolean")
    near = {(r.deck_id, r.slide_id): r.neighbors for r in sections.neighbors(pages, 2).collect()}
    assert near["d", 1025] == [1015, 1020, 1030, 1035] and near["d", 0] == [5, 10] and near["e", 1] == []
    assert sections.leading_frontmatter(pages).groupBy("deck_id").count().orderBy("deck_id").collect() == [("d", 700), ("e", 1)]


@pytest.mark.parametrize("pairs", [1, 64])
def test_words_in_common_equal_brute_force(spark, monkeypatch, pairs):
    from pagemill.operators import grounding

    monkeypatch.setattr(grounding, "FIRST_PAIRS", pairs)
    rng = random.Random(pairs)
    text = lambda n: " ".join(["common"] * (rng.random() < 0.9) + [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(n))])
    images = [("d", i % 3, f"i{i:03}", text(6)) for i in range(90)]
    elements = [("d", i % 3, f"t{i:03}", rng.randrange(50), text(9)) for i in range(240)]
    got = {r.image_id: (r.anchor_id, r.confidence) for r in grounding.semantic_anchors(spark.createDataFrame(images, "deck_id string, slide_id int, element_id string, text string"), spark.createDataFrame(elements, "deck_id string, slide_id int, element_id string, pos int, content string")).collect()}
    want = {}
    for _, page, image, words in images:
        ranked = sorted((-len(set(words.split()) & set(t.split())), pos, e) for _, p, e, pos, t in elements if p == page)
        if ranked[0][0]:
            want[image] = (ranked[0][2], round(min(0.72, 0.42 - ranked[0][0] * 0.06), 3))
    assert got == want


def boxes(rng, n, page, size=0.05):
    out = []
    for i in range(n):
        x, y = rng.uniform(-0.05, 1), rng.uniform(-0.05, 1)
        out.append(("d", page, f"e{i:05}", [x, y, x + rng.uniform(0.001, size), y + rng.uniform(0.001, size)], i))
    return out


def test_grid_joins_equal_all_pairs(spark):
    from pagemill.operators import images, spatial

    rng = random.Random(8)
    rows = boxes(rng, 900, 1) + boxes(rng, 5, 2, 0.9) + boxes(rng, 60, 3, 0.6)
    df = spark.createDataFrame(rows, "deck_id string, slide_id int, element_id string, bbox array<double>, pos int")
    near = lambda a, b, reach: all(a[k] <= b[k + 2] + reach and b[k] <= a[k + 2] + reach for k in (0, 1))
    p, q = df.select("deck_id", "slide_id", F.col("element_id").alias("a"), F.col("bbox").alias("p")), df.select("deck_id", "slide_id", F.col("element_id").alias("b"), F.col("bbox").alias("q"))
    for reach in (0.0, 0.07):
        met = [(r.slide_id, r.a, r.b) for r in spatial.meeting_pairs(p, q, "p", "q", reach).collect()]
        want = {(x[1], x[2], y[2]) for x in rows for y in rows if x[1] == y[1] and near(x[3], y[3], reach)}
        assert len(met) == len(set(met)) and want <= set(met)
        assert len([m for m in met if m[0] == 1]) < 900 * 900 / 5
    some = spark.createDataFrame(boxes(rng, 40, 1, 0.2) + boxes(rng, 3, 2) + boxes(rng, 2, 9), df.schema)
    got = {(r.slide_id, r.image_id): (r.anchor_id, r.confidence) for r in images.spatial_anchors(some, df).collect()}
    over, best = (lambda a, b, k: max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) / max(1e-12, min(a[k + 2] - a[k], b[k + 2] - b[k]))), {}
    for _, page, image, a, _ in some.collect():
        for _, other, anchor, b, pos in rows:
            if other == page:
                o, before = over(a, b, 0), b[3] <= a[1] + 0.03 and over(a, b, 0) >= 0.08
                dx, dy = abs(a[0] + a[2] - b[0] - b[2]) / 2, abs(a[1] + a[3] - b[1] - b[3]) / 2
                score = max(0.0, a[1] - b[3]) * 1.8 + dx * 0.45 - o * 0.25 if before else (dx * dx + dy * dy) ** 0.5 + 0.35 + (0.12 if o < 0.08 else 0)
                best[page, image] = min(best.get((page, image), (9.9,)), (round(score, 9), pos, anchor))
    assert {k: v[0] for k, v in got.items()} == {k: v[2] for k, v in best.items()}


def test_parts_of_one_long_chain_are_one_group(spark):
    from pagemill.operators import images

    n = 3000
    pairs = spark.createDataFrame([("d", 1, f"p{i:05}", f"p{i + 1:05}") for i in range(n)] + [("d", 2, "a", "b"), ("e", 1, "p00000", "z")], "deck_id string, slide_id int, a string, b string")
    got = images.part_groups(pairs).collect()
    assert len(got) == n + 1 and {r.group_id for r in got} == {"p00000"} and {r.deck_id for r in got} == {"d"}


def test_digest_tree_follows_changes(spark):
    from pagemill.operators import digests

    rows = [("d", i * 7, f"h{i}") for i in range(600)] + [("e", 5, "x")]
    pages = spark.createDataFrame(rows, "deck_id string, slide_id int, digest string")
    tree = digests.digest_tree(pages)
    now = spark.createDataFrame([(d, i, "new" if i == 7 * 300 else h) for d, i, h in rows if i != 14] + [("f", 1, "y"), ("d", 999_999, "z")], pages.schema)
    changed = spark.createDataFrame([("d", 14), ("d", 2100), ("f", 1), ("d", 999_999)], "deck_id string, slide_id int")
    both = [sorted(map(tuple, t.select("deck_id", "level", "node", "digest").collect())) for t in (digests.refresh_tree(tree, now, changed), digests.digest_tree(now))]
    assert both[0] == both[1]
    top = [{r.deck_id: r.digest for r in digests.deck_digests(t).collect()} for t in (tree, digests.digest_tree(now))]
    assert top[0]["d"] != top[1]["d"] and top[0]["e"] == top[1]["e"] and "f" in top[1]


def test_pieces_of_titles_are_not_broadcast(spark):
    from pagemill.operators import sections

    titles = spark.createDataFrame([("d", f"A course on subject {i}") for i in range(20)], "deck_id string, k string")
    keys = spark.createDataFrame([("d", f"course on subject {i}") for i in range(15, 25)], "deck_id string, key string")
    pairs = sections._alike(titles, keys)
    assert "Broadcast" not in pairs._jdf.queryExecution().sparkPlan().toString()
    want = {(k.k, x.key) for k in titles.collect() for x in keys.collect() if x.key in k.k and len(x.key) >= 0.72 * len(k.k)}
    assert {(r.k, r.key) for r in pairs.collect()} == want


def test_study_items_clean_each_text_once(spark):
    from pagemill.operators import questions

    lines = spark.createDataFrame([("d", 1, f"s1_t{i}", f"<b>Term {i}</b>: what it means") for i in range(4)], "deck_id string, slide_id int, element_id string, text string")
    roles = spark.createDataFrame([("d", "s1_t1", "formula")], "deck_id string, element_id string, role string")
    items = questions.study_items(lines.join(roles, ["deck_id", "element_id"], "left").withColumn("priority", F.lit(0)))
    assert items._jdf.queryExecution().optimizedPlan().toString().count("<[^>]+>") == 1
    assert [(r.point, r.explanation) for r in items.orderBy("pos").collect()] == [(f"Term {i}", f"Term {i}: what it means") for i in range(4)]


def test_questions_read_documents_once(spark):
    from conftest import SF

    from pagemill.plans import layout_queries

    assert all("documents" not in f for f in layout_queries._asked(spark, SF).inputFiles())


def test_images_of_a_page_join_without_another_shuffle(spark):
    from conftest import SF

    from pagemill.plans import bindings

    i = bindings.images(spark, SF)
    both = i.select("deck_id", "slide_id", "element_id").hint("merge").join(i.select("deck_id", "slide_id", F.col("bbox").alias("q")), ["deck_id", "slide_id"])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("ReusedExchange") == 2


def test_rounding_of_measures_scales_first(spark, duck):
    from pagemill.functions.geometry import round_scaled

    values = [i * 1e-8 * 50 for i in range(1, 4000, 7)] + [0.1234565, 0.0000005, 0.2500005, 1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(round_scaled(F.col("v"), 6)).collect()]
    assert got == [duck.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(F.round("v", 6)).collect()] != got


def test_groups_read_images_with_parts_once(spark, duck):
    from conftest import SF

    from pagemill.operators import images
    from pagemill.plans import bindings, image_queries

    made = image_queries._composites(spark, SF)[0]
    assert made.count() and all("lineitem" not in f for f in made.inputFiles())
    kept = images.images_with_parts(bindings.images(spark, SF))
    every = images.composite_parts(bindings.images(spark, SF)).groupBy("deck_id", "slide_id").count()
    few = {tuple(r) for r in images.composite_parts(kept).groupBy("deck_id", "slide_id").count().collect()}
    assert few == {tuple(r) for r in every.where("count > 2").collect()} and len(few) < every.count() / 2
    boxes = [(*r[:3], *r.bbox) for r in bindings.images(spark, SF).select("deck_id", "slide_id", "element_id", "bbox").collect()]
    assert sorted(boxes) == sorted(duck.sql(f"WITH {bindings.IMAGES_SQL} SELECT deck_id, slide_id, element_id, x1, y1, x2, y2 FROM images").fetchall())


def test_areas_add_up_as_doubles(spark):
    """One value is its own sum and two have the sum of doubles, whatever their size; more have one sum in any order."""
    from pagemill.functions.geometry import sum_of_areas

    def total(values):
        return spark.createDataFrame([(v,) for v in values], "v double").select(sum_of_areas(F.col("v"))).first()[0]

    small, other = 0.0027000000000000006, 0.00216
    assert total([small]) == small and total([small, other]) == small + other and total([1.0, 0.0, 1.0]) == 2.0
    three = [0.0034999999999999996, 0.0007000000000000006, 0.0034999999999999996]
    assert total(three) == total(three[::-1]) == math.fsum(three) and total([0.1 + small, 1e-9]) == 0.1 + small + 1e-9
    assert total([]) is None


def test_anchors_by_row_equal_those_apart(spark):
    """Images that meet their page's elements in one row have the anchors that each kind's own search gives; lines are shuffled once a side."""
    from conftest import SF

    from pagemill.operators import grounding
    from pagemill.plans import image_queries

    rng = random.Random(5)
    box = lambda: [x := rng.randrange(70) / 100, y := rng.randrange(70) / 100, x + rng.randrange(1, 30) / 100, y + rng.randrange(1, 30) / 100]
    words = lambda: " ".join(rng.sample(["alpha", "beta", "gamma", "图", "delta"], rng.randrange(4)))
    pages = [(d, p, n) for d in "de" for p, n in enumerate((0, 1, 3, 9, grounding.ROW_ELEMENTS, grounding.ROW_ELEMENTS + 1))]
    i = spark.createDataFrame([(d, p, f"i{k}", box() if rng.random() < 0.6 else None, words()) for d, p, _ in pages for k in range(6)], "deck_id string, slide_id int, element_id string, bbox array<double>, text string")
    e = spark.createDataFrame(
        [(d, p, f"t{k}", k, rng.choice(["heading", "text"]), box() if p != 2 else None, words()) for d, p, n in pages for k in range(n)],
        "deck_id string, slide_id int, element_id string, pos int, type string, bbox array<double>, content string",
    )
    none = i.limit(0).select("deck_id", "slide_id")
    apart = grounding.pages_apart(e, none)
    assert {tuple(r) for r in apart.collect()} == {("d", 5), ("e", 5)} and grounding.pages_apart(e.where("slide_id < 5"), none) is None
    rows = lambda df: sorted(map(str, df.collect()))
    got = grounding.anchor_images(i, e, None, (), apart)
    reasons = {r.reason for r in got.collect()}
    assert rows(got) == rows(grounding.anchor_images(i, e, None, (), i.select("deck_id", "slide_id").distinct())) and len(reasons) == 6
    assert rows(grounding.semantic_anchors(i, e, none)) == rows(grounding._by_words(i, e))
    plan = image_queries._anchored(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("ReusedExchange") <= 3


def test_pages_and_places_are_not_broadcast(spark):
    """One row makes many pages or places; a hash table of them would be collected by the driver."""
    pages = spark.createDataFrame([("b", i, f"line {i}\nanother") for i in range(1, 40)], "book_id string, physical_page int, combined_text string")
    sections = spark.createDataFrame([("b", "s1", 1, 20), ("b", "s2", 20, 39)], "book_id string, section_id string, start_page int, end_page int")
    units = corpus.section_units(pages, sections)
    assert units.count() == 40 and "Broadcast" not in units._jdf.queryExecution().sparkPlan().toString()
    packed = corpus.chunks(units, 60)
    plan = packed._jdf.queryExecution().sparkPlan().toString()
    assert packed.agg(F.sum("text_chars")).first()[0] > 0 and plan.count("SortMergeJoin") >= 1 and "Generate explode(sequence" in plan and "BroadcastHashJoin [book_id#" not in plan.split("Generate explode(sequence")[0]


def test_next_candidates_by_row_and_in_cells_equal_a_plain_version(spark):
    """Pages of up to ROW_BOXES candidates by one row, others by cells; on the former rows of one pos have one end."""
    from pagemill.operators import images

    rng = random.Random(9)
    box = lambda: [x := rng.randrange(70) / 100, y := rng.randrange(70) / 100, x + rng.randrange(0, 30) / 100, y + rng.randrange(1, 30) / 100]
    sizes = {1: 1, 2: 7, 3: images.ROW_BOXES, 4: images.ROW_BOXES + 1}
    rows = [(1, p, k if p == 4 else k - k % 5 // 4, f"c{k}", None if k % 11 == 5 else box(), 900) for p, n in sizes.items() for k in range(n)]
    got = images.limit_before_next(spark.createDataFrame(rows, "deck_id long, slide_id int, pos int, element_id string, bbox array<double>, height int")).collect()
    boxes, m = {(r[1], r[3]): r[4] for r in rows}, 8 / 900

    def end(page, pos):
        known = [(r[2], r[4]) for r in rows if r[1] == page and r[4]]
        own, others = [b for q, b in known if q == pos], [b for q, b in known if q != pos]
        meet = lambda a, o: (w := min(a[2] - a[0], o[2] - o[0])) > 0 and (min(a[2], o[2]) - max(a[0], o[0])) / w >= 0.25
        return min((min(a[3], o[1] - m) for a in own for o in others if o[1] > a[1] + m and meet(a, o)), default=0.0)

    assert len(got) == len(rows)
    for r in got:
        b, e = boxes[r.slide_id, r.element_id], end(r.slide_id, r.pos)
        assert r.bbox == (b if b is None or e <= b[1] + 0.04 else pytest.approx([*b[:3], e], abs=6e-5)), r
    assert {r.slide_id for r in got if r.bbox != boxes[r.slide_id, r.element_id]} >= {3, 4}


def test_generated_texts_are_cleaned_once(spark):
    from pagemill.operators import notes

    df = spark.createDataFrame([("好的，这是笔记。\n\n# 课程笔记：A\n\nx【对应 PPT：第 3 页，元素 s3_t1】 y\n\n# 课程笔记\n\n本页介绍了 b",)], "m string").select(notes.postprocess(F.col("m")).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(notes.META[0]) == 1
    text = df.first().m
    assert "## A" in text and "p3:s3_t1" in text and "好的" not in text and "本页" not in text and "课程笔记" not in text
