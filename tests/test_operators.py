from pyspark.sql import functions as F

from pagemill.functions import geometry, text
from pagemill.operators import corpus, coverage, grounding, guard, images, layout, lineage, notes, pages, questions, sections, tables, usage


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, text.preview(F.lit(" a　b\n\nc"), 10)) == "a b c"
    assert one(spark, text.preview(F.lit("x" * 20), 5)) == "xxxx…"
    assert one(spark, text.source_tokens(F.lit("s1_t1 s1_t10, s1_t1 (s2_img3)"))) == ["s1_t1", "s1_t10", "s2_img3"]
    assert one(spark, text.source_slides(F.lit("p2:s2_t1 p12: x"))) == [2, 12]
    assert one(spark, text.slide_of(F.lit("s12_fig3"))) == 12
    assert one(spark, text.image_targets(F.lit("![a](<x/y.png>) ![](z.png)"))) == ["x/y.png", "z.png"]
    assert one(spark, text.slugify(F.lit("TCP Basics!"))) == "tcp-basics"
    assert one(spark, text.slugify(F.lit("拥塞控制"))) == "拥塞控制"
    assert one(spark, text.json_object(F.lit("```json\n{\"a\": 1}\n```")).cast("string")) == '{"a":1}'
    assert one(spark, text.json_object(F.lit("broken {")).cast("string")) is None
    assert one(spark, text.is_outline(F.lit("1. a\n2. b\n3. c")))
    assert not one(spark, text.is_outline(F.lit("1 a\n2 b\n3 c")))
    assert one(spark, text.point_from_text(F.lit("Quorum: a majority"))) == "Quorum"
    assert one(spark, text.point_from_text(F.lit("a, b, c"))) == "a, b, c" and one(spark, text.point_from_text(F.lit(" "))) == "知识点"
    assert one(spark, text.is_formula(F.lit("O(n log n)"))) and one(spark, text.is_formula(F.lit("∑ x"))) and not one(spark, text.is_formula(F.lit("a sum")))
    assert one(spark, text.heading_key(F.lit("2. 拥塞 控制："))) == "拥塞控制" and one(spark, text.title_key(F.lit("课程笔记：一、《TCP》"))) == "tcp"
    assert [one(spark, text.zh_ordinal(F.lit(n))) for n in (1, 10, 11, 20, 21)] == ["一", "十", "十一", "二十", "21"]
    runs = spark.createDataFrame([([("a<b", "#ff0000", True, None), ("c", None, None, None)],)], "r array<struct<text:string,color:string,bold:boolean,italic:boolean>>")
    assert runs.select(text.styled_text(F.col("r")).alias("v")).first().v == '<span style="color:#FF0000;font-weight:700">a&lt;b</span>c'


def test_boxes(spark):
    box = F.array(*map(F.lit, (100.0, 200.0, 50.0, 60.0)))
    assert one(spark, geometry.norm_bbox(box, F.lit("pptx"), F.lit(1000.0), F.lit(1000.0))) == [0.1, 0.2, 0.15, 0.26]
    assert one(spark, geometry.norm_bbox(box, F.lit("pdf"), F.lit(None).cast("double"), F.lit(1000.0))) is None
    a, b = F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), F.array(*map(F.lit, (0.25, 0.0, 0.75, 0.5)))
    assert abs(one(spark, geometry.iou(a, b)) - 1 / 3) < 1e-9
    assert abs(one(spark, geometry.horizontal_overlap(a, b)) - 0.5) < 1e-9


def test_coverage_marks_without_text_are_traced_but_not_visible(spark):
    elements = spark.createDataFrame([("d", 1, "s1_t1", "text", "x"), ("d", 1, "s1_img1", "image", "y"), ("e", 1, "s1_t1", "text", "x")], "deck_id string, slide_id int, element_id string, kind string, text string")
    notes = spark.createDataFrame([("d", "Shown <!-- p1: s1_t1 -->\n\n<!-- p1: s1_img1 -->")], "deck_id string, markdown string")
    items = {(r.deck_id, r.element_id): r for r in coverage.coverage_items(elements, notes).collect()}
    assert items["d", "s1_t1"].visible_covered and items["d", "s1_img1"].marker_only
    assert not items["e", "s1_t1"].trace_covered  # equal ids of two decks differ
    totals = {r.deck_id: r for r in coverage.coverage_totals(coverage.coverage_items(elements, notes)).collect()}
    assert (totals["d"].total, totals["d"].covered, totals["d"].visible_covered) == (2, 2, 1)
    assert totals["d"].required_ratio == 1.0


def test_page_without_items_is_covered(spark):
    pages_ = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "deck_id string, slide_id int")
    items = spark.createDataFrame([("d", 1, True), ("d", 2, False)], "deck_id string, slide_id int, trace_covered boolean")
    assert {r.slide_id: r.covered for r in coverage.page_coverage(pages_, items).collect()} == {1: True, 2: False, 3: True}


def test_block_ids_outlast_shifted_lines(spark):
    note = "# Notes\n\nFirst line s1_t1\n\nSecond"

    def ids(markdown):
        n = spark.createDataFrame([("d", 1, markdown)], "deck_id string, slide_id int, markdown string")
        rows = lineage.block_ids(lineage.heading_paths(lineage.markdown_blocks(n))).orderBy("ordinal").collect()
        return {r.text: (r.block_id, r.path) for r in rows}

    a, b = ids(note), ids("# Notes\n\nNew\n\nFirst line s1_t1\n\nSecond")
    assert a["First line s1_t1"] == b["First line s1_t1"] and a["Second"][1] == ["Notes"]


def test_heading_path_drops_deeper_levels(spark):
    n = spark.createDataFrame([("d", 1, "# A\n\n## B\n\nx\n\n# C\n\ny")], "deck_id string, slide_id int, markdown string")
    paths = {r.text: r.path for r in lineage.heading_paths(lineage.markdown_blocks(n)).collect()}
    assert paths["x"] == ["A", "B"] and paths["y"] == ["C"]


def test_modalities(spark):
    stats = spark.createDataFrame(
        [("d", 1, 1, 120, 0, 1, 1, 0, 0, False, 0), ("d", 2, 0, 0, 0, 1, 0, 1, 0, True, 1), ("d", 3, 1, 40, 1, 0, 0, 0, 0, True, 0), ("d", 4, 1, 200, 0, 0, 0, 0, 0, False, 0), ("d", 5, 0, 0, 0, 0, 0, 0, 0, False, 0)],
        "deck_id string, slide_id int, text_blocks long, text_chars long, tables long, images_total long, content_images long, page_images long, decorative_images long, has_screenshot boolean, warnings long",
    )
    found = {r.slide_id: r.modality for r in pages.classify_modality(stats).collect()}
    assert found == {1: "mixed", 2: "image_only", 3: "shape_diagram", 4: "native_text", 5: "decorative"}


def test_table_key_rows_keep_their_order(spark):
    rows = [["Protocol", "Reliability", "Cost"], ["TCP", "Reliable ordered delivery", "Higher"], ["UDP", "Best effort", "Lower"], ["", "", ""]]
    t = spark.createDataFrame([("d", rows), ("e", [["", ""], []])], "deck_id string, rows array<array<string>>")
    found = {r.deck_id: r for r in tables.analyze_tables(t).collect()}
    assert found["d"].has_header and [k.label for k in found["d"].key_rows] == ["TCP", "UDP"]
    assert found["e"].warning == "empty_table" and not found["e"].key_rows


def test_repeated_corner_images_are_templates(spark):
    logo = [0.02, 0.02, 0.10, 0.07]
    rows = [("d", s, f"s{s}_img1", "content", logo, 90, 50, 600, "a/logo.png") for s in (1, 2)] + [("d", 3, "s3_img1", "content", [0.2, 0.2, 0.8, 0.8], 900, 500, 60000, "a/x.png")]
    im = spark.createDataFrame(rows, "deck_id string, slide_id int, element_id string, role string, bbox array<double>, width int, height int, file_size long, path string")
    assert {r.slide_id: r.ignored for r in images.mark_templates(im).collect()} == {1: True, 2: True, 3: False}


def test_overlaps_are_suppressed_in_order(spark):
    rows = [("d", 1, i, f"c{i}", b) for i, b in enumerate([[0, 0, 0.5, 0.5], [0, 0, 0.5, 0.49], [0.5, 0.5, 1, 1], [0, 0.5, 0.5, 1], [0.5, 0, 1, 0.5]])]
    c = spark.createDataFrame([(*r[:4], [float(v) for v in r[4]]) for r in rows], "deck_id string, slide_id int, pos int, element_id string, bbox array<double>")
    assert sorted(r.element_id for r in images.suppress_overlaps(c).collect()) == ["c0", "c2", "c3"]


def test_anchor_is_nearest_preceding_text(spark):
    i = spark.createDataFrame([("d", 1, "s1_img1", [0.1, 0.4, 0.5, 0.6])], "deck_id string, slide_id int, element_id string, bbox array<double>")
    e = spark.createDataFrame([("d", 1, "s1_t1", [0.1, 0.3, 0.5, 0.35], 0), ("d", 1, "s1_t2", [0.1, 0.65, 0.5, 0.7], 1)], "deck_id string, slide_id int, element_id string, bbox array<double>, pos int")
    r = images.spatial_anchors(i, e).first()
    assert (r.anchor_id, r.reason) == ("s1_t1", "bbox_nearest_preceding_element")


def test_chunks_are_packed_greedily(spark):
    units = spark.createDataFrame([("b", "s", 1, i, t) for i, t in enumerate(["aaaa", "bbbb", "cccc", "x" * 14, "e"])], "book_id string, section_id string, page int, pos int, text string")
    rows = corpus.chunks(units, 10).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["aaaa\n\nbbbb", "cccc", "x" * 14, "e"]
    assert all(r.content_hash.startswith("sha256:") for r in rows)


def test_contents_in_two_languages(spark):
    page = "目录\n第1章 网络 .... 3\n1.1 概述 .... 5\nContents\nChapter 2 Transport ........ 12"
    p = spark.createDataFrame([("b", 1, page)], "book_id string, physical_page int, combined_text string")
    assert [r.title for r in corpus.detect_toc(p).orderBy("entry_index").collect()] == ["第1章 网络", "1.1 概述", "Chapter 2 Transport"]


def test_sections_from_headings(spark):
    p = spark.createDataFrame([("b", 1, "1", "Chapter 1 One\ntext"), ("b", 2, "2", "text"), ("b", 3, "3", "Chapter 2 Two\ntext")], "book_id string, physical_page int, printed_page_label string, combined_text string")
    rows = corpus.book_sections(p, corpus.detect_toc(p)).orderBy("start_page").collect()
    assert [(r.start_page, r.end_page, r.source) for r in rows] == [(1, 2, "heading_fallback"), (3, 3, "heading_fallback")]


def test_cost(spark):
    u = spark.createDataFrame([("d", "notes", "openai", "m", 1, 1000, 200, 500)], "deck_id string, stage string, provider string, model string, calls long, input_tokens long, cached_input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("openai/m", 1.0, 0.1, 2.0), ("m", 9.0, 9.0, 9.0)], "model_key string, input_per_1m double, cached_input_per_1m double, output_per_1m double")
    costs = usage.llm_cost(usage.with_prices(u, prices))
    assert abs(costs.first().cost_usd - 0.00182) < 1e-12
    assert usage.cost_report(costs).count() == 3


def test_ocr_cost(spark):
    u = spark.createDataFrame([("ocr", 3, 1200)], "provider string, calls long, text_chars long")
    prices = spark.createDataFrame([("ocr", 1.0, 0.5)], "provider string, per_1k_calls double, per_1k_chars double")
    assert abs(usage.ocr_cost(u, prices).first().cost_usd - 0.603) < 1e-12


def test_empty_tables(spark):
    none = spark.createDataFrame([], "deck_id string, slide_id int, element_id string, kind string, text string")
    notes = spark.createDataFrame([], "deck_id string, slide_id int, markdown string")
    assert coverage.coverage_items(none, notes).count() == 0
    assert lineage.markdown_blocks(notes).count() == 0


def test_anchor_chain(spark):
    i = spark.createDataFrame([("d", 1, "s1_img1", None, "quorum reads"), ("d", 1, "s1_img2", None, ""), ("d", 2, "s2_img1", None, ""), ("d", 3, "s3_img1", None, "")], "deck_id string, slide_id int, element_id string, bbox array<double>, text string")
    e = spark.createDataFrame(
        [("d", 1, "s1_t1", None, "Title", "title", 0), ("d", 1, "s1_t2", None, "a quorum", "paragraph", 1), ("d", 2, "s2_t1", None, "text", "paragraph", 0)],
        "deck_id string, slide_id int, element_id string, bbox array<double>, content string, type string, pos int",
    )
    found = {r.image_id: (r.anchor_id, r.reason, r.confidence) for r in grounding.anchor_images(i, e).collect()}
    assert found == {
        "s1_img1": ("s1_t2", "semantic_overlap", 0.48), "s1_img2": ("s1_t1", "page_title_fallback", 0.45), "s2_img1": ("s2_t1", "first_element_fallback", 0.4), "s3_img1": (None, "page_end_fallback", 0.25)
    }


def test_unique_names(spark):
    df = spark.createDataFrame([("d", 1, "a"), ("d", 2, "a"), ("d", 3, "b"), ("d", 4, "a")], "deck_id string, pos int, slug string")
    assert [r.slug for r in text.with_unique_names(df, ["deck_id"], "slug", "pos").orderBy("pos").collect()] == ["a", "a-2", "b", "a-3"]


def test_guard_items(spark):
    rows = [("s1_t1", "x = 1"), ("s1_t2", "TCP is called reliable"), ("s1_t3", "Stop when it fails"), ("s1_t4", "for example TCP"), ("s1_t5", "long " * 30), ("s1_t6", "Contents"), ("s1_t7", "short")]
    t = spark.createDataFrame([("d", 1, *r) for r in rows], "deck_id string, slide_id int, element_id string, content string")
    found = {r.element_id: (r.learning_role, r.confidence, r.must_explain) for r in guard.guard_text(t).collect()}
    assert found == {"s1_t1": ("formula", 0.84, True), "s1_t2": ("definition", 0.78, True), "s1_t3": ("condition", 0.74, True), "s1_t4": ("example", 0.68, True), "s1_t5": ("concept", 0.7, True), "s1_t6": ("structural", 0.72, False)}
    assert guard.required_items(guard.guard_text(t)).count() == 4
    i = spark.createDataFrame(
        [("a", "figure_crop", False, "", "", ""), ("b", "content", False, "sum", "", ""), ("c", "content", False, "", "w" * 40, ""), ("d", "content", True, "sum", "", ""), ("e", "composite_child", True, "sum", "", ""), ("f", "content", False, "", "", "cap")],
        "element_id string, role string, ignored boolean, visual_summary string, ocr_text string, caption string",
    ).selectExpr("'d' AS deck_id", "1 AS slide_id", "*", "'' AS figure_explanation", "'p' AS path")
    assert {r.element_id: (r.learning_role, r.confidence) for r in guard.guard_images(i).collect()} == {"a": ("figure_explanation", 0.8), "b": ("figure_explanation", 0.78), "c": ("ocr_key_text", 0.76), "e": ("figure_explanation", 0.78)}


def test_code_with_its_output_cause_and_fix_is_one_group(spark):
    rows = [("s1_t1", "title", "Input", 0.02), ("s1_t2", "paragraph", "#include <iostream>\nint main() { cin >> x; }", 0.1), ("s1_t3", "paragraph", "输出: Data Entered", 0.4), ("s1_t4", "paragraph", "因为换行符留在缓冲区", 0.6), ("s1_t5", "paragraph", "需要用 cin.ignore 清除换行符", 0.8)]
    t = spark.createDataFrame([("d", 1, i, k, c, [0.1, y, 0.9, y + 0.05]) for i, k, c, y in rows], "deck_id string, slide_id int, element_id string, type string, content string, bbox array<double>")
    blocks = layout.semantic_blocks(t)
    assert {r.element_id: r.block_type for r in blocks.collect()} == {"s1_t1": "title", "s1_t2": "code", "s1_t3": "output", "s1_t4": "cause_explanation", "s1_t5": "fix"}
    grouped = layout.group_blocks(blocks)
    g = layout.group_attrs(grouped).collect()
    assert [(r.group_id, r.scene_type, r.block_ids) for r in g] == [("p1_sg1", "code_causal_explanation", ["s1_t2", "s1_t3", "s1_t4", "s1_t5"])] and "getline" in g[0].learning_goal
    assert [(r.source, r.relation, r.target) for r in layout.semantic_relations(blocks).orderBy("pos").collect()] == [("s1_t2", "demonstrates", "s1_t3"), ("s1_t2", "explained_by", "s1_t4"), ("s1_t5", "fixes", "s1_t2"), ("s1_t4", "leads_to_fix", "s1_t5")]
    pages_ = spark.createDataFrame([("d", 1, True), ("d", 2, False)], "deck_id string, slide_id int, has_screenshot boolean")
    assert {r.slide_id: r.layout_confidence for r in layout.layout_confidence(pages_, blocks, grouped).collect()} == {1: 0.9, 2: 0.2}


def test_composites(spark):
    boxes = [[0.2 + 0.11 * i, 0.3, 0.3 + 0.11 * i, 0.4] for i in range(5)]
    i = spark.createDataFrame([("d", 1, f"s1_img{k}", "content", [float(v) for v in bb], False, None) for k, bb in enumerate(boxes)], "deck_id string, slide_id int, element_id string, role string, bbox array<double>, ignored boolean, ignore_reason string")
    p = images.composite_parts(i)
    g = images.part_groups(images.neighbor_pairs(p))
    words = spark.createDataFrame([("d", 1, "s1_t1", [0.2, 0.42, 0.5, 0.45])], "deck_id string, slide_id int, element_id string, bbox array<double>")
    page = spark.createDataFrame([("d", 1, "mixed")], "deck_id string, slide_id int, modality string")
    e = images.evaluate_groups(p.join(g, ["deck_id", "slide_id", "element_id"]), words, page)
    made, after = images.select_composites(e, i)
    r = made.first()
    assert (r.element_id, r.confidence, r.source_ids) == ("s1_fig1", 0.725, [f"s1_img{k}" for k in range(5)] + ["s1_t1"])
    assert {x.ignore_reason for x in after.collect()} == {"part_of_composite:s1_fig1"}


def test_sections_of_an_outline(spark):
    rows = [(1, "Contents", "Contents\n1\nLink layer\n2\nNetwork layer"), (2, "Link layer", "x"), (3, "More", "y"), (4, "2. Network layer", "z")]
    p = spark.createDataFrame([("d", *r) for r in rows], "deck_id string, slide_id int, title string, text string")
    o = sections.outline_items(p)
    assert [(r.title, r.number) for r in o.orderBy("rank").collect()] == [("Link layer", "1"), ("Network layer", "2")]
    bounds = sections.section_boundaries(p, o)
    found = sections.sections(p, bounds, sections.section_titles(p, bounds, o)).orderBy("section").collect()
    assert [(r.start, r.end, r.title) for r in found] == [(1, 1, "Contents"), (2, 3, "Link layer"), (4, 4, "Network layer")]
    plan = spark.createDataFrame([("d", 0, 3, "Later", ""), ("d", 1, 99, "no page", ""), ("d", 2, 3, "again", "")], "deck_id string, pos int, start_slide_id int, title string, reason string")
    given = sections.normalize_plan(plan, p, sections.sections(p, bounds)).orderBy("section").collect()
    assert [(r.start, r.end, r.reason, r.method) for r in given] == [(1, 2, "first_page_inserted", "llm"), (3, 4, "llm_boundary", "llm")]


def test_question_sets(spark):
    c = spark.createDataFrame([("d", 0, 1, "s1_t1", "Quorum: a majority of the nodes", "definition"), ("d", 1, 2, "s2_t1", "Leader: the node that decides", None)], "deck_id string, priority int, slide_id int, element_id string, text string, role string")
    items = questions.study_items(c)
    asked = questions.questions(items, 4).orderBy("i").collect()
    assert [(q.question_id, q.type, q.points) for q in asked] == [("q1", "choice", 2), ("q2", "true_false", 1), ("q3", "short", 6), ("q4", "short", 6)]
    assert asked[0].options[0] == "Quorum: a majority of the nodes" and len(asked[0].options) == 4 and asked[0].options[3].startswith("只背「Quorum」")
    exam = questions.final_exam(questions.questions(items, 4)).first()
    assert (exam.points, exam.minutes) == (15, 30)
    raw = spark.createDataFrame([("d", '{"questions": [{"type": "选择题", "options": ["a"], "answer": "9"}, {"type": "choice", "options": ["a", "b"], "answer": "9"}, {"type": "x", "question": " q "}]}'), ("e", "broken")], "deck_id string, json string")
    given = questions.normalize_questions(raw, questions.questions(items, 4).withColumn("deck_id", F.lit("e"))).collect()
    assert [(q.type, q.answer, q.points) for q in sorted((g for g in given if g.deck_id == "d"), key=lambda g: g.i)] == [("short", "9", 2), ("choice", "1", 2), ("short", "", 6)]
    assert sum(g.deck_id == "e" for g in given) == 4


def test_note_texts(spark):
    md = "好的，这是笔记。\n\n# A\n\n`![](a.png)`\n\n说明【对应 PPT：第 3 页，元素 s3_t1】\n\n### B\n\n#### C\n\n### D"
    done = one(spark, notes.postprocess(F.lit(md)))
    assert done == "## A\n\n![图示](a.png)\n\n说明<!-- source: p3:s3_t1 -->\n\n### B\n\n#### C\n\n### D"
    assert one(spark, notes.number_headings(F.lit(done))).split("\n")[-5:] == ["### 1. B", "", "#### 1.1 C", "", "### 2. D"]
    toc = notes.with_contents(spark.createDataFrame([("# T\n\n## A\n\nx\n\n## A\n\n### B",)], "markdown string")).first().markdown
    assert toc.startswith("# T\n\n## 目录\n\n- [A](#a)\n- [A](#a-2)\n  - [B](#b)\n\n## A")
    assert one(spark, notes.prepare_chunk(notes.without_generated(F.lit("# Topic\n\n# Intro\n\ntext\n\n## 生成信息\n\nmade\n\n# Next")), F.lit("Topic"))) == "### Intro\n\ntext\n\n### Next"
    n = spark.createDataFrame([("d", "Text\n<!-- source: p1:s1_t1 -->\n\nMore\n<!-- source: p1:s1_t2 -->\n")], "deck_id string, markdown string")
    f = spark.createDataFrame([("d", 1, "s1_img1", 1, "x.png", "cap", "s1_t1", "![cap](x.png)"), ("d", 9, "s9_img1", 2, "y.png", "cap", None, "![cap](y.png)")], "deck_id string, slide_id int, element_id string, pos int, path string, caption string, anchor_id string, block string")
    placed = notes.place_figures(n, f).first().markdown
    assert placed.index("Text") < placed.index("x.png") < placed.index("More") < placed.index("### 第 9 页图示") < placed.index("y.png")


def test_links_of_blocks_to_images(spark):
    n = spark.createDataFrame([("d", 1, "![a](notes.assets/images/x.png)\n\nText s1_t1")], "deck_id string, slide_id int, markdown string")
    i = spark.createDataFrame([("d", "s1_img1", "images/x.png")], "deck_id string, element_id string, path string")
    e = spark.createDataFrame([("d", "s1_img1"), ("d", "s1_t1")], "deck_id string, element_id string")
    assert sorted((r.ordinal, r.element_id) for r in lineage.block_links(lineage.markdown_blocks(n), e, i).collect()) == [(1, "s1_img1"), (2, "s1_t1")]
    assert lineage.block_ids(lineage.heading_paths(lineage.markdown_blocks(n)), i).where("ordinal = 1").first().block_id.startswith("nb_img_")


def test_bad_words_in_options_lower_the_score(spark):
    shape = "deck_id string, type string, options array<string>, explanation string, pitfall string, source_refs array<string>, question string"
    clean = [f"a clean option {i}" for i in range(4)]
    bad = ["a Decoration of pages", "an unrelated option", "a third option here", "a fourth option here"]
    rows = [(d, "choice", o, "x", "y", ["P1"], "why") for d, o in (("clean", clean), ("bad", bad), ("few", clean[:3]), ("same", ["a long equal option"] * 4))]
    got = {r.deck_id: r.choice_distractor_score for r in questions.question_quality(spark.createDataFrame(rows, shape)).collect()}
    assert got == {"clean": 1.0, "bad": 0.6, "few": 0.25, "same": 0.663}


def test_guard_names_headings(spark):
    blocks = spark.createDataFrame([("d", 1, "s1_t1", "x = y", "title"), ("d", 1, "s1_t2", "x = y", "paragraph")], "deck_id string, slide_id int, element_id string, content string, type string")
    assert {r.element_id: r.reason for r in guard.guard_text(blocks).collect()} == {"s1_t1": "heading;formula_like", "s1_t2": "formula_like"}


def test_foreign_json_as_tables(spark):
    from pagemill.sources import decks

    doc = '{"slides": [{"page": 4, "blocks": [{"type": "Section Title", "text": "<b>Top</b>"}, {"items": [{"id": "k", "content": "inner"}, {"label": "table", "rows": [["a", null], ["b", 1]]}]}, {"src": "x.png", "alt_text": "pic", "bbox": [0, 1, 2, 3]}]}, {"title": "bare", "text": "only text"}]}'
    raw = spark.createDataFrame([("d", doc), ("broken", "{"), ("none", "[]"), ("null", None)], "deck_id string, json string")
    out = decks.foreign_tables(raw)
    assert sorted((r.deck_id, r.slide_id, r.title) for r in out["pages"].collect()) == [("d", 2, "only text"), ("d", 4, "Top")]
    assert sorted((r.slide_id, r.pos, r.element_id, r.type, r.content) for r in out["text_blocks"].collect()) == [(2, 0, "s2_t1", "paragraph", "only text"), (4, 0, "s4_t1", "heading", "Top"), (4, 1, "k", "heading", "inner")]
    assert [(r.element_id, r.rows) for r in out["tables"].collect()] == [("s4_tbl1", [["a", ""], ["b", "1"]])]
    assert [(r.element_id, r.path, r.caption, r.bbox) for r in out["images"].collect()] == [("s4_img1", "x.png", "pic", [0.0, 1.0, 2.0, 3.0])]


def test_crops_on_the_limit_do_not_depend_on_the_order_of_boxes(spark):
    """Text covers 0.55 of the crop but for the last digit, which changes with the order of the boxes."""
    import itertools
    import math
    import random

    from pagemill.operators import images

    rng, crop, pages = random.Random(5), [0.0, 0.0, 0.5, 0.5], []
    while len(pages) < 30 * 6:
        boxes = [[0.0, 0.0, rng.randint(1, 50) / 100, rng.randint(1, 50) / 100] for _ in range(3)]
        parts = [b[2] * b[3] for b in boxes]
        orders = list(itertools.permutations(range(3)))
        if {((parts[a] + parts[b]) + parts[c]) / 0.25 >= 0.55 for a, b, c in orders} == {True, False}:
            pages += [([boxes[i] for i in order], math.fsum(parts) / 0.25 >= 0.55) for order in orders]
    rows = [(1, n, 1, "a", crop, "", "photo", 0.9, 1600, 900) for n in range(len(pages))]
    crops = spark.createDataFrame(rows, "deck_id long, slide_id int, pos int, element_id string, bbox array<double>, label string, content_type string, confidence double, width int, height int")
    layout = spark.createDataFrame([(1, n, "text", b) for n, (boxes, _) in enumerate(pages) for b in boxes], "deck_id long, slide_id int, kind string, bbox array<double>")
    got = {r.slide_id: r.skip_reason for r in images.crop_reject(crops, layout).collect()}
    assert got == {n: "structured_text_region" if covered else None for n, (_, covered) in enumerate(pages)}


def test_context_is_folded_for_a_batch_at_once(spark):
    """As a plain fold gives it, for rows without boxes or context too; no lambda runs over a page's boxes for each row."""
    import random

    from pagemill.operators import images

    rng = random.Random(3)
    box = lambda: (lambda x, y: [x, y, round(x + rng.randint(0, 30) / 100, 4), y + rng.randint(0, 30) / 100])(rng.randint(0, 70) / 100, rng.randint(0, 70) / 100)
    crops = [(1, n % 12, n, None if n % 17 == 0 else box(), rng.choice(["chart", "photo", None])) for n in range(200)]
    context = [(1, n % 11, f"t{n}", n, None if n % 13 == 0 else box(), rng.choice(["title", "legend", "other", None])) for n in range(90)]
    found = images.merge_context(spark.createDataFrame(crops, "deck_id long, slide_id int, pos int, bbox array<double>, content_type string"), spark.createDataFrame(context, "deck_id long, slide_id int, element_id string, pos int, bbox array<double>, role string"))
    got = {r.pos: (r.bbox, r.merged) for r in found.collect()}

    def shared(a, q, i):
        least = min(a[i + 2] - a[i], q[i + 2] - q[i])
        return max(0.0, min(a[i + 2], q[i + 2]) - max(a[i], q[i])) / least if least else 0.0

    for _, slide, pos, a, kind in crops:
        merged = []
        for _, page, _, _, q, role in context:
            if page != slide or a is None or q is None:
                continue
            x, y = (max(0.0, q[i] - a[i + 2], a[i] - q[i + 2]) for i in (0, 1))
            across, along = shared(a, q, 0), shared(a, q, 1)
            title = (y <= 0.06 and across >= 0.28) or (kind == "chart" and y <= 0.075 and across >= 0.18)
            legend = (y <= 0.055 and across >= 0.18) or (x <= 0.045 and along >= 0.22)
            if {"title": title, "legend": legend}.get(role):
                a = [round(v, 4) for v in (min(a[0], q[0]), min(a[1], q[1]), max(a[2], q[2]), max(a[3], q[3]))]
                merged += [f"merged_nearby_{role}"] * (f"merged_nearby_{role}" not in merged)
        assert got[pos] == (a, merged)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
