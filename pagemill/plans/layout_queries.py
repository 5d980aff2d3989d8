"""Layout, elements and question sets on decks of documents with boxes by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, elements, guard, layout, questions
from ..shared import written
from . import bindings as b

#: What some lines say besides, so that code, outputs, causes, fixes and notes occur.
_SAYS = (" int main() { return 0; }", " 输出: Data Entered", " 因为换行符留在缓冲", " 需要清空缓冲", " 注意 → x", "")


def _text(s: SparkSession, d: str) -> DataFrame:
    """A line's box follows from its number, with a wide gap after every sixth line; every ninth line has none."""
    top = (F.col("n") * 3 + F.floor(F.col("n") / 6) * 20) / 200.0
    box = F.array(F.lit(0.1), F.round(top, 4), F.lit(0.9), F.round(top + 0.01, 4))
    says = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*map(F.lit, _SAYS)), ((F.col("doc_id") + F.col("n")) % 6 + 1).cast("int"))).otherwise("")
    kind = F.when(F.col("n") == 1, "title").when(F.length("content") <= 120, "heading").otherwise("paragraph")
    return b.blocks(s, d).select("deck_id", "slide_id", "element_id", "n", F.concat("content", says).alias("content"), kind.alias("type"), F.when(F.col("n") % 9 != 0, box).alias("bbox"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return layout.semantic_blocks(_text(s, d))


def _grouped(s: SparkSession, d: str) -> DataFrame:
    return layout.group_blocks(_blocks(s, d))


def _relations(s: SparkSession, d: str) -> DataFrame:
    return layout.semantic_relations(_blocks(s, d))


def _layout(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, derived once and written, their groups and relations."""
    blocks = written(_blocks(s, d), "blocks")
    return blocks, layout.group_blocks(blocks), layout.semantic_relations(blocks)


def _payload(blocks: DataFrame, grouped: DataFrame, relations: DataFrame) -> DataFrame:
    return layout.layout_payload(blocks, layout.group_attrs(grouped), relations)


def _confidence(s: SparkSession, d: str) -> DataFrame:
    p = b.pages(s, d).select("deck_id", "slide_id", (F.col("doc_id") % 3 != 1).alias("has_screenshot"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("vision_page_screenshot"))).otherwise(F.array().cast("array<string>")).alias("hints"), F.lit("native_text").alias("modality"), (F.col("doc_id") % 5 == 0).alias("has_images"), (F.length("text") > 0).alias("has_content"))
    return layout.needs_enhancement(layout.layout_confidence(p, _blocks(s, d), _grouped(s, d)), _blocks(s, d))


def _elements(s: SparkSession, d: str) -> DataFrame:
    im = b.pages(s, d).where("doc_id % 5 < 2").select("deck_id", "slide_id", F.concat(F.lit("s"), "slide_id", F.lit("_img1")).alias("element_id"), (F.col("doc_id") % 11 == 0).alias("ignored"), F.array(F.lit(0.2), F.lit(0.05), F.lit(0.8), F.lit(0.3)).alias("bbox"))
    return elements.build_elements(_text(s, d), images=im)


def _enriched(s: SparkSession, d: str) -> DataFrame:
    g = guard.guard_text(b.blocks(s, d)).withColumn("pos", F.lit(0))
    m = _blocks(s, d).select("deck_id", "element_id", "learning_role", "must_explain", F.col("importance").alias("confidence"), F.lit(0).alias("pos"))
    return elements.enrich(_elements(s, d), g, m)


def _items(s: SparkSession, d: str) -> DataFrame:
    g = guard.required_items(guard.guard_text(b.blocks(s, d))).select("deck_id", "element_id", F.col("learning_role").alias("role"))
    c = b.blocks(s, d).join(g, ["deck_id", "element_id"], "left").select("deck_id", F.when(F.col("role").isNull(), 1).otherwise(0).alias("priority"), "slide_id", "element_id", F.col("content").alias("text"), "role")
    return questions.study_items(c)


def _asked(s: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """Questions over a deck's few items, which are derived once and written, as three steps read them."""
    return questions.questions(written(_items(s, d), "items") if items is None else items)


def _figure_notes(s: SparkSession, d: str) -> DataFrame:
    """An image with a caption on one of five pages."""
    i = b.pages(s, d).where("doc_id % 5 = 0").select("deck_id", "slide_id", F.concat(F.lit("s"), "slide_id", F.lit("_img1")).alias("element_id"), F.lit(False).alias("ignored"), F.concat(F.lit("picture of "), "title").alias("caption"), F.lit("assets/x.png").alias("path"), *[F.lit("").alias(c) for c in ("figure_explanation", "visual_summary", "ocr_text")])
    return questions.figure_notes(i.limit(0).select("deck_id", "slide_id", "element_id", F.col("caption").alias("text")), i)


def _sectioned(items: DataFrame) -> DataFrame:
    """Items by tens of pages as sections."""
    return items.select("deck_id", "pos", F.concat(F.lit("part "), F.floor(F.col("slide_id") / 10).cast("string")).alias("section"), F.array(F.concat(F.lit("P"), "slide_id")).alias("source_refs"))


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    """Answers of a model for sources with an even number, with gaps in their fields; the other answers are broken."""
    refs = F.array(F.concat(F.lit("P"), "slide_id"))
    items = written(_items(s, d), "items")
    own = items.select("deck_id", "pos", F.lit("base").alias("section"), "importance", "point", "explanation", "why", "pitfall", refs.alias("source_refs"))
    gap = lambda n, c: F.when(F.col("pos") % n == 0, "").otherwise(F.col(c)).alias(c)
    level = F.element_at(F.array(*map(F.lit, ("必考", "x", " FREQ ", "了解"))), F.col("pos") % 4 + 1).alias("importance")
    entry = F.struct("pos", F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("S "), "pos")).alias("section"), level, gap(5, "point"), gap(7, "explanation"), F.lit("").alias("why"), "pitfall", refs.alias("source_refs"))
    whole = F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(entry)).alias("checklist")).alias("review")))
    raw = items.groupBy("deck_id").agg(whole.alias("json")).withColumn("json", F.when(F.col("deck_id").rlike("[02468]/"), F.col("json")).otherwise(F.substring("json", 1, 20)))
    return questions.normalize_review(raw, own)


def _given_layout(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A model's layout: every third block, some by a wrong id; groups of four lines, some of other pages only; a relation from each fifth line to the next one."""
    e = b.blocks(s, d)
    wrong = F.when(F.col("n") % 7 == 0, F.concat("element_id", F.lit("x"))).otherwise(F.col("element_id"))
    four = F.floor((F.col("n") - 1) / 4).cast("string")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", F.when((F.col("n") % 5 == 0) | (F.col("doc_id") % 9 == 4), F.concat("element_id", F.lit("y"))).otherwise(F.col("element_id")).alias("id")))), lambda x: x["id"])
    groups = e.groupBy("deck_id", "slide_id", four.alias("group_id")).agg(F.concat(ids, F.slice(ids, 1, 1)).alias("block_ids"))
    relations = e.where("n % 5 = 1").select("deck_id", "slide_id", F.col("element_id").alias("source"), F.concat(F.lit("s"), "slide_id", F.lit("_t"), F.col("n") + 1).alias("target"))
    return e.where("n % 3 = 0").select("deck_id", "slide_id", wrong.alias("element_id")), groups, relations


def _overlay(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return layout.overlay_report(b.blocks(s, d), *_given_layout(s, d))


def _roles(s: SparkSession, d: str) -> DataFrame:
    """The primary role of each line and image: what it teaches, else its type."""
    none = F.lit(None).cast("string")
    types = _text(s, d).select("deck_id", "element_id", F.col("type").alias("text_type"))
    return _enriched(s, d).join(types, ["deck_id", "element_id"], "left").select("deck_id", "element_id", elements.primary_role(F.col("kind"), F.col("learning_role"), F.col("text_type"), none, F.lit("content"), none).alias("role"))


QUERIES = {
    "p5_normalize_review": lambda s, d: _reviewed(s, d).select("deck_id", "pos", "section", "importance", F.md5("point").alias("point_md5"), F.md5("explanation").alias("explanation_md5"), F.array_join("source_refs", ",").alias("source_refs")),
    "l7_overlay_report": lambda s, d: _overlay(s, d)[0],
    "l7_overlay_references": lambda s, d: _overlay(s, d)[1],
    "e3_primary_role": _roles,
    "l1_semantic_blocks": lambda s, d: _blocks(s, d).drop("bbox", "source_ids", "preview"),
    "l3_group_blocks": lambda s, d: _grouped(s, d).select("deck_id", "slide_id", "element_id", "group_id"),
    "l4_group_attrs": lambda s, d: layout.group_attrs(_grouped(s, d)).select("deck_id", "slide_id", "group_id", "scene_type", "crop_policy", F.size("block_ids").alias("n_blocks"), "importance"),
    "l5_relations": lambda s, d: _relations(s, d).select("deck_id", "slide_id", "source", "target", "relation"),
    "l6_layout_confidence": lambda s, d: _confidence(s, d).select("deck_id", "slide_id", "layout_confidence", "needs_vision", "reason"),
    "l8_layout_report": lambda s, d: layout.layout_report(*_layout(s, d)).withColumn("grouped_share", F.round("grouped_share", 6)),
    "l9_layout_payload": lambda s, d: _payload(*_layout(s, d)),
    "e1_build_elements": lambda s, d: _elements(s, d).drop("bbox"),
    "e4_enrich": lambda s, d: _enriched(s, d).select("deck_id", "slide_id", "element_id", "learning_role", "must_explain", "confidence", "confidence_source"),
    "e5_coverage_state": lambda s, d: elements.coverage_state(_enriched(s, d), coverage.coverage_items(b.elements(s, d), b.notes(s, d))).groupBy("deck_id", "kind", "state").agg(F.count(F.lit(1)).alias("n")),
    "e6_reading_order": lambda s, d: elements.reading_order(_elements(s, d)).select("deck_id", "slide_id", "element_id", "reading_order"),
    "e7_element_index": lambda s, d: elements.element_index(_elements(s, d), _text(s, d).select("deck_id", "element_id", F.col("type").alias("element_type"))),
    "p1_study_items": lambda s, d: _items(s, d).select("deck_id", "pos", "element_id", "slide_id", "priority", "importance", F.md5("point").alias("point_md5"), F.md5("pitfall").alias("pitfall_md5")),
    "p3_questions": lambda s, d: _asked(s, d).select("deck_id", "question_id", "i", "type", "points", "element_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), F.md5("explanation").alias("explanation_md5")),
    "p4_choice_options": lambda s, d: questions.choice_options(written(_items(s, d), "items")).select("deck_id", "pos", F.size("options").alias("n_options"), F.md5(F.array_join("options", "|")).alias("options_md5")),
    "p6_attach_figures": lambda s, d: questions.attach_figures(_asked(s, d), _figure_notes(s, d)).select("deck_id", "question_id", F.array_join("image_refs", ",").alias("image_refs")),
    "p7_section_pack": lambda s, d: questions.section_pack(_sectioned(items := written(_items(s, d), "items")), _asked(s, d, items), _figure_notes(s, d).select("deck_id", F.lit("图表速查").alias("section"))),
    "p8_final_exam": lambda s, d: questions.final_exam(_asked(s, d)).drop("digest"),
    "p9_question_quality": lambda s, d: questions.question_quality(_asked(s, d)).select("deck_id", *[F.col(c) for c in ("choice_distractor_score", "explanation_score", "source_ref_score", "question_mix_score", "figure_question_score", "mechanical_definition_score", "questions_total", "choice_questions_total")], F.array_join("flags", ",").alias("flags")),
    "p10_methods": lambda s, d: questions.methods(_items(s, d).withColumn("explanation", F.concat(F.when(F.col("slide_id") % 3 == 0, "步骤：").otherwise(""), "explanation"))).select("deck_id", "pos", F.md5("name").alias("name_md5")),
    "p10_logic_chains": lambda s, d: questions.logic_chains(b.pages(s, d).select("deck_id").distinct(), b.pages(s, d).limit(0).select("deck_id", F.lit(1).alias("pos"), *[F.lit("").alias(c) for c in ("source", "target", "reason")]), b.pages(s, d).limit(0).select("deck_id", F.lit(1).alias("section"), "title", F.lit(1).alias("start")), b.pages(s, d)).select("deck_id", "pos", "title", F.md5(F.array_join("steps", "|")).alias("steps_md5")),
    "p11_exam_lines": lambda s, d: questions.exam_lines(_asked(s, d)).select("deck_id", "i", "part", F.md5("line").alias("line_md5")),
    "p11_review_lines": lambda s, d: questions.review_lines(_items(s, d)).select("deck_id", "pos", "part", F.md5("line").alias("line_md5")),
    "p12_study_payload": lambda s, d: questions.study_payload(b.pages(s, d), guard.guard_text(b.blocks(s, d)), coverage.coverage_totals(coverage.coverage_items(b.elements(s, d), b.notes(s, d)))),
}

_B = "WITH " + b.BLOCKS_SQL + r""",
txt AS (
  SELECT *, content || CASE WHEN doc_id % 3 = 0 THEN [' int main() { return 0; }', ' 输出: Data Entered', ' 因为换行符留在缓冲', ' 需要清空缓冲', ' 注意 → x', ''][(doc_id + n) % 6 + 1] ELSE '' END AS said,
         CASE WHEN n = 1 THEN 'title' WHEN length(content) <= 120 THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN n % 9 <> 0 THEN round((n * 3 + (n // 6) * 20) / 200.0, 4) END::DOUBLE AS y FROM blocks),
sig AS (
  SELECT *, lower(said) AS lo,
    regexp_matches(lower(said), '#include|using namespace|main\(\)|cout|cin|getline|std::|return |char |string |int ') OR (length(said) - length(regexp_replace(said, '[{};<>=]', '', 'g')) >= 4 AND regexp_matches(lower(said), '(^|[^\p{L}\p{N}_])(if|for|while|void|int|char|string|cout|cin)($|[^\p{L}\p{N}_])')) AS code,
    regexp_matches(lower(said), '(^|[^\p{L}\p{N}_])enter\s+(your|student)') OR (regexp_matches(said, 'Data Entered|Student Number|Student Name|Hello John|输入|输出') AND contains(said, ':')) AS outp,
    regexp_matches(said, '(?i)因为|由于|导致|所以|因此|异常|留在|依然|被接下来|流提取|换行符|空白字符|缓冲|before|after') AS cause, regexp_matches(said, '(?i)cin\.ignore|ignore\(|需要|必须|清空|清除|丢弃|解决|修复|避免|之前|之后') AS fix,
    regexp_matches(said, '(?i)×|√|->|=>|注意|提示|关键|红色|蓝框') AS note, length(regexp_replace(said, '[^一-鿿]', '', 'g')) >= 4 OR regexp_matches(said, '(?i)(^|[^\p{L}\p{N}_])(because|therefore|need|before|after|fix|causes?)($|[^\p{L}\p{N}_])') AS explains FROM txt),
typed AS (
  SELECT *, CASE WHEN type = 'title' THEN 'title' WHEN explains AND fix THEN 'fix' WHEN explains AND cause THEN 'cause_explanation' WHEN code THEN 'code' WHEN outp THEN 'output' WHEN fix THEN 'fix' WHEN cause THEN 'cause_explanation' WHEN note THEN 'annotation'
    WHEN contains(lo, 'include') AND length(said) < 80 THEN 'code' WHEN type = 'heading' AND length(said) <= 80 THEN 'concept_label' ELSE 'explanation' END AS block_type FROM sig),
sb AS (
  SELECT deck_id, slide_id, element_id, n, said, block_type, y, CASE block_type WHEN 'title' THEN 'structural' WHEN 'code' THEN 'code_example' WHEN 'output' THEN 'runtime_output' WHEN 'fix' THEN 'fix' WHEN 'cause_explanation' THEN 'cause'
      WHEN 'annotation' THEN CASE WHEN cause OR fix THEN 'causal_annotation' ELSE 'visual_annotation' END ELSE 'concept' END AS learning_role, block_type <> 'title' AS must_explain,
    round(least(1.0, CASE block_type WHEN 'title' THEN 0.2 WHEN 'code' THEN 0.86 WHEN 'output' THEN 0.78 WHEN 'fix' THEN 0.88 WHEN 'cause_explanation' THEN 0.86 WHEN 'annotation' THEN 0.76 WHEN 'concept_label' THEN 0.58 ELSE 0.62 END + CASE WHEN length(said) >= 160 THEN 0.04 ELSE 0 END), 3)::DOUBLE AS importance,
    CASE WHEN y IS NULL THEN 9999.0 ELSE round(y * 1000 + 0.1, 4) END::DOUBLE AS layout_order, CASE WHEN block_type IN ('code', 'output', 'fix', 'cause_explanation', 'annotation') THEN 'text_or_group_scene' WHEN block_type = 'title' THEN 'skip_crop' ELSE 'text_only' END AS crop_policy FROM typed),
gap AS (
  SELECT *, bool_or(block_type = 'code') OVER p AND bool_or(learning_role IN ('runtime_output', 'cause', 'fix', 'causal_annotation')) OVER p AS scene, max(y + 0.01) OVER (PARTITION BY deck_id, slide_id ORDER BY layout_order, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
  FROM sb WHERE must_explain WINDOW p AS (PARTITION BY deck_id, slide_id)),
grp AS (
  SELECT *, 'p' || slide_id || '_sg' || CAST(1 + CASE WHEN scene THEN 0 ELSE sum(CASE WHEN y - round(low, 4) > 0.16 THEN 1 ELSE 0 END) OVER (PARTITION BY deck_id, slide_id ORDER BY layout_order, element_id) END AS BIGINT) AS group_id FROM gap),
attrs AS (
  SELECT deck_id, slide_id, group_id, CASE WHEN bool_or(block_type = 'code') AND bool_or(learning_role = 'fix') THEN 'code_causal_explanation' WHEN bool_or(block_type = 'code') AND bool_or(learning_role = 'runtime_output') THEN 'code_example_with_output' ELSE 'concept_explanation' END AS scene_type,
    CAST(count(*) AS INTEGER) AS n_blocks, max(importance) AS importance FROM grp GROUP BY ALL),
kinds AS (SELECT deck_id, slide_id, element_id, k, row_number() OVER (PARTITION BY deck_id, slide_id, k ORDER BY layout_order, element_id) AS r
  FROM (SELECT *, unnest(list_filter([CASE WHEN block_type = 'code' THEN 'code' END, CASE WHEN block_type = 'output' THEN 'output' END, CASE WHEN learning_role = 'cause' THEN 'cause' END, CASE WHEN learning_role = 'fix' THEN 'fix' END], lambda x: x IS NOT NULL)) AS k FROM sb) QUALIFY r <= 2),
rel AS (
  SELECT a.deck_id, a.slide_id, CASE WHEN b.k = 'fix' AND a.k = 'code' THEN b.element_id ELSE a.element_id END AS source, CASE WHEN b.k = 'fix' AND a.k = 'code' THEN a.element_id ELSE b.element_id END AS target,
    CASE WHEN a.k = 'cause' THEN 'leads_to_fix' WHEN b.k = 'output' THEN 'demonstrates' WHEN b.k = 'cause' THEN 'explained_by' ELSE 'fixes' END AS relation,
    row_number() OVER (PARTITION BY a.deck_id, a.slide_id ORDER BY CASE a.k WHEN 'code' THEN 0 ELSE 1 END, a.r, CASE b.k WHEN 'output' THEN 0 WHEN 'cause' THEN 1 ELSE 2 END, b.r) AS i
  FROM kinds a JOIN kinds b ON a.deck_id = b.deck_id AND a.slide_id = b.slide_id AND ((a.k = 'code' AND b.k IN ('output', 'cause', 'fix')) OR (a.k = 'cause' AND b.k = 'fix')) QUALIFY i <= 10)"""
_E = _B + r""",
el AS (
  SELECT deck_id, slide_id, element_id, 'text' AS kind, false AS ignored, CASE WHEN n % 9 <> 0 THEN round(round((n * 3 + (n // 6) * 20) / 200.0, 4) * 1000 + 0.1, 4) END::DOUBLE AS layout_order FROM blocks
  UNION ALL SELECT deck_id, slide_id, 's' || slide_id || '_img1', 'image', doc_id % 11 = 0, 50.2 FROM pages WHERE doc_id % 5 < 2)"""


def guard_sql(blocks: str = "blocks") -> str:
    """Learning items of lines in SQL, from a table with deck_id, slide_id, element_id, content."""
    return rf""",
g0 AS (SELECT deck_id, slide_id, element_id, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS c FROM {blocks}),
g1 AS (
  SELECT *, {b._KEY.format('c')} IN ('目录', '课程目录', '本章目录', '章节导航', 'contents', 'outline', 'agenda') AS st FROM g0 WHERE c <> ''),
g2 AS (
  SELECT *, CASE WHEN regexp_matches(c, '[=<>≤≥∑∀∃]|\\frac|\\sum|\\forall|O\([^)]+\)') THEN 'formula' WHEN regexp_matches(lower(c), '定义|称为|是指|consistency|definition|means|called') THEN 'definition'
    WHEN regexp_matches(lower(c), '如果|当|只有|必须|条件|because|if |when |only if|must') THEN 'condition' WHEN regexp_matches(lower(c), '例如|案例|example|e\.g\.') THEN 'example' WHEN length(c) >= 120 AND NOT st THEN 'concept' WHEN st THEN 'structural' END AS r FROM g1),
guard AS (
  SELECT deck_id, slide_id, element_id, 'text' AS kind, r AS learning_role, r <> 'structural' AS must_explain,
    (CASE r WHEN 'formula' THEN 0.84 WHEN 'definition' THEN 0.78 WHEN 'condition' THEN 0.74 WHEN 'example' THEN 0.68 WHEN 'concept' THEN 0.70 ELSE 0.72 END)::DOUBLE AS confidence, c FROM g2 WHERE r IS NOT NULL)"""


_ENRICH = _E + guard_sql() + r""",
enr AS (
  SELECT e.*, coalesce(g.learning_role, s.learning_role) AS learning_role, coalesce(g.must_explain, s.must_explain) AS must_explain, round(coalesce(g.confidence, s.importance, 0.5), 3)::DOUBLE AS confidence,
    CASE WHEN g.confidence IS NOT NULL THEN 'guard' WHEN s.importance IS NOT NULL THEN 'semantic' ELSE 'default' END AS confidence_source
  FROM el e LEFT JOIN guard g ON g.deck_id = e.deck_id AND g.element_id = e.element_id LEFT JOIN sb s ON s.deck_id = e.deck_id AND s.element_id = e.element_id)"""
_STATE = "WITH " + b.ITEMS_SQL + _ENRICH[len("WITH " + b.BLOCKS_SQL):].replace("items AS", "items_AS") + r""",
state AS (
  SELECT e.deck_id, e.kind, CASE WHEN e.ignored THEN 'ignored' WHEN i.visible_covered THEN 'visible_covered' WHEN i.trace_covered THEN 'marker_only' WHEN i.element_id IS NOT NULL THEN 'missing' WHEN coalesce(e.must_explain, false) THEN 'required' ELSE 'expected' END AS state
  FROM enr e LEFT JOIN items i ON i.deck_id = e.deck_id AND i.element_id = e.element_id)"""
_SEP = ["：", ":", "。", ".", "；", ";"]
_POINT = "CASE " + " ".join(f"WHEN contains(t, '{x}') AND length(trim(string_split(t, '{x}')[1])) BETWEEN 2 AND 36 THEN trim(string_split(t, '{x}')[1])" for x in _SEP) + " ELSE rtrim(t[1:36]) END"
_P = "WITH " + b.BLOCKS_SQL + guard_sql() + rf""",
req AS (SELECT deck_id, element_id, learning_role AS role FROM guard WHERE must_explain AND confidence >= 0.7),
cand AS (SELECT b.deck_id, b.slide_id, b.element_id, CASE WHEN role IS NULL THEN 1 ELSE 0 END AS priority, role, trim(regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '<!--.*?-->', '', 'gs'), '\s+', ' ', 'g')) AS t FROM blocks b LEFT JOIN req USING (deck_id, element_id)),
pts AS (SELECT *, {_POINT} AS point FROM cand WHERE t <> ''),
keyed AS (SELECT *, lower(regexp_replace(point, '\s+', '', 'g'))[1:80] AS key FROM pts),
once AS (SELECT * FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY deck_id, key ORDER BY priority, slide_id, element_id) = 1),
items AS (
  SELECT *, t AS explanation, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY priority, slide_id, element_id) - 1 AS INTEGER) AS pos, point || ' ' || t AS bt,
    CASE WHEN contains(coalesce(role, ''), 'formula') THEN '不要只背公式，要能说明符号含义、适用条件和计算对象。' WHEN regexp_matches(point, '图|流程|结构') THEN '不要只看图名，要能沿箭头或结构关系讲出因果链。' ELSE '不要只背关键词，要能说明它解决的问题和使用场景。' END AS pitfall FROM once QUALIFY pos < 16),
lev AS (
  SELECT *, CASE WHEN coalesce(role, '') IN ('definition', 'formula', 'condition', 'concept') OR regexp_matches(bt, '定义|定理|公式|性质|结论|必须|核心') THEN 'must' WHEN coalesce(role, '') IN ('table_conclusion', 'figure_explanation', 'example', 'code_example') OR regexp_matches(bt, '例|步骤|算法|方法|流程|图|表') THEN 'key'
    WHEN regexp_matches(lower(bt), '高频|常见|易错|frequent|common') THEN 'frequent' ELSE 'key' END AS importance FROM items),
wrong AS (
  SELECT a.deck_id, a.pos, b.pos * 2 AS o, '把「' || b.point || '」的作用误当成「' || a.point || '」的主要含义。' AS w FROM items a JOIN items b ON a.deck_id = b.deck_id AND b.point <> a.point
  UNION ALL SELECT a.deck_id, a.pos, b.pos * 2 + 1, '只记住相邻结论“' || CASE WHEN length(b.t) > 52 THEN rtrim(b.t[1:36]) || chr(10) || chr(10) || '...[notes truncated for prompt budget]...' || chr(10) || chr(10) || ltrim(right(b.t, 15)) ELSE b.t END || '”，但忽略它和「' || a.point || '」的适用条件。' FROM items a JOIN items b ON a.deck_id = b.deck_id AND b.point <> a.point
  UNION ALL SELECT deck_id, pos, 1000, '只背「' || point || '」这个名称，但不能说明它解决的问题和限制。' FROM items UNION ALL SELECT deck_id, pos, 1001, '把「' || point || '」理解成任何场景都成立的结论，忽略材料给出的条件。' FROM items UNION ALL SELECT deck_id, pos, 1002, '只记住最终结论，却不能解释「' || point || '」与前后概念的关系。' FROM items),
opts AS (SELECT w.deck_id, w.pos, [any_value(t)] || list(w ORDER BY o) AS options FROM (SELECT * FROM wrong QUALIFY row_number() OVER (PARTITION BY deck_id, pos ORDER BY o) <= 3) w JOIN items i USING (deck_id, pos) GROUP BY ALL),
asked AS (
  SELECT i.*, options, q AS i, q % 4 AS turn, 'q' || q AS question_id, CASE q % 4 WHEN 1 THEN 'choice' WHEN 2 THEN 'true_false' ELSE 'short' END AS type, CASE q % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 6 END AS points,
    CASE q % 4 WHEN 1 THEN '关于「' || point || '」，哪一项最符合材料中的含义？' WHEN 2 THEN '判断：「' || point || '」只要背下名称即可，不需要理解它解决的问题或使用场景。' WHEN 3 THEN '请用自己的话解释「' || point || '」，并说明它为什么重要。' ELSE '围绕「' || point || '」列出一个容易混淆或容易漏写的点。' END AS question,
    CASE q % 4 WHEN 1 THEN '0' WHEN 2 THEN 'false' WHEN 3 THEN t ELSE pitfall END AS answer, CASE q % 4 WHEN 2 THEN '错误。复习时应说明它的含义、作用和易错点：' || t ELSE t END AS said
  FROM (SELECT deck_id, count(*) AS n FROM items GROUP BY deck_id) c, range(1, 9) AS r(q), items i, opts o WHERE i.deck_id = c.deck_id AND i.pos = (q - 1) % n AND o.deck_id = i.deck_id AND o.pos = i.pos),
pics AS (SELECT deck_id, slide_id, 's' || slide_id || '_img1' AS image_id, row_number() OVER (PARTITION BY deck_id ORDER BY slide_id) AS k FROM pages WHERE doc_id % 5 = 0 QUALIFY k <= 200)"""
_OVERLAY = "WITH " + b.BLOCKS_SQL + r""",
members AS (SELECT deck_id, slide_id, CAST((n - 1) // 4 AS VARCHAR) AS g, list(CASE WHEN n % 5 = 0 OR doc_id % 9 = 4 THEN element_id || 'y' ELSE element_id END ORDER BY n) AS l FROM blocks GROUP BY ALL),
refs AS (
  SELECT deck_id, slide_id, 'block' AS kind, CASE WHEN n % 7 = 0 THEN element_id || 'x' ELSE element_id END AS id, '' AS owner, true AS first FROM blocks WHERE n % 3 = 0
  UNION ALL SELECT deck_id, slide_id, 'group_block', id, g, row_number() OVER (PARTITION BY deck_id, slide_id, g, id) = 1 FROM (SELECT deck_id, slide_id, g, unnest(l || l[1:1]) AS id FROM members)
  UNION ALL SELECT deck_id, slide_id, 'relation_from', element_id, CAST(n AS VARCHAR), true FROM blocks WHERE n % 5 = 1
  UNION ALL SELECT deck_id, slide_id, 'relation_to', 's' || slide_id || '_t' || (n + 1), CAST(n AS VARCHAR), true FROM blocks WHERE n % 5 = 1),
judged AS (SELECT r.*, k.element_id IS NOT NULL AND first AS valid FROM refs r LEFT JOIN blocks k ON k.deck_id = r.deck_id AND k.slide_id = r.slide_id AND k.element_id = r.id)"""
SQL = {
    "p5_normalize_review": _P + """ SELECT deck_id, pos, CASE WHEN NOT g THEN 'base' WHEN pos % 3 = 0 THEN '核心知识点' ELSE 'S ' || pos END AS section, CASE WHEN NOT g THEN importance ELSE ['must', 'key', 'frequent', 'background'][pos % 4 + 1] END AS importance,
          md5(CASE WHEN g AND pos % 5 = 0 THEN '知识点' ELSE point END) AS point_md5, md5(CASE WHEN g AND pos % 7 = 0 THEN '需要结合原始笔记复习。' ELSE t END) AS explanation_md5, 'P' || slide_id AS source_refs FROM (SELECT *, regexp_matches(deck_id, '[02468]/') AS g FROM lev)""",
    "l7_overlay_references": _OVERLAY + " SELECT deck_id, slide_id, kind, id, valid, count(*) AS n FROM judged GROUP BY ALL",
    "l7_overlay_report": _OVERLAY + """, own AS (SELECT deck_id, slide_id, kind, owner, count_if(valid) AS good, count_if(NOT valid) AS bad FROM judged GROUP BY ALL),
        rel AS (SELECT deck_id, slide_id, count_if(ok) AS n FROM (SELECT deck_id, slide_id, owner, min(good) > 0 AS ok FROM own WHERE starts_with(kind, 'relation') GROUP BY ALL) GROUP BY ALL),
        per AS (SELECT deck_id, slide_id, coalesce(sum(good) FILTER (kind = 'block'), 0) AS bu, count_if(kind = 'group_block') AS gg, count_if(kind = 'group_block' AND good > 0) AS gv, sum(bad) AS bad FROM own GROUP BY ALL),
        f AS (SELECT *, CASE WHEN gg > 0 AND gv = 0 THEN 'no_valid_vision_groups' END AS reason FROM per)
        SELECT f.deck_id, f.slide_id, CASE WHEN reason IS NULL THEN bu ELSE 0 END::BIGINT AS blocks_updated, gg::BIGINT AS groups_given, CASE WHEN reason IS NULL THEN gv ELSE 0 END::BIGINT AS groups_valid, CASE WHEN reason IS NULL THEN coalesce(rel.n, 0) ELSE 0 END::BIGINT AS relations_valid, bad::BIGINT AS invalid_references, reason AS fallback_reason
        FROM f LEFT JOIN rel ON rel.deck_id = f.deck_id AND rel.slide_id = f.slide_id""",
    "e3_primary_role": _ENRICH + " SELECT e.deck_id, e.element_id, CASE e.kind WHEN 'text' THEN coalesce(nullif(e.learning_role, ''), t.type) ELSE coalesce(nullif(e.learning_role, ''), 'content') END AS role FROM enr e LEFT JOIN txt t ON t.deck_id = e.deck_id AND t.element_id = e.element_id",
    "l1_semantic_blocks": _B + " SELECT deck_id, slide_id, element_id, 'text' AS kind, block_type, learning_role, must_explain, importance, crop_policy, layout_order FROM sb",
    "l3_group_blocks": _B + " SELECT deck_id, slide_id, element_id, group_id FROM grp",
    "l4_group_attrs": _B + " SELECT deck_id, slide_id, group_id, scene_type, CASE WHEN starts_with(scene_type, 'code_') THEN 'prefer_structured_text_then_group_image' ELSE 'no_individual_crop' END AS crop_policy, n_blocks, importance FROM attrs",
    "l5_relations": _B + " SELECT deck_id, slide_id, source, target, relation FROM rel",
    "l6_layout_confidence": _B + """, per AS (SELECT deck_id, slide_id, count(*) AS n, count_if(must_explain) AS m, bool_or(block_type IN ('code', 'output')) AS code, bool_or(learning_role IN ('cause', 'fix', 'causal_annotation', 'visual_annotation')) AS cause FROM sb GROUP BY ALL),
        c AS (SELECT p.*, doc_id % 3 <> 1 AS shot, doc_id % 7 = 0 AS hint, coalesce(code, false) AS code, coalesce(cause, false) AS cause, CASE WHEN n IS NULL THEN CASE WHEN doc_id % 3 <> 1 THEN 0.35 ELSE 0.2 END WHEN m > 0 THEN 0.9 ELSE 0.76 END::DOUBLE AS conf, doc_id % 5 = 0 AND length(text) > 0 AS beside FROM pages p LEFT JOIN per USING (deck_id, slide_id)),
        d AS (SELECT *, shot AND (hint OR beside OR code OR cause OR conf < 0.68) AS need FROM c)
        SELECT deck_id, slide_id, conf AS layout_confidence, need AS needs_vision, CASE WHEN need THEN CASE WHEN hint THEN 'page_modality_hint' WHEN beside THEN 'image_text_mixed_page' WHEN code THEN 'code_or_output_page' WHEN cause THEN 'causal_annotation_page' ELSE 'low_confidence_layout' END END AS reason FROM d""",
    "l8_layout_report": _B + """, a AS (SELECT deck_id, count(*) AS blocks, count_if(must_explain)::BIGINT AS must_explain FROM sb GROUP BY deck_id), g AS (SELECT deck_id, count(DISTINCT slide_id || '/' || group_id) AS groups FROM grp GROUP BY deck_id), r AS (SELECT deck_id, count(*) AS n FROM rel GROUP BY deck_id)
        SELECT deck_id, blocks, must_explain, coalesce(groups, 0) AS groups, coalesce(n, 0) AS relations, 1.0::DOUBLE AS grouped_share FROM a LEFT JOIN g USING (deck_id) LEFT JOIN r USING (deck_id)""",
    "e1_build_elements": _E + " SELECT deck_id, slide_id, element_id, kind, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS DOUBLE) AS confidence, ignored, NOT ignored AS expected, layout_order FROM el",
    "e4_enrich": _ENRICH + " SELECT deck_id, slide_id, element_id, learning_role, must_explain, confidence, confidence_source FROM enr",
    "e5_coverage_state": _STATE + " SELECT deck_id, kind, state, count(*) AS n FROM state GROUP BY ALL",
    "e6_reading_order": _E + " SELECT deck_id, slide_id, element_id, CAST(row_number() OVER (PARTITION BY deck_id, slide_id ORDER BY layout_order NULLS LAST, kind DESC, element_id) AS INTEGER) AS reading_order FROM el",
    "p11_review_lines": _P + """, said AS (SELECT deck_id, pos, list_filter(['- **[' || CASE importance WHEN 'must' THEN '必考' WHEN 'frequent' THEN '高频' ELSE '重点' END || '] ' || point || '**：' || t,
          '  - 为什么考：' || CASE importance WHEN 'must' THEN '这类内容通常支撑定义、推导、公式或综合题。' WHEN 'frequent' THEN '这类内容适合通过判断题和选择题检查是否混淆。' ELSE '这类内容常用于解释过程、比较概念或连接例子。' END, '  - 易错点：' || pitfall, CASE WHEN slide_id > 0 THEN '  - 来源：P' || slide_id END], lambda x: x IS NOT NULL) AS l FROM lev)
        SELECT deck_id, pos, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS part, md5(unnest(l)) AS line_md5 FROM said""",
    "p1_study_items": _P + " SELECT deck_id, pos, element_id, slide_id, priority, importance, md5(point) AS point_md5, md5(pitfall) AS pitfall_md5 FROM lev",
    "p3_questions": _P + " SELECT deck_id, question_id, CAST(i AS INTEGER) AS i, type, points, element_id, md5(question) AS question_md5, md5(answer) AS answer_md5, md5(said) AS explanation_md5 FROM asked",
    "p4_choice_options": _P + " SELECT deck_id, pos, CAST(len(options) AS INTEGER) AS n_options, md5(array_to_string(options, '|')) AS options_md5 FROM opts",
    "p6_attach_figures": _P + """ SELECT a.deck_id, question_id, CASE WHEN p.image_id IS NOT NULL THEN p.image_id WHEN regexp_matches(lower(question || ' ' || said), '图|表|公式|流程|截图|figure|table|formula|diagram') THEN f.image_id END AS image_refs
        FROM asked a LEFT JOIN pics p ON p.deck_id = a.deck_id AND p.slide_id = a.slide_id LEFT JOIN pics f ON f.deck_id = a.deck_id AND f.k = 1""",
    "p7_section_pack": _P + """, s AS (SELECT *, 'part ' || (slide_id // 10) AS section FROM items), st AS (SELECT deck_id, section, min(pos) AS at, count(*) AS checklist FROM s GROUP BY ALL),
        qs AS (SELECT a.deck_id, a.question_id, arg_min(st.section, st.at) AS section FROM asked a JOIN s ON s.deck_id = a.deck_id AND s.slide_id = a.slide_id JOIN st ON st.deck_id = s.deck_id AND st.section = s.section GROUP BY ALL),
        q AS (SELECT deck_id, section, count(*) AS questions FROM qs GROUP BY ALL), n AS (SELECT deck_id, '图表速查' AS section, count(*) AS figure_notes FROM pics GROUP BY ALL),
        k AS (SELECT deck_id, section FROM st UNION SELECT deck_id, section FROM q UNION SELECT deck_id, section FROM n)
        SELECT deck_id, section, coalesce(checklist, 0) AS checklist, coalesce(questions, 0) AS questions, coalesce(figure_notes, 0) AS figure_notes FROM k LEFT JOIN st USING (deck_id, section) LEFT JOIN q USING (deck_id, section) LEFT JOIN n USING (deck_id, section)""",
    "p8_final_exam": _P + " SELECT deck_id, count(*) AS n_questions, sum(points)::BIGINT AS points, greatest(30, least(180, count(*) * 6))::BIGINT AS minutes FROM asked GROUP BY deck_id",
    "p9_question_quality": _P + r""", c AS (SELECT deck_id, 0.45 * len(list_distinct(list_transform(options, lambda x: lower(x)))) / 4 + 0.55 * len(list_filter(options, lambda x: length(x) >= 10)) / 4
          - least(0.6, 0.2 * list_sum(list_transform(options, lambda x: len(list_filter(['装饰', '无关', '不需要', '只需要记住名称', '只需背', 'decoration', 'unrelated'], lambda w: contains(lower(x), w))))) ) AS v FROM asked WHERE type = 'choice'),
        d AS (SELECT deck_id, avg(greatest(0.0, v)) AS v FROM c GROUP BY deck_id),
        q AS (SELECT deck_id, count(*) AS n, count_if(type = 'choice') AS k, avg(CASE WHEN regexp_matches(lower(question), '为什么|如何|比较|解释|推导|场景|条件|作用|易错|why|how|compare|explain|apply') THEN 1.0 ELSE 0 END) AS app FROM asked GROUP BY deck_id)
        SELECT deck_id, round(v, 3)::DOUBLE AS choice_distractor_score, 1.0::DOUBLE AS explanation_score, 1.0::DOUBLE AS source_ref_score, 0.75::DOUBLE AS question_mix_score, 1.0::DOUBLE AS figure_question_score, round(1 - app, 3)::DOUBLE AS mechanical_definition_score, n AS questions_total, k::BIGINT AS choice_questions_total,
          array_to_string(list_filter([CASE WHEN v < 0.55 THEN 'choice_distractors_need_same_concept_cluster' END, CASE WHEN 1 - app > 0.65 THEN 'questions_too_definition_like' END], lambda x: x IS NOT NULL), ',') AS flags FROM q JOIN d USING (deck_id)""",
    "p10_methods": _P + " SELECT deck_id, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY pos) AS INTEGER) AS pos, md5(point) AS name_md5 FROM items WHERE slide_id % 3 = 0 OR regexp_matches(bt, '公式|计算|步骤|算法|推导|example|例') QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY pos) <= 8",
    "p10_logic_chains": "WITH " + b.PAGES_SQL + r""", t AS (SELECT deck_id, slide_id, trim(regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages), k AS (SELECT * FROM t WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY slide_id) <= 6),
        g AS (SELECT deck_id, string_agg('先掌握：' || t, '|' ORDER BY slide_id) AS s FROM k GROUP BY deck_id)
        SELECT deck_id, 1 AS pos, '按材料顺序复习' AS title, md5(coalesce(s, '先读 notes.md，再用自测题检查理解。')) AS steps_md5 FROM (SELECT DISTINCT deck_id FROM pages) LEFT JOIN g USING (deck_id)""",
}
