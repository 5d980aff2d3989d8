"""Semantic layout: block roles, gap groups, relations, confidence, and overlays of a model's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import layout_order
from ..functions.text import has_signal, preview, strip

_PAGE = ["deck_id", "slide_id"]
#: Vertical gap that ends a group.
GAP = 0.16
#: Importance of a text block by type; what explains code beside it.
IMPORTANCE = {"title": 0.2, "code": 0.86, "output": 0.78, "fix": 0.88, "cause_explanation": 0.86, "annotation": 0.76, "concept_label": 0.58, "explanation": 0.62}
ROLES = {"title": "structural", "code": "code_example", "output": "runtime_output", "fix": "fix", "cause_explanation": "cause"}
BESIDE_CODE = ["runtime_output", "cause", "fix", "causal_annotation"]


def _of(values: dict, key: Column, default) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return F.coalesce(found, F.lit(default))


_SIGNALS = ("fix", "cause", "explains", "code", "output", "annotation")


def classify_semantic(text: DataFrame) -> DataFrame:
    """text (content, type) + block_type and learning_role.

    Types: title, fix, cause_explanation, code, output, annotation, concept_label, explanation. Explanations that
    name a fix or a cause come before code and output, other texts that name one after them. Each signal is a
    column of a projection below, so that it is evaluated once.
    """
    said = text.withColumn("_t", strip(F.col("content")))
    marked = said.withColumns({f"_{k}": has_signal(F.col("_t"), k) for k in _SIGNALS})
    fix, cause, explains, code, output, note = (F.col(f"_{k}") for k in _SIGNALS)
    kind = (
        F.when(F.col("type") == "title", "title").when(explains & fix, "fix").when(explains & cause, "cause_explanation").when(code, "code").when(output, "output").when(fix, "fix").when(cause, "cause_explanation").when(note, "annotation")
        .when(F.lower("_t").contains("include") & (F.length("_t") < 80), "code").when(F.col("type").isin("heading", "bullet") & (F.length("_t") <= 80), "concept_label").otherwise("explanation")
    )
    role = F.when(F.col("block_type") == "annotation", F.when(cause | fix, "causal_annotation").otherwise("visual_annotation")).otherwise(_of(ROLES, F.col("block_type"), "concept"))
    return marked.withColumn("block_type", kind).withColumn("learning_role", role).select(*text.columns, "block_type", "learning_role")


def semantic_blocks(text: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Blocks of a page: element_id, kind, source_ids, block_type, learning_role, must_explain, importance, bbox, layout_order, crop_policy, preview.

    text: element_id, content, type, bbox. tables: element_id, text, bbox. images: element_id, role, ignored, bbox
    and, where there are any, importance, source_ids, caption and text. Ignored images are left out; one without
    an importance yet has 0.55.
    """
    t = classify_semantic(text)
    score = F.round(F.least(F.lit(1.0), _of(IMPORTANCE, F.col("block_type"), 0.5) + F.when(F.length("content") >= 160, 0.04).otherwise(0.0)), 3)
    policy = F.when(F.col("block_type").isin("code", "output", "fix", "cause_explanation", "annotation"), "text_or_group_scene").when(F.col("block_type") == "title", "skip_crop").otherwise("text_only")
    rows = t.select(
        *_PAGE, "element_id", F.lit("text").alias("kind"), F.array("element_id").alias("source_ids"), "block_type", "learning_role", F.coalesce(F.col("type") != "title", F.lit(True)).alias("must_explain"), score.alias("importance"), "bbox",
        policy.alias("crop_policy"), preview(F.col("content"), 180).alias("preview"),
    )
    if tables is not None:
        rows = rows.unionByName(tables.select(
            *_PAGE, "element_id", F.lit("table").alias("kind"), F.array("element_id").alias("source_ids"), F.lit("table").alias("block_type"), F.lit("table_conclusion").alias("learning_role"), F.lit(True).alias("must_explain"),
            F.lit(0.82).alias("importance"), "bbox", F.lit("text_summary").alias("crop_policy"), preview(F.col("text"), 220).alias("preview"),
        ))
    if images is not None:
        have = lambda c, t: F.col(c) if c in images.columns else F.lit(None).cast(t)
        figure, importance = F.coalesce(F.col("role").isin("figure_crop", "composite_figure"), F.lit(False)), have("importance", "double")
        rows = rows.unionByName(images.where(~F.coalesce("ignored", F.lit(False))).select(
            *_PAGE, "element_id", F.lit("image").alias("kind"), F.concat(F.array("element_id"), F.coalesce(have("source_ids", "array<string>"), F.array().cast("array<string>"))).alias("source_ids"),
            F.when(figure, "figure").otherwise(F.coalesce(F.nullif("role", F.lit("")), F.lit("image"))).alias("block_type"), F.lit("visual_evidence").alias("learning_role"),
            (figure | (F.coalesce(importance, F.lit(0.0)) >= 0.55)).alias("must_explain"), F.coalesce(importance, F.lit(0.55)).alias("importance"), "bbox", F.lit("use_existing_image").alias("crop_policy"),
            preview(F.coalesce(F.nullif(have("text", "string"), F.lit("")), have("path", "string"), F.col("element_id")), 180).alias("preview"),
        ))
    return rows.withColumn("layout_order", layout_order(F.col("bbox")))


def group_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that must be explained + group_id: a new group where the gap to the lowest bottom so far exceeds 0.16.

    The lowest bottom is that of the page, not of the group. A block without a box never ends a group. A page
    with code beside its output, cause or fix is one group. Windows are per page.
    """
    page = Window.partitionBy(*_PAGE).orderBy("layout_order", "element_id")
    key = blocks.where("must_explain")
    low = F.max(F.col("bbox")[3]).over(page.rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*_PAGE)
    scene = F.bool_or(F.col("block_type") == "code").over(whole) & F.bool_or(F.col("learning_role").isin(BESIDE_CODE)).over(whole)
    cut = key.withColumn("_new", F.when(F.coalesce(F.col("bbox")[1] - low > GAP, F.lit(False)), 1).otherwise(0)).withColumn("_scene", scene)
    n = F.when(F.col("_scene"), 0).otherwise(F.sum("_new").over(page))
    return cut.withColumn("group_id", F.concat(F.lit("p"), F.col("slide_id").cast("string"), F.lit("_sg"), (n + 1).cast("string"))).drop("_new", "_scene")


#: What a group of each scene is to teach.
GOALS = {
    "code_causal_explanation": "讲清代码示例的运行现象、原因和修复方法。", "code_example_with_output": "把代码与运行输出对应起来，说明示例验证了什么行为。",
    "table_explanation": "提炼表格结论，而不是逐格复述表格内容。", "visual_explanation": "将图示与邻近概念合并讲解，避免把图单独堆放。",
}
STREAM_GOAL = "讲清 cin 提取运算符与 getline 混用时的换行符残留问题、现象和修复方法。"


def group_attrs(grouped: DataFrame) -> DataFrame:
    """Per group: scene, blocks and sources in order, crop policy, goal, highest importance."""
    def has(column: str, *values: str) -> Column:
        return F.bool_or(F.col(column).isin(*values))

    scene = (
        F.when(has("block_type", "code") & has("learning_role", "fix"), "code_causal_explanation").when(has("block_type", "code") & has("learning_role", "runtime_output"), "code_example_with_output")
        .when(has("block_type", "table"), "table_explanation").when(has("block_type", "figure", "image"), "visual_explanation").otherwise("concept_explanation")
    )
    per = grouped.groupBy(*_PAGE, "group_id").agg(
        scene.alias("scene_type"), F.array_sort(F.collect_list(F.struct("layout_order", "element_id", "source_ids", "preview"))).alias("b"), F.round(F.max("importance"), 3).alias("importance"), has("kind", "image").alias("image")
    )
    text = F.array_join(F.col("b.preview"), " ")
    policy = F.when(F.col("scene_type").startswith("code_"), "prefer_structured_text_then_group_image").when(F.col("image"), "group_image_near_explanation").otherwise("no_individual_crop")
    goal = (
        F.when((F.col("scene_type") == "code_causal_explanation") & text.rlike(r"(?i)getline|cin|换行符|空白字符|ignore"), STREAM_GOAL).when(F.col("scene_type") != "concept_explanation", _of(GOALS, F.col("scene_type"), ""))
        .otherwise(F.coalesce(F.nullif(preview(text, 140), F.lit("")), F.lit("讲解本组核心概念。")))
    )
    return per.select(*_PAGE, "group_id", "scene_type", F.col("b.element_id").alias("block_ids"), F.array_distinct(F.flatten(F.col("b.source_ids"))).alias("source_ids"), policy.alias("crop_policy"), goal.alias("learning_goal"), "importance")


#: Relations and their reasons.
REASONS = {"demonstrates": "代码块对应运行输入输出现象", "explained_by": "解释块说明代码行为背后的原因", "fixes": "修复提示作用于代码示例", "leads_to_fix": "原因解释导向修复方法"}


def semantic_relations(blocks: DataFrame, most: int = 10) -> DataFrame:
    """Edges (source, target, relation, reason, pos) between the first two blocks of each kind of a page, ten at most.

    For each code block those to its outputs and causes, and from its fixes; then those from causes to fixes. A
    page is one row of four short arrays, so nothing is joined.
    """
    def first(cond: Column) -> Column:
        return F.transform(F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct("layout_order", "element_id")))), 1, 2), lambda x: x["element_id"])

    kind, role = F.col("block_type"), F.col("learning_role")
    per = blocks.groupBy(*_PAGE).agg(first(kind == "code").alias("code"), first(kind == "output").alias("output"), first(role == "cause").alias("cause"), first(role == "fix").alias("fix"))

    def edge(a: Column, b: Column, relation: str) -> Column:
        return F.struct(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), F.lit(REASONS[relation]).alias("reason"))

    of_code = F.flatten(F.transform("code", lambda c: F.concat(
        F.transform(F.col("output"), lambda o: edge(c, o, "demonstrates")), F.transform(F.col("cause"), lambda x: edge(c, x, "explained_by")), F.transform(F.col("fix"), lambda f: edge(f, c, "fixes"))
    )))
    of_cause = F.flatten(F.transform("cause", lambda c: F.transform(F.col("fix"), lambda f: edge(c, f, "leads_to_fix"))))
    return per.select(*_PAGE, F.posexplode(F.slice(F.concat(of_code, of_cause), 1, most)).alias("pos", "e")).select(*_PAGE, "pos", "e.*")


def layout_confidence(pages: DataFrame, blocks: DataFrame, grouped: DataFrame) -> DataFrame:
    """pages (has_screenshot) + layout_confidence: 0.62 and more by the share of blocks to explain that are in groups.

    Without blocks 0.35 with a screenshot, else 0.2; with blocks to explain but no group 0.52; with none to explain 0.76.
    """
    b = blocks.groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("_n"), F.count_if("must_explain").alias("_must"))
    g = grouped.groupBy(*_PAGE).agg(F.count_if("must_explain").alias("_in"))
    share = F.coalesce("_in", F.lit(0)) / F.greatest(F.lit(1), F.col("_must"))
    value = (
        F.when(F.col("_n").isNull(), F.when(F.col("has_screenshot"), 0.35).otherwise(0.2)).when((F.col("_must") > 0) & F.col("_in").isNull(), 0.52)
        .when(F.col("_in").isNotNull(), F.round(0.62 + F.least(F.lit(0.28), share * 0.28), 3)).otherwise(0.76)
    )
    return pages.join(b, _PAGE, "left").join(g, _PAGE, "left").withColumn("layout_confidence", value).drop("_n", "_must", "_in")


def needs_enhancement(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages (has_screenshot, hints, modality, has_images, has_content, layout_confidence) + needs_vision and reason.

    A page without a screenshot needs none. Reasons in order: a hint, a modality of images, images beside text,
    code or output, causes or fixes, a confidence below 0.68.
    """
    b = blocks.groupBy(*_PAGE).agg(F.bool_or(F.col("block_type").isin("code", "output")).alias("_code"), F.bool_or(F.col("learning_role").isin("cause", "fix", "causal_annotation", "visual_annotation")).alias("_cause"))
    code, cause = F.coalesce("_code", F.lit(False)), F.coalesce("_cause", F.lit(False))
    kinds, hint = F.col("modality").isin("mixed", "image_only", "shape_diagram"), F.array_contains("hints", "vision_page_screenshot")
    beside = F.col("has_images") & F.col("has_content")
    need = F.col("has_screenshot") & (hint | F.array_contains("hints", "crop_figures_from_screenshot") | kinds | beside | code | cause | (F.col("layout_confidence") < 0.68))
    why = (
        F.when(hint, "page_modality_hint").when(kinds, F.concat("modality", F.lit("_page"))).when(beside, "image_text_mixed_page").when(code, "code_or_output_page").when(cause, "causal_annotation_page").otherwise("low_confidence_layout")
    )
    return pages.join(b, _PAGE, "left").withColumn("needs_vision", F.coalesce(need, F.lit(False))).withColumn("reason", F.when(F.col("needs_vision"), why)).drop("_code", "_cause")


def layout_report(blocks: DataFrame, grouped: DataFrame, relations: DataFrame) -> DataFrame:
    """Per deck: blocks, those to explain, groups, relations, and the share of blocks to explain that are in a group."""
    g = grouped.groupBy("deck_id").agg(F.count(F.lit(1)).alias("grouped"), F.count_distinct("slide_id", "group_id").alias("groups"))
    r = relations.groupBy("deck_id").agg(F.count(F.lit(1)).alias("relations"))
    a = blocks.groupBy("deck_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("must_explain").alias("must_explain"))
    zero = F.lit(0).cast("bigint")
    share = F.coalesce(F.try_divide(F.coalesce("grouped", zero), F.col("must_explain")), F.lit(1.0))
    return a.join(g, "deck_id", "left").join(r, "deck_id", "left").select("deck_id", "blocks", "must_explain", F.coalesce("groups", zero).alias("groups"), F.coalesce("relations", zero).alias("relations"), share.alias("grouped_share"))


def layout_payload(blocks: DataFrame, groups: DataFrame, relations: DataFrame, limit: int = 6) -> DataFrame:
    """Per page the first 18 blocks, 6 groups and 12 relations as JSON, and a text of 4 groups and 6 relations cut to 900 characters."""
    b = blocks.groupBy(*_PAGE).agg(F.slice(F.array_sort(F.collect_list(F.struct("layout_order", "element_id", "block_type", "learning_role", "must_explain", "crop_policy", "preview"))), 1, limit * 3).alias("blocks"))
    g = groups.groupBy(*_PAGE).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.regexp_extract("group_id", r"_sg(\d+)$", 1).cast("int").alias("n"), "group_id", "scene_type", "learning_goal", "block_ids", "crop_policy"))), 1, limit).alias("groups"))
    r = relations.groupBy(*_PAGE).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "source", "target", "relation", "reason"))), 1, limit * 2).alias("relations"))
    joined = b.join(g, _PAGE, "left").join(r, _PAGE, "left")

    def line(x: Column) -> Column:
        return F.concat(x["group_id"], F.lit("("), x["scene_type"], F.lit(", "), x["crop_policy"], F.lit("): "), x["learning_goal"], F.lit(" -> "), F.array_join(x["block_ids"], ", "))

    edges = F.transform(F.slice("relations", 1, 6), lambda x: F.concat(F.lit("relation "), x["source"], F.lit(" "), x["relation"], F.lit(" "), x["target"], F.lit(": "), x["reason"]))
    text = F.array_join(F.concat(F.transform(F.slice("groups", 1, 4), line), F.coalesce(edges, F.array().cast("array<string>"))), "\n")
    context = F.when(F.length(text) > 900, F.concat(F.substring(text, 1, 899), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))
    return joined.select(*_PAGE, F.to_json(F.struct("blocks", "groups", "relations")).alias("payload"), context.alias("context"))


def overlay_ids(known: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model's rows whose element is known, and those whose isn't: (valid, invalid references)."""
    keys = ["deck_id", "element_id"]
    return given.join(known.select(*keys).distinct(), keys, "left_semi"), given.join(known.select(*keys).distinct(), keys, "left_anti")


def overlay_blocks(local: DataFrame, given: DataFrame) -> DataFrame:
    """local with the types that a model gives (element_id, block_type, pos), the last of each known block."""
    last = given.groupBy("deck_id", "element_id").agg(F.max_by("block_type", "pos").alias("_t"))
    return local.join(last, ["deck_id", "element_id"], "left").withColumn("block_type", F.coalesce("_t", "block_type")).drop("_t")


def overlay_groups(local: DataFrame, given: DataFrame, blocks: DataFrame) -> DataFrame:
    """Groups (deck_id, slide_id, group_id, block_ids) of a model with their known blocks; pages without one keep the local groups."""
    known = blocks.select(*_PAGE, F.col("element_id").alias("_b")).distinct()
    each = given.select(*_PAGE, "group_id", F.posexplode("block_ids").alias("_i", "_b")).join(known, [*_PAGE, "_b"], "left_semi")
    valid = each.groupBy(*_PAGE, "group_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_b"))), lambda x: x["_b"])).alias("block_ids"))
    rest = local.select(*_PAGE, "group_id", "block_ids").join(valid.select(*_PAGE).distinct(), _PAGE, "left_anti")
    return valid.withColumn("origin", F.lit("model")).unionByName(rest.withColumn("origin", F.lit("local")))


def overlay_relations(given: DataFrame, blocks: DataFrame) -> DataFrame:
    """Relations (deck_id, slide_id, source, target, …) of a model whose two blocks are of the page."""
    known = blocks.select(*_PAGE, F.col("element_id").alias("source")).distinct()
    return given.join(known, [*_PAGE, "source"], "left_semi").join(known.withColumnRenamed("source", "target"), [*_PAGE, "target"], "left_semi")


def overlay_report(blocks: DataFrame, given_blocks: DataFrame, given_groups: DataFrame, given_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, references) of a model's layout of pages.

    given_blocks: element_id. given_groups: group_id, block_ids. given_relations: source, target. references:
    deck_id, slide_id, kind (block, group_block, relation_from, relation_to), id, n, valid: a block of the page is
    valid, in a group the first time only. report, a row for each page that the model says something of:
    blocks_updated, groups_given, groups_valid (with a valid block), relations_valid, invalid_references and
    fallback_reason: no_local_blocks, or no_valid_vision_groups where groups are given and none is valid; then
    nothing of the model counts on that page.
    """
    ends = F.array(F.struct(F.lit("relation_from").alias("kind"), F.col("source").alias("id")), F.struct(F.lit("relation_to").alias("kind"), F.col("target").alias("id")))
    members = given_groups.select(*_PAGE, "group_id", F.posexplode("block_ids").alias("i", "id")).withColumn("first", F.row_number().over(Window.partitionBy(*_PAGE, "group_id", "id").orderBy("i")) == 1)
    named = (
        given_blocks.select(*_PAGE, F.lit("block").alias("kind"), F.col("element_id").alias("id"), F.lit("").alias("owner"), F.lit(True).alias("first"))
        .unionByName(members.select(*_PAGE, F.lit("group_block").alias("kind"), "id", F.col("group_id").alias("owner"), "first"))
        .unionByName(given_relations.select(*_PAGE, F.explode(ends).alias("e"), F.concat_ws("\n", "source", "target").alias("owner")).select(*_PAGE, "e.kind", "e.id", "owner", F.lit(True).alias("first")))
    )
    known = blocks.select(*_PAGE, F.col("element_id").alias("id"), F.lit(True).alias("is_block")).distinct()
    judged = named.join(known, [*_PAGE, "id"], "left").withColumn("valid", F.coalesce("is_block", F.lit(False)) & F.col("first"))
    references = judged.groupBy(*_PAGE, "kind", "id", "valid").agg(F.count(F.lit(1)).alias("n"))
    owners = judged.groupBy(*_PAGE, "kind", "owner").agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("bad"))
    pairs = owners.where(F.col("kind").startswith("relation")).groupBy(*_PAGE, "owner").agg(F.min(F.col("good") > 0).alias("both")).groupBy(*_PAGE).agg(F.count_if("both").alias("relations_valid"))
    per = owners.groupBy(*_PAGE).agg(
        F.sum(F.when(F.col("kind") == "block", F.col("good")).otherwise(0)).alias("blocks_updated"), F.count_if(F.col("kind") == "group_block").alias("groups_given"),
        F.count_if((F.col("kind") == "group_block") & (F.col("good") > 0)).alias("groups_valid"), F.sum("bad").alias("invalid_references"),
    )
    has = blocks.select(*_PAGE, F.lit(True).alias("_has")).distinct()
    reason = F.when(F.col("_has").isNull(), "no_local_blocks").when((F.col("groups_given") > 0) & (F.col("groups_valid") == 0), "no_valid_vision_groups")
    report = per.join(pairs, _PAGE, "left").join(has, _PAGE, "left").withColumn("fallback_reason", reason)
    used = lambda c: F.when(F.col("fallback_reason").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    return report.select(*_PAGE, used("blocks_updated"), "groups_given", used("groups_valid"), used("relations_valid"), "invalid_references", "fallback_reason"), references
