"""Required learning items: candidates from text, tables and images, pages' roles, what notes miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, contains_any, cut, is_formula, is_structural_text, preview

_PAGE = ["deck_id", "slide_id"]
#: Words that mark definitions, conditions and examples.
DEFINITION = ["定义", "称为", "是指", "consistency", "definition", "means", "called"]
CONDITION = ["如果", "当", "只有", "必须", "条件", "because", "if ", "when ", "only if", "must"]
EXAMPLE = ["例如", "案例", "example", "e.g."]
#: Confidence from which a must-explain item is required. Examples (0.68) stay below it.
REQUIRED = 0.7


def guard_text(text_blocks: DataFrame) -> DataFrame:
    """Learning items of text blocks: formula 0.84, definition 0.78, condition 0.74, example 0.68, concept 0.70 from 120 characters on.

    The first that holds counts; the reason begins with "heading" for blocks of type title or heading. Text of a contents page that is none of these is structural (0.72) and needs no
    explanation; other text is dropped. White space is collapsed before the tests.
    """
    text = collapse(F.coalesce("content", F.lit("")))
    structural = is_structural_text(F.col("_t"))
    tests = (
        (is_formula(F.col("_t")), "formula", 0.84, "formula_like"), (contains_any(F.col("_l"), DEFINITION, True), "definition", 0.78, "definition_signal"), (contains_any(F.col("_l"), CONDITION, True), "condition", 0.74, "condition_signal"),
        (contains_any(F.col("_l"), EXAMPLE, True), "example", 0.68, "example_signal"), ((F.length("_t") >= 120) & ~structural, "concept", 0.70, "long_content_text"), (structural, "structural", 0.72, "structural_text"),
    )
    role = F.coalesce(*[F.when(cond, F.struct(F.lit(name).alias("role"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"))) for cond, name, conf, why in tests])
    # an array of one, exploded: later filters on the role don't repeat its tests; an empty text has none
    rows = text_blocks.withColumn("_t", text).withColumn("_l", F.lower("_t")).withColumn("_r", F.explode(F.array(role))).where("_r is not null")
    typed = "type" in text_blocks.columns
    kind = F.concat(F.lit("text:"), F.col("type")) if typed else F.lit("text")
    heading = F.when(F.col("type").isin("title", "heading"), "heading;").otherwise("") if typed else F.lit("")
    return rows.select(
        *_PAGE, "element_id", kind.alias("kind"), F.col("_r.role").alias("learning_role"), (F.col("_r.role") != "structural").alias("must_explain"), F.col("_r.confidence").alias("confidence"), F.concat(heading, "_r.reason").alias("reason"), cut(F.col("_t"), 220).alias("preview")
    )


def guard_tables(tables: DataFrame) -> DataFrame:
    """Learning items of tables (element_id, text of the table): each one with a text, 0.82."""
    text = preview(F.coalesce("text", F.lit("")), 160)
    rows = tables.withColumn("_t", text).where("_t <> ''")
    return rows.select(*_PAGE, "element_id", F.lit("table").alias("kind"), F.lit("table_conclusion").alias("learning_role"), F.lit(True).alias("must_explain"), F.lit(0.82).alias("confidence"), F.lit("table").alias("reason"), preview(F.col("_t"), 220).alias("preview"))


def guard_images(images: DataFrame) -> DataFrame:
    """Learning items of images: a crop or composite 0.80, one with a summary 0.78, one with 40 characters of OCR text 0.76; the highest counts.

    Ignored images are left out, parts of a composite are kept if they say something. Others need no explanation and are dropped.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    figure = F.coalesce(F.col("role").isin("figure_crop", "composite_figure"), F.lit(False))
    summary, ocr = (some("figure_explanation") != "") | (some("visual_summary") != ""), F.length(F.trim(some("ocr_text"))) >= 40
    words = F.array_join(F.filter(F.array(*map(some, ("caption", "figure_explanation", "visual_summary", "ocr_text"))), lambda x: x != ""), " ")
    confidence = F.greatest(F.when(figure, 0.8).otherwise(0.5), F.when(summary, 0.78).otherwise(0.5), F.when(ocr, 0.76).otherwise(0.5))
    reason = F.array_join(F.array_compact(F.array(F.when(figure, F.col("role")), F.when(summary, F.lit("has_visual_summary")), F.when(ocr, F.lit("long_image_ocr")))), ";")
    rows = images.where((~F.coalesce("ignored", F.lit(False)) | (F.col("role") == "composite_child")) & (figure | summary | ocr))
    return rows.select(*_PAGE, "element_id", F.lit("image").alias("kind"), F.when(ocr, "ocr_key_text").otherwise("figure_explanation").alias("learning_role"), F.lit(True).alias("must_explain"), confidence.alias("confidence"), reason.alias("reason"), preview(F.coalesce(F.nullif(words, F.lit("")), F.col("path")), 220).alias("preview"))


def guard_pages(pages: DataFrame, items: DataFrame, threshold: float | None = None) -> DataFrame:
    """Role of each page: structural (pages.structural) without items that must be explained, mixed with some, else content.

    With a threshold only items of that confidence count.
    """
    need = F.col("must_explain") if threshold is None else F.col("must_explain") & (F.col("confidence") >= threshold)
    per = items.groupBy(*_PAGE).agg(F.bool_or(need).alias("must"))
    must = F.coalesce("must", F.lit(False))
    role = F.when(F.col("structural"), F.when(must, "mixed").otherwise("structural")).otherwise("content")
    return pages.select(*_PAGE, "structural").join(per, _PAGE, "left").select(*_PAGE, role.alias("page_role"))


def merge_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """candidates with a model's labels (element_id, role, must, confidence, pos): unknown ids are dropped, the last label wins, missing fields keep theirs."""
    last = labels.groupBy("deck_id", "element_id").agg(F.max_by(F.struct("role", "must", "conf"), "pos").alias("l"))
    joined = candidates.join(last, ["deck_id", "element_id"], "left")
    new = {"learning_role": F.coalesce(F.nullif("l.role", F.lit("")), "learning_role"), "must_explain": F.coalesce("l.must", "must_explain"), "confidence": F.coalesce("l.conf", "confidence")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in candidates.columns])


def required_items(items: DataFrame, slides: DataFrame | None = None) -> DataFrame:
    need = items.where(F.col("must_explain") & (F.col("confidence") >= REQUIRED))
    return need if slides is None else need.join(slides.select(*_PAGE).distinct(), _PAGE, "left_semi")


def guard_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("must_explain").alias("must_explain"), F.count_if(F.col("must_explain") & (F.col("confidence") >= REQUIRED)).alias("required"), F.count_if(F.col("learning_role") == "structural").alias("structural")
    )


def missing_required(items: DataFrame, coverage: DataFrame) -> DataFrame:
    """Required items that no text explains: how they are covered, and a warning."""
    c = coverage.select("deck_id", "element_id", "trace_covered", "visible_covered")
    gap = required_items(items).join(c, ["deck_id", "element_id"]).where("not visible_covered")
    how = F.when(F.col("trace_covered"), "marker_only").otherwise("missing")
    return gap.select(*_PAGE, "element_id", "learning_role", "confidence", how.alias("coverage"), F.concat(F.lit("required item "), "element_id", F.lit(" is "), how).alias("warning"))


def repair_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(deck_id, element_id) missing before and after a repair → resolved and unresolved."""
    keys = ["deck_id", "element_id"]
    fixed = before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti").withColumn("state", F.lit("resolved"))
    return fixed.unionByName(after.select(*keys).distinct().withColumn("state", F.lit("unresolved")))
