"""Page statistics, modality, and the choice of pages and images for costly steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, preview

_PAGE = ["deck_id", "slide_id"]
#: Characters below which a page has little text.
LOW_TEXT = 80


def page_stats(pages: DataFrame, text_blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """One row per page: counts of blocks, characters, tables and images by use, screenshot and warnings.

    Each child table is aggregated by page before it joins, so the pages are joined three times with one row each.
    """
    text = text_blocks.groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("text_blocks"), F.sum(F.length(F.trim("content")).cast("bigint")).alias("text_chars"))
    table = tables.groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("tables"))
    page_image, ignored = F.coalesce(F.col("role") == "page_image", F.lit(False)), F.coalesce("ignored", F.lit(False))
    image = images.groupBy(*_PAGE).agg(
        F.count(F.lit(1)).alias("images_total"), F.count_if(~ignored & ~page_image).alias("content_images"), F.count_if(page_image).alias("page_images"), F.count_if(ignored & ~page_image).alias("decorative_images")
    )
    out = pages
    for child in (text, table, image):
        out = out.join(child, _PAGE, "left")
    counts = ["text_blocks", "text_chars", "tables", "images_total", "content_images", "page_images", "decorative_images"]
    return out.select(*_PAGE, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts], "has_screenshot", "warnings")


def classify_modality(stats: DataFrame) -> DataFrame:
    """stats + modality, confidence, reasons, hints: mixed, image_only, shape_diagram, native_text, else decorative."""
    c = F.col
    text, extracted = c("text_chars"), (c("text_chars") > 0) | (c("tables") > 0)
    mixed = c("content_images") > 0
    only = (c("page_images") > 0) | (c("has_screenshot") & (text == 0) & (c("tables") == 0))
    shape = c("has_screenshot") & ((c("tables") > 0) | ((text > 0) & (text < 500)) | (c("warnings") > 0))
    native = (text >= LOW_TEXT) | (c("tables") > 0)

    def names(*items):
        return F.array_compact(F.array(*[F.when(cond, F.lit(name)) if cond is not None else F.lit(name) for name, cond in items]))

    modality = F.when(mixed, "mixed").when(only, "image_only").when(shape, "shape_diagram").when(native, "native_text").otherwise("decorative")
    confidence = (
        F.when(mixed, F.when(extracted, 0.82).otherwise(0.72)).when(only, F.when((c("page_images") > 0) | (c("warnings") > 0), 0.9).otherwise(0.72))
        .when(shape, F.when(text > 0, 0.68).otherwise(0.58)).when(native, 0.86).otherwise(0.55)
    )
    reasons = (
        F.when(mixed, names(("has_content_images", None), ("has_extracted_text_or_tables", extracted))).when(only, names(("full_page_image_or_low_text_screenshot", None)))
        .when(shape, names(("screenshot_with_limited_extracted_objects", None))).when(native, names(("text_rich_or_table_extracted", None))).otherwise(names(("little_or_no_learning_content_detected", None)))
    )
    hints = (
        F.when(mixed, names(("use_embedded_images", None), ("vision_large_images", None), ("use_extracted_text", extracted), ("ocr_page_screenshot", (text < LOW_TEXT) & c("has_screenshot"))))
        .when(only, names(("ocr_page_screenshot", None), ("crop_figures_from_screenshot", None), ("vision_page_screenshot", None)))
        .when(shape, names(("use_extracted_text", None), ("crop_figures_from_screenshot", None), ("vision_page_screenshot", None)))
        .when(native, names(("use_extracted_text", None))).otherwise(names(("low_priority", None)))
    )
    return stats.withColumns({"modality": modality, "confidence": confidence, "reasons": reasons, "hints": F.array_distinct(hints)})


def modality_report(classified: DataFrame) -> DataFrame:
    """Per deck: pages, pages of each modality, and how many want images, OCR or crops."""
    kinds = ("mixed", "image_only", "shape_diagram", "native_text", "decorative")

    def hinted(name: str):
        return F.count_if(F.array_contains("hints", name))

    return classified.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("pages_total"), *[F.count_if(F.col("modality") == k).alias(k) for k in kinds], F.count_if(F.col("modality").isin("image_only", "shape_diagram")).alias("image_driven"),
        hinted("use_embedded_images").alias("embedded_image"), hinted("ocr_page_screenshot").alias("ocr_recommended"), hinted("crop_figures_from_screenshot").alias("crop_recommended"),
    )


def ocr_targets(classified: DataFrame, images: DataFrame, mode: str = "auto", min_area: int = 120_000, cap: int = 120) -> DataFrame:
    """Pages to read by OCR, in deck order up to the cap: the screenshot, else the first large image.

    auto: pages with the hint, little text, or warnings; all: every page. An image of unknown size passes.
    """
    want = F.lit(True) if mode == "all" else F.array_contains("hints", "ocr_page_screenshot") | (F.col("text_chars") < LOW_TEXT) | (F.col("warnings") > 0)
    chosen = classified.where(want)
    shots = chosen.where("has_screenshot").select(*_PAGE, F.lit("screenshot").alias("target"))
    large = images.where(F.col("width").isNull() | F.col("height").isNull() | (F.col("width").cast("bigint") * F.col("height") >= min_area))
    first = large.groupBy(*_PAGE).agg(F.min("element_id").alias("target"))
    rest = chosen.where("not has_screenshot").join(first, _PAGE).select(*_PAGE, "target")
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id"))
    return shots.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= cap)


def figure_targets(classified: DataFrame, cap: int = 80) -> DataFrame:
    """Pages whose screenshot is to be cut into figures: no content image, and a hint, a page image, a table, little text or warnings."""
    want = F.array_contains("hints", "crop_figures_from_screenshot") | (F.col("page_images") > 0) | (F.col("tables") > 0) | (F.col("text_chars") < 800) | (F.col("warnings") > 0)
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id"))
    return classified.where(F.col("has_screenshot") & (F.col("content_images") == 0) & want).withColumn("rank", rank).where(F.col("rank") <= cap).select(*_PAGE, "rank")


def apply_overrides(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """pages with the modality last written for each, by updated_at."""
    last = overrides.groupBy(*_PAGE).agg(F.max_by("modality", "updated_at").alias("override"))
    return pages.join(last, _PAGE, "left").withColumn("modality", F.coalesce("override", "modality")).drop("override")


def apply_results(pages: DataFrame, results: DataFrame) -> DataFrame:
    """OCR: a new text that isn't empty wins. Vision: an OCR text that is there stays, a new summary wins."""
    joined = pages.join(results, _PAGE, "left")
    new_ocr, new_sum = F.nullif("new_ocr_text", F.lit("")), F.nullif("new_summary", F.lit(""))
    old = F.nullif("ocr_text", F.lit(""))
    ocr = F.when(F.col("kind") == "vision", F.coalesce(old, new_ocr)).otherwise(F.coalesce(new_ocr, old))
    return joined.withColumn("ocr_text", ocr).withColumn("summary", F.coalesce(new_sum, "summary")).drop("new_ocr_text", "new_summary", "kind")


def vision_targets(classified: DataFrame, images: DataFrame, mode: str = "auto", min_area: int = 120_000, cap: int = 80) -> DataFrame:
    """Images and pages to look at, in deck order up to the cap: deck_id, slide_id, target, kind, reason, rank.

    auto: all crops of a page, else its best-ranked large image that is no page image, else its screenshot, if the
    page has a hint, content images, tables, little text or warnings. all: the screenshot, else all images. An
    image of unknown size passes. images: element_id, role, ignored, width, height, importance, rank.
    """
    none = F.lit(9999)
    place = F.struct(F.coalesce("rank", none).alias("rank"), (-F.coalesce("importance", F.lit(0.0))).alias("score"), F.col("element_id").alias("id"))
    open_ = images.where(~F.coalesce("ignored", F.lit(False))).withColumn("place", place)
    area = F.col("width").cast("bigint") * F.col("height")
    large = open_.where((F.coalesce("role", F.lit("content")) != "page_image") & (area.isNull() | (area >= (0 if mode == "all" else min_area))))
    reason = F.when(F.col("importance").isNotNull(), "ranked_embedded_image").otherwise("large_embedded_image")
    shot = F.lit("screenshot").alias("target"), F.lit("page_screenshot").alias("kind")
    low = F.struct(F.lit(0).alias("rank"), F.lit(0.0).alias("score"), F.lit("").alias("id"))
    cols = [*_PAGE, "target", "kind", "reason", "place"]
    as_image = lambda df, why: df.select(*_PAGE, F.col("element_id").alias("target"), F.lit("image").alias("kind"), why.alias("reason"), "place")
    pages = classified.select(*_PAGE, "has_screenshot", "hints", "text_chars", "tables", "warnings")
    if mode == "all":
        a = pages.where("has_screenshot").select(*_PAGE, *shot, F.lit("all_page_screenshot").alias("reason"), low.alias("place"))
        b = as_image(large, reason).join(pages.where("not has_screenshot").select(*_PAGE), _PAGE, "left_semi")
        found = a.unionByName(b)
    else:
        crops = as_image(open_.where("role = 'figure_crop'"), F.lit("figure_crop_image"))
        first = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("place"))
        best = as_image(large.withColumn("r", first).where("r = 1"), reason).join(crops.select(*_PAGE).distinct(), _PAGE, "left_anti")
        seen = open_.select(*_PAGE).distinct().withColumn("_seen", F.lit(True))
        worth = F.array_contains("hints", "vision_page_screenshot") | F.coalesce("_seen", F.lit(False)) | (F.col("tables") > 0) | (F.col("text_chars") < 500) | (F.col("warnings") > 0)
        rest = pages.join(crops.select(*_PAGE).union(best.select(*_PAGE)).distinct(), _PAGE, "left_anti").join(seen, _PAGE, "left").where(F.col("has_screenshot") & worth)
        found = crops.unionByName(best).unionByName(rest.select(*_PAGE, *shot, F.lit("auto_page_visual").alias("reason"), low.alias("place")))
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id", "place"))
    return found.select(*cols).withColumn("rank", rank).where(F.col("rank") <= cap).drop("place")


#: Titles of agenda pages and words of examples.
AGENDA_TITLES = ["目录", "课程目录", "contents", "outline", "agenda"]
EXAMPLE_WORDS = r"例如|例子|案例|example|case study|demo"


def page_roles(pages: DataFrame, images: DataFrame, brief_roles: DataFrame | None = None) -> DataFrame:
    """(deck_id, slide_id, role, reason, source, confidence): a brief's role, else agenda, table, diagram, transition, example or concept.

    pages: title, text, modality, tables (a count). brief_roles: deck_id, slide_id, role, reason, pos; the last counts.
    """
    per = images.groupBy(*_PAGE).agg(F.bool_or(~F.coalesce("ignored", F.lit(False))).alias("_seen"), F.bool_or(F.coalesce(F.col("role").isin("figure_crop", "composite_figure"), F.lit(False))).alias("_figure"))
    joined = pages.join(per, _PAGE, "left")
    if brief_roles is None:
        joined = joined.withColumn("_b", F.lit(None).cast("struct<role:string,reason:string>"))
    else:
        last = brief_roles.groupBy(*_PAGE).agg(F.max_by(F.struct("role", "reason"), "pos").alias("_b"))
        joined = joined.join(last, _PAGE, "left")
    key = F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", ""))
    text = F.lower(F.concat_ws(" ", "title", "text"))
    rules = [
        (F.col("_b").isNotNull(), F.coalesce(F.nullif("_b.role", F.lit("")), F.lit("other")), F.coalesce(F.nullif("_b.reason", F.lit("")), F.lit("deck_brief_page_role")), "deck_brief", 0.82),
        (key.isin(AGENDA_TITLES), "agenda", "title_matches_agenda", "local_rules", 0.72), ((F.col("tables") > 0) & ~F.coalesce("_seen", F.lit(False)), "table", "table_dominant_page", "local_rules", 0.7),
        (F.coalesce("_figure", F.lit(False)), "diagram", "has_cropped_or_composite_figure", "local_rules", 0.7), (F.col("modality").isin("image_only", "shape_diagram"), "diagram", F.concat(F.lit("page_modality:"), "modality"), "local_rules", 0.62),
        (F.col("modality") == "decorative", "transition", "decorative_or_low_content_page", "local_rules", 0.56), (text.rlike(EXAMPLE_WORDS), "example", "example_signal", "local_rules", 0.64),
        (F.lit(True), "concept", "text_or_mixed_content_page", "local_rules", 0.58),
    ]
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    found = F.coalesce(*[F.when(cond, F.struct(lit(r).alias("role"), lit(w).alias("reason"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))) for cond, r, w, s, c in rules])
    return joined.select(*_PAGE, found.alias("f")).select(*_PAGE, "f.*")


def key_points(pages: DataFrame, groups: DataFrame, tables: DataFrame, figures: DataFrame, text_blocks: DataFrame, most: int = 8) -> DataFrame:
    """(deck_id, slide_id, pos, point): the first eight different points of a page, each once, cut to 220 characters.

    In order: the title, goals of groups, conclusions and summaries of tables, what figures say, blocks that are no
    headings, the page's visual summary and OCR text. pages: title, visual_summary, ocr_text.
    """
    def rows(df: DataFrame, rank: int, pos, *texts: str) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(i).alias("j"), F.col(t).alias("t")) for i, t in enumerate(texts)])
        return df.select(*_PAGE, F.lit(rank).alias("k"), pos.cast("string").alias("p"), F.explode(parts).alias("x")).select(*_PAGE, F.struct("k", "p", "x.j").alias("at"), "x.t")

    number = F.lpad(F.regexp_extract("group_id", r"_sg(\d+)$", 1), 6, "0")
    order = F.format_string("%06d", "pos")
    every = rows(pages, 0, F.lit(""), "title").unionByName(rows(groups, 1, number, "learning_goal")).unionByName(rows(tables, 2, F.col("element_id"), "table_conclusion", "table_summary"))
    every = every.unionByName(rows(figures, 3, F.format_string("%06d", F.coalesce("rank", F.lit(9999))), "figure_explanation", "visual_summary", "ocr_text")).unionByName(rows(text_blocks.where("type not in ('title', 'heading')"), 4, order, "content"))
    every = every.unionByName(rows(pages, 5, F.lit(""), "visual_summary", "ocr_text")).withColumn("t", collapse(F.col("t"))).where("t <> ''")
    once = every.groupBy(*_PAGE, "t").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("at"))
    return once.withColumn("pos", n).where(F.col("pos") <= most).select(*_PAGE, "pos", preview(F.col("t"), 220).alias("point"))


def page_understanding(pages: DataFrame, roles: DataFrame, points: DataFrame, text_blocks: DataFrame, figures: DataFrame, tables: DataFrame, items: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """One row per page: role, section, key points, the first 12 blocks, figures by rank, tables, required items, as arrays of structs.

    Every child table is aggregated by page before it joins. sections: deck_id, slide_id, section.
    """
    def some(df: DataFrame, name: str, most: int, *columns) -> DataFrame:
        return df.groupBy(*_PAGE).agg(F.slice(F.array_sort(F.collect_list(F.struct(*columns))), 1, most).alias(name))

    size = text_blocks.groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("blocks_total"), F.sum(F.length(F.trim("content")).cast("bigint")).alias("chars_total"))
    rank = F.coalesce("rank", F.lit(9999)).alias("rank")
    out = pages.select(*_PAGE, "title", "modality").join(roles, _PAGE, "left").join(size, _PAGE, "left")
    for child in (
        some(points, "key_points", 8, "pos", "point"), some(text_blocks, "blocks", 12, "pos", "element_id", "type", preview(F.col("content"), 260).alias("preview")),
        some(figures, "figures", 1 << 20, rank, (-F.coalesce("importance", F.lit(0.0))).alias("order"), "element_id", "role"), some(tables, "tables", 1 << 20, "element_id", "table_summary", "table_conclusion"), some(items, "required_items", 1 << 20, "element_id", "learning_role", "confidence"),
    ):
        out = out.join(child, _PAGE, "left")
    if sections is not None:
        out = out.join(sections.select(*_PAGE, "section"), _PAGE, "left")
    return out


def deck_understanding(understood: DataFrame) -> DataFrame:
    """Per deck of page_understanding: title, pages, counts of roles, tables, figures and those of 0.65 and more, and the 80 best figures.

    Figures are ranked with a row_number before they are gathered.
    """
    title = F.when(F.trim("title") != "", F.col("title"))
    per = understood.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("pages_total"), F.coalesce(F.min_by(title, F.when(title.isNotNull(), F.col("slide_id"))), F.lit("Untitled Deck")).alias("course_title"),
        F.sum(F.coalesce(F.size("tables"), F.lit(0)).cast("bigint")).alias("tables_total"), F.sum(F.coalesce(F.size("figures"), F.lit(0)).cast("bigint")).alias("figures_total"),
        F.sum(F.coalesce(F.size("required_items"), F.lit(0)).cast("bigint")).alias("required_items"), *[F.count_if(F.col("role") == r).alias(f"{r}_pages") for r in ("agenda", "table", "diagram", "transition", "example", "concept", "other")],
    )
    each = understood.select("deck_id", F.explode("figures").alias("f")).select("deck_id", "f.rank", "f.order", "f.element_id")
    n = F.row_number().over(Window.partitionBy("deck_id").orderBy("rank", "order", "element_id"))
    best = each.withColumn("n", n).where("n <= 80").groupBy("deck_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "element_id"))), lambda x: x["element_id"]).alias("important_figures"))
    high = each.groupBy("deck_id").agg(F.count_if(F.col("order") <= -0.65).alias("high_value_figures"))
    return per.join(high, "deck_id", "left").join(best, "deck_id", "left").na.fill(0, ["high_value_figures"])


def page_briefs(pages: DataFrame, text_blocks: DataFrame, most: int = 5, limit: int = 520) -> DataFrame:
    """(deck_id, slide_id, brief): title, the first ``most`` blocks and 260 characters each of OCR text and visual summary, collapsed and cut."""
    n = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("pos"))
    first = text_blocks.where(F.trim("content") != "").withColumn("n", n).where(F.col("n") <= most).groupBy(*_PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]).alias("_b"))
    parts = F.concat(F.array("title"), F.coalesce("_b", F.array().cast("array<string>")), F.array(F.substring("ocr_text", 1, 260), F.substring("visual_summary", 1, 260)))
    text = F.array_join(F.filter(F.array_compact(parts), lambda x: x != ""), " ")
    return pages.join(first, _PAGE, "left").select(*_PAGE, preview(text, limit).alias("brief"))
