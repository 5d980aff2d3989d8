"""Images of pages: asset classes, repeated templates, importance and rank, neighbours, overlap suppression."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox_area, center_inside, expand, horizontal_overlap, intersection, iou, is_template_box, round_scaled, sum_of_areas, vertical_overlap
from ..functions.text import contains_any
from ..shared import written
from .spatial import connected, meeting_pairs, nearest_in_cells

_PAGE = ["deck_id", "slide_id"]


def classify_images(images: DataFrame) -> DataFrame:
    """images + asset_class by size, in this order: tiny_file, tiny_area, tiny_dimension, thin_decoration; then by place.

    An image without a positive size is unknown, unless its place makes it decoration or a page image.
    """
    area, low, high = F.col("width").cast("bigint") * F.col("height"), F.least("width", "height"), F.greatest("width", "height")
    share, b = bbox_area(F.col("bbox")), F.col("bbox")
    edge = (b[0] <= 0.08) | (b[1] <= 0.08) | (b[2] >= 0.92) | (b[3] >= 0.92)
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    kind = (
        F.when(sized & (F.col("file_size") < 512), "tiny_file").when(sized & (area < 10_000), "tiny_area").when(sized & (low < 24), "tiny_dimension").when(sized & (high >= 8 * low) & (area < 150_000), "thin_decoration")
        .when(share < 0.01, "tiny_placement").when((share < 0.018) & edge, "edge_decoration").when(share >= 0.85, "page_image").when(~sized, "unknown").otherwise("content")
    )
    return images.withColumn("asset_class", kind)


#: Words in captions of template images.
TEMPLATE_WORDS = ["logo", "watermark", "decorative", "图标", "装饰", "水印"]


def mark_templates(images: DataFrame) -> DataFrame:
    """images + repeat_count, ignored, ignore_reason: of a fingerprint seen twice both if both look like a template, of one seen three times those that do.

    Page images, crops, composites and ignored images aren't compared. A fingerprint (size, dimensions, file name)
    is one deck's; an image without sizes has none. Template-like: small at an edge or corner, or named so in the
    caption. Counts are aggregated and joined back: no window gathers the copies of a hot fingerprint. The few
    fingerprints seen twice are written, so that Spark knows their size before it moves the images for the join.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    known = (F.coalesce("file_size", F.lit(0)) > 0) | (F.coalesce("width", F.lit(0)) > 0) | (F.coalesce("height", F.lit(0)) > 0)
    fingerprint = F.concat_ws(":", F.lit("meta"), *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("file_size", "width", "height")], name)
    before = F.coalesce("ignored", F.lit(False)) if "ignored" in images.columns else F.lit(False)
    open_ = ~F.coalesce(F.col("role").isin("page_image", "figure_crop", "composite_figure", "composite_child"), F.lit(False)) & ~before & known
    like = F.coalesce(is_template_box(F.col("bbox")), F.lit(False))
    if "caption" in images.columns:
        like = like | contains_any(F.coalesce("caption", F.lit("")), TEMPLATE_WORDS)
    marked = images.withColumn("fingerprint", F.when(open_, fingerprint)).withColumn("template_like", like).withColumn("_before", before)
    groups = marked.where("fingerprint is not null").groupBy("deck_id", "fingerprint").agg(F.count(F.lit(1)).alias("repeat_count"), F.count_if("template_like").alias("n_like"))
    out = marked.join(written(groups.where("repeat_count > 1"), "fingerprints"), ["deck_id", "fingerprint"], "left")
    now = F.coalesce(F.col("template_like") & ((F.col("repeat_count") >= 3) | (F.col("n_like") == F.col("repeat_count"))), F.lit(False))
    rest = [c for c in images.columns if c not in ("ignored", "ignore_reason", "repeat_count")]
    reason = F.col("ignore_reason") if "ignore_reason" in images.columns else F.lit(None).cast("string")
    return out.select(*rest, F.coalesce("repeat_count", F.lit(1)).cast("bigint").alias("repeat_count"), (F.col("_before") | now).alias("ignored"), F.when(now, "repeated_template_asset").otherwise(reason).alias("ignore_reason"))


#: What raises or lowers an image's importance, in the order in which reasons are given.
WEIGHTS = {
    "figure_crop": 0.35, "composite_figure": 0.38, "page_image_penalty": -0.22, "embedded_content": 0.08, "large_visual_area": 0.18, "medium_visual_area": 0.12, "small_but_usable_area": 0.04, "low_area_penalty": -0.18,
    "thin_or_tiny_dimension_penalty": -0.16, "extreme_aspect_ratio_penalty": -0.16, "wide_or_tall_aspect_ratio": -0.06, "has_visual_summary": 0.12, "has_ocr_text": 0.08, "has_caption": 0.04, "shape_diagram_crop": 0.08, "image_only_page": 0.05, "mixed_page": 0.03,
}


def score_images(images: DataFrame) -> DataFrame:
    """images + importance (0 to 1, three digits) and reasons; an ignored image has 0.

    Columns that images may have besides: confidence of a crop, visual_summary, ocr_text, caption, page_modality.
    Sizes and roles are columns of one projection, flags of the next, so that each is computed once.
    """
    have = lambda c, t="string": F.col(c) if c in images.columns else F.lit(None).cast(t)
    some = lambda c: F.coalesce(have(c), F.lit("")) != ""
    low = F.least("width", "height")
    base = images.withColumns({
        "_sized": F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "_area": F.col("width").cast("bigint") * F.col("height"), "_low": low, "_aspect": F.greatest("width", "height") / F.greatest(low, F.lit(1)),
        "_role": F.coalesce(F.nullif("role", F.lit("")), F.lit("content")), "_page": F.coalesce(have("page_modality"), F.lit("")), "_sure": have("confidence", "double").cast("double"),
    })
    sized, area, aspect, role, page = map(F.col, ("_sized", "_area", "_aspect", "_role", "_page"))
    conditions = [
        role == "figure_crop", role == "composite_figure", role == "page_image", role == "content", sized & (area >= 500_000), sized & area.between(120_000, 499_999), sized & area.between(40_000, 119_999), sized & (area < 40_000),
        sized & (F.col("_low") < 80), sized & (aspect >= 6), sized & (aspect >= 3.5) & (aspect < 6), some("visual_summary"), some("ocr_text"), some("caption") & ~F.coalesce(have("caption"), F.lit("")).startswith("第 "),
        (page == "shape_diagram") & (role == "figure_crop"), page == "image_only", page == "mixed",
    ]
    flagged = base.withColumns({f"_f{i}": c for i, c in enumerate(conditions)})
    rated = F.col("_f0") & F.col("_sure").isNotNull()
    score = F.lit(0.35) + F.when(rated, F.greatest(F.lit(-0.08), F.least(F.lit(0.12), (F.col("_sure") - 0.45) * 0.28))).otherwise(0.0)
    for i, weight in enumerate(WEIGHTS.values()):
        score = score + F.when(F.col(f"_f{i}"), weight).otherwise(0.0)
    score = F.when(F.col("ignored"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    names = [F.when(F.col(f"_f{i}"), F.lit(name)) for i, name in enumerate(WEIGHTS)]
    sure = F.when(rated, F.format_string("crop_confidence:%.2f", F.col("_sure")))
    reasons = F.array_compact(F.array(F.lit("content_candidate"), *names[:11], sure, *names[11:]))
    why = F.concat(F.lit("ignored:"), F.coalesce(F.nullif(have("ignore_reason"), F.lit("")), F.lit("decorative")))
    return flagged.select(*images.columns, F.round(score, 3).alias("importance"), F.when(F.col("ignored"), F.array(why)).otherwise(reasons).alias("reasons"))


def rank_images(scored: DataFrame) -> DataFrame:
    """scored + rank within the page by importance and id; an ignored image has none."""
    rank = F.row_number().over(Window.partitionBy(*_PAGE, "ignored").orderBy(F.col("importance").desc(), "element_id"))
    return scored.withColumn("rank", F.when(~F.col("ignored"), rank))


def image_report(ranked: DataFrame) -> DataFrame:
    """Per deck: images, those with a rank, those of 0.65 and more, those ignored and those ignored as templates."""
    return ranked.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("images_total"), F.count_if(F.col("rank").isNotNull()).alias("ranked_images"), F.count_if((F.col("importance") >= 0.65) & ~F.col("ignored")).alias("high_value"),
        F.count_if("ignored").alias("ignored_images"), F.count_if(F.col("ignore_reason") == "repeated_template_asset").alias("template_images"),
    )


def _is_part() -> Column:
    """No special role, 0.0002 to 0.18 of the page, no small image at an edge."""
    b, area = F.col("bbox"), bbox_area(F.col("bbox"))
    edge = (area < 0.012) & ((b[0] <= 0.025) | (b[1] <= 0.025) | (b[2] >= 0.975) | (b[3] >= 0.975))
    special = F.coalesce(F.col("role").isin("page_image", "figure_crop", "composite_figure", "composite_child"), F.lit(False))
    return F.coalesce(~special & area.between(0.0002, 0.18) & ~edge, F.lit(False))


def composite_parts(images: DataFrame) -> DataFrame:
    """Parts that may make up a figure + area, aspect: no special role, 0.0002 to 0.18 of the page, no small image at an edge."""
    b = F.col("bbox")
    w, h = F.greatest(F.lit(0.0001), b[2] - b[0]), F.greatest(F.lit(0.0001), b[3] - b[1])
    return images.where(_is_part()).withColumn("area", bbox_area(b)).withColumn("aspect", F.greatest(w / h, h / w))


def images_with_parts(images: DataFrame, least: int = 3) -> DataFrame:
    """All images of pages that have ``least`` parts or more; no other page has a group of parts (``part_groups``)."""
    n = F.count_if("_part").over(Window.partitionBy(*_PAGE))
    return images.withColumn("_part", _is_part()).withColumn("_n", n).where(F.col("_n") >= least).select(*images.columns)


def neighbor_pairs(parts: DataFrame, gap: float = 0.09, cross: float = 0.14, overlap: float = 0.2) -> DataFrame:
    """Pairs (a, b) of a page's parts, a before b: at a distance up to ``gap``, or overlapping in one direction with up to ``cross`` in the other.

    Parts meet in cells of the page's grid; neighbours are at most max(gap, cross) apart in both directions.
    """
    a, b = parts.select(*_PAGE, F.col("element_id").alias("a"), F.col("bbox").alias("p")), parts.select(*_PAGE, F.col("element_id").alias("b"), F.col("bbox").alias("q"))
    p, q = F.col("p"), F.col("q")
    dx = F.greatest(F.lit(0.0), p[0] - q[2], q[0] - p[2])
    dy = F.greatest(F.lit(0.0), p[1] - q[3], q[1] - p[3])
    near = (F.hypot(dx, dy) <= gap) | ((horizontal_overlap(p, q) >= overlap) & (dy <= cross)) | ((vertical_overlap(p, q) >= overlap) & (dx <= cross))
    return meeting_pairs(a, b, "p", "q", max(gap, cross) + 1e-9).where((F.col("a") < F.col("b")) & near).select(*_PAGE, "a", "b")


def part_groups(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Connected parts of a page, groups of ``least`` or more: deck_id, slide_id, element_id, group_id (its first part).

    pairs: deck_id, slide_id, a, b. Rounds of joins (``connected``), so a page may have any number of parts.
    """
    tied = connected(pairs.select(*_PAGE, F.col("a").alias("u"), F.col("b").alias("v")))
    heads = tied.select(*_PAGE, F.col("v").alias("element_id"), F.col("v").alias("group_id")).distinct()
    labels = tied.select(*_PAGE, F.col("u").alias("element_id"), F.col("v").alias("group_id")).unionByName(heads)
    sizes = labels.groupBy(*_PAGE, "group_id").count().where(F.col("count") >= least).drop("count")
    return labels.join(sizes, [*_PAGE, "group_id"], "left_semi").select(*_PAGE, "element_id", "group_id")


def nearby_elements(groups: DataFrame, elements: DataFrame, margin: float = 0.06) -> DataFrame:
    """groups (deck_id, slide_id, group_id, bbox) + nearby: ids of the page's elements that the box, widened by ``margin``, meets or holds the centre of."""
    g = groups.select(*_PAGE, "group_id", expand(F.col("bbox"), margin).alias("_w"))
    e = elements.where("bbox is not null").select(*_PAGE, "element_id", F.col("bbox").alias("_q"))
    met = (intersection(F.col("_w"), F.col("_q")) > 0) | center_inside(F.col("_q"), F.col("_w"))
    found = meeting_pairs(g, e, "_w", "_q").where(met).groupBy(*_PAGE, "group_id").agg(F.array_sort(F.collect_set("element_id")).alias("nearby"))
    return groups.join(found, [*_PAGE, "group_id"], "left").withColumn("nearby", F.coalesce("nearby", F.array().cast("array<string>")))


def evaluate_groups(members: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Groups of parts that look like one figure: deck_id, slide_id, group_id, bbox, parts, nearby, confidence, reason.

    members: parts with group_id, area and aspect. pages: modality. The box of all parts covers 0.04 to 0.75 of
    the page and spans 0.18 in a direction. A diagram shows by five parts, a long thin one, a tiny one beside
    words, or the page's modality. Large parts make no figure, nor do up to four of them without a thin one.
    """
    b = F.col("bbox")
    box = F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3]))
    per = members.groupBy(*_PAGE, "group_id").agg(
        box.alias("bbox"), F.array_sort(F.collect_list("element_id")).alias("parts"), F.median("area").alias("_mid"), F.max("area").alias("_max"), F.sum("area").alias("_sum"),
        F.bool_or(F.col("area") <= 0.015).alias("_tiny"), F.bool_or(F.col("aspect") >= 2.8).alias("_thin"),
    )
    union, n = bbox_area(F.col("bbox")), F.size("parts")
    wide = written(per.where(union.between(0.04, 0.75) & ((b[2] - b[0] >= 0.18) | (b[3] - b[1] >= 0.18))), "wide-groups")
    beside = elements.join(wide.select(*_PAGE).distinct(), _PAGE, "left_semi")
    near = nearby_elements(wide, beside).join(pages.select(*_PAGE, "modality"), _PAGE, "left")
    words, shape, thin = F.size("nearby") > 0, F.coalesce(F.col("modality") == "shape_diagram", F.lit(False)), F.col("_thin")
    sign = (n >= 5) | thin | (F.col("_tiny") & words) | shape
    large = ((n <= 4) & (F.col("_mid") >= 0.045) & ~thin & ~shape) | ((F.col("_max") > 0.14) & (n < 5))
    density = F.col("_sum") / F.greatest(union, F.lit(0.0001))
    sure = 0.54 + F.least(F.lit(0.18), n * 0.025) + F.when(thin, 0.1).otherwise(0.0) + F.when(words, 0.06).otherwise(0.0) + F.when(shape, 0.05).otherwise(0.0) - F.when(density < 0.18, 0.04).otherwise(0.0)
    reason = F.concat(F.lit("small_embedded_images_cluster"), F.when(thin, "+connector_like_part").otherwise(""), F.when(words, "+nearby_labels").otherwise(""))
    return near.where(sign & ~large).select(*_PAGE, "group_id", "bbox", "parts", "nearby", F.round(F.greatest(F.lit(0.45), F.least(F.lit(0.92), sure)), 3).alias("confidence"), reason.alias("reason"))


def select_composites(evaluated: DataFrame, images: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(composites, images): the surest two groups of each page as figures, and images with their parts ignored.

    Composites: deck_id, slide_id, element_id (the page's next figure number), crop_bbox, confidence, reason,
    child_ids, source_ids. Of equal confidence the upper, then the left one comes first.
    """
    order = Window.partitionBy(*_PAGE).orderBy(F.col("confidence").desc(), F.col("bbox")[1], F.col("bbox")[0], "group_id")
    best = evaluated.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    used = images.groupBy(*_PAGE).agg(F.max(F.regexp_extract("element_id", r"^s\d+_fig(\d+)$", 1).try_cast("int")).alias("_last"))
    box = F.transform(expand(F.col("bbox"), 0.025), lambda v: F.round(v, 4))
    name = F.concat(F.lit("s"), F.col("slide_id").cast("string"), F.lit("_fig"), (F.coalesce("_last", F.lit(0)) + F.col("_r")).cast("string"))
    made = best.join(used, _PAGE, "left").select(*_PAGE, name.alias("element_id"), box.alias("crop_bbox"), "confidence", "reason", F.col("parts").alias("child_ids"), F.array_distinct(F.concat("parts", "nearby")).alias("source_ids"))
    child = made.select(*_PAGE, F.col("element_id").alias("_parent"), F.explode("child_ids").alias("element_id"))
    joined = images.join(child, [*_PAGE, "element_id"], "left")
    inside = F.col("_parent").isNotNull()
    new = {"role": F.when(inside, "composite_child").otherwise(F.col("role")), "ignored": F.when(inside, True).otherwise(F.col("ignored")), "ignore_reason": F.when(inside, F.concat(F.lit("part_of_composite:"), "_parent")).otherwise(F.col("ignore_reason"))}
    return made, joined.select(*[new.get(c, F.col(c)).alias(c) for c in images.columns])


def composite_report(pages: DataFrame, parts: DataFrame, composites: DataFrame) -> DataFrame:
    """Per deck: pages, those with parts, those with composites, composites and the images absorbed in them."""
    p = pages.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages_total"))
    a = parts.groupBy("deck_id").agg(F.count_distinct("slide_id").alias("pages_with_candidates"))
    c = composites.groupBy("deck_id").agg(F.count_distinct("slide_id").alias("pages_with_composites"), F.count(F.lit(1)).alias("composites_created"), F.sum(F.size("child_ids")).alias("child_images_absorbed"))
    return p.join(a, "deck_id", "left").join(c, "deck_id", "left").na.fill(0)


def norm_candidate(bbox: Column, width: Column, height: Column) -> Column:
    """A model's box as shares of the page: above 100 it is in pixels, above 1.5 in per cent. Corners in order and clamped; null without an area."""
    high = F.array_max(bbox)
    scaled = F.when(high > 100, F.zip_with(bbox, F.array(width, height, width, height), lambda v, s: v / s)).when(high > 1.5, F.transform(bbox, lambda v: v / 100)).otherwise(bbox)
    clamped = F.transform(scaled, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    box = F.array(F.least(clamped[0], clamped[2]), F.least(clamped[1], clamped[3]), F.greatest(clamped[0], clamped[2]), F.greatest(clamped[1], clamped[3]))
    return F.when((F.size(bbox) == 4) & (bbox_area(box) > 0), box)


#: Words of decoration, of knowledge and of text in a candidate's label and type.
DECORATIVE_WORDS = ["logo", "watermark", "decorative", "decoration", "background", "icon", "页码", "图标", "装饰", "背景", "水印"]
KNOWLEDGE_WORDS = [
    "chart", "plot", "graph", "axis", "curve", "diagram", "table", "formula", "mixed", "screenshot", "screen", "photo", "image", "figure", "flow", "architecture",
    "流程", "架构", "截图", "公式", "坐标", "曲线", "图表", "示意", "结构",
]
TEXT_WORDS = ["text", "title", "heading", "paragraph", "bullet", "caption", "ocr", "word", "文字", "标题", "正文"]
CHART_WORDS = ["chart", "plot", "graph", "axis", "curve", "diagram", "table", "formula", "mixed"]


def crop_reject(candidates: DataFrame, layout: DataFrame, min_confidence: float = 0.45, min_area: int = 20_000) -> DataFrame:
    """candidates + skip_reason: the first that holds, null for a crop worth making.

    candidates: deck_id, slide_id, pos, bbox, label, content_type, confidence, width, height of the page in
    pixels. layout: deck_id, slide_id, kind (text, table or image), bbox. Overlaps are left to suppress_overlaps.
    Last come regions of structured text: by how much of the crop text and pictures cover, whatever the order in
    which their shares are added.
    """
    b, words = F.col("bbox"), F.concat_ws(" ", "content_type", "label")
    edge = (b[0] <= 0.08) | (b[1] <= 0.08) | (b[2] >= 0.92) | (b[3] >= 0.92)
    corner = ((b[0] <= 0.08) | (b[2] >= 0.92)) & ((b[1] <= 0.08) | (b[3] >= 0.92))
    area = bbox_area(b)
    template = ((area <= 0.014) & corner) | ((area <= 0.008) & edge)
    key = [*_PAGE, "pos"]
    met = meeting_pairs(candidates.select(*key, "bbox"), layout.where("bbox is not null").select(*_PAGE, "kind", F.col("bbox").alias("_q")), "bbox", "_q").withColumn("_i", intersection(F.col("bbox"), F.col("_q")))
    text = sum_of_areas(F.when(F.col("kind") != "image", F.col("_i")).otherwise(0.0))
    covered = met.groupBy(*key).agg(text.alias("_text"), sum_of_areas(F.when(F.col("kind") == "image", F.col("_i")).otherwise(0.0)).alias("_seen"))
    joined = candidates.join(covered, key, "left")
    of_text, of_image = F.coalesce(F.col("_text"), F.lit(0.0)) / area, F.coalesce(F.col("_seen"), F.lit(0.0)) / area
    structured = (contains_any(words, TEXT_WORDS) & (of_text >= 0.18) & (of_image < 0.08)) | ((of_text >= 0.55) & (of_image < 0.12))
    reason = (
        F.when(contains_any(words, DECORATIVE_WORDS), "decorative_candidate").when(template & ~contains_any(words, KNOWLEDGE_WORDS), "edge_template_candidate").when(F.col("confidence") < min_confidence, "low_confidence")
        .when(area * F.col("width") * F.col("height") < min_area, "small_area").when((b[2] - b[0] < 0.04) | (b[3] - b[1] < 0.04), "thin_or_tiny_region").when(area > 0.85, "full_page_like").when(structured, "structured_text_region")
    )
    return joined.withColumn("skip_reason", reason).drop("_text", "_seen")


#: Candidates of a page that stand in one row for each of them.
ROW_BOXES = 64


def limit_before_next(candidates: DataFrame) -> DataFrame:
    """candidates with boxes that end above the next candidate of their page in the same columns, if 0.04 of height remain.

    height: of the page in pixels. The boxes of a page's few candidates stand in one row, which each of them meets;
    those of pages with more meet by cells (``_ends_in_cells``). Rows of a page with one pos have one end.
    """
    key = [*_PAGE, "pos"]
    wide = written(candidates.groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROW_BOXES).select(*_PAGE), "wide-pages")
    apart = None if wide.isEmpty() else wide
    near = candidates if apart is None else candidates.join(apart, _PAGE, "left_anti")
    b = F.col("bbox")
    box = F.transform(F.coalesce(b, F.array_repeat(F.lit(None).cast("double"), 4)), lambda v: F.coalesce(v, F.lit(float("nan"))))
    held = near.groupBy(*_PAGE).agg(F.flatten(F.collect_list(F.concat(F.array(F.col("pos").cast("double"), _next_margin()), box))).alias("_boxes"))
    joined = near.join(held, _PAGE, "left").withColumn("_end", F.arrow_udf(_ends, "double")(F.col("pos").cast("double"), "_boxes")).drop("_boxes")
    if apart is not None:
        far = candidates.join(apart, _PAGE, "left_semi")
        joined = joined.unionByName(far.join(_ends_in_cells(far), key, "left"))
    cut = F.transform(F.array(b[0], b[1], b[2], F.col("_end")), lambda v: F.round(v, 4))
    return joined.withColumn("bbox", F.when(F.col("_end") > b[1] + 0.04, cut).otherwise(b)).drop("_end")


def _next_margin() -> Column:
    return F.greatest(F.lit(0.006), F.lit(8.0) / F.greatest(F.lit(1), F.col("height")))


def _ends(pos: pa.Array, boxes: pa.Array) -> pa.Array:
    """Per row the least end that the page's boxes (pos, margin, x1, y1, x2, y2 each) set to those of its pos; null if none does."""
    n = len(pos)
    count = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False) // 6
    flat = pc.fill_null(boxes.flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, 6)
    start, own = np.cumsum(count) - count, pc.fill_null(pos, np.nan).to_numpy(zero_copy_only=False)
    most, least = int(count.max(initial=0)), np.full(n, np.inf)
    for i in range(most):  # the boxes of the row's own pos, mostly one
        mine = np.flatnonzero(count > i)
        mine = mine[flat[start[mine] + i, 0] == own[mine]]
        for k in range(most if len(mine) else 0):
            rows = mine[count[mine] > k]
            (m, x1, y1, x2, y2), (other, a1, b1, a2) = flat[start[rows] + i, 1:].T, flat[start[rows] + k][:, [0, 2, 3, 4]].T
            common, width = np.maximum(0.0, np.minimum(x2, a2) - np.maximum(x1, a1)), np.minimum(x2 - x1, a2 - a1)
            over = np.divide(common, width, out=np.zeros(len(rows)), where=width != 0)
            cuts = (other != own[rows]) & (b1 > y1 + m) & (over >= 0.25)
            least[rows[cuts]] = np.minimum(least[rows[cuts]], np.minimum(y2, b1 - m)[cuts])
    return pa.array(least, mask=np.isinf(least))


def _ends_in_cells(candidates: DataFrame) -> DataFrame:
    """(deck_id, slide_id, pos, _end) for pages of any number of candidates.

    Only a candidate that begins within the box, or just below it, cuts it, so the two meet in a cell of the page's grid.
    """
    key = [*_PAGE, "pos"]
    other = candidates.select(*_PAGE, F.col("pos").alias("_pos"), F.col("bbox").alias("_q"))
    below = meeting_pairs(candidates.select(*key, "bbox", _next_margin().alias("_m")), other, "bbox", "_q", F.col("_m") + 1e-9).where((F.col("pos") != F.col("_pos")) & (F.col("_q")[1] > F.col("bbox")[1] + F.col("_m")) & (horizontal_overlap(F.col("bbox"), F.col("_q")) >= 0.25))
    return below.groupBy(*key).agg(F.min(F.least(F.col("bbox")[3], F.col("_q")[1] - F.col("_m"))).alias("_end"))


def enclosing_groups(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """candidates + group_bbox: of the page's groups larger than the crop, up to 0.72 of the page and covering 0.45 of it, the one with most overlap for its area.

    groups: deck_id, slide_id, group_id, bbox.
    """
    key = [*_PAGE, "pos"]
    area, own = F.col("_a"), F.greatest(bbox_area(F.col("bbox")), F.lit(0.0001))
    g = groups.where("bbox is not null").select(*_PAGE, "group_id", F.col("bbox").alias("_g"), bbox_area(F.col("bbox")).alias("_a"))
    met = meeting_pairs(candidates.select(*key, "bbox"), g, "bbox", "_g").withColumn("_o", intersection(F.col("bbox"), F.col("_g")) / own).where((area > own) & (area <= 0.72) & (F.col("_o") >= 0.45))
    best = met.groupBy(*key).agg(F.min_by("_g", F.struct((-F.col("_o") / area).alias("s"), "group_id")).alias("group_bbox"))
    return candidates.join(best, key, "left")


def merge_context(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """candidates with boxes widened by near titles and legends, in the order of pos of context; merged names what was added.

    context: deck_id, slide_id, element_id, pos, bbox, role (title or legend). A title lies up to 0.06 above or
    below with 0.28 of the width in common (a chart's 0.075 and 0.18); a legend up to 0.055 with 0.18, or beside it up
    to 0.045 with 0.22 of the height. Each box is compared with what has grown so far, so the page's few boxes are
    folded, for all rows of a batch together.
    """
    code, q = F.when(F.col("role") == "title", 1.0).when(F.col("role") == "legend", 2.0), F.col("bbox")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "element_id", code.alias("code"), "bbox")))
    # the boxes of a page as one list of doubles, made once a page: role, x1, y1, x2, y2, role, ...
    flat = F.flatten(F.transform(ordered, lambda x: F.array(x["code"], x["bbox"][0], x["bbox"][1], x["bbox"][2], x["bbox"][3])))
    boxes = context.where(q.isNotNull() & code.isNotNull()).groupBy(*_PAGE).agg(flat.alias("_c"))
    joined = candidates.join(boxes, _PAGE, "left")
    chart = contains_any(F.coalesce("content_type", F.lit("")), CHART_WORDS)
    grown = F.arrow_udf(_grown, "struct<bbox array<double>, merged array<string>>")
    return joined.withColumn("_s", grown("bbox", chart, "_c")).withColumn("bbox", F.coalesce("_s.bbox", "bbox")).withColumn("merged", F.col("_s.merged")).drop("_c", "_s")


def _round4(v: np.ndarray) -> np.ndarray:
    """Four digits, halves of the shortest decimal away from zero, as Spark's round."""
    scaled = np.abs(v) * 1e4
    out = np.copysign(np.floor(scaled + 0.5), v) / 1e4
    for i in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6), strict=True):
        out[i] = float(Decimal(repr(float(v[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


def _grown(bbox: pa.Array, chart: pa.Array, context: pa.Array) -> pa.Array:
    """Each row's box, grown over its context (see ``merge_context``) in its order, all rows of a batch at once; null if it hasn't grown."""
    n = len(bbox)
    known = np.array([v is not None and len(v) == 4 and None not in v for v in bbox.to_pylist()], bool)
    a = np.full((n, 4), np.nan)
    a[known] = pc.fill_null(bbox.filter(pa.array(known)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, 4)
    wide = pc.fill_null(chart, False).to_numpy(zero_copy_only=False).astype(bool)
    flat = pc.fill_null(context.flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, 5)
    count = pc.fill_null(pc.list_value_length(context), 0).to_numpy(zero_copy_only=False) // 5
    start = np.cumsum(count) - count
    #: how each row has grown: 1 by a title first, 2 by a legend first, 3 a title then a legend, 4 the other way round
    state = np.zeros(n, np.int64)
    after = np.array([[0, 1, 2, 3, 4], [1, 1, 4, 3, 4], [2, 3, 2, 3, 4]])

    def shared(p: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
        common, least = np.maximum(0.0, np.minimum(p[:, i + 2], b[:, i + 2]) - np.maximum(p[:, i], b[:, i])), np.minimum(p[:, i + 2] - p[:, i], b[:, i + 2] - b[:, i])
        return np.divide(common, least, out=np.zeros(len(p)), where=least != 0)

    for k in range(int(count.max(initial=0))):
        rows = np.flatnonzero(count > k)
        x = flat[start[rows] + k]
        p, b, c = a[rows], x[:, 1:], wide[rows]
        gap_x, gap_y = (np.maximum(0.0, np.maximum(b[:, i] - p[:, i + 2], p[:, i] - b[:, i + 2])) for i in (0, 1))
        across, along = shared(p, b, 0), shared(p, b, 1)
        title = ((gap_y <= 0.06) & (across >= 0.28)) | (c & (gap_y <= 0.075) & (across >= 0.18))
        legend = ((gap_y <= 0.055) & (across >= 0.18)) | ((gap_x <= 0.045) & (along >= 0.22))
        take = np.where(x[:, 0] == 1, title, legend)
        rows, p, b = rows[take], p[take], b[take]
        a[rows] = _round4(np.hstack([np.minimum(p[:, :2], b[:, :2]), np.maximum(p[:, 2:], b[:, 2:])]))
        state[rows] = after[x[take, 0].astype(int), state[rows]]
    names = pa.array([[], ["merged_nearby_title"], ["merged_nearby_legend"], ["merged_nearby_title", "merged_nearby_legend"], ["merged_nearby_legend", "merged_nearby_title"]], pa.list_(pa.string()))
    new = pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), 4).cast(pa.list_(pa.float64()))
    new = pc.if_else(pa.array(state > 0), new, pa.scalar(None, new.type))
    return pa.StructArray.from_arrays([new, names.take(pa.array(state))], ["bbox", "merged"])


def crop_report(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per deck: pages with candidates, candidates, crops, and candidates left out."""
    c = candidates.groupBy("deck_id").agg(F.count_distinct("slide_id").alias("targets_total"), F.count(F.lit(1)).alias("candidates"))
    a = accepted.groupBy("deck_id").agg(F.count(F.lit(1)).alias("crops_created"))
    return c.join(a, "deck_id", "left").select("deck_id", "targets_total", "candidates", F.coalesce("crops_created", F.lit(0).cast("bigint")).alias("crops_created"), (F.col("candidates") - F.coalesce("crops_created", F.lit(0))).alias("skipped"))


def suppress_overlaps(candidates: DataFrame, limit: float = 0.75, most: int = 3) -> DataFrame:
    """Per page, in order of pos: a candidate stays if it overlaps none that stayed by ``limit``, up to ``most``.

    As many rounds: the first candidate left on each page stays, and takes those away that overlap it. A page's
    candidates are never gathered; the one that stays meets them in a join that Spark can split.
    """
    left = candidates.select(*_PAGE, F.col("pos").cast("int").alias("pos"), "element_id", "bbox")
    stay = None
    for i in range(most):
        first = left.groupBy(*_PAGE).agg(F.min(F.struct("pos", "element_id", "bbox")).alias("k"))
        stay = first if stay is None else stay.unionByName(first)
        if i + 1 < most:
            met = left.join(first, _PAGE).where((iou(F.col("k.bbox"), F.col("bbox")) < limit) & (F.struct("pos", "element_id") > F.struct("k.pos", "k.element_id")))
            left = written(met.drop("k"), "candidates-left")
    return stay.select(*_PAGE, "k.element_id", "k.pos")


def _offsets(p: Column, q: Column) -> dict[str, Column]:
    """How the element q lies to the image p: common width, whether it is above, the gap and distances of the centres."""
    return {
        "over": horizontal_overlap(p, q), "above": q[3] <= p[1] + 0.03, "gap": F.greatest(F.lit(0.0), p[1] - q[3]),
        "dx": F.abs((p[0] + p[2]) / 2 - (q[0] + q[2]) / 2), "dy": F.abs((p[1] + p[3]) / 2 - (q[1] + q[3]) / 2),
    }


def _anchor_score(before: Column, over: Column, gap: Column, dx: Column, dy: Column) -> Column:
    score = F.when(before, gap * 1.8 + dx * 0.45 - over * 0.25).otherwise(F.sqrt(dx * dx + dy * dy) + 0.35 + F.when(over < 0.08, 0.12).otherwise(0.0))
    return round_scaled(score, 9)


def _anchor_reason(b: Column) -> list[Column]:
    """reason and confidence of the best element (before, over)."""
    reason = F.when(b["before"], "bbox_nearest_preceding_element").otherwise("bbox_nearest_element")
    sure = F.round(F.when(b["before"], F.least(F.lit(0.92), 0.72 + b["over"] * 0.2)).otherwise(F.least(F.lit(0.7), 0.46 + b["over"] * 0.2)), 3)
    return [reason.alias("reason"), sure.alias("confidence")]


def nearest_element(box: Column, boxes: Column) -> Column:
    """The element of a page that an image belongs to, as ``spatial_anchors``: its place among boxes, from 0, before and over; null without any.

    boxes: those of the page's few elements in the order of pos as one list of doubles, nan for an element without one.
    """
    return F.arrow_udf(_nearest, "struct<at int, before boolean, over double>")(box, boxes)


def _nearest(box: pa.Array, boxes: pa.Array) -> pa.Array:
    """``_offsets`` and ``_anchor_score`` for the first elements of all rows of a batch, then the second ones, and so on."""
    n = len(box)
    known = pc.fill_null(pc.equal(pc.list_value_length(box), 4), False)
    p = np.full((n, 4), np.nan)
    p[known.to_numpy(zero_copy_only=False)] = pc.fill_null(box.filter(known).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, 4)
    count = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False) // 4
    flat = pc.fill_null(boxes.flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, 4)
    start = np.cumsum(count) - count
    least, at, of_before, of_over = np.full(n, np.inf), np.full(n, -1, np.int32), np.zeros(n, bool), np.zeros(n)
    for k in range(int(count.max(initial=0))):
        rows = np.flatnonzero(count > k)
        x1, y1, x2, y2 = p[rows].T
        a1, b1, a2, b2 = flat[start[rows] + k].T
        common, width = np.maximum(0.0, np.minimum(x2, a2) - np.maximum(x1, a1)), np.minimum(x2 - x1, a2 - a1)
        over = np.divide(common, width, out=np.zeros(len(rows)), where=width != 0)
        gap, dx, dy = np.maximum(0.0, y1 - b2), np.abs((x1 + x2) / 2 - (a1 + a2) / 2), np.abs((y1 + y2) / 2 - (b1 + b2) / 2)
        before = (b2 <= y1 + 0.03) & (over >= 0.08)
        score = np.where(before, gap * 1.8 + dx * 0.45 - over * 0.25, np.sqrt(dx * dx + dy * dy) + 0.35 + np.where(over < 0.08, 0.12, 0.0))
        score = np.copysign(np.floor(np.abs(score) * 1e9 + 0.5), score) / 1e9
        better = score < least[rows]
        rows = rows[better]
        least[rows], at[rows], of_before[rows], of_over[rows] = score[better], k, before[better], over[better]
    return pa.StructArray.from_arrays([pa.array(at), pa.array(of_before), pa.array(of_over)], ["at", "before", "over"], mask=pa.array(at < 0))


def spatial_anchors(images: DataFrame, elements: DataFrame) -> DataFrame:
    """Per image the element it belongs to: the nearest before it in its column, else the nearest of all. First of equals.

    elements: element_id, bbox, pos. The least (score, pos) wins. Elements before an image score by the place of
    their lower edge, others by their centre: each place has its grid, and only the cells are searched that may
    hold a lower score than the best near the image. Of an id on several rows the row nearest to an element counts;
    if that row's placed (a column images may have) is false, the id gets no element.
    """
    placed = F.coalesce("placed", F.lit(True)) if "placed" in images.columns else F.lit(True)
    i = images.where("bbox is not null").select(*_PAGE, F.col("element_id").alias("ask"), F.col("bbox").alias("p"), placed.alias("placed"))
    e = elements.where("bbox is not null").select(*_PAGE, F.col("element_id").alias("anchor_id"), F.col("bbox").alias("q"), "pos")
    p, q = F.col("p"), F.col("q")
    middle, centre = (p[0] + p[2]) / 2, (p[1] + p[3]) / 2

    def judge(pairs: DataFrame) -> DataFrame:
        # overlap and gaps are columns of a projection below, so each is computed once for a pair
        sides = pairs.select(*_PAGE, "ask", "placed", "grid", "anchor_id", "pos", *[c.alias(n) for n, c in _offsets(p, q).items()])
        before = F.col("before")
        sides = sides.withColumn("before", F.col("above") & (F.col("over") >= 0.08))
        score = _anchor_score(before, *map(F.col, ("over", "gap", "dx", "dy")))
        return sides.withColumns({"kind": F.when(before, "before").otherwise("other"), "best": F.struct(score.alias("score"), "pos", "anchor_id", "before", "over", "placed")})

    def off(v: Column, low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0.0), low - v, v - high)

    bounds = {
        "before": lambda x0, x1, y0, y1: off(middle, x0, x1) * 0.45 + F.greatest(F.lit(0.0), p[1] - y1) * 1.8 - 0.25 - 1e-6,
        "other": lambda x0, x1, y0, y1: F.hypot(off(middle, x0, x1), off(centre, y0, y1)) + 0.35 - 1e-6,
    }
    points = {"before": ((q[0] + q[2]) / 2, q[3]), "other": ((q[0] + q[2]) / 2, (q[1] + q[3]) / 2)}
    starts = {"before": (middle, p[1]), "other": (middle, centre)}
    found = nearest_in_cells(i, e, bounds, points, starts, judge).where("b.placed")
    return found.select(*_PAGE, F.col("ask").alias("image_id"), "b.anchor_id", *_anchor_reason(F.col("b")))
