"""Page profiling on decks of documents with images by rule, and tables from the dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages, tables
from . import bindings as b


def _image_rows(s: SparkSession, d: str) -> DataFrame:
    """Two of five pages have an image, one of them the whole page."""
    p = b.pages(s, d).where("doc_id % 5 < 2")
    return p.select("deck_id", "slide_id", F.concat(F.lit("s"), "slide_id", F.lit("_img1")).alias("element_id"), F.when(F.col("doc_id") % 5 == 0, "page_image").otherwise("content").alias("role"), (F.col("doc_id") % 11 == 0).alias("ignored"), (F.col("doc_id") % 900).cast("int").alias("width"), F.lit(400).alias("height"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    p = b.pages(s, d).select("deck_id", "slide_id", (F.col("doc_id") % 3 == 0).alias("has_screenshot"), (F.col("doc_id") % 4).cast("long").alias("warnings"))
    t = b.blocks(s, d).where("content like '%|%'").select("deck_id", "slide_id").distinct()
    return pages.page_stats(p, b.blocks(s, d), t, _image_rows(s, d))


def _modality(s: SparkSession, d: str) -> DataFrame:
    return pages.classify_modality(_stats(s, d))


def _cells(s: SparkSession, d: str) -> DataFrame:
    """A table of parts per size: a header and a row per part."""
    p = b.table(s, d, "part").groupBy("p_size", (F.col("p_partkey") % 40).alias("g")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_retailprice"))).alias("r"))
    rows = F.transform("r", lambda r: F.array(r["p_name"], r["p_brand"], F.floor(r["p_retailprice"]).cast("string")))
    return p.select(F.col("p_size").cast("long").alias("deck_id"), F.col("g").alias("slide_id"), F.concat(F.array(F.array(F.lit("name"), F.lit("brand"), F.lit("price"))), rows).alias("rows"))


QUERIES = {
    "c1_page_stats": lambda s, d: _stats(s, d),
    "c2_modality": lambda s, d: _modality(s, d).select("deck_id", "slide_id", "modality", "confidence", F.array_join("reasons", ",").alias("reasons"), F.array_join("hints", ",").alias("hints")),
    "c3_modality_report": lambda s, d: pages.modality_report(_modality(s, d)),
    "c4_ocr_targets": lambda s, d: pages.ocr_targets(_modality(s, d), _image_rows(s, d)),
    "c6_figure_targets": lambda s, d: pages.figure_targets(_modality(s, d)),
    "t3_key_rows": lambda s, d: tables.analyze_tables(_cells(s, d)).select("deck_id", "slide_id", "has_header", "n_rows", "width", F.array_join(F.col("key_rows.label"), ";").alias("labels")),
    "t4_table_preview": lambda s, d: _cells(s, d).select("deck_id", "slide_id", tables.table_preview(F.col("rows")).alias("preview")),
}

_STATS = "WITH " + b.BLOCKS_SQL + r""",
img AS (SELECT deck_id, slide_id, 's' || slide_id || '_img1' AS element_id, CASE WHEN doc_id % 5 = 0 THEN 'page_image' ELSE 'content' END AS role, doc_id % 11 = 0 AS ignored, CAST(doc_id % 900 AS INTEGER) AS width FROM pages WHERE doc_id % 5 < 2),
tx AS (SELECT deck_id, slide_id, count(*) AS text_blocks, CAST(sum(length(content)) AS BIGINT) AS text_chars, max(CASE WHEN content LIKE '%|%' THEN 1 ELSE 0 END)::BIGINT AS tables FROM blocks GROUP BY ALL),
im AS (SELECT deck_id, slide_id, count(*) AS images_total, count_if(NOT ignored AND role <> 'page_image')::BIGINT AS content_images, count_if(role = 'page_image')::BIGINT AS page_images, count_if(ignored AND role <> 'page_image')::BIGINT AS decorative_images FROM img GROUP BY ALL),
stats AS (
  SELECT p.deck_id, p.slide_id, coalesce(text_blocks, 0) AS text_blocks, coalesce(text_chars, 0) AS text_chars, coalesce(tables, 0) AS tables, coalesce(images_total, 0) AS images_total,
         coalesce(content_images, 0) AS content_images, coalesce(page_images, 0) AS page_images, coalesce(decorative_images, 0) AS decorative_images, doc_id % 3 = 0 AS has_screenshot, doc_id % 4 AS warnings
  FROM pages p LEFT JOIN tx USING (deck_id, slide_id) LEFT JOIN im USING (deck_id, slide_id)),
kinds AS (
  SELECT *, CASE WHEN content_images > 0 THEN 'mixed' WHEN page_images > 0 OR (has_screenshot AND text_chars = 0 AND tables = 0) THEN 'image_only'
         WHEN has_screenshot AND (tables > 0 OR (text_chars > 0 AND text_chars < 500) OR warnings > 0) THEN 'shape_diagram' WHEN text_chars >= 80 OR tables > 0 THEN 'native_text' ELSE 'decorative' END AS modality FROM stats),
modality AS (
  SELECT *, CASE modality WHEN 'mixed' THEN CASE WHEN text_chars > 0 OR tables > 0 THEN 0.82 ELSE 0.72 END WHEN 'image_only' THEN CASE WHEN page_images > 0 OR warnings > 0 THEN 0.9 ELSE 0.72 END
           WHEN 'shape_diagram' THEN CASE WHEN text_chars > 0 THEN 0.68 ELSE 0.58 END WHEN 'native_text' THEN 0.86 ELSE 0.55 END::DOUBLE AS confidence,
         CASE modality WHEN 'mixed' THEN 'has_content_images' || CASE WHEN text_chars > 0 OR tables > 0 THEN ',has_extracted_text_or_tables' ELSE '' END WHEN 'image_only' THEN 'full_page_image_or_low_text_screenshot'
           WHEN 'shape_diagram' THEN 'screenshot_with_limited_extracted_objects' WHEN 'native_text' THEN 'text_rich_or_table_extracted' ELSE 'little_or_no_learning_content_detected' END AS reasons,
         CASE modality WHEN 'mixed' THEN 'use_embedded_images,vision_large_images' || CASE WHEN text_chars > 0 OR tables > 0 THEN ',use_extracted_text' ELSE '' END || CASE WHEN text_chars < 80 AND has_screenshot THEN ',ocr_page_screenshot' ELSE '' END
           WHEN 'image_only' THEN 'ocr_page_screenshot,crop_figures_from_screenshot,vision_page_screenshot' WHEN 'shape_diagram' THEN 'use_extracted_text,crop_figures_from_screenshot,vision_page_screenshot'
           WHEN 'native_text' THEN 'use_extracted_text' ELSE 'low_priority' END AS hints FROM kinds)"""
_CELLS = r"""WITH g AS (SELECT CAST(p_size AS BIGINT) AS deck_id, p_partkey % 40 AS slide_id, p_partkey, p_name, p_brand, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part)"""
SQL = {
    "c1_page_stats": _STATS + " SELECT * FROM stats",
    "c2_modality": _STATS + " SELECT deck_id, slide_id, modality, confidence, reasons, hints FROM modality",
    "c3_modality_report": _STATS + """ SELECT deck_id, count(*) AS pages_total, count_if(modality = 'mixed')::BIGINT AS mixed, count_if(modality = 'image_only')::BIGINT AS image_only, count_if(modality = 'shape_diagram')::BIGINT AS shape_diagram,
        count_if(modality = 'native_text')::BIGINT AS native_text, count_if(modality = 'decorative')::BIGINT AS decorative, count_if(modality IN ('image_only', 'shape_diagram'))::BIGINT AS image_driven,
        count_if(contains(hints, 'use_embedded_images'))::BIGINT AS embedded_image, count_if(contains(hints, 'ocr_page_screenshot'))::BIGINT AS ocr_recommended, count_if(contains(hints, 'crop_figures_from_screenshot'))::BIGINT AS crop_recommended FROM modality GROUP BY deck_id""",
    "c4_ocr_targets": _STATS + """, want AS (SELECT * FROM modality WHERE contains(hints, 'ocr_page_screenshot') OR text_chars < 80 OR warnings > 0),
        t AS (SELECT deck_id, slide_id, 'screenshot' AS target FROM want WHERE has_screenshot UNION ALL SELECT w.deck_id, w.slide_id, i.element_id FROM want w JOIN img i USING (deck_id, slide_id) WHERE NOT has_screenshot AND width * 400 >= 120000)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY slide_id) AS INTEGER) AS rank FROM t) WHERE rank <= 120""",
    "c6_figure_targets": _STATS + """ SELECT deck_id, slide_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY slide_id) AS INTEGER) AS rank FROM modality
        WHERE has_screenshot AND content_images = 0 AND (contains(hints, 'crop_figures_from_screenshot') OR page_images > 0 OR tables > 0 OR text_chars < 800 OR warnings > 0)) WHERE rank <= 80""",
    "t3_key_rows": _CELLS + r""", s AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_id ORDER BY p_partkey) AS i, 6 + least(length(p_name || ' ' || p_brand || ' ' || price) / 30.0, 4.0)
          + CASE WHEN regexp_matches(p_name || ' ' || p_brand, '(?i)total|summary|average|mean') THEN 3 ELSE 0 END + 1.5 AS score FROM g),
        r AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_id ORDER BY score DESC, i) AS k FROM s)
        SELECT deck_id, slide_id, true AS has_header, CAST(count(*) AS INTEGER) AS n_rows, 3 AS width, string_agg(p_name, ';' ORDER BY i) FILTER (k <= 3) AS labels FROM r GROUP BY ALL""",
    "t4_table_preview": _CELLS + r""", s AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_id ORDER BY p_partkey) AS i FROM g)
        SELECT deck_id, slide_id, 'name | brand | price' || coalesce(string_agg(' / ' || p_name || ' | ' || p_brand || ' | ' || price, '' ORDER BY i) FILTER (i <= 2), '') AS preview FROM s GROUP BY ALL""",
}
