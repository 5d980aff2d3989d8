"""The library's tables derived from the test tables, by one rule in Spark and in SQL.

Sections and note contexts have whole sources as decks (``source_pages``). Elsewhere a deck is a batch of 500
documents of a source, as its whole notes, payloads or question sets are one row each. A page is one document, a
block one of its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_structural_page


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck_id, slide_id, doc_id, title, text, structural: the title is the first line, or Contents on one of fifty pages."""
    p = table(spark, sf_dir, "documents").select(
        F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 500).cast("string")).alias("deck_id"),
        (F.col("doc_id") % 500 + 1).cast("int").alias("slide_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"),
    )
    p = p.withColumn("title", F.when(F.col("doc_id") % 50 == 7, "Contents").otherwise(F.substring(F.trim(F.split("text", "\n")[0]), 1, 140)))
    return p.withColumn("structural", is_structural_page(F.col("title"), F.concat("title", F.lit("\n"), "text"), F.col("slide_id") - 1))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck_id, slide_id, doc_id, n, element_id, content: the lines of each page that aren't empty."""
    lines = pages(spark, sf_dir).select("deck_id", "slide_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.col("pos") + 1
    return lines.select("deck_id", "slide_id", "doc_id", n.alias("n"), F.concat(F.lit("s"), "slide_id", F.lit("_t"), n).alias("element_id"), F.trim("line").alias("content")).where("content <> ''")


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck_id, slide_id, doc_id, lang, title, text: a deck is a whole source, a page's number follows its document's."""
    title = F.when(F.col("doc_id") % 50 == 7, "Contents").otherwise(F.substring(F.trim(F.split("text", "\n")[0]), 1, 140))
    p = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("deck_id"), (F.col("doc_id") + 1).cast("int").alias("slide_id"), "doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return p.withColumn("title", title)


def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck_id, slide_id, n, element_id, content: the lines of ``source_pages`` that aren't empty."""
    lines = source_pages(spark, sf_dir).select("deck_id", "slide_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.col("pos") + 1
    return lines.select("deck_id", "slide_id", n.alias("n"), F.concat(F.lit("s"), "slide_id", F.lit("_t"), n).alias("element_id"), F.trim("line").alias("content")).where("content <> ''")


def note_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by rule: of five blocks in turn one is left out and one only marked."""
    b = blocks(spark, sf_dir).withColumn("turn", (F.col("doc_id") + F.col("n")) % 5).where("turn <> 0")
    mark = F.concat(F.lit("<!-- source: p"), "slide_id", F.lit(":"), "element_id", F.lit(" -->"))
    return b.select("deck_id", "slide_id", "n", F.when(F.col("turn") == 1, mark).otherwise(F.concat("content", F.lit("\n"), mark)).alias("block"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck_id, slide_id, markdown: the note of each page."""
    per = note_blocks(spark, sf_dir).groupBy("deck_id", "slide_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    return per.select("deck_id", "slide_id", F.array_join(F.col("b.block"), "\n\n").alias("markdown"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("deck_id", "slide_id", "element_id", F.lit("text").alias("kind"), F.col("content").alias("text"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages: an order is a page, a line of it an image. Some have no size, a caption, a summary or text.

    Ids are unique on a page: lines with one number and one part are numbered on, in the order of their other values.
    """
    x1, y1 = F.col("l_partkey") % 70 / 100, (F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 70 / 100
    x2, y2 = x1 + (F.col("l_quantity") + 1) / 100 * 0.5, y1 + (F.col("l_partkey") % 29 + 1) / 100
    role = F.when(F.col("l_returnflag") == "R", "page_image").when(F.col("l_linestatus") == "O", "figure_crop").otherwise("content")
    k = F.col("l_partkey") % 11
    caption = F.when(k == 0, "company logo").when(k == 1, "第 1 页图片").when(k == 2, "图示").when(k < 6, F.concat(F.lit("figure t"), (F.col("l_orderkey") % 7).cast("string"))).otherwise("")
    again = F.row_number().over(Window.partitionBy("deck_id", "slide_id", "l_linenumber", "l_partkey").orderBy("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")) - 1
    deck, slide = F.col("deck_id"), F.col("slide_id")
    paged = table(spark, sf_dir, "lineitem").withColumns({"deck_id": deck_of(F.col("l_orderkey")), "slide_id": slide_of(F.col("l_orderkey"))})
    # dealt by page, as the operators' joins and windows are: they need no shuffle of their own. Boxes are made below
    # the window: filters stay above it and read them, and don't round again for each use. Places are multiples of
    # 0.005, so the floor gives what round does, without a decimal for each value
    dealt = paged.repartition("deck_id", "slide_id").withColumn("bbox", F.array(*[F.floor(v * 10_000 + 0.5) / 10_000 for v in (x1, y1, x2, y2)]))
    lines = dealt.withColumn("number", again * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey"))
    return lines.select(
        deck, slide, F.concat(F.lit("s"), slide, F.lit("_img"), F.col("number").cast("string")).alias("element_id"),
        role.alias("role"), "bbox", F.when(F.col("l_partkey") % 23 != 0, (F.col("l_partkey") % 900 + 20).cast("int")).alias("width"), (F.col("l_orderkey") % 700 + 20).cast("int").alias("height"),
        (F.col("l_quantity") * 40).cast("bigint").alias("file_size"), F.concat(F.lit("assets/"), (F.col("l_partkey") % 50).cast("string"), F.lit(".png")).alias("path"), F.round(F.col("l_discount") * 10, 4).alias("confidence"),
        caption.alias("caption"), F.when(F.col("l_suppkey") % 6 == 0, F.concat(F.lit("summary of "), F.col("l_partkey").cast("string"))).otherwise("").alias("visual_summary"),
        F.when(F.col("l_partkey") % 5 == 0, F.repeat(F.lit("word "), (F.col("l_linenumber") * 3 + 2).cast("int"))).otherwise("").alias("ocr_text"), F.lit("").alias("figure_explanation"), modality(F.col("l_orderkey")).alias("page_modality"),
    )


def deck_of(order):
    return F.floor(order / 8).cast("bigint")


def slide_of(order):
    return (order % 8 + 1).cast("int")


def modality(order):
    return F.element_at(F.array(*map(F.lit, MODALITIES)), (order % 4 + 1).cast("int"))


MODALITIES = ("mixed", "image_only", "shape_diagram", "native_text")


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of ``images``: deck_id, slide_id, modality."""
    return table(spark, sf_dir, "orders").select(deck_of(F.col("o_orderkey")).alias("deck_id"), slide_of(F.col("o_orderkey")).alias("slide_id"), modality(F.col("o_orderkey")).alias("modality"))


_KEY = r"regexp_replace(lower({}), '[\s:：,，.。;；、\-_（）()<>]+', '', 'g')"
_NUMBERED = r"list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^(?:\d+|[{}])\s*[.、．]'))"


def structural_sql(title: str, text: str, index: str, guard: bool = False) -> str:
    """The test for structural pages in SQL, on a title, the page's whole text and its place."""
    numbered = _NUMBERED.format(text, "一二三四五六七八九十" if guard else "一二三四五")
    titles = "('目录', '课程目录', '本章目录', '章节导航', 'contents', 'outline', 'agenda')"
    label = f"{_KEY.format(text)} IN {titles}" if guard else f"len(list_filter(string_split({text}, chr(10))[1:4], lambda x: {_KEY.format('x')} IN ('目录', '课程目录', '本章目录', '章节导航', 'contents', 'outline'))) > 0"
    cover = "讲师|教师|教授|邮箱|email|homepage|www|http" + ("" if guard else "|主页")
    return f"""({_KEY.format(title)} IN {titles} OR ({index} = 0 AND regexp_matches({_KEY.format(text)}, '{cover}')) OR {label}
      OR (len({numbered}) >= 3 AND coalesce(list_sum(list_transform({numbered}, lambda x: length(x))), 0) <= 260))"""


PAGES_SQL = rf"""pages0 AS (
  SELECT coalesce(source, 'none') || '/' || CAST(doc_id // 500 AS VARCHAR) AS deck_id, CAST(doc_id % 500 + 1 AS INTEGER) AS slide_id, doc_id, coalesce(text, '') AS text FROM documents),
pages1 AS (SELECT *, CASE WHEN doc_id % 50 = 7 THEN 'Contents' ELSE trim(string_split(text, chr(10))[1], ' ')[1:140] END AS title FROM pages0),
pages AS (SELECT *, {structural_sql("title", "title || chr(10) || text", "slide_id - 1")} AS structural FROM pages1)"""
SOURCE_PAGES_SQL = r"""spages AS (
  SELECT coalesce(source, 'none') AS deck_id, CAST(doc_id + 1 AS INTEGER) AS slide_id, doc_id, lang, coalesce(text, '') AS text,
         CASE WHEN doc_id % 50 = 7 THEN 'Contents' ELSE trim(string_split(coalesce(text, ''), chr(10))[1], ' ')[1:140] END AS title FROM documents)"""
BLOCKS_SQL = PAGES_SQL + r""",
blocks AS (
  SELECT deck_id, slide_id, doc_id, n, 's' || slide_id || '_t' || n AS element_id, trim(line, ' ') AS content
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS n FROM pages) WHERE trim(line, ' ') <> '')"""
NOTES_SQL = BLOCKS_SQL + r""",
note_blocks AS (
  SELECT deck_id, slide_id, n, CASE WHEN (doc_id + n) % 5 = 1 THEN '' ELSE content || chr(10) END || '<!-- source: p' || slide_id || ':' || element_id || ' -->' AS block
  FROM blocks WHERE (doc_id + n) % 5 <> 0),
notes AS (SELECT deck_id, slide_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS markdown FROM note_blocks GROUP BY ALL)"""
ITEMS_SQL = NOTES_SQL + r""",
cut AS (SELECT deck_id, unnest(regexp_split_to_array(markdown, '\n\s*\n')) AS block FROM notes),
tokens AS (
  SELECT deck_id, unnest(regexp_extract_all(block, 's\d+_(?:t|tbl|img|fig)\d+')) AS token,
         regexp_replace(regexp_replace(regexp_replace(block, '<!--.*?-->', '', 'gs'), 's\d+_(?:t|tbl|img|fig)\d+', ' ', 'g'), '[#>*_\s`~|:,.;()\[\]-]+', '', 'g') <> '' AS visible FROM cut),
items AS (
  SELECT b.deck_id, slide_id, element_id, content, count(token) > 0 AS trace_covered, coalesce(bool_or(visible), false) AS visible_covered
  FROM blocks b LEFT JOIN tokens t ON t.deck_id = b.deck_id AND t.token = b.element_id GROUP BY ALL)"""
IMAGES_SQL = r"""numbered_lines AS (
  SELECT *, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1) * 10000000 + l_linenumber * 1000000 + l_partkey AS number FROM lineitem),
images AS (
  SELECT l_orderkey // 8 AS deck_id, CAST(l_orderkey % 8 + 1 AS INTEGER) AS slide_id, 's' || (l_orderkey % 8 + 1) || '_img' || number AS element_id,
         CASE WHEN l_returnflag = 'R' THEN 'page_image' WHEN l_linestatus = 'O' THEN 'figure_crop' ELSE 'content' END AS role,
         round(l_partkey % 70 / 100, 4) AS x1, round((l_suppkey * 7 + l_orderkey) % 70 / 100, 4) AS y1,
         round(l_partkey % 70 / 100 + (l_quantity + 1) / 100 * 0.5, 4) AS x2, round((l_suppkey * 7 + l_orderkey) % 70 / 100 + (l_partkey % 29 + 1) / 100, 4) AS y2,
         CASE WHEN l_partkey % 23 <> 0 THEN CAST(l_partkey % 900 + 20 AS INTEGER) END AS width, CAST(l_orderkey % 700 + 20 AS INTEGER) AS height, CAST(l_quantity * 40 AS BIGINT) AS file_size,
         'assets/' || (l_partkey % 50) || '.png' AS path, round(l_discount * 10, 4) AS confidence,
         CASE WHEN l_partkey % 11 = 0 THEN 'company logo' WHEN l_partkey % 11 = 1 THEN '第 1 页图片' WHEN l_partkey % 11 = 2 THEN '图示' WHEN l_partkey % 11 < 6 THEN 'figure t' || (l_orderkey % 7) ELSE '' END AS caption,
         CASE WHEN l_suppkey % 6 = 0 THEN 'summary of ' || l_partkey ELSE '' END AS visual_summary, CASE WHEN l_partkey % 5 = 0 THEN repeat('word ', l_linenumber * 3 + 2) ELSE '' END AS ocr_text,
         ['mixed', 'image_only', 'shape_diagram', 'native_text'][l_orderkey % 4 + 1] AS page_modality, l_partkey, l_suppkey, l_linenumber, l_orderkey, number
  FROM numbered_lines)"""
