"""Readers and normalisers of decks: JSON documents, foreign parser output, Markdown, JSONL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_lines, clean_text, preview, shorten, strip
from ..shared import written

DECK = """
  deck_id string, source_path string, source_type string, warnings array<string>,
  pages array<struct<
    slide_id: int, title: string, page_width: double, page_height: double, page_screenshot: string, warnings: array<string>,
    text_blocks: array<struct<id: string, type: string, content: string, bbox: array<double>>>,
    tables: array<struct<id: string, rows: array<array<string>>, bbox: array<double>>>,
    images: array<struct<id: string, path: string, caption: string, bbox: array<double>, width: int, height: int, file_size: bigint, role: string, ignored: boolean>>>>
"""


def read_decks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Deck documents (one JSON object a file) → decks, pages, text_blocks, tables, images; unknown keys are dropped, pos keeps order."""
    return split_decks(spark.read.schema(DECK).option("multiLine", "true").json(path))


def split_decks(decks: DataFrame) -> dict[str, DataFrame]:
    out = {"decks": decks.drop("pages")}
    page = decks.select("deck_id", F.posexplode("pages").alias("page_index", "p"))
    children = ("text_blocks", "tables", "images")
    out["pages"] = page.select("deck_id", "page_index", "p.*").drop(*children)
    for name in children:
        out[name] = page.select("deck_id", F.col("p.slide_id").alias("slide_id"), F.posexplode(f"p.{name}").alias("pos", "c")).select("deck_id", "slide_id", "pos", "c.*")
    return out


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Whole files → path, value (VARIANT; null for a file that is no JSON). A missing folder is an error of the reader."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("value"))


NATIVE = """
  source_path string, source_type string, warnings array<string>,
  pages array<struct<
    slide_id: string, page_id: string, page_number: string, title: string, page_width: double, page_height: double, page_screenshot: string,
    text_blocks: array<struct<id: string, type: string, block_type: string, content: string, text: string, bbox: array<double>>>,
    tables: array<struct<id: string, rows: array<array<string>>, bbox: array<double>, table_summary: string, summary: string, table_conclusion: string, conclusion: string>>,
    images: array<struct<id: string, image_id: string, path: string, image_path: string, uri: string, caption: string, alt_text: string, bbox: array<double>, width: int, height: int, file_size: bigint, role: string, ignored: boolean>>>>
"""


def normalize_native(raw: DataFrame) -> dict[str, DataFrame]:
    """(deck_id, json in the native shape) → decks, pages, text_blocks, tables, images with ids, types and boxes filled in.

    A page's number is the first positive integer of slide_id, page_id, page_number, else its position. Children
    without an id take s{page}_t{n}, _tbl{n}, _img{n}; a box needs four numbers. Broken JSON gives no pages.
    """
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    deck = raw.select("deck_id", F.from_json("json", NATIVE).alias("d"))
    out = {"decks": deck.select("deck_id", "d.source_path", F.coalesce(F.nullif("d.source_type", F.lit("")), F.lit("external")).alias("source_type"), F.coalesce("d.warnings", F.array().cast("array<string>")).alias("warnings"))}
    page = deck.select("deck_id", F.posexplode("d.pages").alias("page_index", "p")).where("p is not null")
    number = some(F.col("p.slide_id"), F.col("p.page_id"), F.col("p.page_number")).try_cast("int")
    page = page.withColumn("slide_id", F.when(number > 0, number).otherwise(F.col("page_index") + 1))
    out["pages"] = page.select("deck_id", "page_index", "slide_id", "p.title", "p.page_width", "p.page_height", "p.page_screenshot")

    def child(name: str) -> DataFrame:
        return page.select("deck_id", "slide_id", F.posexplode(f"p.{name}").alias("pos", "c")).where("c is not null")

    def own(kind: str, *ids: str) -> Column:
        return F.coalesce(some(*[F.col(f"c.{i}") for i in ids]), F.concat(F.lit("s"), F.col("slide_id").cast("string"), F.lit(f"_{kind}"), (F.col("pos") + 1).cast("string"))).alias("element_id")

    box = F.when(F.size("c.bbox") == 4, F.col("c.bbox")).alias("bbox")
    keys = ["deck_id", "slide_id", "pos"]
    out["text_blocks"] = child("text_blocks").select(*keys, own("t", "id"), F.coalesce(some(F.col("c.type"), F.col("c.block_type")), F.lit("paragraph")).alias("type"), strip(F.coalesce(some(F.col("c.content"), F.col("c.text")), F.lit(""))).alias("content"), box)
    out["tables"] = child("tables").select(*keys, own("tbl", "id"), F.coalesce("c.rows", F.array().cast("array<array<string>>")).alias("rows"), box, some(F.col("c.table_summary"), F.col("c.summary")).alias("table_summary"), some(F.col("c.table_conclusion"), F.col("c.conclusion")).alias("table_conclusion"))
    out["images"] = child("images").select(
        *keys, own("img", "id", "image_id"), F.coalesce(some(F.col("c.path"), F.col("c.image_path"), F.col("c.uri")), F.lit("")).alias("path"), some(F.col("c.caption"), F.col("c.alt_text")).alias("caption"), box, "c.width", "c.height", "c.file_size",
        F.coalesce(some(F.col("c.role")), F.lit("content")).alias("role"), F.coalesce("c.ignored", F.lit(False)).alias("ignored"),
    )
    return out


def stage_exports(pages: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """Results per stage: ocr, figures and visuals, one row per page that has any, images as an array.

    pages: ocr_text, visual_summary. images: element_id, path, role, ocr_text, visual_summary, importance, rank.
    """
    key = ["deck_id", "slide_id"]
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""

    def export(keep: Column, fields: list[str], page: Column, texts: list[str]) -> DataFrame:
        per = images.where(keep).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("images"), F.lit(True).alias("_has"))
        held = pages.select(*key, *texts).join(per, key, "left").where(page | F.coalesce("_has", F.lit(False)))
        return held.select(*key, *texts, F.coalesce("images", F.array().cast(per.schema["images"].dataType)).alias("images"))

    figure = F.coalesce(F.col("role").isin("figure_crop", "composite_figure"), F.lit(False))
    visual = export(some("visual_summary") | some("ocr_text"), ["element_id", "path", "ocr_text", "visual_summary", "importance", "rank"], some("visual_summary") | some("ocr_text"), ["ocr_text", "visual_summary"])
    return {"ocr": export(some("ocr_text"), ["element_id", "path", "ocr_text"], some("ocr_text"), ["ocr_text"]), "figures": export(figure, ["element_id", "path", "importance", "rank"], F.lit(False), []), "visuals": visual}


def compact_elements(pages: DataFrame, text_blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """One row per page for review: title, blocks cut to 180 characters, tables with their number of rows, images with role and importance."""
    key = ["deck_id", "slide_id"]

    def per(df: DataFrame, name: str, *fields) -> DataFrame:
        return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    out = pages.select(*key, "title")
    for child in (per(text_blocks, "text_blocks", "pos", "element_id", shorten(F.col("content"), 180).alias("content")), per(tables, "tables", "element_id", F.size("rows").alias("rows")), per(images, "images", "element_id", "path", "role", "ignored", "importance")):
        out = out.join(child, key, "left")
    return out


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold a JSON object, as VARIANT; blank, broken and other lines are skipped."""
    value = F.try_parse_json("value")
    return spark.read.text(path).select(value.alias("value")).where(F.schema_of_variant("value").startswith("OBJECT"))


def markdown_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) → doc_id, slide_id, title, content: cut at form feeds and ``<!-- page: n -->``; empty parts are dropped, the rest numbered."""
    parts = F.filter(F.transform(F.split("text", r"\f|<!--\s*page:\s*\d+\s*-->"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    cut = docs.select("doc_id", F.posexplode(parts).alias("pos", "content"))
    heading = F.nullif(F.regexp_extract("content", r"(?m)^#{1,3}\s+(.+?)\s*$", 1), F.lit(""))
    first = F.get(clean_lines(F.col("content")), F.lit(0))
    return cut.select("doc_id", (F.col("pos") + 1).alias("slide_id"), F.substring(F.coalesce(heading, first), 1, 140).alias("title"), "content")


def classify_block(content: Column, source_type: Column, is_title: Column | None = None) -> Column:
    """heading, bullet, title or paragraph by the rules of each kind of source."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    bullet = F.exists(F.slice(lines, 1, 3), lambda x: F.trim(x).rlike(r"^[•●○▪■◦·\-–*]"))
    short = (F.length(F.trim(content)) <= 120) & (F.size(lines) <= 1)
    pdf = F.when(bullet, "bullet").when(short, "heading").otherwise("paragraph")
    title = F.lit(False) if is_title is None else F.coalesce(is_title, F.lit(False))
    pptx = F.when(title, "title").when(F.size(lines) > 1, "bullet").when(F.length(F.trim(content)) <= 120, "heading").otherwise("paragraph")
    return F.when(source_type == "pptx", pptx).otherwise(pdf)


def page_titles(text_blocks: DataFrame) -> DataFrame:
    """(deck_id, slide_id, pos, type, content) → title: the first heading or title block, else the first block; its first line, 140 characters."""
    order = F.struct((~F.col("type").isin("heading", "title")).alias("other"), "pos")
    best = text_blocks.groupBy("deck_id", "slide_id").agg(F.min_by("content", order).alias("c"))
    return best.select("deck_id", "slide_id", F.substring(F.trim(F.split(F.trim("c"), "\n")[0]), 1, 140).alias("title"))


def slide_ranges(spec: Column) -> Column:
    """``1,3-5`` → [1, 3, 4, 5]; 0 or a range that runs backwards is an error."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")

    def span(x: Column) -> Column:
        lo, hi = F.split(x, "-")[0].cast("int"), F.element_at(F.split(x, "-"), -1).cast("int")
        bad = (lo < 1) | (hi < lo)
        return F.when(bad, F.raise_error(F.concat(F.lit("bad page range: "), x)).cast("array<int>")).otherwise(F.sequence(lo, hi))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def nodes(raw: DataFrame) -> DataFrame:
    """(doc_id, json) → doc_id, ord, depth, text, kind, path, n_rows of each object of a foreign JSON tree, depth first.

    Keys are coalesced: content, text, markdown, html; path, image_path, uri, src; type, kind, category; rows,
    data, cells. The tree is open-ended, so it is walked in Python, by partition; broken JSON gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import json

        import pandas as pd

        def walk(node, depth):
            if isinstance(node, dict):
                yield node, depth
            for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
                yield from walk(child, depth + isinstance(node, dict))

        def first(node, *keys, kind=str):
            return next((node[k] for k in keys if isinstance(node.get(k), kind) and node[k]), None)

        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["json"], strict=True):
                try:
                    tree = json.loads(text) if text else None
                except ValueError:
                    continue
                for i, (n, depth) in enumerate(walk(tree, 0)):
                    rows = first(n, "rows", "data", "cells", kind=list)
                    out.append((doc, i, depth, first(n, "content", "text", "markdown", "html"), first(n, "type", "kind", "category"), first(n, "path", "image_path", "uri", "src"), len(rows) if rows else 0))
            yield pd.DataFrame(out, columns=["doc_id", "ord", "depth", "text", "kind", "path", "n_rows"])

    kind = raw.schema["doc_id"].dataType.simpleString()
    return raw.select("doc_id", "json").mapInPandas(run, f"doc_id {kind}, ord int, depth int, text string, kind string, path string, n_rows int")


def _got(node: str, kind: str, *keys: str) -> Column:
    """The first of a VARIANT object's fields that has a value of the kind; empty strings and arrays have none."""
    found = [F.try_variant_get(node, f"$.{k}", kind) for k in keys]
    if kind == "string":
        return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in found])
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in found]) if kind.startswith("array") else F.coalesce(*found)


def _branch(node: str, *keys: str) -> Column:
    """The first of the fields that is an object or an array with something in it."""
    values = [F.try_variant_get(node, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(F.schema_of_variant(v).rlike(r"^(?:ARRAY<(?!VOID>)|OBJECT<.)"), v) for v in values])


def _children(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows (keep, path, node) → the members of each node, arrays and objects alike, with their places added to the path."""
    inner = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("node").outer())).select(*keep, F.array_append("path", F.col("pos")).alias("path"), F.col("value").alias("node"))
    return inner.where(F.schema_of_variant("node").rlike("^(?:ARRAY|OBJECT)<"))


def _objects(roots: DataFrame, keep: list[str]) -> DataFrame:
    """All objects of trees, at any depth: keep, path, node. A level at a time, each written, until none is left."""
    found, level = None, written(roots.select(*keep, F.array().cast("array<int>").alias("path"), "node"), "json-level")
    while not level.isEmpty():
        own = level.where(F.schema_of_variant("node").startswith("OBJECT"))
        found = own if found is None else found.unionByName(own)
        level = written(_children(level, keep), "json-level")
    return level.select(*keep, "path", "node") if found is None else found


def foreign_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """(deck_id, json of another parser) → pages, text_blocks, tables, images, with ids, kinds and boxes filled in.

    Pages are the members of a list, or of the first of pages, slides, children, also within document. A page's
    blocks, tables and images are looked for at any depth below it, in the order of their places; fields of one
    object have no order of their own and come by name. Children without an id take s{page}_t{n}, _tbl{n}, _img{n}.
    A block with rows, or called a table, is a table; one with a path, or called an image or picture, an image. A
    page without blocks has its own text as one. A block called a title or heading, or of up to 120 characters, is a
    heading; a page's title is its first heading, else its first block, else its own. Broken JSON, or JSON without pages, gives no rows.
    """
    whole = raw.select("deck_id", F.try_parse_json("json").alias("node"))
    listed = F.when(F.schema_of_variant("node").startswith("ARRAY<OBJECT"), F.col("node"))
    top = whole.select("deck_id", F.coalesce(listed, _branch("node", "pages", "slides", "children", "document.pages", "document.slides", "document.children")).alias("node")).where("node is not null")
    page = _children(top.withColumn("path", F.array().cast("array<int>")), ["deck_id"]).where(F.schema_of_variant("node").startswith("OBJECT"))
    number = F.coalesce(*[F.nullif(F.try_variant_get("node", f"$.{k}", "int"), F.lit(0)) for k in ("slide_id", "page_id", "page", "page_number")])
    page = written(page.select("deck_id", F.col("path")[0].alias("page_index"), "node").withColumn("slide_id", F.coalesce(number, F.col("page_index") + 1)), "foreign-pages")
    key = ["deck_id", "slide_id", "page_index"]
    roots = {"text": ("text_blocks", "blocks", "children"), "table": ("tables", "blocks", "children"), "image": ("images", "pictures", "blocks", "children")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), _branch("node", *names).alias("node")) for k, names in roots.items()]))
    nodes_ = written(_objects(page.select(*key, each.alias("r")).select(*key, "r.of", "r.node").where("node is not null"), [*key, "of"]), "foreign-nodes")
    text = clean_text(F.coalesce(_got("node", "string", "content", "text", "markdown", "html"), F.lit("")))
    rows = F.transform(_got("node", "array<array<string>>", "rows", "data", "cells"), lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    box = F.try_variant_get("node", "$.bbox", "array<double>")
    seen = nodes_.withColumns({
        "kind": F.lower(F.coalesce(_got("node", "string", "type", "label", "block_type"), F.lit(""))), "content": text, "rows": rows, "bbox": F.when(F.size(box) == 4, box),
        "file": _got("node", "string", "path", "image_path", "uri", "src"), "own": _got("node", "string", "id"),
    })
    table = F.col("kind").contains("table") | F.col("rows").isNotNull()

    def numbered(of: str, keep: Column, mark: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*key).orderBy("path"))
        some = seen.where((F.col("of") == of) & keep).withColumn("n", n)
        return some.withColumn("element_id", F.coalesce("own", F.concat(F.lit("s"), F.col("slide_id").cast("string"), F.lit(f"_{mark}"), F.col("n").cast("string")))).withColumn("pos", F.col("n") - 1)

    blocks = numbered("text", (F.col("content") != "") & ~table, "t").withColumn("type", F.when(F.col("kind").contains("title") | F.col("kind").contains("heading") | (F.length("content") <= 120), "heading").otherwise("paragraph"))
    alone = page.join(blocks.select(*key).distinct(), key, "left_anti").withColumn("content", text).where("content <> ''")
    blocks = blocks.select(*key, "pos", "element_id", "type", "content", "bbox").unionByName(alone.select(*key, F.lit(0).alias("pos"), F.concat(F.lit("s"), F.col("slide_id").cast("string"), F.lit("_t1")).alias("element_id"), F.lit("paragraph").alias("type"), "content", F.lit(None).cast("array<double>").alias("bbox")))
    blocks = written(blocks, "foreign-blocks")
    head = F.coalesce(F.min_by("content", F.when(F.col("type") == "heading", F.col("pos"))), F.min_by("content", "pos"))
    titled = page.join(blocks.groupBy(*key).agg(head.alias("_title")), key, "left")
    image = F.col("file").isNotNull() | F.col("kind").contains("image") | F.col("kind").contains("picture")
    size = lambda *names: F.coalesce(*[F.try_variant_get("node", f"$.{n}", "double") for n in names])
    return {
        "pages": titled.select(*key, F.coalesce(preview(F.col("_title"), 140), _got("node", "string", "title")).alias("title"), size("width", "page_width").alias("page_width"), size("height", "page_height").alias("page_height"), _got("node", "string", "page_screenshot", "screenshot").alias("page_screenshot")),
        "text_blocks": blocks,
        "tables": numbered("table", table, "tbl").select(*key, "pos", "element_id", F.coalesce("rows", F.array(F.array("content"))).alias("rows"), "bbox"),
        "images": numbered("image", image, "img").select(*key, "pos", F.coalesce("own", _got("node", "string", "image_id"), "element_id").alias("element_id"), F.coalesce("file", F.lit("")).alias("path"), _got("node", "string", "caption", "alt_text", "text").alias("caption"), "bbox", F.coalesce(_got("node", "string", "role"), F.lit("content")).alias("role"), F.coalesce(F.try_variant_get("node", "$.ignored", "boolean"), F.lit(False)).alias("ignored")),
    }


def generic_text(raw: DataFrame) -> DataFrame:
    """All texts of a foreign tree, each once, in order, joined by a blank line."""
    texts = nodes(raw).where("text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return texts.select("doc_id", F.array_join(F.array_distinct(F.col("t.text")), "\n\n").alias("text"))
