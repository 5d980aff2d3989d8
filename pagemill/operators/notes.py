"""Notes as ordered rows: rule-based notes, clean-up, composition, numbering, figures, links, contents, reports.

Notes stay rows of (deck_id, place, text) until ``join_rows`` makes one text of each deck. Rules on one text are
column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COVER_MARKERS, clean_markdown, collapse, ensure_sentence, escape_md, heading_text, is_outline, quote_lines, slugify, source_slides, source_tokens, strip, styled_text, text_lines, title_key, zh_ordinal
from .lineage import MARK
from .tables import key_row_text

_PAGE = ["deck_id", "slide_id"]
HEADING = r"(?U)^(#{1,6})\s+(.*)$"
IMAGE = r"!\[([^\]]*)]\(([^)]+)\)"
#: Headings that say nothing, of generated information and of front matter, and words of it.
GENERIC = ["", "课程笔记", "笔记", "讲义", "生成信息", "解析提醒", "目录", "contents", "overview"]
GENERATED = ["生成信息", "generationinfo", "generationmetadata"]
FRONT_TITLES, FRONT_PAGES = ["目录", "contents", "课程概览", "overview"], ["目录", "contents", "outline", "agenda"]
FRONT_WORDS = ["目录", "课程目录", "本章目录", "主标题", "副标题", "讲师", "教授", "联系邮箱", "主页", "contents", "overview"]
#: What a model says about its task, and how it begins to speak of slides instead of their content.
META = [
    "好的，这是", "好的，我将", "以下是根据", "下面是依据", "根据您提供的 JSON", "根据你提供的 JSON", "课程材料 JSON", "笔记已严格遵循", "严格遵循全部硬性要求", "覆盖了所有文本块", "覆盖每一个文本块", "每段均标注", "每一段都标注",
    "未提供图片像素", "未提供图像像素", "未提供图片的 OCR", "未提供该截图的 OCR", "未进行视觉解析", "无法进行具体描述", "无法进一步说明", "无法对截图内容", "建议在原始幻灯片", "若需了解图片具体内容", "图片留作原始证据", "仅作为证据保留",
]
META_STARTS = ["幻灯片首先提出", "这一页在上一页的基础上", "上一页介绍了", "下一页将", "本页主要讲解", "本页介绍了", "这页展示", "此页内容", "此幻灯片", "这张幻灯片", "这组幻灯片", "该幻灯片", "当前幻灯片"]


def _any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def _text(n: Column) -> Column:
    return n.cast("string")


def source_marker(slide_id: Column, ids: Column, mode: str = "hidden", mark: str = MARK) -> Column:
    """The mark of a block's sources: a comment (hidden), one after a page (footnote) or after page and ids (inline); without ids no comment."""
    known = F.filter(F.array_compact(ids), lambda x: x != "")
    comment = F.when(F.size(known) > 0, F.concat(F.lit(f"<!-- {mark} p"), _text(slide_id), F.lit(":"), F.array_join(known, ","), F.lit(" -->"))).otherwise("")
    if mode == "hidden":
        return comment
    if mode == "footnote":
        return F.rtrim(F.concat(F.lit("（PPT 第 "), _text(slide_id), F.lit(" 页） "), comment))
    return F.rtrim(F.concat(F.lit("【对应 PPT：第 "), _text(slide_id), F.lit(" 页，元素 "), F.array_join(known, "、"), F.lit("】 "), comment))


def join_rows(rows: DataFrame) -> DataFrame:
    """(deck_id, place, text) → deck_id, markdown: the rows of each deck in order, one newline at the end."""
    per = rows.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("r"))
    return per.select("deck_id", F.concat(F.regexp_replace(F.array_join(F.col("r.text"), "\n"), r"(?U)\s+\z", ""), F.lit("\n")).alias("markdown"))


def image_block(mode: str = "hidden") -> Column:
    """Lines of an image: caption, mark, what it shows, its OCR text if nothing else is said, and the link.

    Columns: slide_id, element_id, source_ids, path, caption, figure_explanation, visual_summary, ocr_text, explanation_status.
    """
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    caption = F.coalesce(some("caption"), F.concat(F.lit("第 "), _text(F.col("slide_id")), F.lit(" 页图片")))
    ids = F.array_distinct(F.concat(F.array("element_id"), F.coalesce("source_ids", F.array().cast("array<string>"))))
    said = F.coalesce(some("figure_explanation"), some("visual_summary"))
    label = F.when(some("figure_explanation").isNotNull(), "图示说明").otherwise("图片视觉解析")
    ocr = some("ocr_text").isNotNull() & said.isNull() & (F.coalesce("explanation_status", F.lit("")) != "ocr_text")
    lines = [
        F.concat(caption, F.lit("。")), source_marker(F.col("slide_id"), ids, mode), F.lit(""), F.when(said.isNotNull(), F.concat(label, F.lit("："), ensure_sentence(said))), F.when(ocr, F.concat(F.lit("图片 OCR 文字：\n"), quote_lines(F.col("ocr_text")))),
        F.when(said.isNotNull() | ocr, F.lit("")), F.concat(F.lit("!["), caption, F.lit("]("), "path", F.lit(")")),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _plain(content: Column, kind: Column) -> Column:
    lines = F.transform(text_lines(content), lambda x: F.btrim(x, F.lit(" \t-•*·")))
    text = F.when((kind == "bullet") & (F.size(lines) > 1), F.array_join(lines, "；")).otherwise(F.trim(F.array_join(lines, " ")))
    return F.when((text == "") | text.rlike(r"[。.!！？?：:]$"), text).otherwise(F.concat(text, F.lit("。")))


def local_notes(decks: DataFrame, pages: DataFrame, text_blocks: DataFrame, tables: DataFrame, images: DataFrame, contexts: DataFrame, mode: str = "hidden") -> DataFrame:
    """Notes by rule as rows (deck_id, place, text): title, context headings, and of each page heading, texts, tables and images.

    decks: title, warnings. pages: title, ocr_text, visual_summary. text_blocks: pos, element_id, type, content
    (style_runs). tables: analysed ones with element_id. images: candidates for notes with anchor_id and the
    columns of ``image_block``. contexts: note_contexts with pos. Images follow the block or table they are
    anchored to, images without an anchor end the page. place: context, page, part, number, image.
    """
    def place(context: Column, slide, part: int, n, sub) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(context.cast("int").alias("c"), lit(slide).cast("int").alias("s"), F.lit(part).alias("p"), lit(n).cast("int").alias("n"), lit(sub).cast("int").alias("i")).alias("place")

    zero = F.lit(0)
    named = contexts.withColumn("_front", title_key(F.col("title")).isin(FRONT_TITLES))
    order = Window.partitionBy("deck_id").orderBy("pos")
    shown = named.withColumn("_no", F.sum((~F.col("_front")).cast("int")).over(order)).withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("deck_id")))
    headed = (F.col("_many") > 1) | (F.col("kind") == "section")
    title = F.coalesce(F.nullif(heading_text(F.col("title")), F.lit("")), F.lit("本节内容"))
    head = F.when(F.col("kind") == "page", F.concat(F.lit("## 第 "), _text(F.col("slide_ids")[0]), F.lit(" 页："), title)).otherwise(F.concat(F.lit("## "), zh_ordinal(F.col("_no")), F.lit("、"), title))
    rows = [decks.select("deck_id", place(F.lit(-1), 0, 0, 0, 0), F.concat(F.lit("# "), "title", F.lit("\n")).alias("text"))]
    rows.append(shown.where(headed & ~F.col("_front")).select("deck_id", place(F.col("pos"), -1, 0, 0, 0), F.concat(head, F.lit("\n")).alias("text")))
    at = shown.select("deck_id", F.col("pos").alias("_c"), headed.alias("_h"), F.explode("slide_ids").alias("slide_id"))
    ids = text_blocks.select(*_PAGE, F.lit(0).alias("k"), "pos", "element_id").unionByName(tables.select(*_PAGE, F.lit(1).alias("k"), F.lit(0).alias("pos"), "element_id"))
    own = ids.groupBy(*_PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pos", "element_id"))), lambda x: x["element_id"]).alias("_ids"))
    p = pages.join(at, _PAGE).join(own, _PAGE, "left")
    level = F.when(F.col("_h"), "###").otherwise("##")
    slide = _text(F.col("slide_id"))
    page_title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("第 "), slide, F.lit(" 页")))
    rows.append(p.select("deck_id", place(F.col("_c"), F.col("slide_id"), 0, 0, 0), F.concat(level, F.lit(" 第 "), slide, F.lit(" 页："), page_title, F.lit("\n"), source_marker(F.col("slide_id"), F.coalesce("_ids", F.array().cast("array<string>")), mode), F.lit("\n")).alias("text")))
    look = F.when(F.coalesce("visual_summary", F.lit("")) != "", F.concat(F.lit("页截图视觉解析："), ensure_sentence(F.col("visual_summary")), F.lit("\n"), source_marker(F.col("slide_id"), F.array(F.concat(F.lit("p"), slide, F.lit("_screenshot"))), mode)))
    read = F.when(F.coalesce("ocr_text", F.lit("")) != "", F.concat(F.lit("页截图 OCR 文字：\n"), quote_lines(F.col("ocr_text")), F.lit("\n"), source_marker(F.col("slide_id"), F.array(F.concat(F.lit("p"), slide, F.lit("_ocr"))), mode)))
    seen = F.array_join(F.array_compact(F.array(look, read)), "\n\n")
    rows.append(p.where(seen != "").select("deck_id", place(F.col("_c"), F.col("slide_id"), 2, 0, 0), F.concat(seen, F.lit("\n")).alias("text")))
    t = text_blocks.join(at, _PAGE)
    said = _plain(F.col("content"), F.col("type"))
    if "style_runs" in text_blocks.columns:
        said = F.coalesce(styled_text(F.col("style_runs")), said)
    content = F.when(F.col("type") == "title", F.concat(F.lit("本页主题是“"), F.trim(F.array_join(text_lines(F.col("content")), " ")), F.lit("”。"))).otherwise(said)
    rows.append(t.select("deck_id", place(F.col("_c"), F.col("slide_id"), 3, F.col("pos"), 0), F.concat(content, F.lit("\n"), source_marker(F.col("slide_id"), F.array("element_id"), mode), F.lit("\n")).alias("text")))
    lead = F.coalesce("table_conclusion", "table_summary", F.concat(F.lit("下表整理了第 "), slide, F.lit(" 页中的表格内容。")))
    keys = F.array_join(F.transform(F.slice("key_rows", 1, 3), lambda r: F.concat(F.lit("- "), key_row_text(r, "：", "", "；"))), "\n")
    wide = F.aggregate("rows", F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    cells = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.coalesce(F.nullif(escape_md(F.coalesce(F.get(r, i), F.lit(""))), F.lit("")), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    grid = F.when(wide > 0, F.array_join(F.concat(F.array(cells(F.get("rows", zero)), rule), F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, zero)), cells)), "\n"))
    body = F.array_join(F.array_compact(F.array(F.when(keys != "", F.concat(F.lit("关键行：\n"), keys, F.lit("\n"))), grid)), "\n")
    numbered = tables.withColumn("_n", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("element_id")))
    prefix = F.when(F.col("table_conclusion").isNotNull(), "表格结论").otherwise("表格说明")
    rows.append(numbered.join(at, _PAGE).select("deck_id", place(F.col("_c"), F.col("slide_id"), 4, F.col("_n"), 0), F.concat(prefix, F.lit("："), ensure_sentence(lead), F.lit("\n"), source_marker(F.col("slide_id"), F.array("element_id"), mode), F.lit("\n\n"), body, F.lit("\n")).alias("text")))
    anchors = text_blocks.select(*_PAGE, F.col("element_id").alias("anchor_id"), F.lit(3).alias("_p"), F.col("pos").alias("_a")).unionByName(numbered.select(*_PAGE, F.col("element_id").alias("anchor_id"), F.lit(4).alias("_p"), F.col("_n").alias("_a")))
    rank = F.row_number().over(Window.partitionBy(*_PAGE).orderBy(F.coalesce("rank", F.lit(9999)), "element_id"))
    i = images.withColumn("_r", rank).join(anchors, [*_PAGE, "anchor_id"], "left").where(F.col("_p").isNotNull() | F.col("anchor_id").isNull()).join(at, _PAGE)
    spot = F.struct(F.col("_c").cast("int").alias("c"), F.col("slide_id").cast("int").alias("s"), F.coalesce("_p", F.lit(5)).alias("p"), F.coalesce("_a", zero).cast("int").alias("n"), F.col("_r").cast("int").alias("i")).alias("place")
    rows.append(i.select("deck_id", spot, F.concat(image_block(mode), F.lit("\n")).alias("text")))
    some = text_blocks.select(*_PAGE).union(tables.select(*_PAGE)).union(images.select(*_PAGE)).distinct()
    empty = p.where(seen == "").join(some, _PAGE, "left_anti")
    rows.append(empty.select("deck_id", place(F.col("_c"), F.col("slide_id"), 6, 0, 0), F.concat(F.lit("PPT 第 "), slide, F.lit(" 页没有解析到可写入的文本、表格或嵌入图片。\n")).alias("text")))
    warned = decks.where(F.size("warnings") > 0)
    rows.append(warned.select("deck_id", place(F.lit(1 << 30), 0, 0, 0, 0), F.concat(F.lit("## 解析提醒\n\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "\n"), F.lit("\n")).alias("text")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _once(c: Column, new) -> Column:
    """``new`` of c, which is computed once, however often new names it: what stands below a lambda is computed as often as it is named."""
    return F.get(F.transform(F.array(c), new), F.lit(0))


def _spliced(c: Column, pattern: str, new) -> Column:
    """c with each match replaced by ``new`` of it."""
    return _once(c, lambda t: _parts_spliced(t, pattern, new))


def _parts_spliced(c: Column, pattern: str, new) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(F.split(c, pattern), found, lambda part, m: F.concat(part, F.coalesce(new(m), F.lit("")))), "")


def _headings(c: Column, new) -> Column:
    """Lines with headings (level, text) replaced; a null drops the line."""
    level = lambda x: F.length(F.regexp_extract(x, HEADING, 1))
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(HEADING), new(level(x), F.regexp_extract(x, HEADING, 2))).otherwise(x))
    return F.array_join(F.array_compact(lines), "\n")


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df + columns that later expressions, lambdas too, take as they are: an array of one is exploded, which isn't inlined."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", row.alias("_row")).select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in columns])


def _hashes(n: Column) -> Column:
    return F.repeat(F.lit("#"), n)


CITATION = r"【[^】]*?PPT[^】]*?】"


def convert_citations(c: Column, mode: str = "hidden", mark: str = MARK) -> Column:
    """Visible citations as marks; inline keeps them and adds the comment that they lack."""
    def new(m: Column) -> Column:
        page = F.nullif(F.regexp_extract(m, r"第\s*(\d+)\s*页", 1), F.lit(""))
        ids = source_tokens(m)
        if mode == "inline":
            return F.when(m.contains(mark) | page.isNull() | (F.size(ids) == 0), m).otherwise(F.concat(m, F.lit(" "), source_marker(page, ids, "hidden", mark)))
        return F.when(page.isNotNull(), source_marker(page, ids, mode, mark)).otherwise("")

    return _spliced(c, CITATION, new)


def postprocess(c: Column, mode: str = "hidden", mark: str = MARK) -> Column:
    """A generated text made fit for notes: images out of code, alternative texts, no talk about the task, headings from level 2, citations as marks."""
    text = F.regexp_replace(F.regexp_replace(c, r"`(!\[[^\]]*]\([^)]+\))`", "$1"), r"!\[\s*]\(", "![图示](")
    flat = lambda p: F.array_join(text_lines(p), " ")

    def meta(f: Column) -> Column:
        starts = F.lit(False)
        for s in META_STARTS:
            starts = starts | f.startswith(s)
        return _any(f, META) | (~f.contains(mark) & (F.length(f) <= 80) & starts)

    # in turn, so that a paragraph is flattened once, and a title is made once
    parts = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: p != "")
    kept = F.filter(F.transform(parts, lambda p: F.struct(p.alias("p"), flat(p).alias("f"))), lambda x: ~meta(x["f"]))
    title = lambda t: F.regexp_replace(strip(t), r"(?U)^课程笔记[：:\s-]*", "")
    text = _headings(F.array_join(F.transform(kept, lambda x: x["p"]), "\n\n"), lambda n, t: _once(title(t), lambda h: F.when(h != "", F.concat(_hashes(F.greatest(n, F.lit(2))), F.lit(" "), h))))
    return strip(convert_citations(text, mode, mark))


def without_generated(c: Column) -> Column:
    """Lines outside sections on how the text was made; such a section ends at the next heading of its level or above."""
    state = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        level = F.length(F.regexp_extract(x, HEADING, 1))
        info = (level > 0) & title_key(F.regexp_extract(x, HEADING, 2)).isin(GENERATED)
        skip = F.when(info, level).when((level > 0) & (level <= s["skip"]), 0).otherwise(s["skip"])
        return F.struct(skip.alias("skip"), F.when(skip == 0, F.array_append(s["out"], x)).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(F.split(c, "\n"), state, step)["out"], "\n")


def prepare_chunk(c: Column, title: Column, outer: bool = True) -> Column:
    """A context's text, ``without_generated`` parts, under its heading: leading headings that repeat it go, others sink to level 3 (2 without a heading), blank lines collapse."""
    text = c
    if outer:
        lines = F.split(text, "\n")

        def redundant(x: Column) -> Column:
            a, b = title_key(F.regexp_extract(x, HEADING, 2)), title_key(title)
            return x.rlike(HEADING) & (a.isin(GENERIC) | ((b != "") & (F.contains(a, b) | F.contains(b, a))))

        first = F.array_position(F.transform(lines, lambda x: ~((strip(x) == "") | redundant(strip(x)))), True)
        text = F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise("")
    low = 3 if outer else 2
    text = _headings(text, lambda n, t: F.when(~title_key(t).isin(GENERIC), F.concat(_hashes(F.least(F.lit(6), F.greatest(n, F.lit(low)))), F.lit(" "), heading_text(t))))
    return strip(F.regexp_replace(text, r"(?U)\n(?:[^\S\n]*\n)+", "\n\n"))


def strip_frontmatter(c: Column, front: Column, marks: Column) -> Column:
    """c without the blocks of front matter at its start, their marks in front; front: slide ids of the context that are front matter."""
    blocks = F.filter(F.transform(F.split(strip(c), r"(?U)\n\s*\n"), strip), lambda x: x != "")

    def droppable(x: Column) -> Column:
        head = F.regexp_extract(x, HEADING, 2)
        of_front = (F.size(source_slides(x)) > 0) & (F.size(F.array_except(source_slides(x), front)) == 0)
        return x.rlike(r"^[-*_]{3,}$") | F.when(x.rlike(HEADING), title_key(head).isin(GENERIC) | _any(title_key(head), FRONT_WORDS)).otherwise(of_front | _any(title_key(x), FRONT_WORDS))

    first = F.array_position(F.transform(blocks, lambda x: ~droppable(x)), True)
    body = F.when(first > 0, F.array_join(F.slice(blocks, first.cast("int"), F.size(blocks)), "\n\n")).otherwise("")
    return F.when(F.size(front) == 0, c).otherwise(strip(F.concat_ws("\n\n", F.nullif(marks, F.lit("")), F.nullif(body, F.lit("")))))


def number_headings(c: Column) -> Column:
    """Headings from level 3 on numbered 1, 1.1 …, relative to the highest level since the last heading above level 3. A fold over the lines."""
    empty = F.array().cast("array<int>")
    state = F.struct(F.lit(0).alias("base"), empty.alias("count"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        n = F.length(F.regexp_extract(x, HEADING, 1))
        restart = (s["base"] == 0) | (n < s["base"])
        base = F.when(restart, n).otherwise(s["base"])
        depth = n - base + 1
        had = F.when(restart, empty).otherwise(F.slice(s["count"], 1, F.greatest(depth, F.lit(0))))
        full = F.concat(had, F.array_repeat(F.lit(0), F.greatest(depth - F.size(had), F.lit(0))))
        count = F.transform(full, lambda v, j: F.when(j == depth - 1, v + 1).otherwise(v))
        bare = strip(F.regexp_replace(strip(F.regexp_extract(x, HEADING, 2)), r"(?U)^\s*(?:\d+(?:\.\d+)*\.?|[一二三四五六七八九十]+[、.])\s*", ""))
        line = F.concat(_hashes(n), F.lit(" "), F.array_join(F.transform(count, lambda v: v.cast("string")), "."), F.when(depth == 1, ". ").otherwise(" "), bare)
        reset = F.struct(F.lit(0).alias("base"), empty.alias("count"), F.array_append(s["out"], x).alias("out"))
        same = F.struct(s["base"].alias("base"), s["count"].alias("count"), F.array_append(s["out"], x).alias("out"))
        numbered = F.struct(base.alias("base"), count.alias("count"), F.array_append(s["out"], line).alias("out"))
        return F.when(n == 0, same).when(n < 3, reset).otherwise(numbered)

    return F.array_join(F.aggregate(F.split(c, "\n"), state, step)["out"], "\n")


def is_frontmatter(title: Column, text: Column, index: Column) -> Column:
    """A page of contents; a first page with a cover's words; an outline among the first four. text: title and blocks."""
    cover = (index == 0) & _any(title_key(text), COVER_MARKERS)
    return title_key(F.coalesce(title, F.lit(""))).isin(FRONT_PAGES) | text.contains("目录") | text.contains("Contents") | cover | ((index <= 3) & is_outline(text))


def compose_notes(decks: DataFrame, contexts: DataFrame, chunks: DataFrame, front: DataFrame, marks: DataFrame) -> DataFrame:
    """(deck_id, markdown): the title, then each context's text under its numbered heading.

    decks: title. contexts: note_contexts with pos. chunks: deck_id, context, markdown. front: (deck_id, slide_id) of
    leading front matter. marks: (deck_id, slide_id, mark) of pages. A context that is front matter only leaves
    the marks of its pages, and contexts without a text are left out.
    """
    each = contexts.select("deck_id", "context", F.posexplode("slide_ids").alias("n", "slide_id")).join(marks, _PAGE, "left").join(front.select(*_PAGE).withColumn("_f", F.lit(True)), _PAGE, "left")
    joined = lambda cond: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", "mark")))), lambda x: x["mark"]), lambda m: F.coalesce(m, F.lit("")) != ""), "\n")
    per = each.groupBy("deck_id", "context").agg(joined(F.lit(True)).alias("_all"), joined(F.col("_f")).alias("_front"), F.collect_set(F.when(F.col("_f"), F.col("slide_id"))).alias("_ids"))
    rows = contexts.join(chunks, ["deck_id", "context"]).join(per, ["deck_id", "context"], "left").withColumn("_md", strip(F.coalesce("markdown", F.lit("")))).where("_md <> ''")
    many = contexts.groupBy("deck_id").agg(F.count(F.lit(1)).alias("_many"))
    title = F.coalesce(F.nullif(heading_text(F.col("title")), F.lit("")), F.lit("本节内容"))
    rows = rows.join(many, "deck_id").withColumn("_t", title).withColumn("_headed", (F.col("_many") > 1) | (F.col("kind") == "section"))
    rows = rows.withColumn("_skip", F.col("_headed") & title_key(F.col("_t")).isin(FRONT_TITLES) & (F.col("_many") > 1))
    number = F.sum((F.col("_headed") & ~F.col("_skip")).cast("int")).over(Window.partitionBy("deck_id").orderBy("pos"))
    head = F.when(F.col("kind") == "page", F.concat(F.lit("## 第 "), _text(F.col("slide_ids")[0]), F.lit(" 页："), "_t")).otherwise(F.concat(F.lit("## "), zh_ordinal(F.col("_no")), F.lit("、"), "_t"))
    rows = _held(rows.withColumn("_no", number), _clean=without_generated(F.col("_md")))
    rows = _held(rows, _prepared=F.when(F.col("_headed"), prepare_chunk(F.col("_clean"), F.col("_t"))).otherwise(prepare_chunk(F.col("_clean"), F.col("_t"), False)))
    rows = _held(rows, _inner=strip_frontmatter(F.col("_prepared"), F.col("_ids"), F.col("_front")))
    text = F.when(F.col("_skip"), F.col("_all")).when(F.col("_headed"), F.concat(head, F.lit("\n\n"), number_headings(F.col("_inner")))).otherwise(F.col("_prepared"))
    body = rows.select("deck_id", F.col("pos").cast("int").alias("place"), F.concat(text, F.lit("\n")).alias("text")).where("text <> '\n'")
    return join_rows(decks.select("deck_id", F.lit(-1).alias("place"), F.concat(F.lit("# "), "title", F.lit("\n")).alias("text")).unionByName(body))


def _prefixes(token: Column) -> Column:
    """Ids of which a text that holds the token holds the letters too: s1_t1 for s1_t12."""
    head, number = F.regexp_extract(token, r"^(.*?)\d+$", 1), F.regexp_extract(token, r"(\d+)$", 1)
    return F.transform(F.sequence(F.lit(1), F.length(number)), lambda n: F.concat(head, F.substr(number, F.lit(1), n)))


def place_figures(notes: DataFrame, figures: DataFrame, mark: str = MARK) -> DataFrame:
    """(deck_id, markdown) with each figure (deck_id, slide_id, element_id, pos, path, caption, anchor_id, block) at its place.

    A figure's old block goes: its link, a mark of its own beside it, its caption before that. The new one follows
    the paragraph of the first mark that holds its anchor, else that of the last mark of its page, else a heading at
    the end. A mark holds s1_t1 also where it names s1_t12. Figures of one anchor come last first, those of one page
    in order. Blank lines are collapsed. All positions are those of the old text: lines and figures are joined on
    deck and id, no text is rewritten figure by figure.
    """
    lines = notes.select("deck_id", F.posexplode(F.split(F.regexp_replace("markdown", r"(?U)\s+\z", ""), "\n")).alias("pos", "line")).withColumn("_blank", strip(F.col("line")) == "")
    full = Window.partitionBy("deck_id").orderBy("pos")
    solid = lines.where("not _blank").select("deck_id", "pos", "line", *[F.lag(F.struct("pos", "line"), k).over(full).alias(f"b{k}") for k in (1, 2)], F.lead(F.struct("pos", "line")).over(full).alias("a1"))
    target = F.replace(F.btrim(F.trim(F.regexp_extract("line", IMAGE, 2)), F.lit("<>")), F.lit("\\"), F.lit("/"))
    hits = solid.where(F.col("line").rlike(IMAGE)).withColumn("path", target).join(figures.select("deck_id", "path", "element_id", "caption"), ["deck_id", "path"])
    only = lambda c: F.coalesce(strip(c["line"]).rlike(r"^<!--.*?-->$") & c["line"].contains(mark) & F.array_contains(source_tokens(c["line"]), F.col("element_id")), F.lit(False))
    b1, b2, a1 = F.col("b1"), F.col("b2"), F.col("a1")
    said = F.coalesce((strip(b2["line"]) == F.col("caption")) | (strip(b2["line"]) == F.concat("caption", F.lit("。"))) | strip(b2["line"]).rlike(r"^第\s*\d+\s*页(?:图片|图示|截图).*[。.]?$"), F.lit(False))
    gone = hits.select("deck_id", F.explode(F.array_compact(F.array(F.col("pos"), F.when(only(b1), b1["pos"]), F.when(only(b1) & said, b2["pos"]), F.when(only(a1), a1["pos"])))).alias("pos")).distinct()
    kept = lines.join(gone, ["deck_id", "pos"], "left_anti")
    rest = Window.partitionBy("deck_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    next_ = kept.withColumn("_nn", F.min(F.when(~F.col("_blank"), F.col("pos"))).over(rest))
    ends = next_.withColumn("_end", F.min(F.when(F.col("_blank"), F.struct("pos", F.coalesce("_nn", F.lit(1 << 30)).alias("nn")))).over(rest)["nn"]).withColumn("_end", F.coalesce("_end", F.lit(1 << 30)))
    marked = ends.where(F.col("line").contains(mark))
    by_id = marked.select("deck_id", "pos", "_end", F.explode(F.array_distinct(F.flatten(F.transform(source_tokens(F.col("line")), _prefixes)))).alias("anchor_id")).groupBy("deck_id", "anchor_id").agg(F.min_by("_end", "pos").alias("_at"))
    by_page = marked.select("deck_id", "pos", "_end", F.explode(source_slides(F.col("line"))).alias("slide_id")).groupBy("deck_id", "slide_id").agg(F.max_by("_end", "pos").alias("_page_at"))
    spot = figures.join(by_id, ["deck_id", "anchor_id"], "left").join(by_page, ["deck_id", "slide_id"], "left")
    anchored = F.col("_at").isNotNull()
    heading = F.when(~anchored & F.col("_page_at").isNull(), F.concat(F.lit("### 第 "), _text(F.col("slide_id")), F.lit(" 页图示\n\n"))).otherwise("")
    order = F.when(anchored, -F.col("pos")).otherwise(F.col("pos"))
    new = spot.select("deck_id", F.struct(F.coalesce("_at", "_page_at", F.lit(1 << 30)).cast("int").alias("at"), (~anchored).cast("int").alias("k"), order.cast("int").alias("n")).alias("place"), F.concat(F.lit("\n"), heading, "block", F.lit("\n")).alias("text"))
    old = kept.select("deck_id", F.struct(F.col("pos").cast("int").alias("at"), F.lit(2).alias("k"), F.lit(0).alias("n")).alias("place"), F.col("line").alias("text"))
    return join_rows(old.unionByName(new)).withColumn("markdown", F.regexp_replace("markdown", r"(?U)\n(?:[^\S\n]*\n)+", "\n\n"))


def _clean_target(c: Column) -> Column:
    return F.replace(F.btrim(F.trim(c), F.lit("<>")), F.lit("\\"), F.lit("/"))


def repair_links(notes: DataFrame, assets: DataFrame) -> DataFrame:
    """notes (deck_id, markdown) with image links to raw paths rewritten: by path, else by file name where one asset has it.

    assets: deck_id, raw_path, display_path; a deck's assets meet its text as two maps. Web and data links stay.
    """
    a = assets.select("deck_id", _clean_target(F.col("raw_path")).alias("raw"), _clean_target(F.col("display_path")).alias("display")).where("display <> ''")
    keys = a.select("deck_id", "display", F.explode(F.array_distinct(F.array("raw", "display", F.ltrim("raw", F.lit("./")), F.ltrim("display", F.lit("./"))))).alias("k")).where("k <> ''")
    exact = keys.groupBy("deck_id", "k").agg(F.max("display").alias("d")).groupBy("deck_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "d"))).alias("_exact"))
    name = lambda c: F.regexp_extract(c, r"([^/]+)/*$", 1)
    names = a.select("deck_id", "display", F.explode(F.array_distinct(F.array(name(F.col("raw")), name(F.col("display"))))).alias("k")).where("k <> ''").groupBy("deck_id", "k").agg(F.min("display").alias("d"), F.max("display").alias("e")).where("d = e")
    by_name = names.groupBy("deck_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "d"))).alias("_name"))
    joined = notes.join(exact, "deck_id", "left").join(by_name, "deck_id", "left")

    def new(m: Column) -> Column:
        t = _clean_target(F.regexp_extract(m, IMAGE, 2))
        to = F.coalesce(F.try_element_at("_exact", t), F.try_element_at("_exact", F.ltrim(t, F.lit("./"))), F.try_element_at("_name", name(t)))
        return F.when((t == "") | t.rlike(r"^(?:data:|https?://)") | to.isNull() | (to == t), m).otherwise(F.concat(F.lit("!["), F.regexp_extract(m, IMAGE, 1), F.lit("]("), to, F.lit(")")))

    return joined.withColumn("markdown", _spliced(F.col("markdown"), IMAGE, new)).drop("_exact", "_name")


def missing_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(deck_id, target) of image links that are no file (deck_id, path) of the deck; web and data links don't count."""
    links = notes.select("deck_id", F.explode(F.regexp_extract_all("markdown", F.lit(IMAGE), F.lit(2))).alias("t")).select("deck_id", F.btrim(F.trim("t"), F.lit("<>")).alias("target")).where(~F.col("target").rlike(r"^(?:data:|https?://|$)")).distinct()
    return links.join(files.select("deck_id", F.col("path").alias("target")).distinct(), ["deck_id", "target"], "left_anti")


def asset_paths(pages: DataFrame, images: DataFrame, policy: str = "fallback") -> DataFrame:
    """(deck_id, path, kind) of what notes show: images that aren't ignored, and screenshots always, never, or of pages without a content image."""
    seen = images.where(~F.coalesce("ignored", F.lit(False)))
    kind = F.when(F.col("role").isin("figure_crop", "composite_figure"), "figures").otherwise("images")
    out = seen.select("deck_id", "path", kind.alias("kind"))
    shots = pages.where(F.coalesce("screenshot", F.lit("")) != "")
    if policy == "fallback":
        shots = shots.join(seen.where(F.coalesce("role", F.lit("")) != "page_image").select(*_PAGE).distinct(), _PAGE, "left_anti")
    return out.distinct() if policy == "never" else out.unionByName(shots.select("deck_id", F.col("screenshot").alias("path"), F.lit("screenshots").alias("kind"))).distinct()


def with_contents(notes: DataFrame) -> DataFrame:
    """notes (markdown) with a table of contents after the first heading of level 1: headings up to level 3, indented, with unique slugs.

    Comments go and lines lose the white space at their ends; a text without headings is else unchanged.
    """
    plain = lambda x: collapse(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, HEADING, 2), r"\[([^\]]+)]\([^)]+\)", "$1"), r"[`*_~]", ""))
    rows = _held(notes, _text=clean_markdown(F.col("markdown")))
    rows = _held(rows, _lines=F.split(F.regexp_replace("_text", r"\n\z", ""), "\n"))
    parsed = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.length(F.regexp_extract(strip(x), HEADING, 1)).alias("n"), plain(strip(x)).alias("t")))
    rows = _held(rows, _heads=F.filter(parsed, lambda h: (h["n"] > 0) & (h["t"] != "")))
    rows = _held(rows, _top=F.get(F.filter("_heads", lambda h: h["n"] == 1), F.lit(0))["i"])
    rows = _held(rows, _listed=F.filter("_heads", lambda h: (h["n"] <= 3) & ~F.coalesce(h["i"] == F.col("_top"), F.lit(False))))
    rows = _held(rows, _low=F.array_min(F.transform("_listed", lambda h: h["n"])), _slugs=F.transform("_listed", lambda h: slugify(h["t"])), _after=F.array_position(F.transform("_lines", lambda x, i: (i > F.col("_top")) & (strip(x) != "")), True).cast("int"))

    def entry(h: Column, j: Column) -> Column:
        slug = F.get(F.col("_slugs"), j)
        n = F.size(F.filter(F.slice("_slugs", 1, j + 1), lambda s: s == slug))
        unique = F.when(n == 1, slug).otherwise(F.concat(slug, F.lit("-"), n.cast("string")))
        return F.concat(F.repeat(F.lit("  "), h["n"] - F.col("_low")), F.lit("- ["), h["t"], F.lit("](#"), unique, F.lit(")"))

    at = F.when(F.col("_top").isNull(), 0).when(F.col("_after") > 0, F.col("_after") - 1).otherwise(F.size("_lines"))
    toc = F.concat(F.array(F.lit("## 目录"), F.lit("")), F.transform("_listed", entry), F.array(F.lit("")))
    merged = F.concat(F.slice("_lines", 1, at), toc, F.slice("_lines", at + 1, F.size("_lines")))
    text = F.when(F.size("_listed") > 0, F.concat(strip(F.array_join(merged, "\n")), F.lit("\n"))).otherwise(F.col("_text"))
    return rows.select(*[text.alias("markdown") if c == "markdown" else F.col(c) for c in notes.columns])


def coverage_lines(totals: DataFrame, missing: DataFrame, cap: int = 200) -> DataFrame:
    """Report rows (deck_id, place, text) of coverage_totals and of items missing (slide_id, element_id, preview)."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    head = F.array_join(F.array(
        F.lit("# Coverage"), F.lit(""), F.concat(F.lit("- Total: "), _text(F.col("total"))), F.concat(F.lit("- Covered: "), _text(F.col("covered"))), F.concat(F.lit("- Missing: "), _text(F.col("total") - F.col("covered"))),
        F.concat(F.lit("- Trace coverage: "), pct("ratio")), F.concat(F.lit("- Visible coverage: "), pct("visible_ratio")), F.concat(F.lit("- Required coverage: "), pct("required_ratio")), F.lit(""),
    ), "\n")
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id", "element_id"))
    items = missing.withColumn("place", rank).where(F.col("place") <= cap).select("deck_id", "place", F.concat(F.lit("- p"), _text(F.col("slide_id")), F.lit(" "), "element_id", F.lit(": "), "preview").alias("text"))
    return totals.select("deck_id", F.lit(0).alias("place"), head.alias("text")).unionByName(items)


def page_note_lines(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (deck_id, place, text): each page's heading and its text (deck_id, slide_id, markdown)."""
    slide = _text(F.col("slide_id"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("第 "), slide, F.lit(" 页")))
    body = strip(F.coalesce("markdown", F.lit("")))
    return pages.join(texts, _PAGE, "left").select("deck_id", F.col("slide_id").cast("int").alias("place"), F.concat(F.lit("## 第 "), slide, F.lit(" 页："), title, F.lit("\n"), F.when(body != "", F.concat(F.lit("\n"), body, F.lit("\n"))).otherwise("")).alias("text"))


def book_lines(manifest: DataFrame, entries: DataFrame, sections: DataFrame) -> DataFrame:
    """Report rows (book_id, place, text) of a book: counts, up to 80 entries of its contents, up to 120 sections."""
    place = lambda k, n: F.struct(F.lit(k).alias("k"), n.cast("int").alias("n")).alias("place")
    counts = F.array_join(F.array(F.lit("# Book report"), F.lit(""), *[F.concat(F.lit(f"- {label}: "), _text(F.col(c))) for label, c in (("Pages", "pages"), ("Sections", "sections"), ("Chunks", "chunks"))], F.lit(""), F.lit("## TOC")), "\n")
    a = manifest.select("book_id", place(0, F.lit(0)), counts.alias("text"))
    b = entries.where("entry_index <= 80").select("book_id", place(1, F.col("entry_index")), F.concat(F.lit("- "), F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), "title", F.lit(" -> "), "label").alias("text"))
    none = manifest.join(entries.select("book_id").distinct(), "book_id", "left_anti").select("book_id", place(1, F.lit(0)), F.lit("- No explicit TOC detected; sections used heading fallback.").alias("text"))
    number = F.regexp_extract("section_id", r"(\d+)$", 1).cast("int")
    c = sections.where(number <= 120).select("book_id", place(3, number), F.concat(F.lit("- "), "section_id", F.lit(": "), "title", F.lit(" (pages "), _text(F.col("start_page")), F.lit("-"), _text(F.col("end_page")), F.lit(")")).alias("text"))
    head = manifest.select("book_id", place(2, F.lit(0)), F.lit("\n## Sections").alias("text"))
    return a.unionByName(b).unionByName(none).unionByName(head).unionByName(c)
