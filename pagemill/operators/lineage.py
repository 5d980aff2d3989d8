"""Notes as rows: Markdown blocks with line numbers, heading paths, links to elements, stable ids, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, image_targets, round_score, source_tokens, strip, strip_comments, text_lines

_KEYS = ["deck_id", "slide_id"]
IMAGE = r"!\[[^\]]*]\([^)]+\)"
DELIMITER_ROW = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"
#: What begins the comment that names a block's sources.
MARK = "source:"


def _first_line(text: Column) -> Column:
    return strip(strip_comments(F.get(F.split(text, r"\R"), F.lit(0))))


def block_kind(text: Column) -> Column:
    """heading, source_marker (comments only), image (nothing else visible), table (with its delimiter row), list (all lines), paragraph."""
    lines, seen = text_lines(text), strip(strip_comments(text))
    item = lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("+ ") | x.rlike(r"(?U)^\d+[.)]\s+")
    return (
        F.when(_first_line(text).rlike(r"(?U)^#{1,6}\s+"), "heading").when(text.rlike(r"(?sU)\A(?:<!--.*?-->\s*)+\z"), "source_marker").when(seen.rlike(rf"\A{IMAGE}\z"), "image")
        .when((F.size(lines) >= 2) & F.get(lines, F.lit(0)).startswith("|") & F.get(lines, F.lit(1)).rlike(DELIMITER_ROW), "table").when(F.forall(lines, item), "list").otherwise("paragraph")
    )


def markdown_blocks(notes: DataFrame) -> DataFrame:
    """(deck_id, slide_id, markdown) → ordinal, kind, line_start, line_end, text of each block between blank lines.

    Only blank lines end a block. Windows are per note, not per deck.
    """
    lines = notes.select(*_KEYS, F.posexplode(F.split("markdown", r"\R")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    note = Window.partitionBy(*_KEYS).orderBy("line_no")
    blank = strip(F.col("line")) == ""
    starts = ~blank & F.coalesce(F.lag(blank).over(note), F.lit(True))
    cut = lines.withColumn("starts", starts).withColumn("b", F.sum(F.col("starts").cast("int")).over(note)).where(~blank)
    whole = cut.groupBy(*_KEYS, "b").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    named = whole.select(*_KEYS, F.col("b").alias("ordinal"), F.col("l")[0]["line_no"].alias("line_start"), F.element_at("l", -1)["line_no"].alias("line_end"), strip(F.array_join(F.col("l.line"), "\n")).alias("text"))
    return named.select(*_KEYS, "ordinal", block_kind(F.col("text")).alias("kind"), "line_start", "line_end", "text")


def heading_paths(blocks: DataFrame) -> DataFrame:
    """blocks + path array<string>: the headings above each block and its own, those of deeper or equal level dropped by a new one."""
    first = _first_line(F.col("text"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(first, r"^(#{1,6})", 1)))
    note = Window.partitionBy(*_KEYS).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    title = collapse(F.btrim(F.regexp_replace(first, r"(?U)^#{1,6}\s+", ""), F.lit(" #")))
    last = [F.last(F.when(level == k, F.struct(F.col("ordinal").alias("o"), title.alias("t"))), ignorenulls=True).over(note).alias(f"h{k}") for k in range(1, 7)]
    found = blocks.select("*", *last)
    above = [F.lit(-1).cast("bigint")]
    keep = []
    for k in range(1, 7):
        newest = F.greatest(*above, F.lit(-1))
        keep.append(F.when(F.col(f"h{k}.o") > newest, F.col(f"h{k}.t")))
        above.append(F.coalesce(F.col(f"h{k}.o"), F.lit(-1)))
    return found.select(*blocks.columns, F.array_compact(F.array(*keep)).alias("path"))


def _name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+)/*$", 1)


def block_elements(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Distinct (deck_id, slide_id, ordinal, element_id) that a block names: ids in its text, and images it shows.

    images: deck_id, element_id, path. A link shows an image if one path ends in the other or the file names are
    equal; each of these makes the names equal, so the join is on deck and name.
    """
    named = blocks.select(*_KEYS, "ordinal", F.explode(source_tokens(F.col("text"))).alias("element_id"))
    if images is not None:
        shown = blocks.select(*_KEYS, "ordinal", F.explode(image_targets(F.col("text"))).alias("target")).select(*_KEYS, "ordinal", _name(F.col("target")).alias("_name")).where("_name <> ''")
        paths = images.select("deck_id", "element_id", _name(F.col("path")).alias("_name")).distinct()
        named = named.unionByName(shown.join(paths, ["deck_id", "_name"]).select(*_KEYS, "ordinal", "element_id"))
    return named.distinct()


def block_links(blocks: DataFrame, elements: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Of what blocks name, the elements of their deck."""
    known = elements.select("deck_id", "element_id").distinct()
    return block_elements(blocks, images).join(known, ["deck_id", "element_id"], "left_semi").select(*_KEYS, "ordinal", "element_id")


#: Prefixes of block ids.
PREFIX = {"heading": "h", "paragraph": "p", "list": "list", "table": "tbl", "image": "img", "source_marker": "src"}


def visible_text(c: Column) -> Column:
    """Without comments, images as their alternative texts, white space collapsed."""
    return collapse(F.regexp_replace(strip_comments(c), r"!\[([^\]]*)]\([^)]+\)", "$1"))


def block_ids(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """blocks (with path) + block_id: a prefix of the kind and 12 hex digits of SHA-1 of kind, path, ids and visible text; repeats get _2, _3."""
    ids = block_elements(blocks, images).groupBy(*_KEYS, "ordinal").agg(F.array_sort(F.collect_list("element_id")).alias("_ids"))
    text = F.concat_ws("\n", "kind", F.array_join("path", " / "), F.array_join(F.coalesce("_ids", F.array().cast("array<string>")), ","), visible_text(F.col("text")))
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), F.col("kind")), F.lit("blk"))
    with_base = blocks.join(ids, [*_KEYS, "ordinal"], "left").withColumn("_base", F.concat(F.lit("nb_"), prefix, F.lit("_"), F.substring(F.sha1(text), 1, 12)))
    n = F.row_number().over(Window.partitionBy(*_KEYS, "_base").orderBy("ordinal"))
    return with_base.withColumn("_n", n).select(*blocks.columns, F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_n"))).alias("block_id"))


def page_sources(elements: DataFrame) -> DataFrame:
    """Per page: how many elements, and their ids in order."""
    return elements.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_elements"), F.array_sort(F.collect_list("element_id")).alias("element_ids"))


def note_excerpts(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """(deck_id, markdown), (deck_id, slide_id) → excerpt of each page: the section under its heading, else the first four blocks that name it, else empty.

    A page's heading is a third-level one that names 第 n 页; its section ends at the next such heading. The note
    is cut into lines and blocks once, the pages join on deck and number.
    """
    heading = r"(?U)^### .*?第\s*(\d+)\s*页"
    lines = notes.select("deck_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    note = Window.partitionBy("deck_id").orderBy("pos")
    head = F.when(F.col("line").rlike(heading), F.struct("pos", F.regexp_extract("line", heading, 1).cast("int").alias("slide_id")))
    held = lines.select("deck_id", "pos", "line", F.last(head, ignorenulls=True).over(note).alias("h")).where("h is not null")
    part = held.groupBy("deck_id", F.col("h.slide_id").alias("slide_id"), F.col("h.pos").alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    section = part.groupBy("deck_id", "slide_id").agg(F.min_by(strip(F.array_join(F.col("l.line"), "\n")), "at").alias("section"))
    blocks = notes.select("deck_id", F.posexplode(F.split("markdown", "\n\n")).alias("pos", "block")).select("deck_id", "pos", "block", F.explode(F.array_distinct(F.regexp_extract_all("block", F.lit(r"p(\d+):"), F.lit(1)))).alias("slide_id"))
    first = F.row_number().over(Window.partitionBy("deck_id", "slide_id").orderBy("pos"))
    four = blocks.withColumn("slide_id", F.col("slide_id").cast("int")).withColumn("r", first).where("r <= 4")
    named = four.groupBy("deck_id", "slide_id").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "block"))), lambda x: x["block"]), "\n\n")).alias("named"))
    return pages.select(*_KEYS).join(section, _KEYS, "left").join(named, _KEYS, "left").select(*_KEYS, F.coalesce("section", "named", F.lit("")).alias("excerpt"))


#: Words counted for each score, and patterns of page listings.
DEPTH = ["为什么", "原因", "重要", "如何", "机制", "关系", "影响", "直觉", "步骤", "because", "why", "how"]
EXAMPLES = ["例如", "例子", "比如", "类比", "case", "example"]
SELF_TEST = ["自测", "检查自己", "思考题", "quiz", "self-test"]
PITFALLS = ["易错", "误解", "注意", "陷阱", "常见错误", "pitfall", "misconception"]
FIGURE_TERMS = ["图", "表", "公式", "流程", "截图", "figure", "formula"]
LISTINGS = [r"(?U)第\s*\d+\s*页", r"(?U)第\s*\d+\s*张", r"(?U)幻灯片\s*\d+", r"(?iU)slide\s*\d+", r"(?i)this page", r"(?i)on this slide"]
LISTING_HEADING = r"(?miU)^#{2,4}\s*(第\s*\d+\s*页|Slide\s*\d+)"


def _hits(c: Column, words: list[str]) -> Column:
    """How often these words occur, each counted by itself."""
    total = F.lit(0)
    for w in words:
        total = total + (F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w)
    return total


def note_quality(notes: DataFrame, images: DataFrame | None = None, mark: str = MARK) -> DataFrame:
    """Per note: paragraphs, headings, marks and image links, and seven scores from 0 to 1.

    images: deck_id, slide_id, ignored; a note without images has full figure integration.
    """
    text, low = F.col("markdown"), F.lower("markdown")
    chunks = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("<!--") & ~x.startswith("![") & ~x.startswith("|"))
    rows = notes.select(*_KEYS, "markdown", F.size(chunks).alias("paragraphs"), F.aggregate(chunks, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("_chars"), F.regexp_count(text, F.lit(r"(?mU)^#{2,4}\s+")).alias("headings"), F.regexp_count(text, F.lit(rf"<!--\s*{mark}")).alias("source_markers"), F.regexp_count(text, F.lit(IMAGE)).alias("image_refs"))
    if images is None:
        rows = rows.withColumn("source_images", F.lit(0).cast("bigint"))
    else:
        per = images.groupBy(*_KEYS).agg(F.count_if(~F.coalesce("ignored", F.lit(False))).alias("source_images"))
        rows = rows.join(per, _KEYS, "left").withColumn("source_images", F.coalesce("source_images", F.lit(0).cast("bigint")))
    n, one, zero = F.col("paragraphs"), F.lit(1.0), F.lit(0.0)
    mean = F.coalesce(F.try_divide(F.col("_chars"), n), zero)
    headings = F.when(F.col("headings") > 0, F.least(one, F.col("headings") / 5)).otherwise(0.25)
    coherence = F.when(n == 0, zero).otherwise(0.42 * F.least(one, n / 8) + 0.28 * headings + 0.30 * F.least(one, mean / 180))
    figures = F.when(F.col("source_images") == 0, one).otherwise(0.55 * F.least(one, F.col("image_refs") / F.greatest(F.lit(1), "source_images")) + 0.45 * F.least(one, _hits(text, FIGURE_TERMS) / F.greatest(F.lit(2), F.col("image_refs") * 2)))
    listed = F.regexp_count(text, F.lit(LISTING_HEADING)) * 2
    for p in LISTINGS:
        listed = listed + F.regexp_count(text, F.lit(p))
    scores = {
        "coherence_score": coherence, "explanation_depth_score": mean / 220 + _hits(low, DEPTH) / 8, "example_score": _hits(low, EXAMPLES) / 8, "figure_integration_score": figures,
        "mechanical_page_listing_score": listed / F.greatest(one, F.length(text) / 1000) / 3, "self_test_score": _hits(low, SELF_TEST) / 8, "pitfall_score": _hits(low, PITFALLS) / 8,
    }
    return rows.select(*_KEYS, "paragraphs", "headings", "source_markers", "image_refs", "source_images", *[round_score(v).alias(k) for k, v in scores.items()])


#: Suggestions, in order.
REPAIRS = {
    "explanation_depth_score": "补充核心概念的为什么、如何运作、前后关系解释。", "example_score": "增加帮助理解的例子或类比，但避免新增课件没有依据的具体事实。", "figure_integration_score": "加强图、表、公式与正文概念之间的解释关系。",
    "mechanical_page_listing_score": "减少按页复述，把内容按章节问题和概念链重新组织。", "self_test_score": "增加本节自测问题，帮助学生检查是否真正理解。", "pitfall_score": "补充易错点或常见误解。",
}


def quality_risk(quality: DataFrame, coverage: DataFrame, expanded: bool = False) -> DataFrame:
    """quality + risk (high, medium, low) and repairs.

    coverage: the keys, missing, required_missing; null as none. High: a required item is missing, or, in
    expanded notes, under 0.25 marks a paragraph. Medium: an item is missing, or under 0.45 marks a paragraph.
    """
    density = F.col("source_markers") / F.greatest(F.lit(1), "paragraphs")
    joined = quality.join(coverage.select(*_KEYS, "missing", "required_missing"), _KEYS, "left")
    missing, required = F.coalesce("missing", F.lit(0)), F.coalesce("required_missing", F.lit(0))
    risk = F.when((required > 0) | (F.lit(expanded) & (density < 0.25)), "high").when((missing > 0) | (density < 0.45), "medium").otherwise("low")
    low = {
        "explanation_depth_score": F.col("explanation_depth_score") < 0.55, "example_score": F.col("example_score") < 0.35, "figure_integration_score": (F.col("source_images") > 0) & (F.col("figure_integration_score") < 0.55),
        "mechanical_page_listing_score": F.col("mechanical_page_listing_score") > 0.35, "self_test_score": F.col("self_test_score") < 0.25, "pitfall_score": F.col("pitfall_score") < 0.25,
    }
    repairs = F.array_compact(F.array(*[F.when(cond, F.lit(REPAIRS[k])) for k, cond in low.items()]))
    return joined.select(*quality.columns, risk.alias("risk"), repairs.alias("repairs"))
