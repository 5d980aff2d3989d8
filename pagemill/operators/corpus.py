"""Long documents for retrieval: page text, contents, sections, paragraphs and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segments import Segments
from ..functions.text import clean_lines, collapse, page_text, sha256_text
from ..shared import written

#: Patterns of headings and of entries in a table of contents.
CHAPTER = r"第\s*[一二三四五六七八九十百千万零〇\d]+\s*[章节篇部]"
TITLES = (rf"(?i)^{CHAPTER}", r"(?i)^Chapter\s+\d+", r"(?iU)^\d+(?:\.\d+)*\s+[\w一-鿿]")
TOC_LINES = (r"(?i)^(.+?)(?:\.{2,}|…{2,}|\s{2,}|\t+)\s*([ivxlcdm]+|\d{1,4})$", rf"(?i)^({CHAPTER}.+?|Chapter\s+\d+.+?|\d+(?:\.\d+)*\s+.+?)\s+(\d{{1,4}})$")
_SECTION = ["book_id", "section_id"]
LOW_TEXT, CHUNK_CHARS, PARAGRAPH_CHARS, TOC_PAGES = 80, 1200, 360, 25


def book_pages(pages: DataFrame) -> DataFrame:
    """(book_id, physical_page, text, label) → native_text, text_chars, needs_ocr (under 80 characters), title_hint.

    The hint is the first of eight lines that heads a table of contents or is a title, else the first line, 140 characters.
    """
    native = pages.select("book_id", "physical_page", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("physical_page").cast("string")).alias("printed_page_label"), page_text(F.coalesce("text", F.lit(""))).alias("native_text"))
    lines = clean_lines(F.col("native_text"))
    near = F.get(F.filter(F.slice(lines, 1, 8), lambda x: is_toc_heading(x) | is_title(x)), F.lit(0))
    hint = F.coalesce(F.when(is_toc_heading(near), near).otherwise(F.substring(strip_leader(near), 1, 140)), F.substring(F.get(lines, F.lit(0)), 1, 140))
    n = F.length(F.trim("native_text"))
    return native.select("book_id", "physical_page", "printed_page_label", "native_text", n.alias("text_chars"), (n < LOW_TEXT).alias("needs_ocr"), hint.alias("title_hint"))


def book_ocr_targets(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """Pages to read by OCR with the reason: all, or those with little text; off gives none."""
    chosen = pages.where(F.lit(mode == "all") | (F.lit(mode != "off") & F.col("needs_ocr")))
    return chosen.select("book_id", "physical_page", F.lit("all_pages" if mode == "all" else "low_native_text").alias("reason"))


def ocr_report(records: DataFrame) -> DataFrame:
    """Per book: targets, calls, cache hits, skipped and characters of OCR records (api_call, cache_status, text_chars)."""
    return records.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("targets_total"), F.count_if("api_call").alias("api_calls"), F.count_if(F.col("cache_status") == "local_hit").alias("local_cache_hits"),
        F.count_if(F.col("cache_status") == "skipped").alias("skipped"), F.sum(F.coalesce("text_chars", F.lit(0)).cast("bigint")).alias("text_chars"),
    )


def combine_text(pages: DataFrame) -> DataFrame:
    """pages (native_text, ocr_text) + combined_text: OCR alone where native text is short, native alone where it holds the OCR text, else both."""
    native, ocr = F.trim(F.coalesce("native_text", F.lit(""))), F.trim(F.coalesce("ocr_text", F.lit("")))
    text = F.when(ocr == "", native).when(F.length(native) < LOW_TEXT, ocr).when(F.contains(native, ocr), native).otherwise(F.concat(native, F.lit("\n\n[OCR]\n"), ocr))
    return pages.withColumn("combined_text", text)


def strip_leader(c: Column) -> Column:
    return F.btrim(collapse(F.regexp_replace(c, r"\.{2,}|…{2,}", " ")), F.lit(".·- "))


def is_title(c: Column) -> Column:
    """A chapter, or a number and a word, of 2 to 140 characters."""
    return _titled(strip_leader(c))


def _titled(t: Column) -> Column:
    return F.length(t).between(2, 140) & (t.rlike(TITLES[0]) | t.rlike(TITLES[1]) | t.rlike(TITLES[2]))


def is_toc_heading(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return low.isin("目录", "目 录", "contents", "table of contents") | low.startswith("目录 ")


def toc_level(c: Column) -> Column:
    dots = F.regexp_extract(c, r"^(\d+(?:\.\d+)*)\b", 1)
    return F.when(c.rlike(rf"^{CHAPTER}") & ~c.rlike(r"^第\s*[一二三四五六七八九十百千万零〇\d]+\s*节"), 1).when(c.rlike(r"^第"), 2).when(dots != "", F.least(F.lit(6), F.size(F.split(dots, r"\.")))).otherwise(1)


def toc_lines(pages: DataFrame) -> DataFrame:
    """(book_id, physical_page, combined_text) → entries of a table of contents with their page, line, title, label and level."""
    lines = pages.select("book_id", "physical_page", F.posexplode(clean_lines(F.col("combined_text"))).alias("pos", "line"))
    open_ = lines.where((F.length("line") <= 180) & ~is_toc_heading(F.col("line")))
    parts = []
    for pattern in TOC_LINES:
        title = strip_leader(F.regexp_extract("line", pattern, 1))
        parts.append(F.when(F.col("line").rlike(pattern) & is_title(title), F.struct(title.alias("title"), F.regexp_extract("line", pattern, 2).alias("label"))))
    found = open_.withColumn("e", F.coalesce(*parts)).where("e is not null")
    return found.select("book_id", "physical_page", "pos", F.col("e.title").alias("title"), F.col("e.label").alias("label"), toc_level(F.col("e.title")).alias("level"))


def detect_toc(pages: DataFrame) -> DataFrame:
    """Entries of each book's table of contents: book_id, entry_index, title, label, level, toc_page.

    Among the first 25 pages those count that have a heading for it in their first 12 lines, or two entries. Of
    equal (title, label) the first stays.
    """
    first = pages.where(F.col("physical_page") <= TOC_PAGES)
    heads = first.select("book_id", "physical_page", F.exists(F.slice(clean_lines(F.col("combined_text")), 1, 12), is_toc_heading).alias("head"))
    entries = toc_lines(first)
    counted = entries.groupBy("book_id", "physical_page").agg(F.count(F.lit(1)).alias("n"))
    good = heads.join(counted, ["book_id", "physical_page"], "left").where(F.col("head") | (F.col("n") >= 2)).select("book_id", "physical_page")
    kept = entries.join(good, ["book_id", "physical_page"], "left_semi")
    order = F.struct("physical_page", "pos")
    once = kept.groupBy("book_id", "title", "label").agg(F.min(order).alias("at"), F.min_by("level", order).alias("level"))
    index = F.row_number().over(Window.partitionBy("book_id").orderBy("at"))
    return once.select("book_id", index.alias("entry_index"), "title", "label", "level", F.col("at.physical_page").alias("toc_page"))


def toc_summary(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Per book: entries and the confidence of its table of contents: 0.45, 0.08 an entry, 0.15 for any; at most 0.95; 0 without entries."""
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    per = entries.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    sure = F.when(n > 0, F.round(F.least(F.lit(0.95), 0.45 + 0.08 * n + 0.15), 3)).otherwise(0.0)
    return pages.select("book_id").distinct().join(per, "book_id", "left").select("book_id", n.alias("entries"), sure.alias("confidence"))


def resolve_labels(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """entries + start: the physical page of the printed label, by label or number, the smallest; else the page of the entry."""
    label = F.trim(F.coalesce(F.col("printed_page_label"), F.lit("")))

    def norm(c: Column) -> Column:
        return F.when(c.rlike(r"^\d+$"), c.cast("bigint").cast("string")).otherwise(F.lower(c))

    forms = F.array(F.col("physical_page").cast("string"), label, norm(label))
    lookup = pages.select("book_id", "physical_page", F.explode(F.array_distinct(forms)).alias("form")).where("form <> ''").groupBy("book_id", "form").agg(F.min("physical_page").alias("page"))
    exact = lookup.select("book_id", F.col("form").alias("label"), F.col("page").alias("by_label"))
    normal = lookup.select("book_id", F.col("form").alias("norm"), F.col("page").alias("by_norm"))
    joined = entries.withColumn("norm", norm(F.col("label"))).join(exact, ["book_id", "label"], "left").join(normal, ["book_id", "norm"], "left")
    return joined.select(*[F.col(c) for c in entries.columns], F.coalesce("by_label", "by_norm", "toc_page").alias("start"))


def book_sections(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Sections of each book: from its table of contents (levels 1 and 2), else from its headings, else the whole book.

    A section ends before the next begins, at its own start at least, so two that start on one page share it.
    Numbers and ends follow from ranges of pages, so a book of any length is spread over tasks.
    """
    count = pages.groupBy("book_id").agg(F.max("physical_page").alias("pages"))
    toc = resolve_labels(entries.where("level <= 2"), pages).select("book_id", "start", "level", "title", F.lit("toc").alias("source"))
    bare = F.transform(F.slice(clean_lines(F.col("combined_text")), 1, 12), lambda x: F.struct(x.alias("line"), strip_leader(x).alias("t")))
    line = F.get(F.filter(bare, lambda x: _titled(x["t"])), F.lit(0))["line"]
    titled = pages.select("book_id", F.col("physical_page").alias("start"), F.explode(F.array(line)).alias("line"))
    title = strip_leader(F.col("line"))
    heads = titled.where("line is not null").select("book_id", "start", toc_level(F.col("line")).alias("level"), title.alias("title"), F.lit("heading_fallback").alias("source"))
    heads = heads.join(toc.select("book_id").distinct(), "book_id", "left_anti")
    found = written(toc.unionByName(heads), "section-starts")
    whole = count.join(found.select("book_id").distinct(), "book_id", "left_anti").select("book_id", F.lit(1).alias("start"), F.lit(1).alias("level"), F.lit("Full textbook").alias("title"), F.lit("fallback").alias("source"))
    every = found.unionByName(whole).join(count, "book_id")
    book = Segments(["book_id"], ["start", "level", "title"], 256)
    start = F.least(F.greatest(F.col("start"), F.lit(1)), F.greatest("pages", F.lit(1)))
    after = book.lead(book.row_number(every.withColumn("start", start), "index"), F.col("start"), "_next")
    cut = after.withColumn("end", F.coalesce(F.greatest("start", F.least("pages", F.col("_next") - 1)), "pages"))
    return cut.select("book_id", F.format_string("tb_sec%03d", "index").alias("section_id"), "title", "level", F.col("start").alias("start_page"), F.col("end").alias("end_page"), "source")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, if there are two or more; else lines packed until 360 characters or a title."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: b != "")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    # in turn, so that each line's title is tested once: a lambda computes what it names as often as it names it
    bare = F.transform(clean_lines(text), lambda x: F.struct(x.alias("line"), strip_leader(x).alias("t")))
    lines = F.transform(bare, lambda x: F.struct(x["line"].alias("line"), _titled(x["t"]).alias("title")))

    def step(s: Column, x: Column) -> Column:
        held = F.when(s["held"] == "", x["line"]).otherwise(F.concat(s["held"], F.lit(" "), x["line"]))
        full = (F.length(held) >= PARAGRAPH_CHARS) | x["title"]
        return F.struct(F.when(full, F.array_append(s["out"], held)).otherwise(s["out"]).alias("out"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    packed = F.aggregate(lines, state, step, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.array_append(s["out"], s["held"])))
    return F.when(F.size(blocks) > 1, blocks).otherwise(packed)


def section_units(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Paragraphs of each section in order: book_id, section_id, page, pos, text. The page range becomes an equi-join.

    The pages of a section are many times its one row, which Spark's estimate doesn't show; so they are shuffled, never broadcast.
    """
    spans = sections.select("book_id", "section_id", F.explode(F.sequence(F.col("start_page"), F.col("end_page"))).alias("physical_page"))
    # an array of one, exploded: what follows, and the filter of empty lists, reads a column and doesn't pack again
    packed = pages.select("book_id", "physical_page", F.explode(F.array(paragraphs(F.col("combined_text")))).alias("p"))
    units = packed.select("book_id", "physical_page", F.posexplode("p").alias("pos", "text"))
    return spans.hint("merge").join(units, ["book_id", "physical_page"]).select("book_id", "section_id", F.col("physical_page").alias("page"), "pos", "text")


#: Pages of a range when a section's paragraphs are numbered, and characters of one when they look for their successors.
PAGE_RANGE, CHAR_RANGE = 32, 1 << 16
#: Paragraphs of a section that are folded together.
UNIT_RANGE = 1024


def placed_units(units: DataFrame) -> DataFrame:
    """Paragraphs with their place n in the section, from 1, and upto: characters of the section so far, two more for each paragraph."""
    order = Segments(_SECTION, ["page", "pos"], PAGE_RANGE)
    return order.running_sum(order.row_number(units, "n"), (F.length("text") + 2).cast("bigint"), "upto")


def chunk_successors(placed: DataFrame, max_chars: int) -> DataFrame:
    """(book_id, section_id, n, next): where the next chunk begins if one begins at n; null if it reaches the section's end.

    A chunk from n holds what ends by ``limit``, the characters before it and ``max_chars`` and two more; a
    longer first paragraph stands alone. Ends and limits of a section lie on one line; the successor is the
    first end after the limit, found by looking back from the line's other end, range by range.
    """
    line = placed.select(*_SECTION, "n", F.col("upto").alias("at"), F.lit(True).alias("end"))
    limit = F.greatest(F.col("upto") - (F.length("text") + 2) + max_chars + 2, F.col("upto"))
    asks = placed.select(*_SECTION, "n", limit.alias("at"), F.lit(False).alias("end"))
    both = line.unionByName(asks).withColumn("back", -F.col("at"))
    # of one place the end comes later in this order than the limits, as an end at the limit is within it
    found = Segments(_SECTION, ["back", "end"], CHAR_RANGE).last_value(both, F.when(F.col("end"), F.col("n")), "next")
    return found.where("not end").select(*_SECTION, "n", "next")


def chunk_starts(successors: DataFrame, width: int = UNIT_RANGE) -> DataFrame:
    """(book_id, section_id, n): the places that are reached from a section's first by successors.

    Ranges of ``width`` places are folded backwards, which gives each place the one by which its path leaves the
    range. Only places by which a path may enter a range jump on, by pointer doubling: round k knows the entries
    of the first 2^k ranges and, of each entry, the one 2^k ranges on; jumps past the section's end drop out.
    Then each range is folded once from its entry. A section within one range needs no round.
    """
    place = F.floor((F.col("n") - 1) / width)
    ranges = written(successors.groupBy(*_SECTION, place.alias("_r")).agg(F.array_sort(F.collect_list(F.struct("n", "next"))).alias("_c")), "chunk-ranges")
    last = F.element_at("_c", -1)["n"]
    leave = F.aggregate(F.reverse("_c"), F.array().cast("array<bigint>"), lambda s, x: F.array_append(s, F.when(x["next"] <= last, F.get(s, (last - x["next"]).cast("int"))).otherwise(x["next"])))
    exits = ranges.select(*_SECTION, F.explode(F.arrays_zip(F.col("_c.n").alias("n"), F.reverse(leave).alias("to"))).alias("_x")).select(*_SECTION, "_x.n", "_x.to").where("to is not null")
    entries = exits.select(*_SECTION, F.col("to").alias("n")).distinct()
    jump = written(exits.where("n > 1").join(entries, [*_SECTION, "n"], "left_semi").unionByName(exits.where("n = 1")), "chunk-jumps")
    found = successors.where("n = 1").select(*_SECTION, "n")
    while not jump.isEmpty():
        reached = found.join(jump, [*_SECTION, "n"]).select(*_SECTION, F.col("to").alias("n"))
        found = written(found.unionByName(reached), "chunk-entries")
        on = jump.select(*_SECTION, F.col("n").alias("to"), F.col("to").alias("_then"))
        jump = written(jump.join(on, [*_SECTION, "to"]).select(*_SECTION, "n", F.col("_then").alias("to")), "chunk-jumps")
    start = F.struct(F.col("n").alias("at"), F.array().cast("array<bigint>").alias("out"))
    walk = F.aggregate("_c", start, lambda s, x: F.when(s["at"] == x["n"], F.struct(x["next"].alias("at"), F.array_append(s["out"], x["n"]).alias("out"))).otherwise(s))["out"]
    return ranges.join(found.withColumn("_r", place), [*_SECTION, "_r"]).select(*_SECTION, F.explode(walk).alias("n"))


def chunks(units: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Paragraphs packed in order into chunks of at most ``max_chars`` within a section; a longer one stands alone.

    Joined by a blank line, which counts two characters. Where a chunk begins depends on the one before (cutting a
    running length at multiples would give other chunks), but each paragraph knows where the next chunk would
    begin, so the beginnings follow by folds over ranges and pointer doubling between them. A section of any size
    is spread over all tasks: its paragraphs are numbered, searched and joined by place, and only the texts of one
    chunk meet.
    """
    placed = written(placed_units(units), "units")
    after = written(chunk_successors(placed, max_chars), "successors")
    # written starts are small as files but not as rows
    begun = written(chunk_starts(after), "starts").hint("merge").join(after, [*_SECTION, "n"])
    numbered = Segments(_SECTION, ["n"], 4096).row_number(begun, "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int"))
    last = placed.groupBy(*_SECTION).agg(F.max("n").alias("_last"))
    spans = numbered.join(last, _SECTION).select(*_SECTION, "chunk_index", F.explode(F.sequence(F.col("n"), F.coalesce(F.col("next") - 1, F.col("_last")))).alias("n"))
    # places are many times the chunks that they come from, which Spark's estimate doesn't show: they are shuffled
    whole = placed.join(spans.hint("merge"), [*_SECTION, "n"]).groupBy(*_SECTION, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("_u"), F.min("page").cast("int").alias("page_start"), F.max("page").cast("int").alias("page_end"))
    flat = whole.withColumn("text", F.array_join(F.col("_u.text"), "\n\n"))
    return flat.select(
        *_SECTION, "chunk_index", "text", F.length("text").alias("text_chars"), sha256_text(F.col("text")).alias("content_hash"), "page_start", "page_end",
        F.concat(F.lit("tb_"), F.substring(F.sha2(F.col("book_id").cast("string"), 256), 1, 12), F.lit("_"), "section_id", F.format_string("_c%03d", F.col("chunk_index"))).alias("chunk_id"),
    )


def chunk_index(packed: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks without their texts, with the title of their section."""
    named = packed.join(sections.select("book_id", "section_id", F.col("title").alias("section_title")), ["book_id", "section_id"], "left")
    return named.select("book_id", "chunk_id", "section_id", "section_title", "page_start", "page_end", "text_chars", "content_hash")


def manifest(pages: DataFrame, sections: DataFrame, packed: DataFrame) -> DataFrame:
    """Per book: pages, pages with little text, sections, chunks and their characters."""
    p = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.length(F.trim("combined_text")) < LOW_TEXT).alias("low_text_pages"))
    s = sections.groupBy("book_id").agg(F.count(F.lit(1)).alias("sections"))
    c = packed.groupBy("book_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("text_chars").cast("bigint")).alias("chars"))
    return p.join(s, "book_id", "left").join(c, "book_id", "left").na.fill(0)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per row, keys sorted, nulls kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def duplicate_groups(items: DataFrame) -> DataFrame:
    """(key, content[, name, module]) → key and the least key with the same normalised content, of contents found twice or more.

    Pairs follow from the groups: copies aren't expanded, so a content with n copies has n rows. With name and
    module, equal contents of one name in one module are one: the group must hold another name or module.
    """
    named = {"name", "module"} <= set(items.columns)
    own = F.struct("name", "module") if named else F.struct("key")
    hashed = items.select("key", F.sha2(collapse(F.lower("content")), 256).alias("h"), own.alias("own"))
    groups = hashed.groupBy("h").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), (F.min("own") != F.max("own")).alias("differ")).where("copies > 1")
    if named:
        groups = groups.where("differ")
    return hashed.join(groups, "h").select("key", "first", "copies")


def unreferenced(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """Dotted keys that no reference equals, lies below or lies above; both sides become equi-joins on prefixes."""

    def prefixes(c: str) -> Column:
        parts = F.split(c, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))

    below = refs.select(F.explode(prefixes("ref")).alias("key")).distinct()
    above = keys.select("key", F.explode(prefixes("key")).alias("ref")).join(refs.distinct(), "ref", "left_semi").select("key").distinct()
    return keys.join(below, "key", "left_anti").join(above, "key", "left_anti")
