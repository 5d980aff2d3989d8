"""Sections of decks: boundaries, titles and spans, note contexts, neighbouring pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segments import Segments
from ..functions.text import heading_key, strip, text_lines
from ..shared import written

#: Share of lengths from which a title that holds another, or lies in it, matches.
RATIO = 0.72
#: Lengths of the pieces by which titles find each other, and of those by which pages find titles.
GRAMS, ANCHORS = (1, 2, 4, 8, 16, 32), (4, 8, 16, 32)
#: 64-bit words of the filter of anchors, whatever their number: 2 MB.
FILTER_WORDS = 1 << 18
#: Pages of a deck in order.
_DECK = Segments(["deck_id"], ["slide_id"])


NUMBER = r"(?U)^[（(]?\s*(?:\d+|[一二三四五六七八九十]+)\s*[)）.、]?$"
NUMBER_PREFIX = r"(?U)^\s*[（(]?\s*(?:\d+|[一二三四五六七八九十]+)\s*(?:[)）.、]|\s+)\s*"


def outline_items(pages: DataFrame) -> DataFrame:
    """(deck_id, slide_id, text) → deck_id, rank, title, key, number, slide_id: lines of contents pages (those that hold 目录 or Contents).

    A line's key has four characters or more; each key counts once a deck. A line that is only a number numbers
    the next item of its page. The window that carries numbers on is per page; items are numbered by ranges of pages.
    """
    listed = pages.where(F.col("text").contains("目录") | F.col("text").contains("Contents"))
    lines = listed.select("deck_id", "slide_id", F.posexplode(text_lines(F.col("text"))).alias("n", "line")).withColumn("key", heading_key(F.col("line")))
    lines = lines.where((F.col("key") != "") & ~F.lower("key").isin("目录", "contents"))
    number = F.col("line").rlike(NUMBER)
    order = F.struct("slide_id", "n")
    first = lines.where(~number & (F.length("key") >= 4)).groupBy("deck_id", "key").agg(F.min(order).alias("o"))
    kept = lines.join(first, ["deck_id", "key"], "left").withColumn("item", ~number & (F.col("o") == order))
    page = Window.partitionBy("deck_id", "slide_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last_item = F.max(F.when(F.coalesce("item", F.lit(False)), F.col("n"))).over(page)
    last_number = F.last(F.when(number, F.struct("n", "line")), ignorenulls=True).over(page)
    marked = kept.withColumn("_i", last_item).withColumn("_n", last_number).where("item")
    pending = F.when(F.col("_n.n") > F.coalesce("_i", F.lit(-1)), F.col("_n.line"))
    ranked = Segments(["deck_id"], ["slide_id", "n"]).row_number(marked, "rank")
    return ranked.select("deck_id", F.col("rank").cast("int").alias("rank"), strip(F.regexp_replace("line", NUMBER_PREFIX, "")).alias("title"), "key", pending.alias("number"), "slide_id")


def _matches(a: Column, b: Column) -> Column:
    near = F.least(F.length(a), F.length(b)) >= F.lit(RATIO) * F.greatest(F.length(a), F.length(b))
    return (a == b) | ((F.contains(a, b) | F.contains(b, a)) & near)


def _gram_of(longer: int) -> int:
    """Length of the middle piece of a longer title that any title with RATIO of its length, lying in it, must hold."""
    shorter = -(-int(longer * RATIO * 100 + 1e-6) // 100)
    return max(g for g in GRAMS if g <= max(1, 2 * shorter - longer))


def _pieces(titles: DataFrame, name: str, middle: bool) -> DataFrame:
    """(deck_id, name) → its pieces as (g, piece): the middle one if it is the longer side of a match, else all of the lengths that longer ones may have."""
    top = 2 * GRAMS[-1] * 2
    length = F.length(name)
    if middle:
        g = F.element_at(F.array(*[F.lit(_gram_of(n)) for n in range(1, top + 1)]), F.least(length, F.lit(top)))
        return titles.select("deck_id", name, g.alias("g"), F.substr(name, F.floor((length - g) / 2).cast("int") + 1, g).alias("piece")).where(length > 0)
    sizes = [sorted({_gram_of(n) for n in range(m, int(m / RATIO) + 2)}) for m in range(1, top + 1)]
    own = titles.where(length > 0).withColumn("g", F.explode(F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in sizes]), F.least(length, F.lit(top)))))
    places = F.transform(F.sequence(F.lit(1), F.length(name) - F.col("g") + 1), lambda i: F.substr(F.col(name), i, F.col("g")))
    return own.where(F.length(name) >= F.col("g")).select("deck_id", name, "g", F.explode(F.array_distinct(places)).alias("piece"))


def _alike(titles: DataFrame, keys: DataFrame) -> DataFrame:
    """(deck_id, k) and (deck_id, key), each distinct → pairs that match.

    Pieces are many times the titles that they come from, which Spark's estimate doesn't show; so both sides are
    shuffled by piece, and none is sent to all tasks.
    """
    met = [_pieces(titles, "k", m).hint("merge").join(_pieces(keys, "key", not m), ["deck_id", "g", "piece"]).select("deck_id", "k", "key") for m in (True, False)]
    return met[0].unionByName(met[1]).where(_matches(F.col("k"), F.col("key"))).distinct()


def outline_matches(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(deck_id, slide_id, rank): outline items that a page's title equals, or holds or lies in with a length ratio of 0.72 or more.

    Different titles are joined, not pages. A title that lies in another and has most of its length holds the
    other's middle; so the middle piece of the longer one is looked up among all pieces of the shorter one, and
    the rule itself decides. A deck's titles are spread by their pieces.
    """
    p = pages.select("deck_id", "slide_id", heading_key(F.coalesce("title", F.lit(""))).alias("k")).where("k <> '' and not contains(k, '目录') and lower(k) <> 'contents'")
    pairs = _alike(p.select("deck_id", "k").distinct(), outline.select("deck_id", "key").distinct())
    return p.join(pairs, ["deck_id", "k"]).join(outline.select("deck_id", "key", "rank"), ["deck_id", "key"]).select("deck_id", "slide_id", "rank")


def _rolling(text: str) -> dict[int, np.ndarray]:
    """Hashes of all runs of 4, 8, 16 and 32 characters, each made of two of half the length."""
    h, base, n, out = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1, {}
    while n < ANCHORS[-1]:
        h = h[: max(0, len(h) - n)] * np.uint64(base) + h[n:] if len(h) > n else h[:0]
        n, base = 2 * n, base * base % (1 << 64)
        if n in ANCHORS:
            out[n] = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out


def _grams(rows: DataFrame, text: str, keep: list[str], known: np.ndarray | None = None) -> DataFrame:
    """(deck_id, *keep, g, h): of each text its first piece of the longest anchor length, or, with a filter, all pieces that may be anchors of its deck."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, found = [], [], []
            for i, (t, deck) in enumerate(zip(batch.column(text).to_pylist(), batch.column("_d").to_numpy().view(np.uint64), strict=True)):
                hashes = _rolling(t)
                if known is None:
                    g = max((g for g in ANCHORS if g <= len(t)), default=0)
                    hashes = {g: hashes[g][:1]} if g else {}
                for g, h in hashes.items():
                    h = np.unique(h ^ deck)
                    if known is not None:
                        h = h[(known[(h >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0]
                    row.append(np.full(len(h), i))
                    size.append(np.full(len(h), g, np.int32))
                    found.append(h)
            if row:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("deck_id", *keep)), pa.array(np.concatenate(size)), pa.array(np.concatenate(found).view(np.int64))], ["deck_id", *keep, "g", "h"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("deck_id", *keep))
    return rows.select(*dict.fromkeys(["deck_id", *keep, text]), F.xxhash64("deck_id").alias("_d")).mapInArrow(run, f"{kinds}, g int, h long")


def titles_shown(body: DataFrame, outline: DataFrame) -> DataFrame:
    """(deck_id, slide_id, k), outline → (deck_id, slide_id, shown): how many of its deck's outline keys each page's k holds, if any.

    A key is found by its first 4, 8, 16 or 32 characters. A filter of fixed size, broadcast to all tasks, keeps
    those places of a page that may begin a key; these meet the keys by hash, and the texts themselves decide.
    """
    keys = written(_grams(outline.select("deck_id", "key", "rank"), "key", ["rank", "key"]), "anchors")
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(FILTER_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    known = np.zeros(FILTER_WORDS, np.uint64)
    for r in keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        known[r.w] = r.b % (1 << 64)
    maybe = _grams(body.select("deck_id", "slide_id", "k"), "k", ["slide_id"], known).hint("merge").join(keys, ["deck_id", "g", "h"]).select("deck_id", "slide_id", "rank", "key").distinct()
    shown = body.select("deck_id", "slide_id", "k").join(maybe, ["deck_id", "slide_id"]).where(F.contains("k", "key"))
    return shown.groupBy("deck_id", "slide_id").agg(F.count(F.lit(1)).alias("shown"))


def section_boundaries(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(deck_id, slide_id, reason): the first page of each deck, and those whose title matches an outline title.

    In decks without an outline, pages that only hold a title begin a section: pages may have a flag title_page.
    """
    first = pages.groupBy("deck_id").agg(F.min("slide_id").alias("slide_id"))
    titled = outline_matches(pages, outline).select("deck_id", "slide_id").distinct().withColumn("reason", F.lit("matched_outline_title"))
    if "title_page" in pages.columns:
        key = heading_key(F.coalesce("title", F.lit("")))
        alone = pages.where(F.col("title_page") & (key != "") & ~F.contains(key, F.lit("目录")) & (F.lower(key) != "contents")).join(outline.select("deck_id").distinct(), "deck_id", "left_anti")
        titled = titled.unionByName(alone.select("deck_id", "slide_id", F.lit("section_title_page").alias("reason")))
    return first.withColumn("reason", F.lit("first_page")).unionByName(titled.join(first, ["deck_id", "slide_id"], "left_anti"))


def agenda_followups(pages: DataFrame, outline: DataFrame, boundaries: DataFrame) -> DataFrame:
    """boundaries + the pages after those that show min(3, n) titles of an outline of two items or more (reason outline_followup).

    pages: title, text. Pages up to three after the first don't count.
    """
    first = pages.groupBy("deck_id").agg(F.min("slide_id").alias("low"))
    items = outline.groupBy("deck_id").agg(F.count(F.lit(1)).alias("items")).where("items >= 2")
    body = pages.select("deck_id", "slide_id", heading_key(F.concat_ws("\n", F.coalesce("title", F.lit("")), "text")).alias("k"))
    open_ = body.join(first, "deck_id").where(F.col("slide_id") > F.col("low") + 3)
    full = titles_shown(open_, outline).join(items, "deck_id").where(F.col("shown") >= F.least(F.lit(3), "items")).select("deck_id", "slide_id")
    follow = _DECK.lead(pages.select("deck_id", "slide_id"), F.col("slide_id"), "next").join(full, ["deck_id", "slide_id"], "left_semi").where("next is not null")
    new = follow.select("deck_id", F.col("next").alias("slide_id")).distinct().join(boundaries.select("deck_id", "slide_id"), ["deck_id", "slide_id"], "left_anti")
    return boundaries.unionByName(new.withColumn("reason", F.lit("outline_followup")))


def section_titles(pages: DataFrame, boundaries: DataFrame, outline: DataFrame) -> DataFrame:
    """(deck_id, slide_id, title) of boundaries: the first outline item that its title matches; items left over go to boundaries left over, in order.

    If the first item of a deck matches none, the first boundary takes it, whatever it matched itself.
    """
    at = boundaries.select("deck_id", "slide_id").distinct()
    own = outline_matches(pages.join(at, ["deck_id", "slide_id"], "left_semi"), outline).groupBy("deck_id", "slide_id").agg(F.min("rank").alias("rank"))
    low = at.groupBy("deck_id").agg(F.min("slide_id").alias("slide_id"))
    lead = low.join(outline.where("rank = 1").select("deck_id"), "deck_id").join(own.where("rank = 1").select("deck_id").distinct(), "deck_id", "left_anti").withColumn("rank", F.lit(1))
    taken = own.join(lead.select("deck_id", "slide_id"), ["deck_id", "slide_id"], "left_anti").unionByName(lead)
    used = own.select("deck_id", "rank").unionByName(lead.select("deck_id", "rank")).distinct()
    free_items = Segments(["deck_id"], ["rank"]).row_number(outline.join(used, ["deck_id", "rank"], "left_anti").select("deck_id", "rank"), "z")
    free_pages = _DECK.row_number(at.join(taken, ["deck_id", "slide_id"], "left_anti").select("deck_id", "slide_id"), "z")
    rest = free_pages.join(free_items, ["deck_id", "z"]).select("deck_id", "slide_id", "rank")
    return taken.select("deck_id", "slide_id", "rank").unionByName(rest).join(outline.select("deck_id", "rank", "title"), ["deck_id", "rank"]).select("deck_id", "slide_id", "title")


def fixed_boundaries(pages: DataFrame, boundaries: DataFrame, every: int = 8) -> DataFrame:
    """boundaries, and for decks with one at most every eighth page instead."""
    few = boundaries.groupBy("deck_id").count().where("count <= 1").select("deck_id")
    step = _DECK.row_number(pages.join(few, "deck_id", "left_semi").select("deck_id", "slide_id"), "r").where((F.col("r") - 1) % every == 0)
    reason = F.when(F.col("r") == 1, "first_page").otherwise("fixed_size_fallback")
    return boundaries.join(few, "deck_id", "left_anti").unionByName(step.select("deck_id", "slide_id", reason.alias("reason")))


def sections(pages: DataFrame, boundaries: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Sections between boundaries: section, start, end, slide_ids, title, reason.

    A title of ``titles`` (deck_id, slide_id, title) counts first, then that of the section's first page with one, then its number.
    """
    at = boundaries.select("deck_id", "slide_id", F.lit(1).alias("b"), F.col("reason").alias("_why") if "reason" in boundaries.columns else F.lit("local_boundary").alias("_why"))
    marked = pages.join(at, ["deck_id", "slide_id"], "left")
    if titles is None:
        marked = marked.withColumn("_given", F.lit(None).cast("string"))
    else:
        marked = marked.join(titles.select("deck_id", "slide_id", F.col("title").alias("_given")), ["deck_id", "slide_id"], "left")
    numbered = _DECK.running_sum(marked, F.col("b"), "section")
    title = F.when(F.trim("title") != "", F.col("title"))
    per = numbered.groupBy("deck_id", "section").agg(
        F.min("slide_id").alias("start"), F.max("slide_id").alias("end"), F.array_sort(F.collect_list("slide_id")).alias("slide_ids"), F.min_by("_given", "slide_id").alias("_given"), F.min_by("_why", "slide_id").alias("reason"),
        F.min_by(title, F.when(title.isNotNull(), F.col("slide_id"))).alias("_own"),
    )
    named = F.coalesce(F.nullif("_given", F.lit("")), "_own", F.concat(F.lit("第 "), F.col("section").cast("string"), F.lit(" 节")))
    return per.select("deck_id", "section", "start", "end", "slide_ids", named.alias("title"), F.coalesce("reason", F.lit("local_boundary")).alias("reason"))


def normalize_plan(given: DataFrame, pages: DataFrame, local: DataFrame) -> DataFrame:
    """Sections of a model's plan (deck_id, pos, start_slide_id, title, reason) where it names a known page, else the local ones.

    Starts that are no page of the deck are dropped, repeats count once (the first), and the deck's first page is
    put in front. Sections between starts hold all pages in order. Local rows have the columns of ``sections``.
    """
    known = pages.select("deck_id", F.col("slide_id").alias("start_slide_id")).distinct()
    valid = given.join(known, ["deck_id", "start_slide_id"], "left_semi").groupBy("deck_id", F.col("start_slide_id").alias("slide_id")).agg(F.min_by(F.struct("title", "reason"), "pos").alias("g"))
    valid = valid.select("deck_id", "slide_id", F.trim(F.coalesce("g.title", F.lit(""))).alias("title"), F.coalesce(F.nullif(F.trim("g.reason"), F.lit("")), F.lit("llm_boundary")).alias("reason"))
    first = pages.groupBy("deck_id").agg(F.min("slide_id").alias("slide_id")).join(valid.select("deck_id").distinct(), "deck_id", "left_semi")
    front = first.join(valid, ["deck_id", "slide_id"], "left_anti").select("deck_id", "slide_id", F.lit("").alias("title"), F.lit("first_page_inserted").alias("reason"))
    starts = valid.unionByName(front)
    own = sections(pages.join(starts.select("deck_id").distinct(), "deck_id", "left_semi"), starts, starts.select("deck_id", "slide_id", "title"))
    rest = local.join(starts.select("deck_id").distinct(), "deck_id", "left_anti")
    return own.withColumn("method", F.lit("llm")).unionByName(rest.select(*own.columns).withColumn("method", F.lit("local")))


def note_modes(pages: DataFrame, max_pages: int = 12, max_chars: int = 16_000) -> DataFrame:
    """Per deck: whole documents up to 12 pages and 16,000 characters are one context, larger ones go by section."""
    per = pages.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text").cast("bigint")).alias("chars"))
    return per.withColumn("mode", F.when((F.col("pages") <= max_pages) & (F.col("chars") <= max_chars), "document").otherwise("section"))


def note_contexts(pages: DataFrame, found: DataFrame, requested: str = "auto") -> DataFrame:
    """(deck_id, context, kind, title, slide_ids): what is written in one go: a whole document, a section or a page."""
    mode = note_modes(pages).select("deck_id", "mode") if requested == "auto" else pages.select("deck_id").distinct().withColumn("mode", F.lit(requested))
    p = pages.join(mode, "deck_id")
    doc = p.where("mode = 'document'").groupBy("deck_id").agg(F.array_sort(F.collect_list("slide_id")).alias("slide_ids")).select("deck_id", F.lit("doc").alias("context"), F.lit("document").alias("kind"), F.lit("").alias("title"), "slide_ids")
    page_title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("第 "), F.col("slide_id").cast("string"), F.lit(" 页")))
    page = p.where("mode = 'page'").select("deck_id", F.concat(F.lit("p"), F.col("slide_id").cast("string")).alias("context"), F.lit("page").alias("kind"), page_title.alias("title"), F.array("slide_id").alias("slide_ids"))
    part = found.join(mode.where("mode = 'section'"), "deck_id", "left_semi").select("deck_id", F.concat(F.lit("sec"), F.col("section").cast("string")).alias("context"), F.lit("section").alias("kind"), "title", "slide_ids")
    return doc.unionByName(page).unionByName(part)


def normalize_roles(given: DataFrame, pages: DataFrame) -> DataFrame:
    """A brief's page roles (deck_id, pos, slide_id, page, page_id as texts, role) → deck_id, slide_id, pos, role: the first of each page of its deck.

    The page is the first of slide_id, page and page_id with something in it; what is no number, or no page, is dropped.
    """
    named = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("slide_id", "page", "page_id")]).try_cast("int")
    own = given.withColumn("_s", named).where("_s is not null").groupBy("deck_id", F.col("_s").alias("slide_id")).agg(F.min(F.struct("pos", "role")).alias("r"))
    return own.join(pages.select("deck_id", "slide_id").distinct(), ["deck_id", "slide_id"], "left_semi").select("deck_id", "slide_id", "r.pos", "r.role")


def brief_for_scope(brief: DataFrame, scope: DataFrame, cap: int = 80) -> DataFrame:
    """Items (deck_id, kind, pos, slide_ids, …) of a deck's brief for each context of scope (deck_id, context, slide_ids).

    An item belongs to a context that shares a page with it, or to all of its deck's if it names no page; of each
    kind the first ``cap`` count. Items with pages join on deck and page, so only those without go to every context.
    """
    free = brief.where(F.size(F.coalesce("slide_ids", F.array().cast("array<int>"))) == 0).join(scope.select("deck_id", "context"), "deck_id")
    at = scope.select("deck_id", "context", F.explode("slide_ids").alias("_s"))
    held = brief.withColumn("_s", F.explode("slide_ids")).join(at, ["deck_id", "_s"]).drop("_s").dropDuplicates(["deck_id", "context", "kind", "pos"])
    rank = F.row_number().over(Window.partitionBy("deck_id", "context", "kind").orderBy("pos"))
    return held.unionByName(free).withColumn("rank", rank).where(F.col("rank") <= cap)


def page_payload(pages: DataFrame, elements: DataFrame, items: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """(deck_id, slide_id, payload): each page's title, elements in order, guard items and layout as one JSON text.

    elements: element_id, kind, preview, layout_order. items: element_id, learning_role, must_explain, confidence.
    """
    key = ["deck_id", "slide_id"]
    e = elements.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("layout_order", F.lit(9999.0)).alias("o"), "element_id", "kind", "preview"))), lambda x: F.struct(x["element_id"].alias("id"), x["kind"].alias("kind"), x["preview"].alias("preview"))).alias("elements"))
    g = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("element_id", "learning_role", "must_explain", "confidence"))).alias("required_items"))
    joined = pages.select(*key, "title").join(e, key, "left").join(g, key, "left")
    fields = ["slide_id", "title", "elements", "required_items"]
    if layout is not None:
        joined = joined.join(layout.select(*key, F.col("payload").alias("semantic_layout")), key, "left")
        fields.append("semantic_layout")
    return joined.select(*key, F.to_json(F.struct(*fields)).alias("payload"))


def generation_requests(contexts: DataFrame, payloads: DataFrame, strategy: str = "direct", enrichment: bool = False) -> DataFrame:
    """Requests for texts: deck_id, stage, context, slides, payload_chars, request_key.

    direct: one per context. weave: one per page, then one per context, then one per context for enrichment if
    wanted. The key is a digest of the stage and the payloads of its pages in order.
    """
    each = contexts.select("deck_id", "context", F.posexplode("slide_ids").alias("n", "slide_id")).join(payloads, ["deck_id", "slide_id"])
    per = each.groupBy("deck_id", "context").agg(F.array_sort(F.collect_list(F.struct("n", "slide_id", F.sha2("payload", 256).alias("h")))).alias("p"), F.sum(F.length("payload").cast("bigint")).alias("payload_chars"))

    def rows(df: DataFrame, stage: str) -> DataFrame:
        return df.select("deck_id", F.lit(stage).alias("stage"), "context", F.col("p.slide_id").alias("slides"), "payload_chars", F.sha2(F.concat_ws("\n", F.lit(stage), F.col("p.h")), 256).alias("request_key"))

    if strategy == "direct":
        return rows(per, "direct")
    one = payloads.select("deck_id", F.concat(F.lit("p"), F.col("slide_id").cast("string")).alias("context"), F.array(F.struct(F.lit(0).alias("n"), "slide_id", F.sha2("payload", 256).alias("h"))).alias("p"), F.length("payload").cast("bigint").alias("payload_chars"))
    out = rows(one, "page").unionByName(rows(per, "section"))
    return out.unionByName(rows(per, "enrichment")) if enrichment else out


def step_count(requests: DataFrame) -> DataFrame:
    """Per deck: how many requests of each stage and in all."""
    return requests.groupBy("deck_id").agg(F.count(F.lit(1)).alias("steps"), *[F.count_if(F.col("stage") == x).alias(x) for x in ("direct", "page", "section", "enrichment")])


def neighbors(pages: DataFrame, radius: int = 1) -> DataFrame:
    """Per page the pages up to ``radius`` before and after it."""
    near = pages.select("deck_id", "slide_id")
    before, after = ["slide_id"], ["slide_id"]
    for i in range(radius):
        near = _DECK.lead(_DECK.lag(near, F.col(before[-1]), f"_b{i}"), F.col(after[-1]), f"_a{i}")
        before.append(f"_b{i}")
        after.append(f"_a{i}")
    return near.select("deck_id", "slide_id", F.array_compact(F.array(*before[:0:-1], *after[1:])).alias("neighbors"))


def leading_frontmatter(pages: DataFrame) -> DataFrame:
    """(deck_id, slide_id, is_front) → the longest run of front-matter pages from the first page on."""
    body = pages.where(~F.coalesce("is_front", F.lit(False))).groupBy("deck_id").agg(F.min("slide_id").alias("_body"))
    return pages.join(body, "deck_id", "left").where(F.col("_body").isNull() | (F.col("slide_id") < F.col("_body"))).select("deck_id", "slide_id")


def section_by_slide(found: DataFrame) -> DataFrame:
    """(deck_id, slide_id) → its section, the last one that lists it."""
    return found.select("deck_id", "section", "title", F.explode("slide_ids").alias("slide_id")).groupBy("deck_id", "slide_id").agg(F.max("section").alias("section"), F.max_by("title", "section").alias("title"))
