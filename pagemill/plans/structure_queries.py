"""Sources, sections, guard and streaming jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segments import Segments
from ..functions.text import is_structural_page, preview
from ..operators import coverage, digests, guard, images, sections
from ..shared import shared_path, written
from ..sources import decks
from ..streaming import jobs
from . import bindings as b
from .layout_queries import guard_sql


_GROUP = "floor(doc_id / 200)"


def _listed(s: SparkSession, d: str) -> DataFrame:
    """Pages of whole sources as decks. The first of each 200 documents' pages lists contents, a later one shows them again.

    Contents are the titles of those pages whose language is not that of the page before, some with a number on a line before.
    """
    p = b.source_pages(s, d)
    marked = Segments(["deck_id"], ["slide_id"]).lag(p.select("deck_id", "slide_id", "doc_id", "title", "lang"), F.col("lang"), "last").where("not lang <=> last")
    line = F.concat(F.when(F.col("doc_id") % 10 == 3, F.concat("slide_id", F.lit(".\n"))).otherwise(""), "title")
    entries = F.array_sort(F.collect_list(F.struct("doc_id", line.alias("t"), "title")))
    listed = marked.groupBy("deck_id", F.expr(_GROUP).alias("part")).agg(F.array_join(F.transform(entries, lambda x: x["t"]), "\n").alias("toc"), F.array_join(F.transform(entries, lambda x: x["title"]), "\n").alias("again"))
    low = p.groupBy("deck_id", F.expr(_GROUP).alias("part")).agg(F.min("slide_id").alias("low")).join(listed, ["deck_id", "part"], "left")
    plain, no = F.replace("text", F.lit("Contents"), F.lit("")), F.lit("")
    text = F.when(F.col("slide_id") == F.col("low"), F.concat(F.lit("Contents\n"), F.coalesce("toc", no))).when(F.expr("floor(doc_id / 20) % 10 = 5"), F.concat(plain, F.lit("\n"), F.coalesce("again", no))).otherwise(plain)
    return p.withColumn("part", F.expr(_GROUP)).join(low, ["deck_id", "part"]).select("deck_id", "slide_id", "doc_id", "title", text.alias("text"), (F.length("text") < 200).alias("title_page"))


def _outline(s: SparkSession, d: str) -> DataFrame:
    return sections.outline_items(_listed(s, d))


class _Deck:
    """Listed pages, outline and boundaries, each derived once and written."""

    def __init__(self, s: SparkSession, d: str):
        self.pages = written(_listed(s, d), "listed")
        self.outline = written(sections.outline_items(self.pages), "outline")
        self.bounds = written(sections.section_boundaries(self.pages, self.outline), "bounds")

    def followups(self) -> DataFrame:
        return sections.agenda_followups(self.pages, self.outline, self.bounds)

    def fixed(self) -> DataFrame:
        return sections.fixed_boundaries(self.pages, self.bounds)

    def titles(self, fixed: DataFrame) -> DataFrame:
        return sections.section_titles(self.pages, fixed, self.outline)

    def sections(self) -> DataFrame:
        fixed = written(self.fixed(), "fixed")
        return written(sections.sections(self.pages, fixed, written(self.titles(fixed), "titles")), "sections")

    def contexts(self) -> DataFrame:
        return sections.note_contexts(self.pages, self.sections())


def _guard(s: SparkSession, d: str) -> DataFrame:
    return guard.guard_text(b.blocks(s, d))


def _guard_pages(s: SparkSession, d: str) -> DataFrame:
    text = F.concat("title", F.lit("\n"), "text")
    return b.pages(s, d).withColumn("structural", is_structural_page(F.col("title"), text, F.col("slide_id") - 1, True))


def _payloads(s: SparkSession, d: str) -> DataFrame:
    e = b.source_blocks(s, d).select("deck_id", "slide_id", "element_id", F.lit("text").alias("kind"), preview(F.col("content")).alias("preview"), F.col("n").cast("double").alias("layout_order"))
    return sections.page_payload(b.source_pages(s, d), e, guard.guard_text(b.source_blocks(s, d)))


def _requests(s: SparkSession, d: str) -> DataFrame:
    return sections.generation_requests(_Deck(s, d).contexts(), _payloads(s, d), "weave", True)


def _labels(s: SparkSession, d: str) -> DataFrame:
    """A model's labels: of every third item, and of ids that don't exist."""
    g = _guard(s, d).where(F.length("element_id") % 3 == 0)
    known = g.select("deck_id", "element_id", F.lit("concept").alias("role"), (F.length("preview") % 2 == 0).alias("must"), F.lit(0.9).alias("conf"), F.lit(1).alias("pos"))
    return known.unionByName(known.select("deck_id", F.concat("element_id", F.lit("x")).alias("element_id"), "role", "must", "conf", "pos"))


def _html_json(s: SparkSession, d: str) -> DataFrame:
    """Pages as a foreign parser gives them: every seventh document broken."""
    p = b.table(s, d, "pages")
    para = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda x: F.struct(F.lit("paragraph").alias("type"), x.alias("text")))
    whole = F.to_json(F.struct(F.lit("page").alias("kind"), F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("content"), para.alias("children")))
    return p.select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("json"))


def _planned(s: SparkSession, d: str) -> DataFrame:
    """A model's plan for sources whose name ends in an even digit: some pages, each named twice, and numbers that are no page; the others keep their own sections."""
    k = _Deck(s, d)
    own = k.sections()
    chosen = k.pages.where("deck_id rlike '[02468]$' and floor(doc_id / 20) % 7 = 3").select("deck_id", F.col("slide_id").cast("int").alias("start_slide_id"), "title")
    twice = chosen.select("deck_id", F.col("start_slide_id").alias("pos"), "start_slide_id", "title", F.lit("").alias("reason")).unionByName(chosen.select("deck_id", (F.col("start_slide_id") + 1_000_000_000).alias("pos"), "start_slide_id", F.lit("later").alias("title"), F.lit("x").alias("reason")))
    wrong = chosen.select("deck_id", F.lit(0).alias("pos"), (-F.col("start_slide_id")).alias("start_slide_id"), F.lit("no page").alias("title"), F.lit("y").alias("reason"))
    return sections.normalize_plan(twice.unionByName(wrong), k.pages, own)


def _roles(s: SparkSession, d: str) -> DataFrame:
    """A brief's roles of all pages: their number in one of three fields, no number for one in five, and each page twice."""
    p = b.source_pages(s, d)
    number = F.when(F.col("doc_id") % 5 == 1, "x").otherwise(F.col("slide_id").cast("string"))
    fields = [F.when(F.col("doc_id") % 3 == i, number).otherwise("").alias(c) for i, c in enumerate(("slide_id", "page", "page_id"))]
    role = F.when(F.col("doc_id") % 2 == 0, "example").otherwise("concept")
    first = p.select("deck_id", F.col("slide_id").alias("pos"), *fields, role.alias("role"))
    return sections.normalize_roles(first.unionByName(first.withColumns({"pos": F.col("pos") + 1_000_000_000, "role": F.lit("later")})), p)


def _scoped(s: SparkSession, d: str) -> DataFrame:
    """How many roles, and questions of the whole deck, each context gets of its deck's brief."""
    roles = _roles(s, d).select("deck_id", F.lit("role").alias("kind"), "pos", F.array("slide_id").alias("slide_ids"))
    free = b.source_pages(s, d).select("deck_id").distinct().select("deck_id", F.lit("question").alias("kind"), F.lit(1).alias("pos"), F.array().cast("array<int>").alias("slide_ids"))
    found = sections.brief_for_scope(roles.unionByName(free), written(_Deck(s, d).contexts(), "contexts").select("deck_id", "context", "slide_ids"))
    return found.groupBy("deck_id", "context", "kind").agg(F.count(F.lit(1)).alias("n"))


def _foreign(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Web pages as another parser gives them: a page of nested blocks, and one with the links as a table and a picture, below document."""
    p = b.table(s, d, "pages")
    para = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda x: F.struct(F.lit("Paragraph").alias("type"), F.struct(x.alias("text")).alias("inner")))
    cells = F.transform(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1)), lambda x: F.array(x, F.concat(F.lit("to "), x)))
    title, empty = F.regexp_extract("html", r"<title>(.*?)</title>", 1), F.lit(None)
    block = lambda kind, text, rows, src: F.struct(F.lit(kind).alias("label"), text.cast("string").alias("text"), rows.cast("array<array<string>>").alias("cells"), src.cast("string").alias("src"))
    pages = F.to_json(F.array(
        F.to_json(F.struct(F.lit(3).alias("page"), title.alias("title"), para.alias("blocks"))),
        F.to_json(F.struct(title.alias("text"), F.array(block("list", title, empty, empty), block("grid", empty, cells, empty), block("picture", title, empty, F.concat(F.lit("img/"), "page_id", F.lit(".png")))).alias("children"))),
    ))
    whole = F.concat(F.lit('{"document":{"pages":['), F.array_join(F.from_json(pages, "array<string>"), ","), F.lit("]}}"))
    return decks.foreign_tables(p.select(F.col("page_id").alias("deck_id"), whole.alias("json")))


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.readStream.schema(b.table(s, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _finished(s: SparkSession, frame: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream to its end; the last state of its table."""
    out = shared_path(s, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/table")

    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{out}/table")


def z1_stream_progress(s: SparkSession, d: str) -> DataFrame:
    kinds = {"view": "api_call", "click": "cache_hit", "error": "skipped"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("other"))
    events = _stream(s, d, "events").select((F.col("user_id") % 50).alias("run_id"), F.concat(F.lit("stage"), F.col("event_id") % 4).alias("stage"), kind.alias("event_type"))
    return _finished(s, jobs.stream_progress(events), "complete", "progress")


def z2_stream_misses(s: SparkSession, d: str) -> DataFrame:
    """The first request of each key within the watermark, of keys that the cache lacks."""
    requests = _stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 500).cast("string").alias("cache_key"))
    known = b.table(s, d, "customer").select((F.col("c_custkey") % 50 * 9).cast("string").alias("cache_key"))
    return _finished(s, jobs.stream_misses(requests, known, within="60 days"), "append", "misses").select("cache_key")


def z3_stream_pages(s: SparkSession, d: str) -> DataFrame:
    """Documents whose text isn't stored yet, after a run that stored those with an even id."""
    out = shared_path(s, "pages")
    pages = b.pages(s, d).select("deck_id", "slide_id", "doc_id", "text")
    pages.where("doc_id % 2 = 0").withColumn("digest", jobs.page_digest("text")).select("deck_id", "slide_id", "digest").write.parquet(f"{out}/stored")
    stream = _stream(s, d, "documents").select(
        F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 500).cast("string")).alias("deck_id"), (F.col("doc_id") % 500 + 1).cast("int").alias("slide_id"), F.coalesce("text", F.lit("")).alias("text")
    )

    def step(batch: DataFrame, n: int) -> None:
        jobs.changed_pages(batch, s.read.parquet(f"{out}/stored"), "text").select("deck_id", "slide_id").write.mode("append").parquet(f"{out}/changed")

    jobs.start_pages(stream, step, f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/changed")


def _digests(s: SparkSession, d: str) -> DataFrame:
    return b.source_pages(s, d).select("deck_id", "slide_id", F.sha2(F.concat("title", F.lit("\n"), "text"), 256).alias("digest"))


def z3_deck_digests(s: SparkSession, d: str) -> DataFrame:
    """Digests of decks after a stream of documents, of which every third changed since the tree was stored: only nodes above those are made anew."""
    out = shared_path(s, "digests")
    old = F.when(F.col("slide_id") % 3 == 0, F.sha2("digest", 256)).otherwise(F.col("digest"))
    before = written(_digests(s, d).withColumn("digest", old), "stored-pages")
    tree = written(digests.digest_tree(before), "stored-tree")
    p = _stream(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("deck_id"), (F.col("doc_id") + 1).cast("int").alias("slide_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    title = F.when(F.col("doc_id") % 50 == 7, "Contents").otherwise(F.substring(F.trim(F.split("text", "\n")[0]), 1, 140))
    stream = p.select("deck_id", "slide_id", F.sha2(F.concat(title, F.lit("\n"), "text"), 256).alias("digest"))

    def step(batch: DataFrame, n: int) -> None:
        batch.join(before, ["deck_id", "slide_id", "digest"], "left_anti").select("deck_id", "slide_id", "digest").write.mode("append").parquet(f"{out}/changed")

    jobs.start_pages(stream, step, f"{out}/state").awaitTermination()
    changed = s.read.schema("deck_id string, slide_id int, digest string").parquet(f"{out}/changed")
    return digests.deck_digests(digests.refresh_tree(tree, written(jobs.upsert_pages(before, changed), "pages-now"), changed))


QUERIES = {
    "a2_pages": lambda s, d: _foreign(s, d)["pages"].select("deck_id", "slide_id", "page_index", "title"),
    "a2_text_blocks": lambda s, d: _foreign(s, d)["text_blocks"].select("deck_id", "slide_id", "pos", "element_id", "type", F.md5("content").alias("content_md5")),
    "a2_tables": lambda s, d: _foreign(s, d)["tables"].select("deck_id", "slide_id", "element_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells")),
    "a2_images": lambda s, d: _foreign(s, d)["images"].select("deck_id", "slide_id", "element_id", "path", "caption", "role", "ignored"),
    "b15_deck_digests": lambda s, d: digests.deck_digests(digests.digest_tree(_digests(s, d))),
    "z3_deck_digests": z3_deck_digests,
    "a2_nodes": lambda s, d: decks.nodes(_html_json(s, d)).select("doc_id", "ord", "depth", "kind", F.length("text").cast("long").alias("n_chars")),
    "a4_markdown_pages": lambda s, d: decks.markdown_pages(b.table(s, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\f").alias("text"))).select("doc_id", "slide_id", F.md5("content").alias("content_md5")),
    "a5_generic_text": lambda s, d: decks.generic_text(_html_json(s, d)).select("doc_id", F.length("text").cast("long").alias("n_chars")),
    "a6_classify_block": lambda s, d: b.blocks(s, d).select("deck_id", "element_id", decks.classify_block(F.col("content"), F.lit("pdf")).alias("type")),
    "a7_page_titles": lambda s, d: decks.page_titles(b.blocks(s, d).select("deck_id", "slide_id", F.col("n").alias("pos"), decks.classify_block(F.col("content"), F.lit("pdf")).alias("type"), "content")),
    "a14_slide_ranges": lambda s, d: b.pages(s, d).groupBy("deck_id").agg(F.min("slide_id").alias("a"), F.max("slide_id").alias("z")).select("deck_id", F.size(decks.slide_ranges(F.concat(F.col("a").cast("string"), F.lit(","), F.col("a").cast("string"), F.lit("-"), F.col("z").cast("string")))).alias("n")),
    "s1_outline_items": lambda s, d: _outline(s, d).select("deck_id", "rank", "title", "number", "slide_id"),
    "s2_section_boundaries": lambda s, d: _Deck(s, d).bounds,
    "s3_agenda_followups": lambda s, d: _Deck(s, d).followups(),
    "s4_fixed_boundaries": lambda s, d: _Deck(s, d).fixed(),
    "s5_section_titles": lambda s, d: (k := _Deck(s, d)).titles(written(k.fixed(), "fixed")),
    "s6_sections": lambda s, d: _Deck(s, d).sections().select("deck_id", "section", "start", "end", F.size("slide_ids").alias("n_pages"), "title", "reason"),
    "s7_normalize_plan": lambda s, d: _planned(s, d).select("deck_id", "section", "start", "end", F.size("slide_ids").alias("n_pages"), "title", "reason", "method"),
    "s8_note_contexts": lambda s, d: _Deck(s, d).contexts().select("deck_id", "context", "kind", F.size("slide_ids").alias("n_pages")),
    "s12_page_roles": lambda s, d: _roles(s, d).select("deck_id", "slide_id", "role"),
    "s12_brief_for_scope": _scoped,
    "s13_page_payload": lambda s, d: _payloads(s, d),
    "s14_generation_requests": lambda s, d: _requests(s, d).select("deck_id", "stage", "context", F.size("slides").alias("n_pages")),
    "s14_step_count": lambda s, d: sections.step_count(_requests(s, d)),
    "s8_note_modes": lambda s, d: sections.note_modes(b.source_pages(s, d)),
    "s9_section_by_slide": lambda s, d: sections.section_by_slide(_Deck(s, d).sections()).select("deck_id", "slide_id", "section"),
    "s10_neighbors": lambda s, d: sections.neighbors(b.source_pages(s, d), 2).select("deck_id", "slide_id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("near")),
    "s11_frontmatter": lambda s, d: sections.leading_frontmatter(b.source_pages(s, d).select("deck_id", "slide_id", (F.length("text") < 4000).alias("is_front"))),
    "k1_guard_text": lambda s, d: _guard(s, d).drop("reason").withColumn("preview", F.md5("preview")),
    "k2_guard_images": lambda s, d: guard.guard_images(images.mark_templates(b.images(s, d))).drop("reason"),
    "k2_guard_tables": lambda s, d: guard.guard_tables(b.table(s, d, "part").select((F.col("p_partkey") % 40).alias("deck_id"), F.col("p_size").alias("slide_id"), F.concat(F.lit("s"), "p_size", F.lit("_tbl"), "p_partkey").alias("element_id"), F.when(F.col("p_partkey") % 7 != 0, F.concat("p_name", F.lit(" | "), "p_brand")).alias("text"))).drop("reason"),
    "k3_guard_pages": lambda s, d: guard.guard_pages(_guard_pages(s, d), _guard(s, d), 0.7),
    "k4_merge_labels": lambda s, d: guard.merge_labels(_guard(s, d), _labels(s, d)).select("deck_id", "element_id", "learning_role", "must_explain", "confidence"),
    "k7_repair_diff": lambda s, d: guard.repair_diff(_guard(s, d).where("must_explain"), _guard(s, d).where("must_explain and length(element_id) % 2 = 0")),
    "k5_guard_summary": lambda s, d: guard.guard_summary(_guard(s, d)),
    "k6_missing_required": lambda s, d: guard.missing_required(_guard(s, d), coverage.coverage_items(b.elements(s, d), b.notes(s, d))).select("deck_id", "element_id", "learning_role", "coverage"),
    "z1_stream_progress": z1_stream_progress,
    "z2_stream_misses": z2_stream_misses,
    "z3_stream_pages": z3_stream_pages,
}

_GUARD = guard_sql()
_HK = r"trim(regexp_replace(regexp_replace(trim({}), '^(?:\d+|[一二三四五六七八九十]+)[.、\s-]+', ''), '\s+', '', 'g'), '：:')"
_SECTIONS = "WITH " + b.SOURCE_PAGES_SQL + rf""",
said AS (SELECT *, lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY deck_id ORDER BY slide_id) AS changed FROM spages),
toc AS (SELECT deck_id, doc_id // 200 AS part, min(slide_id) AS low, coalesce(string_agg(CASE WHEN doc_id % 10 = 3 THEN slide_id || '.' || chr(10) ELSE '' END || title, chr(10) ORDER BY doc_id) FILTER (changed), '') AS toc, coalesce(string_agg(title, chr(10) ORDER BY doc_id) FILTER (changed), '') AS again FROM said GROUP BY ALL),
listed AS (SELECT p.deck_id, slide_id, doc_id, title, CASE WHEN slide_id = low THEN 'Contents' || chr(10) || toc WHEN doc_id // 20 % 10 = 5 THEN replace(text, 'Contents', '') || chr(10) || again ELSE replace(text, 'Contents', '') END AS text, length(text) < 200 AS title_page
  FROM spages p JOIN toc ON toc.deck_id = p.deck_id AND part = doc_id // 200),
olines AS (SELECT deck_id, slide_id, n, trim(x) AS line FROM (SELECT deck_id, slide_id, unnest(string_split(text, chr(10))) AS x, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS n FROM listed WHERE contains(text, 'Contents') OR contains(text, '目录')) WHERE trim(x) <> ''),
okeys AS (SELECT *, {_HK.format('line')} AS key, regexp_matches(line, '^[（(]?\s*(?:\d+|[一二三四五六七八九十]+)\s*[)）.、]?$') AS num FROM olines),
okept AS (SELECT *, CASE WHEN NOT num AND length(key) >= 4 THEN row_number() OVER (PARTITION BY deck_id, key, num ORDER BY slide_id, n) = 1 ELSE false END AS item FROM okeys WHERE key <> '' AND lower(key) NOT IN ('目录', 'contents')),
onum AS (SELECT *, max(CASE WHEN item THEN n END) OVER w AS li, arg_max(line, n) FILTER (num) OVER w AS ln, max(CASE WHEN num THEN n END) OVER w AS lno FROM okept WINDOW w AS (PARTITION BY deck_id, slide_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
outline AS (
  SELECT deck_id, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY slide_id, n) AS INTEGER) AS rank, trim(regexp_replace(line, '^\s*[（(]?\s*(?:\d+|[一二三四五六七八九十]+)\s*(?:[)）.、]|\s+)\s*', '')) AS title, key, CASE WHEN lno > coalesce(li, -1) THEN ln END AS number, slide_id FROM onum WHERE item),
tk AS (SELECT deck_id, slide_id, {_HK.format('title')} AS k FROM listed),
om AS (SELECT t.deck_id, t.slide_id, o.rank FROM tk t JOIN outline o ON o.deck_id = t.deck_id AND k <> '' AND NOT contains(k, '目录') AND lower(k) <> 'contents'
       AND (k = o.key OR ((contains(k, o.key) OR contains(o.key, k)) AND least(length(k), length(o.key)) >= 0.72 * greatest(length(k), length(o.key))))),
firsts AS (SELECT deck_id, min(slide_id) AS slide_id FROM listed GROUP BY deck_id),
bounds AS (
  SELECT deck_id, slide_id, 'first_page' AS reason FROM firsts UNION ALL
  SELECT DISTINCT deck_id, slide_id, 'matched_outline_title' FROM om ANTI JOIN firsts USING (deck_id, slide_id) UNION ALL
  SELECT l.deck_id, l.slide_id, 'section_title_page' FROM listed l JOIN tk USING (deck_id, slide_id) ANTI JOIN firsts f ON f.deck_id = l.deck_id AND f.slide_id = l.slide_id WHERE title_page AND k <> '' AND NOT contains(k, '目录') AND lower(k) <> 'contents' AND l.deck_id NOT IN (SELECT deck_id FROM outline)),
few AS (SELECT deck_id FROM bounds GROUP BY deck_id HAVING count(*) <= 1),
fixed AS (
  SELECT * FROM bounds WHERE deck_id NOT IN (SELECT deck_id FROM few) UNION ALL
  SELECT deck_id, slide_id, CASE WHEN r = 1 THEN 'first_page' ELSE 'fixed_size_fallback' END FROM (SELECT deck_id, slide_id, row_number() OVER (PARTITION BY deck_id ORDER BY slide_id) AS r FROM listed WHERE deck_id IN (SELECT deck_id FROM few)) WHERE (r - 1) % 8 = 0),
own AS (SELECT deck_id, slide_id, min(rank) AS rank FROM om SEMI JOIN fixed USING (deck_id, slide_id) GROUP BY ALL),
ld AS (SELECT f.deck_id, min(f.slide_id) AS slide_id FROM fixed f WHERE deck_id IN (SELECT deck_id FROM outline) AND deck_id NOT IN (SELECT deck_id FROM own WHERE rank = 1) GROUP BY 1),
taken AS (SELECT * FROM own ANTI JOIN ld USING (deck_id, slide_id) UNION ALL SELECT deck_id, slide_id, 1 FROM ld),
used AS (SELECT deck_id, rank FROM own UNION SELECT deck_id, 1 FROM ld),
fi AS (SELECT deck_id, rank, row_number() OVER (PARTITION BY deck_id ORDER BY rank) AS z FROM outline ANTI JOIN used USING (deck_id, rank)),
fp AS (SELECT deck_id, slide_id, row_number() OVER (PARTITION BY deck_id ORDER BY slide_id) AS z FROM fixed ANTI JOIN taken USING (deck_id, slide_id)),
titles AS (SELECT t.deck_id, t.slide_id, o.title FROM (SELECT * FROM taken UNION ALL SELECT fp.deck_id, fp.slide_id, fi.rank FROM fp JOIN fi USING (deck_id, z)) t JOIN outline o USING (deck_id, rank)),
numbered AS (SELECT l.*, f.reason, t.title AS given, sum(CASE WHEN f.slide_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.deck_id ORDER BY l.slide_id) AS section FROM listed l LEFT JOIN fixed f USING (deck_id, slide_id) LEFT JOIN titles t USING (deck_id, slide_id)),
secs AS (
  SELECT deck_id, section::BIGINT AS section, min(slide_id) AS start, max(slide_id) AS end_, CAST(count(*) AS INTEGER) AS n_pages, coalesce(nullif(arg_min(given, slide_id) FILTER (given IS NOT NULL), ''), arg_min(title, slide_id) FILTER (trim(title, ' ') <> ''), '第 ' || section || ' 节') AS title, arg_min(reason, slide_id) FILTER (reason IS NOT NULL) AS reason FROM numbered GROUP BY deck_id, section),
modes AS (SELECT deck_id, count(*) AS n, CASE WHEN count(*) <= 12 AND sum(length(text)) <= 16000 THEN 'document' ELSE 'section' END AS mode FROM listed GROUP BY deck_id),
contexts AS (SELECT deck_id, 'doc' AS context, 'document' AS kind, CAST(n AS INTEGER) AS n_pages FROM modes WHERE mode = 'document' UNION ALL SELECT deck_id, 'sec' || section, 'section', n_pages FROM secs JOIN modes USING (deck_id) WHERE mode = 'section')"""
_P = "WITH " + b.PAGES_SQL
_S = "WITH " + b.SOURCE_PAGES_SQL
_TREE = _S + """, l0 AS (SELECT deck_id, slide_id AS node, sha256(title || chr(10) || text) AS digest FROM spages),
l1 AS (SELECT deck_id, node // 1024 AS node, sha256(string_agg(digest, chr(10) ORDER BY l0.node)) AS digest FROM l0 GROUP BY deck_id, l0.node // 1024),
l2 AS (SELECT deck_id, node // 1024 AS node, sha256(string_agg(digest, chr(10) ORDER BY l1.node)) AS digest FROM l1 GROUP BY deck_id, l1.node // 1024)
SELECT deck_id, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l2 GROUP BY deck_id"""
_HTML = r"""WITH h AS (SELECT page_id AS deck_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS p, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a FROM pages),
t AS (SELECT deck_id, pos, x FROM (SELECT deck_id, unnest(generate_series(1, len(p))) AS pos, unnest(list_transform(p, lambda y: trim(regexp_replace(regexp_replace(y, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '))) AS x FROM h) WHERE x <> ''),
c AS (SELECT deck_id, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS x FROM h)"""
SQL = {
    "a2_pages": _HTML + """, k AS (SELECT deck_id, coalesce(arg_min(x, pos) FILTER (length(x) <= 120), arg_min(x, pos)) AS x FROM t GROUP BY deck_id), e AS (SELECT deck_id, 3 AS slide_id, 0 AS page_index, k.x, title FROM h LEFT JOIN k USING (deck_id) UNION ALL SELECT deck_id, 2, 1, nullif(x, ''), NULL FROM c)
        SELECT deck_id, slide_id, page_index, coalesce(CASE WHEN length(x) > 140 THEN x[1:139] || '…' ELSE x END, nullif(trim(title, ' '), '')) AS title FROM e""",
    "a2_text_blocks": _HTML + """ SELECT deck_id, 3 AS slide_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, 's3_t' || row_number() OVER w AS element_id, CASE WHEN length(x) <= 120 THEN 'heading' ELSE 'paragraph' END AS type, md5(x) AS content_md5 FROM t WINDOW w AS (PARTITION BY deck_id ORDER BY pos)
        UNION ALL SELECT deck_id, 2, i, 's2_t' || (i + 1), CASE WHEN length(x) <= 120 THEN 'heading' ELSE 'paragraph' END, md5(x) FROM c, (VALUES (0), (1)) AS v(i) WHERE x <> ''""",
    "a2_tables": _HTML + " SELECT deck_id, 2 AS slide_id, 's2_tbl1' AS element_id, array_to_string(list_transform(a, lambda x: trim(x, ' ') || '|to ' || rtrim(x, ' ')), ';') AS cells FROM h WHERE len(a) > 0",
    "a2_images": _HTML + " SELECT deck_id, 2 AS slide_id, 's2_img1' AS element_id, 'img/' || deck_id || '.png' AS path, nullif(trim(title, ' '), '') AS caption, 'content' AS role, false AS ignored FROM h",
    "b15_deck_digests": _TREE,
    "z3_deck_digests": _TREE,
    "a4_markdown_pages": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(13)) AS c FROM l) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS slide_id, md5(c) AS content_md5 FROM k WHERE c <> ''""",
    "a6_classify_block": "WITH " + b.BLOCKS_SQL + r" SELECT deck_id, element_id, CASE WHEN regexp_matches(content, '^[•●○▪■◦·\-–*]') THEN 'bullet' WHEN length(content) <= 120 THEN 'heading' ELSE 'paragraph' END AS type FROM blocks",
    "a7_page_titles": "WITH " + b.BLOCKS_SQL + r""", t AS (SELECT *, NOT (length(content) <= 120 AND NOT regexp_matches(content, '^[•●○▪■◦·\-–*]')) AS o FROM blocks)
        SELECT deck_id, slide_id, arg_min(content, (o::INTEGER * 1000000 + n))[1:140] AS title FROM t GROUP BY ALL""",
    "a14_slide_ranges": _P + " SELECT deck_id, CAST(max(slide_id) - min(slide_id) + 1 AS INTEGER) AS n FROM pages GROUP BY deck_id",
    "s8_note_modes": _S + " SELECT deck_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, CASE WHEN count(*) <= 12 AND sum(length(text)) <= 16000 THEN 'document' ELSE 'section' END AS mode FROM spages GROUP BY deck_id",
    "s10_neighbors": _S + """, l AS (SELECT *, lag(slide_id, 2) OVER w AS a, lag(slide_id) OVER w AS b, lead(slide_id) OVER w AS c, lead(slide_id, 2) OVER w AS d FROM spages WINDOW w AS (PARTITION BY deck_id ORDER BY slide_id))
        SELECT deck_id, slide_id, concat_ws(',', a, b, c, d) AS near FROM l""",
    "s11_frontmatter": _S + " SELECT deck_id, slide_id FROM (SELECT *, bool_and(length(text) < 4000) OVER (PARTITION BY deck_id ORDER BY slide_id) AS run FROM spages) WHERE run",
    "s1_outline_items": _SECTIONS + " SELECT deck_id, rank, title, number, slide_id FROM outline",
    "s2_section_boundaries": _SECTIONS + " SELECT * FROM bounds",
    "s3_agenda_followups": _SECTIONS + f""", n AS (SELECT deck_id, count(*) AS n FROM outline GROUP BY deck_id HAVING count(*) >= 2),
        body AS (SELECT l.deck_id, l.slide_id, n.n, {_HK.format("l.title || chr(10) || l.text")} AS k FROM listed l JOIN n USING (deck_id) JOIN firsts f USING (deck_id) WHERE l.slide_id > f.slide_id + 3),
        m AS (SELECT b.deck_id, b.slide_id FROM body b JOIN outline o ON o.deck_id = b.deck_id WHERE contains(b.k, o.key) GROUP BY b.deck_id, b.slide_id, b.n HAVING count(*) >= least(3, b.n)),
        nx AS (SELECT deck_id, slide_id, lead(slide_id) OVER (PARTITION BY deck_id ORDER BY slide_id) AS nxt FROM listed)
        SELECT * FROM bounds UNION ALL SELECT DISTINCT x.deck_id, x.nxt, 'outline_followup' FROM nx x SEMI JOIN m USING (deck_id, slide_id) ANTI JOIN bounds b ON b.deck_id = x.deck_id AND b.slide_id = x.nxt WHERE x.nxt IS NOT NULL""",
    "s4_fixed_boundaries": _SECTIONS + " SELECT * FROM fixed",
    "s5_section_titles": _SECTIONS + " SELECT * FROM titles",
    "s6_sections": _SECTIONS + ' SELECT deck_id, section, start, end_ AS "end", n_pages, title, reason FROM secs',
    "s7_normalize_plan": _SECTIONS + """, pl AS (SELECT deck_id, slide_id, trim(title, ' ') AS title, 'llm_boundary' AS reason FROM listed WHERE regexp_matches(deck_id, '[02468]$') AND doc_id // 20 % 7 = 3),
        st AS (SELECT * FROM pl UNION ALL SELECT f.deck_id, f.slide_id, '', 'first_page_inserted' FROM firsts f SEMI JOIN pl ON pl.deck_id = f.deck_id ANTI JOIN pl ON pl.deck_id = f.deck_id AND pl.slide_id = f.slide_id),
        nm AS (SELECT l.*, s.reason AS why, s.title AS own, sum(CASE WHEN s.slide_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.deck_id ORDER BY l.slide_id) AS section FROM listed l LEFT JOIN st s ON s.deck_id = l.deck_id AND s.slide_id = l.slide_id WHERE l.deck_id IN (SELECT deck_id FROM st))
        SELECT deck_id, section::BIGINT AS section, min(slide_id) AS start, max(slide_id) AS "end", CAST(count(*) AS INTEGER) AS n_pages, coalesce(nullif(arg_min(own, slide_id) FILTER (own IS NOT NULL), ''), arg_min(title, slide_id) FILTER (trim(title, ' ') <> ''), '第 ' || section || ' 节') AS title,
          arg_min(why, slide_id) FILTER (why IS NOT NULL) AS reason, 'llm' AS method FROM nm GROUP BY deck_id, section
        UNION ALL SELECT deck_id, section, start, end_, n_pages, title, reason, 'local' FROM secs WHERE deck_id NOT IN (SELECT deck_id FROM st)""",
    "s8_note_contexts": _SECTIONS + " SELECT * FROM contexts",
    "s12_page_roles": _S + " SELECT deck_id, slide_id, CASE WHEN doc_id % 2 = 0 THEN 'example' ELSE 'concept' END AS role FROM spages WHERE doc_id % 5 <> 1",
    "s12_brief_for_scope": _SECTIONS + """, ctx AS (SELECT n.deck_id, CASE WHEN m.mode = 'document' THEN 'doc' ELSE 'sec' || n.section END AS context, doc_id FROM numbered n JOIN modes m USING (deck_id))
        SELECT deck_id, context, 'role' AS kind, least(80, count_if(doc_id % 5 <> 1))::BIGINT AS n FROM ctx GROUP BY ALL HAVING count_if(doc_id % 5 <> 1) > 0 UNION ALL SELECT deck_id, context, 'question', 1::BIGINT FROM (SELECT DISTINCT deck_id, context FROM ctx)""",
    "s9_section_by_slide": _SECTIONS + " SELECT deck_id, slide_id, section::BIGINT AS section FROM numbered",
    "s14_generation_requests": _SECTIONS + " SELECT deck_id, 'page' AS stage, 'p' || slide_id AS context, 1 AS n_pages FROM listed UNION ALL SELECT deck_id, 'section', context, n_pages FROM contexts UNION ALL SELECT deck_id, 'enrichment', context, n_pages FROM contexts",
    "s14_step_count": _SECTIONS + ", p AS (SELECT deck_id, count(*) AS p FROM listed GROUP BY deck_id), c AS (SELECT deck_id, count(*) AS c FROM contexts GROUP BY deck_id) SELECT deck_id, p + 2 * c AS steps, 0::BIGINT AS direct, p AS page, c AS section, c AS enrichment FROM p JOIN c USING (deck_id)",
    "k1_guard_text": "WITH " + b.BLOCKS_SQL + _GUARD + " SELECT deck_id, slide_id, element_id, kind, learning_role, must_explain, confidence, md5(CASE WHEN length(c) > 220 THEN c[1:219] || '…' ELSE c END) AS preview FROM guard",
    "k2_guard_images": "WITH " + b.IMAGES_SQL + r""", f AS (SELECT *, CASE WHEN role = 'content' THEN file_size || ':' || coalesce(CAST(width AS VARCHAR), 'None') || ':' || height || ':' || path END AS fp,
          ((x2 - x1) * (y2 - y1) <= 0.018 AND (x1 <= 0.12 OR x2 >= 0.88) AND (y1 <= 0.12 OR y2 >= 0.88)) OR ((x2 - x1) * (y2 - y1) <= 0.01 AND (x1 <= 0.08 OR y1 <= 0.08 OR x2 >= 0.92 OR y2 >= 0.92)) OR contains(caption, 'logo') AS tl FROM images),
        m AS (SELECT *, fp IS NOT NULL AND count(*) OVER w > 1 AND tl AND (count(*) OVER w >= 3 OR count_if(tl) OVER w = count(*) OVER w) AS ignored FROM f WINDOW w AS (PARTITION BY deck_id, fp)),
        k AS (SELECT *, role = 'figure_crop' AS fig, visual_summary <> '' AS sum, length(trim(ocr_text, ' ')) >= 40 AS ocr, trim(regexp_replace(array_to_string(list_filter([caption, visual_summary, ocr_text], lambda x: x <> ''), ' '), '\s+', ' ', 'g')) AS w FROM m WHERE NOT ignored)
        SELECT deck_id, slide_id, element_id, 'image' AS kind, CASE WHEN ocr THEN 'ocr_key_text' ELSE 'figure_explanation' END AS learning_role, true AS must_explain, greatest(CASE WHEN fig THEN 0.8 ELSE 0.5 END, CASE WHEN sum THEN 0.78 ELSE 0.5 END, CASE WHEN ocr THEN 0.76 ELSE 0.5 END)::DOUBLE AS confidence,
          CASE WHEN w = '' THEN path WHEN length(w) > 220 THEN w[1:219] || '…' ELSE w END AS preview FROM k WHERE fig OR sum OR ocr""",
    "k2_guard_tables": "SELECT p_partkey % 40 AS deck_id, p_size AS slide_id, 's' || p_size || '_tbl' || p_partkey AS element_id, 'table' AS kind, 'table_conclusion' AS learning_role, true AS must_explain, 0.82::DOUBLE AS confidence, p_name || ' | ' || p_brand AS preview FROM part WHERE p_partkey % 7 <> 0",
    "k4_merge_labels": "WITH " + b.BLOCKS_SQL + _GUARD + ", x AS (SELECT *, CASE WHEN length(c) > 220 THEN 220 ELSE length(c) END AS l, length(element_id) % 3 = 0 AS m FROM guard) SELECT deck_id, element_id, CASE WHEN m THEN 'concept' ELSE learning_role END AS learning_role, CASE WHEN m THEN l % 2 = 0 ELSE must_explain END AS must_explain, CASE WHEN m THEN 0.9 ELSE confidence END::DOUBLE AS confidence FROM x",
    "k7_repair_diff": "WITH " + b.BLOCKS_SQL + _GUARD + " SELECT DISTINCT deck_id, element_id, CASE WHEN length(element_id) % 2 = 0 THEN 'unresolved' ELSE 'resolved' END AS state FROM guard WHERE must_explain",
    "k3_guard_pages": "WITH " + b.BLOCKS_SQL + _GUARD + f""", per AS (SELECT deck_id, slide_id, bool_or(must_explain AND confidence >= 0.7) AS m FROM guard GROUP BY ALL),
        st AS (SELECT *, {b.structural_sql("title", "title || chr(10) || text", "slide_id - 1", True)} AS s FROM pages)
        SELECT p.deck_id, p.slide_id, CASE WHEN s THEN CASE WHEN coalesce(m, false) THEN 'mixed' ELSE 'structural' END ELSE 'content' END AS page_role FROM st p LEFT JOIN per USING (deck_id, slide_id)""",
    "k5_guard_summary": "WITH " + b.BLOCKS_SQL + _GUARD + " SELECT deck_id, count(*) AS items, count_if(must_explain)::BIGINT AS must_explain, count_if(must_explain AND confidence >= 0.7)::BIGINT AS required, count_if(learning_role = 'structural')::BIGINT AS structural FROM guard GROUP BY deck_id",
    "k6_missing_required": "WITH " + b.ITEMS_SQL + _GUARD + """ SELECT g.deck_id, g.element_id, learning_role, CASE WHEN trace_covered THEN 'marker_only' ELSE 'missing' END AS coverage
        FROM guard g JOIN items i ON i.deck_id = g.deck_id AND i.element_id = g.element_id WHERE must_explain AND confidence >= 0.7 AND NOT visible_covered""",
    "z1_stream_progress": r"""SELECT user_id % 50 AS run_id, 'stage' || (event_id % 4) AS stage, count(*) AS current, count_if(event_type = 'click')::BIGINT AS cache_hits, count_if(event_type = 'view')::BIGINT AS api_calls, count_if(event_type = 'error')::BIGINT AS skipped FROM events GROUP BY ALL""",
    "z2_stream_misses": r"SELECT DISTINCT CAST(user_id % 500 AS VARCHAR) AS cache_key FROM events WHERE user_id % 500 NOT IN (SELECT c_custkey % 50 * 9 FROM customer)",
    "z3_stream_pages": _P + " SELECT deck_id, slide_id FROM pages WHERE doc_id % 2 <> 0",
}
