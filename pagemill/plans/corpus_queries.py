"""Long-document operators on documents: a book is a language, a page one of its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_float, as_int, clean_inline, ensure_sentence, escape_md, is_outline, json_object, quote_lines, rel_path, slugify, str_or_none, text_key, token_set, zh_ordinal
from ..operators import corpus, notes
from ..shared import written
from . import bindings as b


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Every fifth page has little native text and the whole by OCR; of the first 25, five begin with contents.

    The entries are the page's own lines, numbered on three levels, with pages three apart.
    """
    p = b.table(s, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("book_id"), "doc_id", (F.col("doc_id") + 1).cast("int").alias("physical_page"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 5)

    def entry(x, i):
        n = i.cast("string")
        number = F.when(i % 5 == 4, F.concat(n, F.lit(".1.1"))).when(i % 2 == 1, F.concat(n, F.lit(".1"))).otherwise(n)
        return F.concat(number, F.lit(" "), F.trim(F.substring(x, 1, 40)), F.lit(" "), (i * 3 + F.col("doc_id")).cast("string"))

    toc = F.when((F.col("doc_id") < 25) & (F.col("doc_id") % 5 == 2), F.concat(F.lit("Contents\n"), F.array_join(F.transform(lines, entry), "\n"), F.lit("\n"))).otherwise("")
    native = F.concat(toc, F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 60)).otherwise(F.col("text")))
    return p.select("book_id", "physical_page", F.col("physical_page").cast("string").alias("printed_page_label"), native.alias("native_text"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise("").alias("ocr_text"))


def _text(s: SparkSession, d: str) -> DataFrame:
    return corpus.combine_text(_pages(s, d))


def _book_pages(s: SparkSession, d: str) -> DataFrame:
    return corpus.book_pages(_pages(s, d).select("book_id", "physical_page", F.col("native_text").alias("text"), F.when(F.col("physical_page") % 3 != 0, F.col("printed_page_label")).alias("label")))


def _toc(s: SparkSession, d: str) -> DataFrame:
    return corpus.detect_toc(_text(s, d))


class _Book:
    """Pages, contents, sections and chunks of all books, each derived once and written."""

    def __init__(self, s: SparkSession, d: str):
        self.pages = written(_text(s, d), "pages")
        self.toc = written(corpus.detect_toc(self.pages), "toc")
        self.sections = written(corpus.book_sections(self.pages, self.toc), "book-sections")

    def units(self) -> DataFrame:
        return corpus.section_units(self.pages, self.sections)

    def chunks(self) -> DataFrame:
        return corpus.chunks(self.units())

    def manifest(self) -> DataFrame:
        return corpus.manifest(self.pages, self.sections, written(self.chunks(), "chunks"))


def _book_lines(s: SparkSession, d: str) -> DataFrame:
    book = _Book(s, d)
    return notes.book_lines(written(book.manifest(), "manifest"), book.toc, book.sections)


def _chunk_index(s: SparkSession, d: str) -> DataFrame:
    book = _Book(s, d)
    return corpus.chunk_index(book.chunks(), book.sections)


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Events' properties as a model gives them: broken, fenced, or with words around."""
    n, props = F.col("event_id"), F.col("props")
    return b.table(s, d, "events").select("event_id", F.when(n % 7 == 0, F.substring(props, 1, 5)).when(n % 3 == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n % 3 == 2, F.concat(F.lit("answer: "), props, F.lit(" done"))).otherwise(props).alias("answer"))


def _casts(s: SparkSession, d: str) -> DataFrame:
    o = b.table(s, d, "orders")
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    return o.select("o_orderkey", "o_custkey", as_int(F.substring("o_orderpriority", 1, 1)).alias("level"), as_int(F.col("o_orderpriority"), -1).alias("none"), as_float(price).alias("price"), str_or_none(F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))).alias("name"))


QUERIES = {
    "b6_clean_inline": lambda s, d: b.table(s, d, "pages").select("page_id", F.md5(clean_inline(F.col("html"))).alias("text_md5")),
    "b16_safe_casts": _casts,
    "b17_json_object": lambda s, d: _answers(s, d).withColumn("v", json_object(F.col("answer"))).select("event_id", F.col("v").isNotNull().alias("parsed"), F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.lit(-1)).cast("bigint").alias("k")),
    "b19_sentences": lambda s, d: b.pages(s, d).select("doc_id", F.md5(ensure_sentence(F.col("title"))).alias("sentence_md5"), F.md5(escape_md(F.col("text"))).alias("cell_md5"), F.md5(quote_lines(F.col("text"))).alias("quote_md5"), zh_ordinal(F.col("slide_id")).alias("ordinal")),
    "b21_rel_path": lambda s, d: b.images(s, d).select("deck_id", "element_id", rel_path(F.concat(F.when(F.col("slide_id") % 2 == 0, "/data/book/").otherwise("C:\\x\\"), "path"), "/data/book").alias("path")),
    "b3_slugify": lambda s, d: b.pages(s, d).select("doc_id", slugify(F.col("text")).alias("slug")),
    "b5_text_key": lambda s, d: b.pages(s, d).select("doc_id", F.md5(text_key(F.col("text"))).alias("key_md5")),
    "b10_outline": lambda s, d: b.pages(s, d).select("doc_id", is_outline(F.col("text")).alias("outline")),
    "b14_token_set": lambda s, d: b.pages(s, d).select("doc_id", F.size(token_set(F.col("text"))).cast("long").alias("n_tokens")),
    "x2_combine_text": lambda s, d: _text(s, d).select("book_id", "physical_page", F.length("combined_text").cast("long").alias("n_chars"), F.md5("combined_text").alias("text_md5")),
    "x1_book_pages": lambda s, d: _book_pages(s, d).select("book_id", "physical_page", "printed_page_label", "text_chars", "needs_ocr", F.md5("title_hint").alias("hint_md5")),
    "x1_ocr_targets": lambda s, d: corpus.book_ocr_targets(_book_pages(s, d)),
    "x4_detect_toc": lambda s, d: _toc(s, d),
    "x4_toc_summary": lambda s, d: corpus.toc_summary(_toc(s, d), _pages(s, d)),
    "x5_resolve_labels": lambda s, d: corpus.resolve_labels(_toc(s, d), _pages(s, d)),
    "x6_book_sections": lambda s, d: _Book(s, d).sections,
    "x8_section_units": lambda s, d: _Book(s, d).units().select("book_id", "section_id", "page", "pos", F.md5("text").alias("text_md5")),
    "x9_chunks": lambda s, d: _Book(s, d).chunks().select("book_id", "section_id", "chunk_index", "text_chars", "content_hash", "page_start", "page_end"),
    "x10_chunk_index": lambda s, d: _chunk_index(s, d).drop("section_title"),
    "x11_ocr_report": lambda s, d: corpus.ocr_report(b.table(s, d, "events").select((F.col("user_id") % 50).alias("book_id"), (F.col("event_id") % 3 == 0).alias("api_call"), F.element_at(F.array(*map(F.lit, ("local_hit", "miss", "skipped"))), (F.col("event_id") % 3 + 1).cast("int")).alias("cache_status"), (F.col("event_id") % 97).alias("text_chars"))),
    "n9_book_lines": lambda s, d: _book_lines(s, d).select("book_id", F.md5("text").alias("text_md5")),
    "x10_manifest": lambda s, d: _Book(s, d).manifest(),
    "u12_duplicates": lambda s, d: corpus.duplicate_groups(b.pages(s, d).select(F.col("doc_id").alias("key"), F.col("text").alias("content"))),
    "u13_unreferenced": lambda s, d: corpus.unreferenced(
        b.table(s, d, "part").select(F.concat_ws(".", F.lit("p"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("key")),
        b.table(s, d, "lineitem").select(F.concat_ws(".", F.lit("p"), (F.col("l_partkey") % 50 + 1).cast("string"), F.col("l_partkey").cast("string"), F.lit("x")).alias("ref")),
    ),
}

_PAGES = r"""WITH pages AS (
  SELECT coalesce(lang, 'none') AS book_id, CAST(doc_id + 1 AS INTEGER) AS physical_page,
         trim(CASE WHEN doc_id < 25 AND doc_id % 5 = 2 THEN 'Contents' || chr(10) || array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, ' ')) > 5),
             lambda x, i: (i - 1) || CASE WHEN (i - 1) % 5 = 4 THEN '.1.1' WHEN (i - 1) % 2 = 1 THEN '.1' ELSE '' END || ' ' || trim(x[1:40], ' ') || ' ' || ((i - 1) * 3 + doc_id)), chr(10)) || chr(10) ELSE '' END
           || CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '')[1:60] ELSE coalesce(text, '') END, ' ') AS native, trim(CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') ELSE '' END, ' ') AS ocr FROM documents),
texts AS (SELECT book_id, physical_page, CASE WHEN ocr = '' THEN native WHEN length(native) < 80 THEN ocr WHEN contains(native, ocr) THEN native ELSE native || chr(10) || chr(10) || '[OCR]' || chr(10) || ocr END AS combined_text FROM pages)"""
_CH = r"第\s*[一二三四五六七八九十百千万零〇\d]+\s*[章节篇部]"
_TITLE = rf"(length({{0}}) BETWEEN 2 AND 140 AND (regexp_matches({{0}}, '(?i)^{_CH}') OR regexp_matches({{0}}, '(?i)^Chapter\s+\d+') OR regexp_matches({{0}}, '(?i)^\d+(?:\.\d+)*\s+[\p{{{{L}}}}\p{{{{N}}}}_一-鿿]')))"
_LEAD = r"trim(trim(regexp_replace(regexp_replace({0}, '\.{{2,}}|…{{2,}}', ' ', 'g'), '\s+', ' ', 'g')), '.·- ')"
_LEVEL = rf"CASE WHEN regexp_matches({{0}}, '^{_CH}') AND NOT regexp_matches({{0}}, '^第\s*[一二三四五六七八九十百千万零〇\d]+\s*节') THEN 1 WHEN starts_with({{0}}, '第') THEN 2 WHEN regexp_extract({{0}}, '^(\d+(?:\.\d+)*)\b', 1) <> '' THEN least(6, len(string_split(regexp_extract({{0}}, '^(\d+(?:\.\d+)*)\b', 1), '.'))) ELSE 1 END"
_HEAD = "(lower(trim({0})) IN ('目录', '目 录', 'contents', 'table of contents') OR starts_with(lower(trim({0})), '目录 '))"
_TOC = _PAGES + rf""",
lines0 AS (SELECT book_id, physical_page, trim(regexp_replace(unnest(string_split(combined_text, chr(10))), '\s+', ' ', 'g')) AS line, generate_subscripts(string_split(combined_text, chr(10)), 1) AS n FROM texts),
lines AS (SELECT book_id, physical_page, line, row_number() OVER (PARTITION BY book_id, physical_page ORDER BY n) - 1 AS pos FROM lines0 WHERE line <> ''),
two AS (SELECT *, regexp_extract(line, '(?i)^(.+?)(?:\.{{2,}}|…{{2,}}|\s{{2,}}|\t+)\s*([ivxlcdm]+|\d{{1,4}})$', ['t', 'l']) AS a, regexp_extract(line, '(?i)^({_CH}.+?|Chapter\s+\d+.+?|\d+(?:\.\d+)*\s+.+?)\s+(\d{{1,4}})$', ['t', 'l']) AS b FROM lines WHERE physical_page <= 25 AND length(line) <= 180 AND NOT {_HEAD.format("line")}),
cleaned AS (SELECT *, {_LEAD.format("a.t")} AS ta, {_LEAD.format("b.t")} AS tb FROM two),
found AS (SELECT book_id, physical_page, pos, CASE WHEN a.t <> '' AND {_TITLE.format("ta")} THEN ta WHEN b.t <> '' AND {_TITLE.format("tb")} THEN tb END AS title, CASE WHEN a.t <> '' AND {_TITLE.format("ta")} THEN a.l ELSE b.l END AS label FROM cleaned),
entries AS (SELECT *, {_LEVEL.format("title")} AS level FROM found WHERE title IS NOT NULL),
good AS (SELECT book_id, physical_page FROM lines WHERE physical_page <= 25 AND pos < 12 AND {_HEAD.format("line")} UNION SELECT book_id, physical_page FROM entries GROUP BY ALL HAVING count(*) >= 2),
once AS (SELECT * FROM entries SEMI JOIN good USING (book_id, physical_page) QUALIFY row_number() OVER (PARTITION BY book_id, title, label ORDER BY physical_page, pos) = 1),
toc AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY physical_page, pos) AS INTEGER) AS entry_index, title, label, CAST(level AS INTEGER) AS level, physical_page AS toc_page FROM once),
starts AS (SELECT t.*, coalesce(p.physical_page, t.toc_page) AS start FROM toc t LEFT JOIN pages p ON p.book_id = t.book_id AND CAST(p.physical_page AS VARCHAR) = CASE WHEN regexp_matches(label, '^\d+$') THEN CAST(CAST(label AS BIGINT) AS VARCHAR) ELSE lower(label) END)"""
_SECS = _TOC + rf""",
size AS (SELECT book_id, max(physical_page) AS pages FROM texts GROUP BY book_id),
of_toc AS (SELECT book_id, start, level, title, 'toc' AS source FROM starts WHERE level <= 2),
st AS (SELECT *, {_LEAD.format("line")} AS t FROM lines WHERE pos < 12),
of_head AS (SELECT book_id, physical_page AS start, {_LEVEL.format("line")} AS level, t AS title, 'heading_fallback' AS source FROM st WHERE {_TITLE.format("t")} AND book_id NOT IN (SELECT book_id FROM of_toc) QUALIFY row_number() OVER (PARTITION BY book_id, physical_page ORDER BY pos) = 1),
some_ AS (SELECT * FROM of_toc UNION ALL SELECT * FROM of_head),
every_ AS (SELECT * FROM some_ UNION ALL SELECT book_id, 1, 1, 'Full textbook', 'fallback' FROM size WHERE book_id NOT IN (SELECT book_id FROM some_)),
secs AS (
  SELECT book_id, 'tb_sec' || lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') AS section_id, title, CAST(level AS INTEGER) AS level, st AS start_page, coalesce(greatest(st, least(pages, lead(st) OVER w - 1)), pages) AS end_page, source
  FROM (SELECT e.*, pages, CAST(least(greatest(start, 1), greatest(pages, 1)) AS INTEGER) AS st FROM every_ e JOIN size USING (book_id)) WINDOW w AS (PARTITION BY book_id ORDER BY st, level, title))"""
_UNITS = _SECS + rf""",
ln AS (SELECT book_id, physical_page, list([struct_pack(o := []::VARCHAR[], h := line, f := {_TITLE.format(_LEAD.format("line"))})] ORDER BY pos) AS u FROM lines GROUP BY ALL),
fold AS (SELECT book_id, physical_page, list_reduce([struct_pack(o := []::VARCHAR[], h := '', f := false)] || list_transform(u, lambda x: x[1]), lambda s, x:
  CASE WHEN length(CASE WHEN s.h = '' THEN x.h ELSE s.h || ' ' || x.h END) >= 360 OR x.f THEN struct_pack(o := s.o || [CASE WHEN s.h = '' THEN x.h ELSE s.h || ' ' || x.h END], h := '', f := false)
  ELSE struct_pack(o := s.o, h := CASE WHEN s.h = '' THEN x.h ELSE s.h || ' ' || x.h END, f := false) END) AS s FROM ln),
blk AS (SELECT book_id, physical_page, list_filter(list_transform(regexp_split_to_array(combined_text, '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS b FROM texts),
paras AS (SELECT k.book_id, k.physical_page, CASE WHEN len(b) > 1 THEN b ELSE CASE WHEN s.h = '' THEN s.o ELSE s.o || [s.h] END END AS p FROM blk k JOIN fold f USING (book_id, physical_page)),
pos AS (SELECT book_id, physical_page, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS pos FROM paras),
units AS (SELECT s.book_id, section_id, p.physical_page AS page, pos, text FROM secs s JOIN pos p ON p.book_id = s.book_id AND p.physical_page BETWEEN start_page AND end_page)"""
_FLAT = _UNITS + """, lens AS (SELECT book_id, section_id, list([struct_pack(t := text, a := page, z := page)] ORDER BY page, pos) AS u FROM units GROUP BY ALL),
packed AS (SELECT book_id, section_id, list_reduce(u, lambda acc, x: CASE WHEN length(acc[-1].t) + 2 + length(x[1].t) > 1200 THEN acc || x ELSE acc[:-2] || [struct_pack(t := acc[-1].t || chr(10) || chr(10) || x[1].t, a := acc[-1].a, z := x[1].z)] END) AS c FROM lens),
flat AS (SELECT book_id, section_id, unnest(c) AS k, CAST(generate_subscripts(c, 1) AS INTEGER) AS chunk_index FROM packed)"""
_OWN = _PAGES + rf""",
own AS (SELECT book_id, physical_page, list_filter(list_transform(string_split(native, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages),
near AS (SELECT *, length(array_to_string(l, chr(10))) AS n, list_filter(l[1:8], lambda x: {_HEAD.format("x")} OR {_TITLE.format(_LEAD.format("x"))})[1] AS h FROM own)"""
SQL = {
    "b6_clean_inline": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '<!--.*?-->', '', 'gs'), '\s+', ' ', 'g'), ' ')) AS text_md5 FROM pages",
    "b16_safe_casts": "SELECT o_orderkey, o_custkey, CAST(o_orderpriority[1] AS BIGINT) AS level, -1::BIGINT AS none, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END::DOUBLE AS price, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS name FROM orders",
    "b17_json_object": "SELECT event_id, event_id % 7 <> 0 AS parsed, CASE WHEN event_id % 7 <> 0 THEN CAST(props->>'$.k' AS BIGINT) ELSE -1 END AS k FROM events",
    "b19_sentences": "WITH " + b.PAGES_SQL + r""", c AS (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)
        SELECT doc_id, md5(CASE WHEN t = '' OR regexp_matches(t, '[。.!！？?：:]$') THEN t ELSE t || '。' END) AS sentence_md5, md5(replace(replace(text, '|', '\|'), chr(10), '<br>')) AS cell_md5, md5(coalesce(array_to_string(list_transform(l, lambda x: '> ' || x), chr(10)), '')) AS quote_md5,
          CASE WHEN slide_id <= 10 THEN ['一','二','三','四','五','六','七','八','九','十'][slide_id] WHEN slide_id <= 19 THEN '十' || ['一','二','三','四','五','六','七','八','九'][slide_id - 10] WHEN slide_id = 20 THEN '二十' ELSE CAST(slide_id AS VARCHAR) END AS ordinal FROM c""",
    "b21_rel_path": "WITH " + b.IMAGES_SQL + " SELECT deck_id, element_id, CASE WHEN slide_id % 2 = 0 THEN path ELSE 'C:/x/' || path END AS path FROM images",
    "b3_slugify": r"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''), ' ')), '[^\p{L}\p{M}\p{Nd}_一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM documents",
    "b5_text_key": "SELECT doc_id, md5(" + b._KEY.format("coalesce(text, '')") + ") AS key_md5 FROM documents",
    "b10_outline": "SELECT doc_id, len(" + (k := b._NUMBERED.format("coalesce(text, '')", "一二三四五")) + f") >= 3 AND coalesce(list_sum(list_transform({k}, lambda x: length(x))), 0) <= 260 AS outline FROM documents",
    "x1_book_pages": _OWN + f" SELECT book_id, physical_page, CAST(physical_page AS VARCHAR) AS printed_page_label, CAST(n AS INTEGER) AS text_chars, n < 80 AS needs_ocr, md5(coalesce(CASE WHEN {_HEAD.format('h')} THEN h ELSE ({_LEAD.format('h')})[1:140] END, l[1][1:140])) AS hint_md5 FROM near",
    "x1_ocr_targets": _OWN + " SELECT book_id, physical_page, 'low_native_text' AS reason FROM near WHERE n < 80",
    "x10_chunk_index": _FLAT + " SELECT book_id, 'tb_' || sha256(book_id)[1:12] || '_' || section_id || '_c' || CASE WHEN chunk_index < 1000 THEN lpad(CAST(chunk_index AS VARCHAR), 3, '0') ELSE CAST(chunk_index AS VARCHAR) END AS chunk_id, section_id, k.a AS page_start, k.z AS page_end, CAST(length(k.t) AS INTEGER) AS text_chars, 'sha256:' || sha256(k.t) AS content_hash FROM flat",
    "x10_manifest": _FLAT + """, p AS (SELECT book_id, count(*) AS pages, count_if(length(trim(combined_text, ' ')) < 80)::BIGINT AS low_text_pages FROM texts GROUP BY 1), n AS (SELECT book_id, count(*) AS sections FROM secs GROUP BY 1), c AS (SELECT book_id, count(*) AS chunks, sum(length(k.t))::BIGINT AS chars FROM flat GROUP BY 1)
        SELECT book_id, pages, low_text_pages, coalesce(sections, 0) AS sections, coalesce(chunks, 0) AS chunks, coalesce(chars, 0) AS chars FROM p LEFT JOIN n USING (book_id) LEFT JOIN c USING (book_id)""",
    "b14_token_set": r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}'))) AS BIGINT) AS n_tokens FROM documents",
    "x2_combine_text": _PAGES + " SELECT book_id, physical_page, length(combined_text) AS n_chars, md5(combined_text) AS text_md5 FROM texts",
    "x4_detect_toc": _TOC + " SELECT book_id, entry_index, title, label, level, toc_page FROM toc",
    "x4_toc_summary": _TOC + ", n AS (SELECT book_id, count(*) AS n FROM toc GROUP BY book_id) SELECT book_id, coalesce(n, 0) AS entries, CASE WHEN n > 0 THEN round(least(0.95, 0.45 + 0.08 * n + 0.15), 3) ELSE 0 END::DOUBLE AS confidence FROM (SELECT DISTINCT book_id FROM texts) LEFT JOIN n USING (book_id)",
    "x5_resolve_labels": _TOC + " SELECT book_id, entry_index, title, label, level, toc_page, start FROM starts",
    "x6_book_sections": _SECS + " SELECT book_id, section_id, title, level, start_page, end_page, source FROM secs",
    "x8_section_units": _UNITS + " SELECT book_id, section_id, page, CAST(pos AS INTEGER) AS pos, md5(text) AS text_md5 FROM units",
    "x9_chunks": _FLAT + " SELECT book_id, section_id, chunk_index, CAST(length(k.t) AS INTEGER) AS text_chars, 'sha256:' || sha256(k.t) AS content_hash, k.a AS page_start, k.z AS page_end FROM flat",
    "x11_ocr_report": "SELECT user_id % 50 AS book_id, count(*) AS targets_total, count_if(event_id % 3 = 0)::BIGINT AS api_calls, count_if(event_id % 3 = 0)::BIGINT AS local_cache_hits, count_if(event_id % 3 = 2)::BIGINT AS skipped, sum(event_id % 97)::BIGINT AS text_chars FROM events GROUP BY 1",
    "u12_duplicates": r"""WITH h AS (SELECT doc_id AS key, md5(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'), ' ')) AS h FROM documents)
        SELECT key, min(key) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS copies FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1""",
    "u13_unreferenced": r"""WITH k AS (SELECT 'p.' || p_size || '.' || p_partkey AS key FROM part), r AS (SELECT DISTINCT 'p.' || (l_partkey % 50 + 1) || '.' || l_partkey AS ref FROM lineitem)
        SELECT key FROM k WHERE key NOT IN (SELECT ref FROM r)""",
}
