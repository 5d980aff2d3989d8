"""Coverage, lineage and note rows on decks of documents and notes made by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import image_targets, preview, slide_of, source_tokens
from ..operators import coverage, guard, lineage
from . import bindings as b
from .layout_queries import guard_sql


def _items(s: SparkSession, d: str) -> DataFrame:
    """Coverage of all lines; structural pages and the guard's required items are flagged."""
    required = guard.required_items(guard.guard_text(b.blocks(s, d))).select("deck_id", "element_id")
    return coverage.coverage_items(b.elements(s, d), b.notes(s, d), b.pages(s, d).where("structural").select("deck_id", "slide_id"), required)


def _contexts(s: SparkSession, d: str) -> DataFrame:
    """User turns are inputs, assistant turns outputs; every third letter position of a text names an element."""
    mark = F.concat(F.lit(" s"), F.col("turn") % 3, F.lit("_t"), F.length("text") % 7)
    c = b.table(s, d, "conversations").withColumn("marked", F.concat("text", mark))
    side = {n: F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("marked")))), " ") for n, r in (("input", "user"), ("output", "assistant"))}
    return c.groupBy(F.col("conv_id").alias("deck_id")).agg(*[v.alias(k) for k, v in side.items()]).withColumn("context", F.lit(0))


def _linked_notes(s: SparkSession, d: str, all_of_them: bool = True) -> DataFrame:
    """Images linked in notes, some by a longer path; not all of them: one in three has no link, which is what coverage has to find."""
    i = b.images(s, d)
    i = i if all_of_them else i.where(F.substring("element_id", -1, 1).cast("int") % 3 != 0)
    return i.select("deck_id", F.concat(F.lit("![x]("), F.when(F.col("width") % 2 == 0, "../").otherwise(""), "path", F.lit(")")).alias("markdown"))


def _headed(s: SparkSession, d: str) -> DataFrame:
    """Notes with a heading of level 1 to 3 before each line of over 200 characters, lists, tables, images and lines without a text."""
    n = b.blocks(s, d)
    level = F.repeat(F.lit("#"), (F.col("n") % 3 + 1).cast("int"))
    kind = (F.col("doc_id") + F.col("n")) % 7
    block = (
        F.when(F.length("content") > 200, F.concat(level, F.lit(" H"), "n", F.lit("\n\n"), "content")).when(kind == 0, F.concat(F.lit("- "), "content")).when(kind == 1, F.concat(F.lit("| a | b |\n|---|---|\n| "), "content", F.lit(" |")))
        .when(kind == 2, F.concat(F.lit("![pic](assets/"), F.col("n") % 9, F.lit(".png)"))).when(kind == 3, F.lit("")).otherwise(F.col("content"))
    )
    text = F.concat(block, F.when(block == "", "").otherwise("\n"), F.lit("<!-- source: p"), "slide_id", F.lit(":"), "element_id", F.lit(" -->"))
    per = n.groupBy("deck_id", "slide_id").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("l"))
    return per.select("deck_id", "slide_id", F.array_join(F.col("l.t"), "\n\n").alias("markdown"))


def _pictures(s: SparkSession, d: str) -> DataFrame:
    """Nine images of each deck."""
    return b.pages(s, d).select("deck_id").distinct().select("deck_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("deck_id", F.concat(F.lit("s1_img"), "k").alias("element_id"), F.concat(F.lit("images/"), "k", F.lit(".png")).alias("path"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return lineage.markdown_blocks(_headed(s, d))


def _page_images(s: SparkSession, d: str) -> DataFrame:
    return b.pages(s, d).select("deck_id", "slide_id", (F.col("doc_id") % 2 == 0).alias("ignored"))


def _page_missing(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).groupBy("deck_id", "slide_id").agg(F.count_if(~F.col("trace_covered")).alias("missing"), F.count_if(F.col("required") & ~F.col("visible_covered")).alias("required_missing"))


QUERIES = {
    "b1_preview": lambda s, d: b.pages(s, d).select("doc_id", preview(F.col("text"), 160).alias("preview")),
    "b7_source_tokens": lambda s, d: b.notes(s, d).select("deck_id", "slide_id", F.size(source_tokens(F.col("markdown"))).cast("long").alias("n_tokens")),
    "b8_slide_of": lambda s, d: b.elements(s, d).select("deck_id", "element_id", slide_of(F.col("element_id")).alias("slide")),
    "b9_image_targets": lambda s, d: _linked_notes(s, d).select("deck_id", F.explode(image_targets(F.col("markdown"))).alias("target")).groupBy("deck_id", "target").agg(F.count(F.lit(1)).alias("n")),
    "v1_coverage_items": lambda s, d: _items(s, d).select("deck_id", "slide_id", "element_id", "trace_covered", "visible_covered", "structural", "required", "marker_only"),
    "v2_visible_tokens": lambda s, d: coverage.visible_tokens(b.notes(s, d)),
    "v3_coverage_totals": lambda s, d: coverage.coverage_totals(_items(s, d)).withColumns({c: F.round(c, 6) for c in ("ratio", "visible_ratio", "required_ratio")}),
    "v4_page_coverage": lambda s, d: coverage.page_coverage(b.pages(s, d), _items(s, d), "visible_covered"),
    "v4_deck_pages": lambda s, d: coverage.deck_page_coverage(coverage.page_coverage(b.pages(s, d), _items(s, d))),
    "v5_marker_only": lambda s, d: coverage.marker_only(_items(s, d)),
    "v6_figure_coverage": lambda s, d: coverage.figure_coverage(b.images(s, d).select("deck_id", "slide_id", "element_id", "path"), _linked_notes(s, d, False)),
    "v7_missing_view": lambda s, d: coverage.missing_view(_items(s, d)),
    "v8_lineage_diff": lambda s, d: coverage.lineage_diff(_contexts(s, d)).select("deck_id", *[F.array_join(c, ",").alias(c) for c in ("kept", "dropped", "added")]),
    "m1_markdown_blocks": lambda s, d: _blocks(s, d).select("deck_id", "slide_id", "ordinal", "kind", "line_start", "line_end"),
    "m2_heading_paths": lambda s, d: lineage.heading_paths(_blocks(s, d)).select("deck_id", "slide_id", "ordinal", F.array_join("path", "/").alias("path")),
    "m3_block_links": lambda s, d: lineage.block_links(_blocks(s, d), b.elements(s, d).select("deck_id", "element_id").unionByName(_pictures(s, d).select("deck_id", "element_id")), _pictures(s, d)),
    "m4_block_ids": lambda s, d: lineage.block_ids(lineage.heading_paths(_blocks(s, d)), _pictures(s, d)).select("deck_id", "slide_id", "ordinal", "block_id"),
    "m5_page_sources": lambda s, d: lineage.page_sources(b.elements(s, d)).select("deck_id", "slide_id", "n_elements", F.array_join("element_ids", ",").alias("element_ids")),
    "m6_note_excerpts": lambda s, d: lineage.note_excerpts(b.notes(s, d).groupBy("deck_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide_id", "markdown"))), lambda x: x["markdown"]), "\n\n").alias("markdown")), b.pages(s, d)).select("deck_id", "slide_id", F.md5("excerpt").alias("excerpt_md5")),
    "q1_note_quality": lambda s, d: lineage.note_quality(_headed(s, d), _page_images(s, d)),
    "q2_quality_risk": lambda s, d: lineage.quality_risk(lineage.note_quality(_headed(s, d), _page_images(s, d)), _page_missing(s, d)).select("deck_id", "slide_id", "risk", F.size("repairs").alias("n_repairs")),
}

_I = "WITH " + b.ITEMS_SQL.replace("items AS (", "items0 AS (") + guard_sql() + r""",
items AS (SELECT i.*, p.structural, g.element_id IS NOT NULL AS required FROM items0 i JOIN pages p USING (deck_id, slide_id) LEFT JOIN guard g ON g.deck_id = i.deck_id AND g.element_id = i.element_id AND g.must_explain AND g.confidence >= 0.7)"""
_HEADED = (
    "WITH RECURSIVE " + b.BLOCKS_SQL + r""",
headed AS (
  SELECT deck_id, slide_id, string_agg(t || CASE WHEN t = '' THEN '' ELSE chr(10) END || '<!-- source: p' || slide_id || ':' || element_id || ' -->', chr(10) || chr(10) ORDER BY n) AS markdown
  FROM (SELECT *, CASE WHEN length(content) > 200 THEN repeat('#', n % 3 + 1) || ' H' || n || chr(10) || chr(10) || content WHEN (doc_id + n) % 7 = 0 THEN '- ' || content WHEN (doc_id + n) % 7 = 1 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || content || ' |'
    WHEN (doc_id + n) % 7 = 2 THEN '![pic](assets/' || (n % 9) || '.png)' WHEN (doc_id + n) % 7 = 3 THEN '' ELSE content END AS t FROM blocks) GROUP BY ALL),
lines AS (SELECT deck_id, slide_id, unnest(string_split(markdown, chr(10))) AS line, CAST(generate_subscripts(string_split(markdown, chr(10)), 1) AS INTEGER) AS no FROM headed),
flags AS (SELECT *, trim(line, ' ') = '' AS blank FROM lines),
starts AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER w, true) AS st FROM flags WINDOW w AS (PARTITION BY deck_id, slide_id ORDER BY no)),
numbered AS (SELECT *, CAST(sum(st::INTEGER) OVER (PARTITION BY deck_id, slide_id ORDER BY no) AS BIGINT) AS ordinal FROM starts),
mb0 AS (SELECT deck_id, slide_id, ordinal, min(no) AS line_start, max(no) AS line_end, trim(string_agg(line, chr(10) ORDER BY no), ' ' || chr(10)) AS text FROM numbered WHERE NOT blank GROUP BY ALL),
mb AS (
  SELECT *, CASE WHEN regexp_matches(string_split(text, chr(10))[1], '^#{1,6}\s+\S') THEN 'heading' WHEN regexp_full_match(text, '(?s)(<!--.*?-->\s*)+') THEN 'source_marker' WHEN regexp_full_match(trim(regexp_replace(text, '<!--.*?-->', '', 'gs'), ' ' || chr(10)), '!\[[^\]]*\]\([^)]+\)') THEN 'image'
    WHEN starts_with(text, '|') AND regexp_full_match(trim(string_split(text, chr(10))[2]), '\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?') THEN 'table'
    WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^([-*+] |\d+[.)]\s+)'))) = 0 THEN 'list' ELSE 'paragraph' END AS kind FROM mb0),
heads AS (SELECT deck_id, slide_id, ordinal, length(regexp_extract(text, '^(#+)', 1)) AS lv, trim(regexp_replace(string_split(text, chr(10))[1], '^#+\s+', '')) AS title FROM mb WHERE kind = 'heading'),
paths AS (
  SELECT m.deck_id, m.slide_id, m.ordinal, string_agg(h.title, '/' ORDER BY h.ordinal) AS path, string_agg(h.title, ' / ' ORDER BY h.ordinal) AS wide FROM mb m LEFT JOIN heads h ON h.deck_id = m.deck_id AND h.slide_id = m.slide_id AND h.ordinal <= m.ordinal
    AND NOT EXISTS (SELECT 1 FROM heads k WHERE k.deck_id = h.deck_id AND k.slide_id = h.slide_id AND k.ordinal > h.ordinal AND k.ordinal <= m.ordinal AND k.lv <= h.lv) GROUP BY ALL),
pics AS (SELECT deck_id, 's1_img' || k AS element_id, k || '.png' AS name FROM (SELECT DISTINCT deck_id FROM pages), range(0, 9) AS r(k)),
named AS (
  SELECT DISTINCT * FROM (SELECT deck_id, slide_id, ordinal, unnest(regexp_extract_all(text, 's\d+_(?:t|tbl|img|fig)\d+')) AS element_id FROM mb
    UNION ALL SELECT m.deck_id, m.slide_id, m.ordinal, p.element_id FROM (SELECT *, unnest(regexp_extract_all(text, '!\[[^\]]*\]\((?:[^)]*/)?([^)/]+)\)', 1)) AS name FROM mb) m JOIN pics p ON p.deck_id = m.deck_id AND p.name = m.name)),
ids AS (
  SELECT m.*, coalesce(wide, '') AS wide, coalesce((SELECT string_agg(n.element_id, ',' ORDER BY n.element_id) FROM named n WHERE n.deck_id = m.deck_id AND n.slide_id = m.slide_id AND n.ordinal = m.ordinal), '') AS ids,
    trim(regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g')) AS seen FROM mb m JOIN paths USING (deck_id, slide_id, ordinal)),
bases AS (SELECT *, 'nb_' || CASE kind WHEN 'heading' THEN 'h' WHEN 'paragraph' THEN 'p' WHEN 'table' THEN 'tbl' WHEN 'image' THEN 'img' WHEN 'source_marker' THEN 'src' ELSE kind END || '_' || sha1(kind || chr(10) || wide || chr(10) || ids || chr(10) || seen)[1:12] AS base FROM ids),
bids AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_id, base ORDER BY ordinal) AS k FROM bases)"""
)
SQL = {
    "b1_preview": r"WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS p FROM documents) SELECT doc_id, CASE WHEN length(p) > 160 THEN p[1:159] || '…' ELSE p END AS preview FROM t",
    "b7_source_tokens": "WITH " + b.NOTES_SQL + r" SELECT deck_id, slide_id, CAST(len(list_distinct(regexp_extract_all(markdown, 's\d+_(?:t|tbl|img|fig)\d+'))) AS BIGINT) AS n_tokens FROM notes",
    "b8_slide_of": "WITH " + b.BLOCKS_SQL + " SELECT deck_id, element_id, slide_id AS slide FROM blocks",
    "b9_image_targets": "WITH " + b.IMAGES_SQL + " SELECT deck_id, CASE WHEN width % 2 = 0 THEN '../' ELSE '' END || path AS target, count(*) AS n FROM images GROUP BY ALL",
    "v1_coverage_items": _I + " SELECT deck_id, slide_id, element_id, trace_covered, visible_covered, structural, required, trace_covered AND NOT visible_covered AS marker_only FROM items",
    "v2_visible_tokens": _I + " SELECT DISTINCT deck_id, token FROM tokens WHERE visible",
    "v3_coverage_totals": _I + """, c AS (SELECT deck_id, count(*) AS total, count_if(trace_covered)::BIGINT AS covered, count_if(NOT structural)::BIGINT AS visible_total, count_if(NOT structural AND visible_covered)::BIGINT AS visible_covered, count_if(required)::BIGINT AS required_total, count_if(required AND visible_covered)::BIGINT AS required_covered FROM items GROUP BY deck_id)
        SELECT *, round(covered / total, 6) AS ratio, round(coalesce(visible_covered / nullif(visible_total, 0), 1), 6) AS visible_ratio, round(coalesce(required_covered / nullif(required_total, 0), 1), 6) AS required_ratio FROM c""",
    "v4_page_coverage": _I + """ SELECT p.deck_id, p.slide_id, count(element_id) AS expected_items, count_if(visible_covered)::BIGINT AS covered_items, (count(element_id) - count_if(visible_covered))::BIGINT AS missing_items,
        count(element_id) = 0 OR count_if(visible_covered) > 0 AS covered FROM pages p LEFT JOIN items i USING (deck_id, slide_id) GROUP BY ALL""",
    "v4_deck_pages": _I + """, per AS (SELECT p.deck_id, p.slide_id, count(element_id) AS n, count_if(trace_covered) AS c FROM pages p LEFT JOIN items i USING (deck_id, slide_id) GROUP BY ALL)
        SELECT deck_id, count(*) AS pages_total, count_if(n > 0)::BIGINT AS pages_expected, count_if(c > 0)::BIGINT AS covered_pages, count_if(n > 0 AND c = 0)::BIGINT AS missing_pages FROM per GROUP BY deck_id""",
    "v5_marker_only": _I + " SELECT deck_id, slide_id, element_id, structural FROM items WHERE trace_covered AND NOT visible_covered",
    "v6_figure_coverage": "WITH " + b.IMAGES_SQL + """, links AS (SELECT DISTINCT deck_id, CASE WHEN width % 2 = 0 THEN '../' ELSE '' END || path AS target FROM images WHERE CAST(element_id[-1] AS INTEGER) % 3 <> 0)
        SELECT deck_id, slide_id, element_id, path, EXISTS (SELECT 1 FROM links l WHERE l.deck_id = i.deck_id AND ends_with(l.target, i.path)) AS covered FROM images i""",
    "v7_missing_view": _I + """ SELECT deck_id, element_id, slide_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY slide_id, element_id) AS INTEGER) AS rank FROM items WHERE NOT trace_covered) WHERE rank <= 200""",
    "v8_lineage_diff": r"""WITH c AS (SELECT conv_id AS deck_id, role, 's' || (turn % 3) || '_t' || (length(text) % 7) AS t FROM conversations),
        g AS (SELECT deck_id, list_distinct(coalesce(list(t) FILTER (role = 'user'), [])) AS i, list_distinct(coalesce(list(t) FILTER (role = 'assistant'), [])) AS o FROM c GROUP BY deck_id)
        SELECT deck_id, coalesce(array_to_string(list_sort(list_intersect(i, o)), ','), '') AS kept, coalesce(array_to_string(list_sort(list_filter(i, lambda x: NOT list_contains(o, x))), ','), '') AS dropped,
               coalesce(array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(i, x))), ','), '') AS added FROM g""",
    "m1_markdown_blocks": _HEADED + " SELECT deck_id, slide_id, ordinal, kind, line_start, line_end FROM mb",
    "m2_heading_paths": _HEADED + " SELECT deck_id, slide_id, ordinal, coalesce(path, '') AS path FROM paths",
    "m3_block_links": _HEADED + " SELECT n.* FROM named n SEMI JOIN (SELECT deck_id, element_id FROM blocks UNION ALL SELECT deck_id, element_id FROM pics) e ON e.deck_id = n.deck_id AND e.element_id = n.element_id",
    "m4_block_ids": _HEADED + " SELECT deck_id, slide_id, ordinal, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS block_id FROM bids",
    "q1_note_quality": _HEADED + r""", ch AS (SELECT deck_id, slide_id, trim(unnest(regexp_split_to_array(markdown, '\n\s*\n')), ' ' || chr(10)) AS c FROM headed), pa AS (SELECT deck_id, slide_id, count(*) AS n, sum(length(c)) AS l FROM ch WHERE c <> '' AND NOT regexp_matches(c, '^(#|<!--|!\[|\|)') GROUP BY ALL),
        im AS (SELECT deck_id, slide_id, count_if(doc_id % 2 <> 0)::BIGINT AS source_images FROM pages GROUP BY ALL),
        q AS (SELECT h.deck_id, h.slide_id, markdown AS md, lower(markdown) AS lo, CAST(coalesce(n, 0) AS INTEGER) AS paragraphs, coalesce(l / n, 0) AS mean, CAST(len(regexp_extract_all(markdown, '(?m)^#{2,4}\s+')) AS INTEGER) AS headings, CAST(len(regexp_extract_all(markdown, '<!--\s*source:')) AS INTEGER) AS source_markers,
          CAST(len(regexp_extract_all(markdown, '!\[[^\]]*\]\([^)]+\)')) AS INTEGER) AS image_refs, coalesce(source_images, 0)::BIGINT AS source_images FROM headed h LEFT JOIN pa USING (deck_id, slide_id) LEFT JOIN im USING (deck_id, slide_id)),
        k AS (SELECT *, """ + ", ".join(f"list_sum(list_transform([{', '.join(repr(w) for w in words)}], lambda w: (length({col}) - length(replace({col}, w, ''))) / length(w))) AS {name}" for name, col, words in (("kd", "lo", lineage.DEPTH), ("ke", "lo", lineage.EXAMPLES), ("ks", "lo", lineage.SELF_TEST), ("kp", "lo", lineage.PITFALLS), ("kf", "md", lineage.FIGURE_TERMS))) + r""" FROM q)
        SELECT deck_id, slide_id, paragraphs, headings, source_markers, image_refs, source_images, CASE WHEN paragraphs = 0 THEN 0 ELSE round(0.42 * least(1.0, paragraphs / 8) + 0.28 * CASE WHEN headings > 0 THEN least(1.0, headings / 5) ELSE 0.25 END + 0.30 * least(1.0, mean / 180), 3) END::DOUBLE AS coherence_score,
          round(least(1, mean / 220 + kd / 8), 3)::DOUBLE AS explanation_depth_score, round(least(1, ke / 8), 3)::DOUBLE AS example_score, CASE WHEN source_images = 0 THEN 1 ELSE round(0.55 * least(1.0, image_refs / greatest(1, source_images)) + 0.45 * least(1.0, kf / greatest(2, image_refs * 2)), 3) END::DOUBLE AS figure_integration_score,
          round(least(1.0, (len(regexp_extract_all(lo, 'slide\s*\d+|this page|on this slide|第\s*\d+\s*[页张]|幻灯片\s*\d+')) + 2 * len(regexp_extract_all(md, '(?mi)^#{2,4}\s*(第\s*\d+\s*页|slide\s*\d+)'))) / greatest(1.0, length(md) / 1000) / 3), 3)::DOUBLE AS mechanical_page_listing_score,
          round(least(1, ks / 8), 3)::DOUBLE AS self_test_score, round(least(1, kp / 8), 3)::DOUBLE AS pitfall_score FROM k""",
    "m5_page_sources": "WITH " + b.BLOCKS_SQL + " SELECT deck_id, slide_id, count(*) AS n_elements, string_agg(element_id, ',' ORDER BY element_id) AS element_ids FROM blocks GROUP BY ALL",
}


def _risk_sql() -> str:
    """The risk of notes: q1's scores beside what coverage misses on each page."""
    body = SQL["q1_note_quality"][len(_HEADED):]
    at = body.rindex("        SELECT deck_id, slide_id, paragraphs")
    return (
        "WITH RECURSIVE " + _I[len("WITH ") :] + _HEADED[len("WITH RECURSIVE " + b.BLOCKS_SQL) :] + body[:at] + ", q1 AS (" + body[at:] + r"""),
        lost AS (SELECT deck_id, slide_id, count_if(NOT trace_covered) AS missing, count_if(required AND NOT visible_covered) AS required_missing FROM items GROUP BY ALL)
        SELECT q1.deck_id, q1.slide_id, CASE WHEN coalesce(required_missing, 0) > 0 THEN 'high' WHEN coalesce(missing, 0) > 0 OR source_markers / greatest(1, paragraphs) < 0.45 THEN 'medium' ELSE 'low' END AS risk,
          CAST((explanation_depth_score < 0.55)::INT + (example_score < 0.35)::INT + (source_images > 0 AND figure_integration_score < 0.55)::INT + (mechanical_page_listing_score > 0.35)::INT + (self_test_score < 0.25)::INT + (pitfall_score < 0.25)::INT AS INTEGER) AS n_repairs
        FROM q1 LEFT JOIN lost ON lost.deck_id = q1.deck_id AND lost.slide_id = q1.slide_id"""
    )


SQL["q2_quality_risk"] = _risk_sql()
