"""How much of the source a note covers: items, totals, pages, figures, and what was lost between contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import image_targets, is_visible, preview, slide_of, source_tokens


def trace_tokens(notes: DataFrame) -> DataFrame:
    """(deck_id, markdown) → distinct (deck_id, token) of all element ids in the notes."""
    return notes.select("deck_id", F.explode(source_tokens(F.col("markdown"))).alias("token")).distinct()


def visible_tokens(notes: DataFrame) -> DataFrame:
    """Distinct (deck_id, token) of the blocks, cut at blank lines, that say something beside their marks."""
    blocks = notes.select("deck_id", F.explode(F.split("markdown", r"\n\s*\n")).alias("block"))
    return blocks.where(is_visible(F.col("block"))).select("deck_id", F.explode(source_tokens(F.col("block"))).alias("token")).distinct()


def coverage_items(elements: DataFrame, notes: DataFrame, structural: DataFrame | None = None, required: DataFrame | None = None) -> DataFrame:
    """Expected elements with their flags: trace_covered, visible_covered, structural, required, marker_only.

    elements: deck_id, slide_id, element_id, kind, text. structural: deck_id, slide_id of pages whose items need
    no explanation. required: deck_id, element_id. Joins are on (deck_id, id), so equal ids of two decks differ.
    """
    out = elements.where("element_id is not null and element_id <> ''")
    for tokens, flag in ((trace_tokens(notes), "trace_covered"), (visible_tokens(notes), "visible_covered")):
        marked = tokens.select("deck_id", F.col("token").alias("element_id"), F.lit(True).alias(flag))
        out = out.join(marked, ["deck_id", "element_id"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    for table, keys, flag in ((structural, ["deck_id", "slide_id"], "structural"), (required, ["deck_id", "element_id"], "required")):
        if table is None:
            out = out.withColumn(flag, F.lit(False))
        else:
            out = out.join(table.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out.select(
        "deck_id", "slide_id", "element_id", "kind", "trace_covered", "visible_covered", "structural", "required",
        (F.col("trace_covered") & ~F.col("visible_covered")).alias("marker_only"), preview(F.coalesce("text", "element_id"), 120).alias("preview"),
    )


def coverage_totals(items: DataFrame) -> DataFrame:
    """Per deck: total, covered and ratio over all items by trace, over items that aren't structural and over required ones by visibility."""
    open_, need = ~F.col("structural"), F.col("required")
    counts = items.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("trace_covered").alias("covered"),
        F.count_if(open_).alias("visible_total"), F.count_if(open_ & F.col("visible_covered")).alias("visible_covered"),
        F.count_if(need).alias("required_total"), F.count_if(need & F.col("visible_covered")).alias("required_covered"),
    )

    def ratio(covered: str, total: str):
        return F.coalesce(F.try_divide(F.col(covered), F.col(total)), F.lit(1.0))

    return counts.withColumns({"ratio": ratio("covered", "total"), "visible_ratio": ratio("visible_covered", "visible_total"), "required_ratio": ratio("required_covered", "required_total")})


def page_coverage(pages: DataFrame, items: DataFrame, flag: str = "trace_covered") -> DataFrame:
    """Per page: expected, covered and missing items; a page without expected items counts as covered."""
    per = items.groupBy("deck_id", "slide_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(flag).alias("covered_items"))
    zero = F.lit(0).cast("bigint")
    joined = pages.select("deck_id", "slide_id").join(per, ["deck_id", "slide_id"], "left")
    return joined.select(
        "deck_id", "slide_id", F.coalesce("expected", zero).alias("expected_items"), F.coalesce("covered_items", zero).alias("covered_items"),
        (F.coalesce("expected", zero) - F.coalesce("covered_items", zero)).alias("missing_items"), (F.col("expected").isNull() | (F.col("covered_items") > 0)).alias("covered"),
    )


def deck_page_coverage(per_page: DataFrame) -> DataFrame:
    """Per deck: pages, pages with expected items, those covered and those missing."""
    return per_page.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("pages_total"), F.count_if(F.col("expected_items") > 0).alias("pages_expected"),
        F.count_if((F.col("expected_items") > 0) & F.col("covered")).alias("covered_pages"), F.count_if(~F.col("covered")).alias("missing_pages"),
    )


def marker_only(items: DataFrame) -> DataFrame:
    """Items that a mark names but no text explains, with whether they are of a structural page."""
    return items.where("marker_only").select("deck_id", "slide_id", "element_id", "structural")


def figure_coverage(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Images that may stand in notes (deck_id, slide_id, element_id, path) + covered: a link of the deck's notes is the path or ends in it.

    A path with a folder ends a link only if the file names are equal, so those join on deck and name; bare
    names join on the last eight characters (shorter ones on their last), since any longer name may end in them.
    """
    links = notes.select("deck_id", F.explode(image_targets(F.col("markdown"))).alias("target")).distinct()

    def tails(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.right(c, n)))

    named = images.where("path <> ''").select("deck_id", "path").distinct().withColumn("tail", F.right(F.col("path"), F.lit(8)))
    hit = named.join(links.withColumn("tail", F.explode(tails(F.col("target")))), ["deck_id", "tail"]).where(F.col("target").endswith(F.col("path"))).select("deck_id", "path").distinct()
    return images.join(hit.withColumn("covered", F.lit(True)), ["deck_id", "path"], "left").select(*images.columns, F.coalesce("covered", F.lit(False)).alias("covered"))


def figure_totals(figures: DataFrame) -> DataFrame:
    """Per deck: figures, covered, missing, anchored, explained and in need of review (anchor_id, explanation_status, audit_status)."""
    return figures.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("total_figures"), F.count_if("covered").alias("covered_figures"), F.count_if(~F.col("covered")).alias("missing_figures"), F.count_if(F.col("anchor_id").isNotNull()).alias("anchored_figures"),
        F.count_if(F.coalesce("explanation_status", F.lit("missing")) != "missing").alias("explained_figures"), F.count_if(F.col("audit_status") == "needs_review").alias("needs_review"),
    )


def missing_view(items: DataFrame, cap: int = 200) -> DataFrame:
    """Uncovered items of each deck for review, the first ``cap`` by page and id."""
    first = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id", "element_id"))
    return items.where("not trace_covered").withColumn("rank", first).where(F.col("rank") <= cap).select("deck_id", "element_id", slide_of(F.col("element_id")).alias("slide_id"), "rank")


def lineage_diff(contexts: DataFrame) -> DataFrame:
    """(deck_id, context, input, output) texts → ids in both, possibly dropped and possibly added, sorted."""
    a, b = F.array_sort(source_tokens(F.col("input"))), F.array_sort(source_tokens(F.col("output")))
    return contexts.select("deck_id", "context", F.array_intersect(a, b).alias("kept"), F.array_except(a, b).alias("dropped"), F.array_except(b, a).alias("added"))
