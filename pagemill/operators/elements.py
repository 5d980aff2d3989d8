"""One table of all elements: roles, confidence, state, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import layout_order

_PAGE = ["deck_id", "slide_id"]


def build_elements(text: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Text, table, image and group elements in one schema. An ignored image and a group aren't expected in notes."""
    parts = []
    for kind, df in (("text", text), ("table", tables), ("image", images), ("group", groups)):
        if df is not None:
            get = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in (("bbox", "array<double>"), ("confidence", "double"), ("ignored", "boolean"), ("role", "string"))}
            ignored = F.coalesce(get["ignored"], F.lit(False))
            parts.append(df.select(*_PAGE, "element_id", F.lit(kind).alias("kind"), get["bbox"].alias("bbox"), get["role"].alias("role"), get["confidence"].alias("confidence"), ignored.alias("ignored"), (~ignored & F.lit(kind != "group")).alias("expected")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("layout_order", layout_order(F.col("bbox"), None))


def enrich(elements: DataFrame, guard: DataFrame, semantic: DataFrame) -> DataFrame:
    """elements + learning_role, must_explain, confidence and its source: the guard's value, else the layout's, else the element's, else 0.5. The last of duplicate ids counts."""
    keys = ["deck_id", "element_id"]
    g = guard.groupBy(*keys).agg(F.max_by(F.struct("learning_role", "must_explain", "confidence"), "pos").alias("g"))
    s = semantic.groupBy(*keys).agg(F.max_by(F.struct("learning_role", "must_explain", "confidence"), "pos").alias("s"))
    joined = elements.join(g, keys, "left").join(s, keys, "left")
    source = F.when(F.col("g.confidence").isNotNull(), "guard").when(F.col("s.confidence").isNotNull(), "semantic").when(F.col("confidence").isNotNull(), "element").otherwise("default")
    value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("g.confidence", "s.confidence", "confidence", F.lit(0.5)))), 3)
    return joined.select(*[c for c in elements.columns if c != "confidence"], F.coalesce("g.learning_role", "s.learning_role").alias("learning_role"), F.coalesce("g.must_explain", "s.must_explain").alias("must_explain"), value.alias("confidence"), source.alias("confidence_source"))


def coverage_state(elements: DataFrame, coverage: DataFrame) -> DataFrame:
    """elements + state: structural_group, ignored, visible_covered, marker_only, missing_required, missing, required or expected."""
    c = coverage.select("deck_id", "element_id", "trace_covered", "visible_covered", F.col("required").alias("_req"))
    joined = elements.join(c, ["deck_id", "element_id"], "left")
    known = F.col("trace_covered").isNotNull()
    state = (
        F.when(F.col("kind") == "group", "structural_group").when(F.col("ignored"), "ignored").when(F.col("visible_covered"), "visible_covered").when(F.col("trace_covered"), "marker_only")
        .when(known & F.col("_req"), "missing_required").when(known, "missing").when(F.coalesce("must_explain", F.lit(False)), "required").otherwise("expected")
    )
    return joined.select(*elements.columns, state.alias("state"))


def reading_order(elements: DataFrame) -> DataFrame:
    """elements + reading_order within the page: by layout order, those without last, then by kind and id."""
    kind = F.array_position(F.array(*map(F.lit, ("text", "table", "image", "group"))), F.col("kind"))
    return elements.withColumn("reading_order", F.row_number().over(Window.partitionBy(*_PAGE).orderBy(F.col("layout_order").asc_nulls_last(), kind, "element_id")))


def expected_elements(elements: DataFrame) -> DataFrame:
    return elements.where("expected")


def primary_role(kind: Column, learning_role: Column, text_type: Column, block_type: Column, image_role: Column, scene_type: Column) -> Column:
    """An element's role: what it teaches, else its own type, else its kind."""
    def first(*parts: Column) -> Column:
        return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], kind)

    return F.when(kind == "text", first(learning_role, text_type)).when(kind == "table", first(learning_role, block_type)).when(kind == "image", first(learning_role, image_role, block_type)).when(kind == "group", first(scene_type)).otherwise(kind)


def element_index(elements: DataFrame, details: DataFrame) -> DataFrame:
    """(deck_id, element_id, slide_id, ref): a reference for each element that is no group, as JSON of what its kind has.

    details: deck_id, element_id and columns of the kinds: preview, element_type, table_summary, table_conclusion,
    path, role, importance, anchor_id. Fields that an element lacks are left out.
    """
    known = [c for c in ("preview", "element_type", "table_summary", "table_conclusion", "path", "image_role", "importance", "anchor_id") if c in details.columns]
    joined = elements.where("kind <> 'group' and element_id <> ''").join(details.select("deck_id", "element_id", *known), ["deck_id", "element_id"], "left")
    own = [c for c in ("kind", "slide_id", "element_id", "bbox", "role", "confidence", "layout_order", "state") if c in elements.columns]
    return joined.select("deck_id", "element_id", "slide_id", F.to_json(F.struct(*own, *known)).alias("ref"))
