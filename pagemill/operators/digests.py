"""Digests of pages and decks: a tree of ranges, so that a changed page asks only for the nodes above it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Children of a node at most, and levels: three levels of 1,024 reach over all page numbers of 30 bits.
WIDTH, LEVELS = 1024, 3


def _above(children: DataFrame, level: int) -> DataFrame:
    """(deck_id, node, digest) → the level above: each node's digest is that of its children's digests, in order, one a line."""
    parent = F.floor(F.col("node") / WIDTH)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])
    made = children.groupBy("deck_id", parent.alias("parent")).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))
    return made.select("deck_id", F.lit(level).alias("level"), F.col("parent").alias("node"), "digest")


def _leaves(pages: DataFrame) -> DataFrame:
    return pages.select("deck_id", F.col("slide_id").cast("bigint").alias("node"), "digest")


def digest_tree(pages: DataFrame) -> DataFrame:
    """(deck_id, slide_id, digest) → deck_id, level, node, digest of all ranges of pages; the last level has one node per deck.

    No deck is gathered: a node has at most WIDTH children. Page numbers are from 0 to 2**30 - 1.
    """
    levels, below = [], _leaves(pages)
    for level in range(1, LEVELS + 1):
        levels.append(_above(below, level))
        below = levels[-1]
    return reduce(DataFrame.unionByName, levels)


def refresh_tree(tree: DataFrame, pages: DataFrame, changed: DataFrame) -> DataFrame:
    """tree with the nodes above changed pages (deck_id, slide_id) made anew from pages, all pages as they are now; others stay.

    Only children of those nodes are read for it: WIDTH at each level for a changed page. A range whose pages are
    all gone has no node; a deck without pages has none.
    """
    out, below = [], _leaves(pages)
    touched = changed.select("deck_id", F.col("slide_id").cast("bigint").alias("node"))
    for level in range(1, LEVELS + 1):
        touched = touched.select("deck_id", F.floor(F.col("node") / WIDTH).alias("node")).distinct()
        children = below.withColumn("_p", F.floor(F.col("node") / WIDTH)).join(touched.withColumnRenamed("node", "_p"), ["deck_id", "_p"], "left_semi")
        kept = tree.where(F.col("level") == level).join(touched, ["deck_id", "node"], "left_anti")
        below = kept.select("deck_id", "level", "node", "digest").unionByName(_above(children, level))
        out.append(below)
    return reduce(DataFrame.unionByName, out)


def deck_digests(tree: DataFrame) -> DataFrame:
    """(deck_id, digest): the digest at the top of each deck's tree."""
    return tree.where(F.col("level") == LEVELS).select("deck_id", "digest")
