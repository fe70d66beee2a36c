"""Connected components of a link table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_unique, materialise


def connected_components(links: DataFrame, rows: int = BROADCAST_ROWS, least: int = 10_000) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Each round hooks every node to the smallest node next to it, follows the
    hooks to their roots by doubling, and rewrites the links between roots,
    dropping those that have become loops. Neighbours are never
    gathered in a list: a hub costs one partial minimum per task, and joins
    broadcast hot keys (``join_unique``, whose bounds ``rows`` and ``least``
    are). Null ends and loops link nothing. A chain takes as many
    doublings as the logarithm of its length; each ends in a table in the shared folder.
    """
    both = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = materialise(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = sides.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("to"))
        nearest = materialise(nearest, "hooks")
        hooked = _shortened(nearest, rows, least)
        if labels is None:
            labels = hooked.select("node", F.col("to").alias("component"))
        else:
            moved = hooked.select(F.col("node").alias("component"), "to")
            labels = join_unique(labels, moved, ["component"], "left", rows, least).select("node", F.coalesce("to", "component").alias("component"))
        labels = materialise(labels, "labels")
        a_to, b_to = hooked.select(F.col("node").alias("a"), F.col("to").alias("x")), hooked.select(F.col("node").alias("b"), F.col("to").alias("y"))
        half = join_unique(edges, a_to, ["a"], "inner", rows, least)
        joined = join_unique(materialise(half, "half") if hooked.limit(rows + 1).count() > rows else half, b_to, ["b"], "inner", rows, least).filter("x <> y")
        edges = materialise(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _shortened(hooks: DataFrame, rows: int, least: int) -> DataFrame:
    """(node, to) with every hook followed to its root; each pass doubles what a hook spans."""
    while True:
        onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        passed = materialise(join_unique(hooks, onward, ["to"], "inner", rows, least).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hooked")
        if passed.filter("moved").isEmpty():
            return passed.select("node", "to")
        hooks = passed.select("node", "to")
