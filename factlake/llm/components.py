"""Connected components of a link table, by hooking roots and shortening paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import Workspace


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node that is not the smallest of its own component.

    links: a, b (long), a < b. Each round hooks every root that has a smaller neighbour to the smallest one, then follows the
    hooks to their ends by doubling; the roots that remain are at most half of those that had a neighbour. Only counts reach the driver.
    """
    where = None  # node, component
    edges = work.keep(links.select("a", "b"))
    while edges.head(1):
        hooks = work.keep(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")))
        while True:  # until no hook's end has a hook itself
            ends = hooks.select(F.col("node").alias("component"), F.col("component").alias("further"))
            longer = work.keep(hooks.join(ends, "component", "left").select("node", F.coalesce("further", "component").alias("component"), F.col("further").isNotNull().alias("moved")))
            moved = longer.filter("moved").head(1)
            hooks = longer.drop("moved")
            if not moved:
                break
        ends = hooks.select(F.col("node").alias("component"), F.col("component").alias("further"))
        if where is None:
            where = hooks
        else:
            where = work.keep(where.join(ends, "component", "left").select("node", F.coalesce("further", "component").alias("component")).unionByName(hooks))
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}"))
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y")).filter("x <> y")
        edges = work.keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return where if where is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
