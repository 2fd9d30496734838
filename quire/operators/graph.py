"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import dropped, stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Nodes of ``edges`` with the smallest node that links lead to.

    Returns ``(node, component)`` for every node on an edge. In each round every
    node hooks onto its smallest neighbour, if that is smaller, the hooks are
    followed to their ends, each time twice as far, and the links between the
    ends go to the next round. A chain of n links takes about log n steps in
    whatever order its nodes stand. Loops (src = dst), edges met twice and edges
    with a null end change nothing; no edges give no rows.
    """
    one = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"), (F.col(src) != F.col(dst)).alias("differ"))
    left = stored(one.where("differ").select("a", "b").distinct())
    labels, rows = None, left.count()  # links; there are no more hooks than links
    for _ in range(max_rounds):
        ends = _ends(stored(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), rows), max_rounds, rows)
        was, labels = labels, ends if labels is None else stored(_moved(labels, ends, "component").unionByName(ends), rows)
        moved = _moved(_moved(left, ends, "a"), ends, "b").where("a <> b")
        old, left = left, stored(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
        dropped(old, was, ends if labels is not ends else None)
        if left.isEmpty():
            dropped(left)
            return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _ends(hooks: DataFrame, max_rounds: int, rows: int) -> DataFrame:
    """Hooks (node, component) followed until no component is itself a node."""
    for _ in range(max_rounds):
        nodes = hooks.select(F.col("node").alias("component"))
        if not hooks.select("component").distinct().join(nodes, "component", "left_semi").limit(1).count():
            return hooks
        old, hooks = hooks, stored(_moved(hooks, hooks, "component"), rows)
        dropped(old)
    raise RuntimeError(f"hooks did not settle in {max_rounds} rounds")


def _moved(rows: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    """``rows`` with the values of ``column`` that are nodes of ``ends`` replaced by their components."""
    other = ends.select(F.col("node").alias("__node"), F.col("component").alias("__end"))
    return rows.join(other, rows[column] == other["__node"], "left").withColumn(column, F.coalesce("__end", column)).select(*rows.columns)
