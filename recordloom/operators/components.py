"""Connected components over a table of edges, by alternating stars.

Each round hangs every node's larger neighbours on its least one, then every node's smaller neighbours likewise, until
the edges stand still; they are then stars whose centre is the least node of the component. Hubs cost no memory: a star
is a minimum per node joined back to the edges, never a collected list. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import Workspace


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, workspace: Workspace, label: str = "components") -> DataFrame:
    """node, label for every node of an edge (columns a, b); label is the least node reachable. Loops and
    repeated edges are allowed; no edges give no rows."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = workspace.keep_small(edges.where("a <> b").select(u, v).distinct(), f"{label}-0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
    seen, step = mark(now), 0
    while seen[0]:
        step += 1
        now = workspace.keep_small(_small(_large(now)), f"{label}-{step}")
        workspace.drop(f"{label}-{step - 1}")
        last, seen = seen, mark(now)
        if seen == last:
            break
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
