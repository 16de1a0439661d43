"""Connected components of an edge table, by repeated contraction to neighbourhood minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long, either direction, repeats allowed) -> (node, root), root the same for all nodes that edges connect.

    Each round maps a node to the least of its closed neighbourhood and contracts the edges; with
    hashes as ids at least about half the nodes of every component go in a round. Tables of a round
    are written to the shared folder, so lineage stays short and nothing passes the driver but
    whether any edge is left.
    """
    maps = []
    now = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = materialize(now, "cc-edges")
    while not now.isEmpty():
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "cc-map")
        maps.append(least)
        a, b = least.select(F.col("node").alias("u"), F.col("to").alias("a")), least.select(F.col("node").alias("v"), F.col("to").alias("b"))
        moved = now.join(a, "u").join(b, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        now = materialize(moved, "cc-edges")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(out, "cc-roots") if len(maps) > 1 else out
