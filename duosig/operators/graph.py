"""Connected components of links, by aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of edges (u, v), which may be of any kind that has an order: root is the smallest node of a component.

    In turn every node's larger neighbours are tied to its smallest one, and its smaller neighbours to the smallest of these, until each
    node has one edge, to its root. No task holds a component; a round's edges are a table.
    """
    apart = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    at, before = edges, None
    for _ in range(rounds):
        both = at.where("u <> v").select("u", "v").unionByName(at.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        tied = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = tied.groupBy("u").agg(F.min("v").alias("m"))
        moved = apart(tied.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))))
        at = stored(moved)
        after = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == before or not after["n"]:
            break
        before = after
    else:
        raise RuntimeError(f"no end of the component search after {rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
