"""Connected components of an edge table by alternating large-star and small-star steps (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for each node that has an edge to another node.

    Each round hangs larger neighbours, then smaller ones, on the smallest node known to each node; the number of
    rounds grows with the logarithm of the longest path. Edges with a null end and loops are ignored. Each round is
    written to the shared folder, so lineage stays one round long.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    links = materialize(links, "components")
    for _ in range(max_rounds):
        if _is_star_forest(links):
            break
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "components")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(small.where("u <> v").distinct(), "components")
        drop(links)
        drop(large)
        links = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_star_forest(links: DataFrame) -> bool:
    """Every edge leads from a node with one edge to a smaller node that leads nowhere."""
    roles = links.select(F.col("u").alias("n"), F.lit(1).alias("out"), (F.col("v") > F.col("u")).cast("int").alias("up")).unionAll(links.select(F.col("v").alias("n"), F.lit(1 << 40).alias("out"), F.lit(0).alias("up")))
    # a node is fine as one leaf (out = 1) or as any number of centres (a multiple of 2^40)
    bad = roles.groupBy("n").agg(F.sum(F.col("out").cast("long")).alias("out"), F.max("up").alias("up")).where(f"up > 0 or (out % {1 << 40} > 0 and out <> 1)")
    return bad.isEmpty()
