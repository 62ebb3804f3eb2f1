"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour. A hub's neighbours aren't gathered: its minimum is aggregated and joined back."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("__u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    named = least.select(F.col("u").alias("__u"), "m")
    moved = edges.join(named, F.col("u") == F.col("__u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs -> (node, root): root is the least node that node reaches, for each node that isn't its own root.

    Loops and repeated edges do no harm; edges with a null end are ignored. Each round's edges are written to the shared
    folder, so that neither the plan nor the work after a lost executor grows with the rounds; the driver sees two
    numbers a round. It raises if the edges haven't settled after most_rounds (their number is logarithmic in the nodes).
    """
    from decimal import Decimal

    spark = edges.sparkSession
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = stored(both, "edges"), None
    for _ in range(most_rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        seen = (found["n"], found["s"] or Decimal(0))
        if seen == mark or not found["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        after = stored(_small_star(_large_star(now)), "edges")
        forget(now)
        now = after
    raise RuntimeError(f"components of {spark.sparkContext.appName} haven't settled in {most_rounds} rounds")
