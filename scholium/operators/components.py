"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import dropped, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)``: the smallest node id reachable over undirected ``edges``.

    Nodes that occur only in self loops or with a null end have no row; an empty table gives an empty one. Each round is
    two equi-joins and two partially aggregated minima; no group of neighbours is ever collected in one task, and the
    lineage is cut by a table in the shared folder.
    """
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    ends = known.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v")
    now = written(ends.distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = now.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(small_min.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(after)
        dropped(now)
        now = after
        if before == mark:
            break
    else:
        raise RuntimeError(f"connected_components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
