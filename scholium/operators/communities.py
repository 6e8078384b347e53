"""Communities kept up to date: components that follow new edges, and what is known of each, changed only where an edge touches.

A node carries the label it was first seen with; a small table says which component a label belongs to now, so that merging two
communities writes no node. A community's row has its size, concepts, summary, whether it is stale, its size when it was last summarised
and the day. Untouched communities are neither read for their members nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_path, written
from ..streaming.tables import KeyedTable
from .components import connected_components
from .graph import key_concepts

COMMUNITY = "component long, size long, concepts string, summary string, dirty boolean, size_at_last_summary long, last_updated string"


class Communities:
    """Batches of ``nodes (id, name, mentions)`` and ``edges (src, dst)``; ids are longs, a component's id is its smallest node."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 16):
        self.spark, self.folder = spark, folder or new_path(spark, "communities")
        table = lambda schema, key: KeyedTable(spark, schema, key, f"{self.folder}/{key}", buckets)
        self.nodes = table("id long, name string, mentions long, label long", "id")
        self.labels = table("label long, component long", "label")
        self.told = table(COMMUNITY, "component")

    def members(self) -> DataFrame:
        """Rows ``(id, name, mentions, component)``."""
        return self.nodes.read().join(self.labels.read(), "label").drop("label")

    def communities(self) -> DataFrame:
        return self.told.read()

    def add(self, nodes: DataFrame, edges: DataFrame, tag: str) -> None:
        """Apply a batch; one that is applied again under its tag changes nothing. Edges to unknown nodes and null ends are left out;
        a node that comes again takes its new name and mentions. Rounds and writes grow with the batch and what it touches."""
        if self.told.done(tag):
            return
        came = written(nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("mentions", "name")).alias("r")).select("id", "r.name", "r.mentions"), "came")
        ends = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
        old = self.members().select("id", "component")
        # Where the batch's own nodes and the ends of its edges are now; a new node is a component of its own.
        used = came.select("id").unionByName(ends.select(F.col("src").alias("id"))).unionByName(ends.select(F.col("dst").alias("id"))).distinct()
        known = old.join(used, "id", "left_semi")
        here = written(known.unionByName(came.join(known, "id", "left_anti").select("id", F.col("id").alias("component"))), "here")
        at = lambda end: here.select(F.col("id").alias(end), F.col("component").alias(f"{end}_at"))
        between = ends.join(at("src"), "src").join(at("dst"), "dst").where("src_at <> dst_at")
        merged = written(connected_components(between, "src_at", "dst_at").select(F.col("node").alias("was"), "component"), "merged")
        moved = written(here.select(F.col("component").alias("was")).distinct().join(merged, "was", "left").select("was", F.coalesce("component", "was").alias("component")), "moved")
        grew = came.join(known, "id", "left_anti").select("id").persist()
        # What must be told anew: components that merged, or got a node, or whose nodes changed.
        touched = written(here.join(came.select("id"), "id", "left_semi").select(F.col("component").alias("was")).unionByName(merged.select("was")).distinct().join(moved, "was").select("component").distinct(), "touched")
        parents = self.told.read().join(moved.select(F.col("was").alias("component"), F.col("component").alias("into")), "component").join(touched.select(F.col("component").alias("into")), "into", "left_semi")
        parents = written(parents.groupBy("into").agg(F.count(F.lit(1)).alias("n_old"), F.min(F.struct("component", "size", "summary", "dirty", "size_at_last_summary", "last_updated")).alias("p")), "parents")

        def put(rows: DataFrame, key: str):
            return lambda before: before.join(rows.select(key), key, "left_anti").unionByName(rows.select(*before.columns))

        fresh = came.join(grew, "id", "left_semi").withColumn("label", F.col("id"))
        again = self.nodes.read().select("id", "label").join(came, "id")
        self.nodes.change(came, put(written(fresh.select("id", "name", "mentions", "label").unionByName(again.select("id", "name", "mentions", "label")), "nodes"), "id"), tag)
        gone = moved.where("was <> component")
        relabelled = written(self.labels.read().join(gone.withColumnRenamed("component", "into"), F.col("component") == F.col("was")).select("label", F.col("into").alias("component")), "relabelled")
        new = grew.select(F.col("id").alias("label")).join(moved.select(F.col("was").alias("label"), "component"), "label")
        labels = written(relabelled.join(new, "label", "left_anti").unionByName(new), "labels")
        self.labels.change(labels, put(labels, "label"), tag)
        grew.unpersist()
        inside = self.nodes.read().join(self.labels.read().join(touched, "component", "left_semi"), "label").select("component", "name", "mentions")
        sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        now = sizes.join(key_concepts(inside), "component").join(parents.withColumnRenamed("into", "component"), "component", "left")
        one, same = F.col("n_old") == 1, (F.col("n_old") == 1) & (F.col("p.size") == F.col("size"))
        rows = written(now.select(
            "component", "size", "concepts", F.when(one, F.col("p.summary")).otherwise("").alias("summary"), F.when(same, F.col("p.dirty")).otherwise(True).alias("dirty"),
            F.when(one, F.col("p.size_at_last_summary")).otherwise(0).cast("long").alias("size_at_last_summary"), F.when(same, F.col("p.last_updated")).alias("last_updated"),
        ), "told")
        out = rows.select("component").unionByName(gone.select(F.col("was").alias("component"))).distinct()
        self.told.change(out, lambda before: before.join(out, "component", "left_anti").unionByName(rows.select(*before.columns)), tag)

    def summarised(self, summaries: DataFrame, day: str, tag: str) -> None:
        """Take ``summaries (component, summary)``: those communities are no longer stale, as of ``day``."""
        got = summaries.select("component", F.col("summary").alias("said"))

        def told(before: DataFrame) -> DataFrame:
            both = before.join(got, "component", "left")
            new = F.col("said").isNotNull()
            return both.select(
                "component", "size", "concepts", F.coalesce("said", "summary").alias("summary"), (F.col("dirty") & ~new).alias("dirty"),
                F.when(new, F.col("size")).otherwise(F.col("size_at_last_summary")).alias("size_at_last_summary"), F.when(new, F.lit(day)).otherwise(F.col("last_updated")).alias("last_updated"),
            )

        self.told.change(got, told, tag)

    def stale(self) -> DataFrame:
        """Those to be summarised: dirty, or more than doubled since."""
        return self.communities().where("dirty or (size_at_last_summary > 0 and size > 2 * size_at_last_summary)")
