"""Derived tables and logs kept between runs: notes, the registry, chats, the change log, graph and index snapshots.

Tables are Parquet, laid out by the column that readers filter on; logs are JSON lines, read with a schema, so that unknown
keys are ignored and corrupt lines dropped. Nothing here passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Characters that a stored note needs to be worth reading again.
LEAST_NOTE = 50
REGISTRY = "paper_id string, title string, status string, seq long"
CHAT = "conv_id long, turn long, role string, content string, sources array<string>"
CHANGES = "seq long, op string, id long, payload double, synced boolean"


def note_path(kind: Column, title: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("ingested/"), kind, F.lit("/"), X.slug(title, 60), F.lit("_"), F.substring(doc_id, 1, 8), F.lit(".md"))


def notes(docs: DataFrame) -> DataFrame:
    """``(doc_id, title, source_type, source_url, content)`` with path and front matter; no clock is read, so that a rerun writes the same."""
    title = F.coalesce("title", F.lit(""))
    head = X.front_matter(title=F.concat(F.lit('"'), title, F.lit('"')), doc_id=F.col("doc_id"), source_type=F.col("source_type"), source_url=F.col("source_url"))
    return docs.select("doc_id", "source_type", note_path(F.col("source_type"), title, F.col("doc_id")).alias("relative_path"), F.concat(head, F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("body"))


def write_notes(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("source_type").parquet(path)


def body_of(note: Column) -> Column:
    """A note without its front matter."""
    return F.regexp_replace(note, r"(?s)\A---\n.*?\n---\n+", "")


def read_notes(spark: SparkSession, path: str, least: int = LEAST_NOTE) -> DataFrame:
    """Stored notes whose stripped content is long enough to be ingested again."""
    rows = spark.read.parquet(path).withColumn("content", body_of(F.col("body")))
    return rows.where(F.length(F.trim("content")) >= least)


def scan_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files below ``folder``: path, title (the stem), size, time of change, body."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), F.regexp_replace(meta["file_name"], r"\.md$", "").alias("title"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), F.col("value").alias("body"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).option("multiLine", False).json(path)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT).json(path).withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def read_changes(spark: SparkSession, path: str, unsynced: bool = False) -> DataFrame:
    """The change log's sound lines, or those of them that no sink has seen."""
    rows = spark.read.schema(CHANGES).option("mode", "DROPMALFORMED").json(path).where("seq is not null")
    return rows.where(~F.coalesce("synced", F.lit(False))) if unsynced else rows


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    entities.write.parquet(f"{path}/entities")
    relations.write.parquet(f"{path}/relations")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities and relations; aliases (lower-case name to the first id) and adjacency are derived again."""
    entities, relations = spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")
    aliases = entities.groupBy(F.lower(F.trim("name")).alias("normalized_name")).agg(F.min("id").alias("entity"))
    ends = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    adjacency = ends.unionByName(relations.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))).distinct()
    return entities, relations, aliases, adjacency


def write_index(posts: DataFrame, vectors: DataFrame, path: str) -> None:
    posts.repartition("token").sortWithinPartitions("token").write.parquet(f"{path}/postings")
    vectors.write.parquet(f"{path}/vectors")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vectors")


def exported_property_graph(members: DataFrame, relations: DataFrame, bridges: DataFrame, latent: DataFrame) -> DataFrame:
    """Rows ``(src, dst, kind, weight)``: typed edges between Entity (``e``), Community (``c``) and Bridge (``b``) nodes.

    ``members (id, component)``, ``relations (source_id, target_id, weight)``, ``bridges (id, docs)``, ``latent (a, b, sim)``.
    """
    node = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    edge = lambda df, src, dst, kind, weight: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), weight.cast("double").alias("weight"))
    return (
        edge(relations, node("e", "source_id"), node("e", "target_id"), "RELATES", F.col("weight")).unionByName(edge(members, node("e", "id"), node("c", "component"), "MEMBER_OF", F.lit(1.0)))
        .unionByName(edge(bridges, node("e", "id"), node("b", "id"), "IS_BRIDGE", F.size("docs"))).unionByName(edge(latent, node("e", "a"), node("e", "b"), "LATENT_CONNECTION", F.col("sim")))
    )


def imported_property_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes (id, kind, name)`` and ``edges (src, dst, kind, weight)`` to relations and community sizes.

    A community's members stay rows (they grow with the graph); only their number is aggregated.
    """
    relations = edges.where("kind = 'RELATES'").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "weight")
    members = edges.where("kind = 'MEMBER_OF'").select(F.col("src").alias("id"), F.col("dst").alias("community_id"))
    known = members.join(nodes.where("kind = 'Entity'").select("id"), "id", "left_semi")
    return relations, known.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
