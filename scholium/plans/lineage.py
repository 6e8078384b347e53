"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, with its file system. Only in local mode (tests) is a temporary folder set where it is
    unset, and removed at the end: executors of a cluster would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = "file://" + local
        spark.conf.set("spark.checkpoint.dir", found)
    folder = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one: everything that ``written`` and the operators put down lies there."""
    return f"{shared_dir(spark)}/scholium-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> None:
    """Delete what this application has put down, once no frame that reads it is needed any more."""
    deleted(spark, run_dir(spark))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: survives lost executors, and has a known size."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Funnel:
    """Rows of named stages, counted by the jobs that make them anyway. A stage's frame must be run once, by some job, before ``rows``;
    a stage that the optimizer finds empty counts 0."""

    def __init__(self) -> None:
        self.seen: list[tuple[dict, Observation]] = []

    def stage(self, df: DataFrame, **names: object) -> DataFrame:
        noted = Observation()
        self.seen.append((names, noted))
        return df.observe(noted, F.count(F.lit(1)).alias("n"))

    def rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """Rows of the stages' names and ``n``, in the order of ``schema``."""
        found = [{**names, "n": int(noted.get.get("n") or 0)} for names, noted in self.seen]
        kind = spark.createDataFrame([], schema).schema
        return spark.createDataFrame([tuple(row[c] for c in kind.names) for row in found], kind)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in an order, without gathering the rows in one task: ranges are sorted apart, written, and
    each is given the number of rows before it, from one count a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("range", F.shiftright("place", 33))
    sizes = [(r[0], r[1]) for r in placed.groupBy("range").count().orderBy("range").collect()]  # a row for each range
    before, total = [], first
    for k, size in sizes:
        before.append((k, total))
        total += size
    offsets = df.sparkSession.createDataFrame(before, "range long, start long")
    out = placed.join(F.broadcast(offsets), "range").withColumn(name, F.col("place").bitwiseAND((1 << 33) - 1) + F.col("start"))
    return out.select(name, *df.columns)
