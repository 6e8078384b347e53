"""Keyed tables that streams change: rows lie in buckets of their key, and a change writes anew only the buckets that it touches.

    <folder>/data/<version>/bucket=<b>       all rows of the bucket, as of that version
    <folder>/manifest/<version>_<tag>        one row for each bucket: the version that holds it; written last

A version is there when its manifest is; a job that breaks off before leaves the table as it was. ``tag`` names the change, so that one
that is run again is known. Older versions go, save the last few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import children, deleted, new_path

#: Versions whose manifests stay.
KEPT = 8


class KeyedTable:
    """``schema`` in DDL without the bucket; ``key`` is the column whose buckets the rows lie in. Rows with a null key have a bucket too."""

    def __init__(self, spark: SparkSession, schema: str, key: str, folder: str | None = None, buckets: int = 16):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.folder = folder or new_path(spark, "table")

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _manifests(self) -> list[str]:
        names = children(self.spark, f"{self.folder}/manifest")
        return sorted(n for n in names if "_SUCCESS" in children(self.spark, f"{self.folder}/manifest/{n}"))

    def _held(self) -> tuple[int, dict[int, int], int | None]:
        """The version, where each bucket lies, and the number noted with it."""
        last = self._manifests()[-1:]
        if not last:
            return 0, {}, None
        rows = self.spark.read.schema("bucket int, version long, noted long").parquet(f"{self.folder}/manifest/{last[0]}").collect()
        return int(last[0].split("_", 1)[0]), {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, next(r["noted"] for r in rows if r["bucket"] < 0)

    def done(self, tag: str) -> bool:
        return any(n.split("_", 1)[1] == tag for n in self._manifests())

    def noted(self) -> int | None:
        """The number that the last change noted: a high-water mark."""
        return self._held()[2]

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        by_version: dict[int, list[int]] = {}
        for bucket, version in self._held()[1].items():
            if only is None or bucket in only:
                by_version.setdefault(version, []).append(bucket)
        out = self.spark.createDataFrame([], self.schema)
        for version, buckets in sorted(by_version.items()):
            part = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/data/{version:012d}").where(F.col("bucket").isin(buckets))
            out = out.unionByName(part.drop("bucket"))
        return out

    def change(self, keys: DataFrame, made: Callable[[DataFrame], DataFrame], tag: str, noted: int | None = None) -> None:
        """Replace the buckets in which ``keys`` lie by what ``made`` makes of their rows, unless a change of this tag was made."""
        if self.done(tag):
            return
        touched = [r[0] for r in self.bucketed(keys.select(self.key)).select("bucket").distinct().collect()]  # no more than there are buckets
        version, held, before = self._held()
        version += 1
        rows = self.bucketed(made(self.read(touched)))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{version:012d}")
        held.update(dict.fromkeys(touched, version))
        noted = before if noted is None else noted
        manifest = self.spark.createDataFrame([(-1, version, noted), *((b, v, None) for b, v in held.items())], "bucket int, version long, noted long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{version:012d}_{tag}")
        for n in self._manifests()[:-KEPT]:
            deleted(self.spark, f"{self.folder}/manifest/{n}")
        oldest, used = self._manifests()[0].split("_")[0], set(held.values())
        for n in children(self.spark, f"{self.folder}/data"):
            if n < oldest and int(n) not in used:
                deleted(self.spark, f"{self.folder}/data/{n}")
