"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII lower case only, as the contracts ask; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def fold(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the split into learning and held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")) % mod


def free(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that no column of ``df`` has (names differ by case for no one)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """A number of partitions for explicit repartitioning: the session's shuffle setting, at least its parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The ASCII-white-space separated words of ``data``, some ``size`` bytes at a time, so that a huge text needs no huge list."""
    at, end = 0, len(data)
    while at < end:
        cut = at + size
        if cut >= end:
            cut = end
        else:
            while cut < end and data[cut] not in b" \t\n\r\x0b\x0c":
                cut += 1
        if words := data[at:cut].split():
            yield words
        at = cut


def few_rows(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The batches in parts of ``rows``, so that what is derived from a part is handed on before the next is begun."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows go to a Python worker at once, for jobs that are run inside: their rows are large, and batches are bounded by rows alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(text: object) -> bytes:
    """A text's UTF-8 bytes; null is empty."""
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def bounded(df: DataFrame, key: Column, limit: int, n_rows: int) -> DataFrame:
    """About ``limit`` of ``n_rows`` rows, chosen by a hash of ``key``: the same rows at every partitioning.

    Only for learning: the bound is a documented parameter of the operators that fit a model.
    """
    share = 1.0 if n_rows <= limit else limit / n_rows
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))
