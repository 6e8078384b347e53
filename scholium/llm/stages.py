"""A training-data pipeline of five stages; each works on all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's docs.
All but the last return the columns of ``documents``. SQL cannot express the stages (their models are fitted, their
fingerprints are hashes over shingles), so ``ORACLE_SQL`` is None and the tests compare each stage with brute force.

Nulls: a null text has no language and goes in the first stage; a row without an id is judged by its text, keeps its lines and
is never a near-duplicate or removed for a benchmark passage. A text left empty by line dedup stays. Ties: the smallest id of a
near-duplicate class stays, and of repeated rows with that id all stay. Very long texts are worked on in blocks. An empty
``documents`` gives an empty result; extra columns pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import written
from . import bpe, decontaminate, langid, linededup, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letter in the text, or no learned language that it clearly belongs to."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave the texts; n_chars follows. Every row stays."""
    out = linededup.cleaned(docs)
    changed = F.col(out.columns[-1]) > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: shingles of five words, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, by document."""
    return bpe.query(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
