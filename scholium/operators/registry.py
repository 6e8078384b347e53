"""The paper registry and the change log as tables of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The order in which statuses are listed.
ORDER = ("ingesting", "queued", "ingested", "shortlisted", "failed")


def status_counts(events: DataFrame) -> DataFrame:
    """Rows by status, with the total under a null status."""
    return events.rollup("status").agg(F.count(F.lit(1)).alias("n"))


def latest(events: DataFrame) -> DataFrame:
    """The last status of each paper; the batch twin of the streaming registry."""
    return events.groupBy("paper_id").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("events"))


def by_status(rows: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    return rows.orderBy(place, "paper_id")


def register_new(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Search hits ``(paper_id, title, abstract, seq)`` that the registry lacks, the first of each, shortlisted."""
    new = hits.join(known.select("paper_id").distinct(), "paper_id", "left_anti").groupBy("paper_id").agg(F.min_by(F.struct("title", "abstract", "seq"), "seq").alias("r"))
    return new.select("paper_id", "r.title", F.substring("r.abstract", 1, 500).alias("abstract"), "r.seq", F.lit("shortlisted").alias("status"))


def register_or_requeue(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows ``(identifier, paper_id, outcome)``: an identifier that is some row's arXiv id or DOI queues that row again (the first by id),
    any other is registered as ``manual:<identifier>``."""
    ids = registry.select("paper_id", F.explode(F.filter(F.array("arxiv_id", "doi"), lambda x: F.coalesce(x, F.lit("")) != "")).alias("identifier"))
    first = ids.groupBy("identifier").agg(F.min("paper_id").alias("found"))
    out = asked.select("identifier").distinct().join(first, "identifier", "left")
    return out.select("identifier", F.coalesce("found", F.concat(F.lit("manual:"), "identifier")).alias("paper_id"), F.when(F.col("found").isNull(), "registered").otherwise("requeued").alias("outcome"))


def states(events: DataFrame) -> DataFrame:
    """Rows ``(paper_id, status, refused)`` after all events in order: ``queued`` is refused while the paper is ingesting or ingested.

    A request meets the state that the last other event before it left: a window in order of events, which Spark sorts and streams.
    """
    other = events.where("status <> 'queued'").groupBy("paper_id").agg(F.max(F.struct("seq", "status")).alias("last"))
    asked = events.where("status = 'queued'").select("paper_id", "seq")
    settled = events.where("status <> 'queued'").select("paper_id", F.col("seq").alias("at"), F.col("status").alias("then"))
    # The state that each request meets: the last other event before it.
    both = settled.select("paper_id", F.col("at").alias("seq"), "then").unionByName(asked.withColumn("then", F.lit(None).cast("string")))
    before = F.last("then", ignorenulls=True).over(W.partitionBy("paper_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    met = both.withColumn("state", before).where("then is null").withColumn("refuse", F.coalesce(F.col("state").isin("ingesting", "ingested"), F.lit(False)))
    by = met.groupBy("paper_id").agg(F.max(F.when(~F.col("refuse"), F.col("seq"))).alias("granted"), F.sum(F.col("refuse").cast("long")).alias("refused"))
    whole = events.select("paper_id").distinct().join(other, "paper_id", "left").join(by, "paper_id", "left")
    status = F.when(F.col("last").isNull() | (F.col("granted") > F.col("last.seq")), "queued").otherwise(F.col("last.status"))
    return whole.select("paper_id", status.alias("status"), F.coalesce("refused", F.lit(0)).alias("refused"))


def replayed(log: DataFrame) -> DataFrame:
    """``(seq, id, op, payload)``: the last add's payload, and one mention more for each merge after it."""
    adds = log.where("op = 'add'").groupBy("id").agg(F.max("seq").alias("added"), F.max_by("payload", "seq").alias("payload"))
    merges = log.where("op = 'merge'").join(adds.select("id", "added"), "id").where("seq > added").groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return adds.join(merges, "id", "left").select("id", "payload", (1 + F.coalesce("k", F.lit(0))).alias("mentions"))
