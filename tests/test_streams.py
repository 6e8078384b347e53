"""Streams give what the batch gives, in one file or many, at once or with a restart in between."""

import pytest
from pyspark.sql import functions as F

from scholium.operators import registry as R
from scholium.operators import retrieval as S
from scholium.streaming import jobs

SF = "/root/testdata/sf0.001"


def pieces(df, folder, n):
    df.repartition(n).write.parquet(folder)
    return folder


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ingest_in_batches_equals_one_batch(spark, tmp_path, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, None)], "doc_id long, text string"))
    scans = []
    job = jobs.Ingest(spark, f"file://{tmp_path}/index", 50, lambda posts: scans.append(posts.count())).run(pieces(docs, f"{tmp_path}/docs", n), files=1)
    whole = S.postings(docs.where("text is not null"), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
    assert sorted(map(tuple, job.tokens().collect())) == sorted(map(tuple, whole.collect()))
    assert {r["status"]: r["count"] for r in job.registry().groupBy("status").count().collect()} == {"ingested": 200, "failed": 1}
    assert len(scans) == min(n, 4) and scans == sorted(scans)


def test_ingest_resumes_after_a_restart(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    folder, index = f"{tmp_path}/docs", f"file://{tmp_path}/index"
    docs.where("doc_id % 2 = 0").write.parquet(folder)
    first = jobs.Ingest(spark, index).run(folder)
    assert first.registry().count() == docs.where("doc_id % 2 = 0").count()
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(folder)
    again = jobs.Ingest(spark, index).run(folder)
    assert again.registry().count() == again.registry().select("doc_id").distinct().count() == 200
    assert jobs.Ingest(spark, index).run(folder).registry().count() == 200


@pytest.mark.parametrize("n", [1, 3])
def test_states_in_batches_equal_the_batch(spark, tmp_path, n):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = f"{tmp_path}/events"
    # Files in order of time, as they would arrive.
    bounds = events.approxQuantile("event_id", [(k + 1) / n for k in range(n)], 0.0)
    low = -1
    for high in bounds:
        events.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(folder)
        low = high
    named = F.create_map(*[F.lit(x) for pair in jobs.STATUS.items() for x in pair])
    batch = R.states(events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("paper_id"), F.coalesce(named[F.col("event_type")], F.lit("failed")).alias("status")))
    got = jobs.state_stream(spark, folder, files=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_firsts_and_windows_in_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = pieces(events, f"{tmp_path}/events", 4)
    got = [r[0] for r in jobs.dedup_stream(spark, folder, "user_id", files=1).collect()]
    assert sorted(got) == sorted(r[0] for r in events.select("user_id").distinct().collect())
    closed = jobs.windowed_stream(spark, pieces(events, f"{tmp_path}/one", 1))
    assert closed.agg(F.sum("n")).first()[0] <= events.count()
