"""Streams that keep tables: states with what broke off, change logs in any order, sessions, bounded state."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.operators import registry as R
from scholium.streaming import jobs
from scholium.streaming.tables import KeyedTable

SF = "/root/testdata/sf0.001"


def in_order(events, folder, n):
    """``n`` files in order of time, as they would arrive."""
    low = None
    for high in events.select(F.col("ts").cast("timestamp").cast("double").alias("t")).approxQuantile("t", [(k + 1) / n for k in range(n)], 0.0):
        t = F.col("ts").cast("timestamp").cast("double")
        events.where((t <= high) if low is None else (t > low) & (t <= high)).coalesce(1).write.mode("append").parquet(folder)
        low = high
    return folder


def test_a_table_changes_by_bucket(spark, tmp_path):
    table = KeyedTable(spark, "k long, v string", "k", f"file://{tmp_path}/t", 4)
    put = lambda rows: (lambda old: old.join(rows, "k", "left_anti").unionByName(rows))
    rows = spark.createDataFrame([(k, "a") for k in range(20)] + [(None, "n")], "k long, v string")
    table.change(rows, put(rows), "first", 7)
    one = spark.createDataFrame([(3, "b")], "k long, v string")
    for _ in range(2):
        table.change(one, put(one), "second")
    assert table.noted() == 7 and {r["k"]: r["v"] for r in table.read().collect()} == {**dict.fromkeys(range(20), "a"), None: "n", 3: "b"}
    # Only one bucket was written, and a change without its manifest is none.
    assert len({f.split("/bucket=")[1].split("/")[0] for f in table.read().inputFiles() if "/000000000002/" in f}) == 1
    with pytest.raises(ZeroDivisionError):
        table.change(one, lambda old: 1 / 0, "third")
    for k in range(8):
        table.change(one, put(one), f"more{k}")
    assert table.read().count() == 21 and len(table._manifests()) == 8 and not table.done("first")


@pytest.mark.parametrize("n", [1, 2, 5])
def test_change_log_in_any_order_and_twice(spark, tmp_path, n):
    r = random.Random(n)
    log = [(k, r.randint(0, 12), r.choice(["add", "merge", "merge", "merge"]), f"p{k}") for k in range(400)]
    df = spark.createDataFrame(log, "seq long, id long, op string, payload string")
    want = sorted(map(tuple, R.replayed(df).collect()))
    order = list(range(400))
    r.shuffle(order)
    sync = jobs.ChangeSync(spark, late=400, folder=f"file://{tmp_path}/any")
    for k, name in [*((k, f"b{k}") for k in range(n)), (0, "b0"), (n - 1, "again")]:  # some twice, under their own name and another
        sync.apply(df.where(F.col("seq").isin(order[k::n])), name)
    assert sorted(map(tuple, sync.nodes().collect())) == want
    # In order the mark settles merges, and delivering all again changes nothing.
    sync = jobs.ChangeSync(spark, late=10, folder=f"file://{tmp_path}/ordered")
    for k in range(n):
        sync.apply(df.where(f"seq >= {400 * k // n} and seq < {400 * (k + 1) // n}"), f"b{k}")
    sync.apply(df, "all again")
    assert sorted(map(tuple, sync.nodes().collect())) == want
    assert sync.table.read().where("kind = 'merge' and seq <= 389").count() == 0


def test_change_log_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = in_order(events, f"{tmp_path}/events", 3)
    shaped = lambda df: df.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "signup", "add").otherwise("merge").alias("op"), F.col("value").cast("string").alias("payload"))
    sync = jobs.ChangeSync(spark, folder=f"file://{tmp_path}/sync")
    for _ in range(2):
        sync.run(shaped(jobs._stream(spark, folder, 1)))
    assert sorted(map(tuple, sync.nodes().collect())) == sorted(map(tuple, R.replayed(shaped(events)).collect()))


def sessions(events, gap, delay):
    by, out = {}, []
    for user, t in sorted((r["user_id"], r["t"]) for r in events.select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t")).collect()):
        if user in by and t < by[user][1] + gap:
            by[user] = [by[user][0], t, by[user][2] + 1]
        else:
            out += [(user, *by[user])] if user in by else []
            by[user] = [t, t, 1]
    out += [(user, *x) for user, x in by.items()]
    high = max(x[2] for x in out) - delay
    return sorted((u, round(a, 3), round(b + gap, 3), n) for u, a, b, n in out if b + gap <= high)


@pytest.mark.parametrize("n", [1, 3])
def test_sessions_merge_across_batches(spark, tmp_path, n):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = jobs.session_stream(spark, in_order(events, f"{tmp_path}/events", n), "6 hours", files=1)
    got = got.select("user_id", F.col("start").cast("double").alias("a"), F.col("end").cast("double").alias("b"), "n").collect()
    assert sorted((r["user_id"], round(r["a"], 3), round(r["b"], 3), r["n"]) for r in got) == sessions(events, 6 * 3600, 600)


def test_firsts_have_bounded_state(spark, tmp_path):
    # Keys come again after one day, when the state has forgotten them, and new ones come all the time.
    rows = [(k if k % 3 else k // 30, f"2024-01-{1 + k // 60:02d} {k // 5 % 24:02d}:{k % 60:02d}:00") for k in range(1200)]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    folder = in_order(df, f"{tmp_path}/events", 10)
    first = jobs.Firsts(spark, "user_id", "1 hour", f"file://{tmp_path}/firsts").run(folder, 1)
    got = [r["user_id"] for r in first.keys().collect()]
    assert sorted(got) == sorted({k for k, _ in rows})
    assert max(first.progress) <= 0.3 * len(got)
    assert len(first.run(folder, 1).keys().collect()) == len(got)


class Broken(jobs.Ingest):
    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        add, self.left = self.index.add, 1

        def once(docs, number):
            if number == 1 and self.left:
                self.left = 0
                raise RuntimeError("killed")
            add(docs, number)

        self.index.add = once


def test_a_batch_killed_midway_ends_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha beta gamma{k}") for k in range(30)], "doc_id long, text string")
    folder, at = f"{tmp_path}/docs", f"file://{tmp_path}/ingest"
    for k in range(3):
        docs.where(f"doc_id % 3 = {k}").coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="killed"):
        Broken(spark, at).run(folder, 1)
    seen = {r["status"]: r["count"] for r in jobs.Ingest(spark, at).registry().groupBy("status").count().collect()}
    assert seen == {"ingested": 10, "ingesting": 10}
    job = jobs.Ingest(spark, at).run(folder, 1)
    assert {(r["status"], r["refused"]) for r in job.registry().collect()} == {("ingested", 0)} and job.registry().count() == 30
    assert job.index.sizes()[0] == 30 and job.postings().where("token = 'alpha'").count() == 30


def test_failed_documents_are_queued_again_and_ingested_ones_refused(spark, tmp_path):
    folder, at = f"{tmp_path}/docs", f"file://{tmp_path}/ingest"
    put = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    broken = lambda docs: docs.select("doc_id", F.when(F.col("text").contains("bad"), "cannot be read").alias("error"))
    put((1, "good one"), (2, "bad one"), (3, None), (3, None))
    job = jobs.Ingest(spark, at, work=broken).run(folder)
    state = lambda: {r["doc_id"]: (r["status"], r["error"], r["refused"]) for r in job.registry().collect()}
    assert state() == {1: ("ingested", None, 0), 2: ("failed", "cannot be read", 0), 3: ("failed", "no text", 0)}
    assert job.requeue() == 2 and state()[2][0] == state()[3][0] == "queued"
    put((1, "again"), (2, "good now"), (3, "has text"))
    job.run(folder)
    assert state() == {1: ("ingested", None, 1), 2: ("ingested", None, 0), 3: ("ingested", None, 0)}
