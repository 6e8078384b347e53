"""Structured Streaming jobs over file sources, run to the end of what is there (``availableNow``). A checkpoint makes each resume where
it stopped; a batch that is run again replaces what it wrote."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keywords import KeywordIndex
from ..plans.lineage import new_path, written
from .tables import KeyedTable

STATUS = {"click": "shortlisted", "signup": "queued", "view": "ingesting", "purchase": "ingested"}


def _stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, ``files`` of them a batch (all where it is None)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # A table is a file or a folder of part files; a file source watches a folder.
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/{name}*")


def _run(df: DataFrame, mode: str, write: Callable[[DataFrame, int], None], check: str) -> list[dict]:
    """Run a query to the end of what is there; its progress by batch."""
    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def _finished(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a query to its end; each batch's result replaces (complete) or extends (append, update) the output in the shared folder."""
    spark = df.sparkSession
    out, check = new_path(spark, name), new_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    _run(df, mode, write, check)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(out)
    rows = spark.read.schema(f"{df.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(out)
    return rows if mode == "update" else rows.drop("batch")


def _lifecycle(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    named = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return _stream(spark, path, files).select(F.col("event_id").alias("seq"), F.col("user_id").alias("paper_id"), F.coalesce(named[F.col("event_type")], F.lit("failed")).alias("status"))


def counted_stream(spark: SparkSession, path: str, condition: str = "true") -> DataFrame:
    """Events that meet a condition, counted by user and type as they arrive."""
    events = _stream(spark, path).where(condition)
    return _finished(events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")), "complete", "counts")


def registry_stream(spark: SparkSession, path: str) -> DataFrame:
    """The registry's last status by paper, kept as aggregation state over the stream of lifecycle events."""
    events = _lifecycle(spark, path)
    return _finished(events.groupBy("paper_id").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("events")), "complete", "registry")


def state_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Rows ``(paper_id, status, refused)``: the registry with its rule that a paper being ingested, or ingested, is not queued again.

    A paper's state is its status and the number of refusals; events of a batch are taken in order of ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, refused = state.get if state.exists else (None, 0)
        for _, said in sorted((s, t) for pdf in batches for s, t in zip(pdf["seq"], pdf["status"])):
            if said == "queued" and status in ("ingesting", "ingested"):
                refused += 1
            else:
                status = said
        state.update((status, refused))
        yield pd.DataFrame({"paper_id": [key[0]], "status": [status], "refused": [refused]})

    schema = "paper_id long, status string, refused long"
    kept = _lifecycle(spark, path, files).groupBy("paper_id").applyInPandasWithState(step, schema, "status string, refused long", "update", GroupStateTimeout.NoTimeout)
    return _finished(kept, "update", "states").groupBy("paper_id").agg(F.max_by("status", "batch").alias("status"), F.max_by("refused", "batch").alias("refused"))


class Firsts:
    """What arrives for the first time, with state that does not grow with the keys: repeats within ``delay`` of event time go by the stream's
    state, which forgets a key when the watermark passes; later ones, which the state no longer knows, go because the table of known
    keys holds them. So every key is registered once, whatever the batches, and a late repeat is dropped like any other.

    ``progress`` holds, for each batch, the keys in state.
    """

    def __init__(self, spark: SparkSession, key: str, delay: str = "1 hour", folder: str | None = None, buckets: int = 16):
        self.spark, self.key, self.delay = spark, key, delay
        self.folder, self.buckets, self.progress = folder or new_path(spark, "firsts"), buckets, []

    def run(self, path: str, files: int | None = None, ts: str = "ts") -> Firsts:
        arriving = _stream(self.spark, path, files).select(self.key, F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", self.delay)
        kind = dict(arriving.dtypes)[self.key]
        self.known = KeyedTable(self.spark, f"{self.key} {kind}, batch long", self.key, f"{self.folder}/known", self.buckets)

        def batch(rows: DataFrame, number: int) -> None:
            new = rows.select(self.key).distinct().persist()
            fresh = lambda old: old.unionByName(new.join(old, self.key, "left_anti").withColumn("batch", F.lit(number).cast("long")))
            self.known.change(new, fresh, f"batch{number}")
            new.unpersist()

        once = arriving.dropDuplicatesWithinWatermark([self.key])
        self.progress += [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in _run(once, "append", batch, f"{self.folder}/checkpoint")]
        return self

    def keys(self) -> DataFrame:
        return self.known.read()


def dedup_stream(spark: SparkSession, path: str, key: str, files: int | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows ``(<key>)``: what arrives for the first time."""
    return Firsts(spark, key, delay).run(path, files).keys().select(key)


def windowed_stream(spark: SparkSession, path: str, length: str = "1 hour", delay: str = "10 minutes", files: int | None = None) -> DataFrame:
    """Tumbling counts by event time; windows still open at the end of the data are not emitted."""
    events = _stream(spark, path, files).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = events.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _finished(counts.select("window.start", "event_type", "n"), "append", "windows")


def session_stream(spark: SparkSession, path: str, gap: str = "30 minutes", delay: str = "10 minutes", files: int | None = None) -> DataFrame:
    """Rows ``(user_id, start, end, n)``: a user's events, each within ``gap`` of the one before, as one session; open sessions are state that
    merges as events arrive, and are emitted when the watermark passes their end. Those still open at the end of the data are not."""
    events = _stream(spark, path, files).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = events.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return _finished(counts.select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n"), "append", "sessions")


class ChangeSync:
    """A change log ``(seq, id, op, payload)`` applied to a table of nodes as it arrives, in any order and split, once however often a
    batch or an event is delivered: the result is that of ``registry.replayed`` over all events.

    A node is its last add's payload, with one mention and one more for each merge of a higher ``seq``. Merges stay as rows until the
    high-water mark, the highest ``seq`` less ``late``, passes them; then they are a number. What arrives at or under the mark is
    counted as applied already and passed over, so ``late`` is the disorder that is allowed for.
    """

    SCHEMA = "id long, kind string, seq long, payload string, settled long"

    def __init__(self, spark: SparkSession, late: int = 1_000_000, folder: str | None = None, buckets: int = 16):
        self.spark, self.late, self.folder = spark, late, folder or new_path(spark, "sync")
        self.table = KeyedTable(spark, self.SCHEMA, "id", f"{self.folder}/nodes", buckets)

    def apply(self, events: DataFrame, tag: str) -> None:
        if self.table.done(tag):
            return
        mark = self.table.noted()
        mark = -1 if mark is None else mark
        events = events.select("seq", "id", "op", F.col("payload").cast("string").alias("payload")).where(F.col("seq") > mark).persist()
        top = events.agg(F.max("seq")).first()[0]
        after = mark if top is None else max(mark, top - self.late)
        new = events.select("id", F.when(F.col("op") == "add", "node").otherwise("merge").alias("kind"), "seq", "payload", F.lit(0).cast("long").alias("settled"))

        def made(old: DataFrame) -> DataFrame:
            rows = old.unionByName(new)
            # One add decides; of a merge delivered twice one counts.
            node = rows.where("kind = 'node'").groupBy("id").agg(F.max(F.struct("seq", "settled", "payload")).alias("a"))
            merges = rows.where("kind = 'merge'").select("id", "seq").distinct().join(node, "id", "left").where("a is null or seq > a.seq")
            done = merges.where((F.col("seq") <= after) & F.col("a").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("more"))
            nodes = node.join(done, "id", "left").select("id", F.lit("node").alias("kind"), "a.seq", "a.payload", (F.col("a.settled") + F.coalesce("more", F.lit(0))).alias("settled"))
            return nodes.unionByName(merges.where(F.col("seq") > after).select("id", F.lit("merge").alias("kind"), "seq", F.lit(None).cast("string").alias("payload"), F.lit(0).cast("long").alias("settled")))

        self.table.change(events, made, tag, after)
        events.unpersist()

    def run(self, changes: DataFrame) -> ChangeSync:
        _run(changes, "append", lambda rows, number: self.apply(rows, f"batch{number}"), f"{self.folder}/checkpoint")
        return self

    def nodes(self) -> DataFrame:
        """Rows ``(id, payload, mentions)``."""
        rows = self.table.read()
        node, open_ = rows.where("kind = 'node'"), rows.where("kind = 'merge'").groupBy("id").agg(F.count(F.lit(1)).alias("k"))
        return node.join(open_, "id", "left").select("id", "payload", (1 + F.col("settled") + F.coalesce("k", F.lit(0))).alias("mentions"))


class Ingest:
    """Documents ``(doc_id, text)`` ingested as their files arrive, by the registry's states: what arrives is marked ``ingesting``, the work is
    done, and the outcome noted, ``ingested`` or ``failed`` with its error. A document that is ingested, or being ingested by another
    batch, is refused; a failed one is taken when it arrives again. After each ``scan_every`` documents ``scan`` is called with the postings.

    The work adds a segment to the keyword index and makes ``work (doc_id, text) -> (doc_id, error)``, null for success. ``run`` may be called
    again, in another session too: a batch that broke off is run again by the checkpoint, finds its own documents ``ingesting`` and
    ends them; ``requeue`` takes those that no batch will end back to ``queued``. Of rows of one id in a batch the greatest text counts.
    """

    SCHEMA = "doc_id long, status string, error string, batch long, refused long"

    def __init__(self, spark: SparkSession, folder: str | None = None, scan_every: int = 5, scan: Callable[[DataFrame], None] | None = None, work: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder = spark, folder or new_path(spark, "ingest")
        self.scan_every, self.scan, self.work = scan_every, scan, work
        self.index = KeywordIndex(spark, f"{self.folder}/index")
        self.states = KeyedTable(spark, self.SCHEMA, "doc_id", f"{self.folder}/registry")

    def batch(self, docs: DataFrame, number: int) -> None:
        if self.states.done(f"batch{number}-ended"):
            return
        docs = docs.groupBy("doc_id").agg(F.max("text").alias("text")).persist()
        mine = (F.col("status") == "ingesting") & (F.col("batch") == number)
        taken = F.coalesce(F.col("status").isin("shortlisted", "queued", "failed"), F.lit(True)) | mine
        kept = lambda old: old.join(docs.select("doc_id"), "doc_id", "left_anti")
        row = lambda status, error: (status.alias("status"), error.alias("error"), F.lit(number).cast("long").alias("batch"), F.coalesce("refused", F.lit(0)).alias("refused"))
        none = F.lit(None).cast("string")

        def begun(old: DataFrame) -> DataFrame:
            met = docs.select("doc_id").join(old, "doc_id", "left")
            refused = met.where(~taken).withColumn("refused", F.col("refused") + 1).select(*old.columns)
            return kept(old).unionByName(met.where(taken).select("doc_id", *row(F.lit("ingesting"), none))).unionByName(refused)

        self.states.change(docs, begun, f"batch{number}-begun")
        todo = docs.join(self.states.read().where(mine).select("doc_id"), "doc_id", "left_semi").persist()
        before = self.index.sizes()[0]
        self.index.add(todo.where("text is not null"), number)
        error = F.when(F.col("text").isNull(), "no text")
        ended = todo.select("doc_id", error.alias("said"))
        if self.work:
            ended = written(ended.join(self.work(todo.where("text is not null")).select("doc_id", F.col("error").alias("broke")), "doc_id", "left").select("doc_id", F.coalesce("said", "broke").alias("said")), "outcomes")

        def noted(old: DataFrame) -> DataFrame:
            met = old.join(ended, "doc_id")
            out = met.select("doc_id", *row(F.when(F.col("said").isNull(), "ingested").otherwise("failed"), F.col("said")))
            return old.join(ended.select("doc_id"), "doc_id", "left_anti").unionByName(out)

        self.states.change(todo, noted, f"batch{number}-ended")
        todo.unpersist()
        docs.unpersist()
        if self.scan and self.index.sizes()[0] // self.scan_every > before // self.scan_every:
            self.scan(self.postings())

    def run(self, path: str, files: int | None = None) -> Ingest:
        _run(_stream(self.spark, path, files).select("doc_id", "text"), "append", self.batch, f"{self.folder}/checkpoint")
        return self

    def requeue(self) -> int:
        """Failed documents, and those left ``ingesting``, to ``queued``; how many there were."""
        stuck = self.registry().where("status in ('failed', 'ingesting')").persist()
        n = stuck.count()
        if n:
            again = F.col("status").isin("failed", "ingesting")
            self.states.change(stuck, lambda old: old.withColumn("status", F.when(again, "queued").otherwise(F.col("status"))), f"requeue{uuid.uuid4().hex}")
        stuck.unpersist()
        return n

    def registry(self) -> DataFrame:
        return self.states.read()

    def postings(self) -> DataFrame:
        return self.index.postings()

    def tokens(self) -> DataFrame:
        """Rows ``(token, df, uses)``."""
        return self.index.stats().select("token", "df", "uses")
