"""A keyword index on disk: postings by bucket of tokens, statistics as sums that merge, segments that are compacted.

    <folder>/seg=<number>/postings/bucket=<b>   (token, id, tf, dl)
    <folder>/seg=<number>/stats/bucket=<b>      (token, df, uses)
    <folder>/seg=<number>/lengths               (n, words), written last: a segment without it is not there
    <folder>/upto=<number>/...                  all segments up to that number in one

A segment is what one batch of documents adds; a batch that is added again replaces its segment, or is passed over if it has been
compacted. Searching reads the buckets of the queries' tokens and no text. A document belongs to one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import children, deleted, new_path, written
from .retrieval import idf_of, ranked, tf_part, top_k

#: Tokens of queries that are broadcast; beyond, postings meet them in a shuffle.
FEW = 200_000


class KeywordIndex:
    """``buckets`` and the type of ids are fixed for a folder; more than ``most`` segments are compacted when a batch is added."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 32, most: int = 8, id_type: str = "long"):
        self.spark, self.folder, self.buckets, self.most, self.id_type = spark, folder or new_path(spark, "keywords"), buckets, most, id_type

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def segments(self) -> list[str]:
        """What is live: the last compaction, and the segments after it."""
        names = sorted(n for n in children(self.spark, self.folder) if n.startswith(("seg=", "upto=")) and "_SUCCESS" in children(self.spark, f"{self.folder}/{n}/lengths"))
        base = max((n for n in names if n.startswith("upto=")), default=None)
        after = [n for n in names if n.startswith("seg=") and (base is None or n[4:] > base[5:])]
        return ([base] if base else []) + after

    def _read(self, what: str, schema: str, parted: bool = True) -> DataFrame:
        paths = [f"{self.folder}/{n}/{what}" for n in self.segments()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Each segment's buckets are found under its own folder.
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def postings(self) -> DataFrame:
        return self._read("postings", f"token string, id {self.id_type}, tf long, dl int, bucket int")

    def stats(self) -> DataFrame:
        """Rows ``(token, df, uses)``, with the bucket: the segments' sums."""
        return self._read("stats", "token string, df long, uses long, bucket int").groupBy("bucket", "token").agg(F.sum("df").alias("df"), F.sum("uses").alias("uses"))

    def sizes(self) -> tuple[int, float]:
        """Documents, and their mean length."""
        n, words = self._read("lengths", "n long, words long").agg(F.sum("n"), F.sum("words")).first()
        return (n or 0), (words or 0) / n if n else 0.0

    def _dealt(self, posts: DataFrame) -> DataFrame:
        # A token of every document fills its bucket: a bucket is dealt to several tasks by id where there are more tasks than buckets.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return posts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 + n // self.buckets))).repartition(n, "bucket", "salt")

    def _write(self, segment: str, posts: DataFrame, stats: DataFrame | None, lengths: DataFrame | int) -> None:
        """Write a segment of dealt postings; ``lengths`` may be the number of documents, whose words are then summed up from the statistics."""
        at = f"{self.folder}/{segment}"
        posts.sortWithinPartitions("bucket", "token", "id").drop("salt").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
        if stats is None:
            back = self.spark.read.schema(f"token string, id {self.id_type}, tf long, dl int, bucket int").parquet(f"{at}/postings")
            stats = back.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
        stats.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/stats")
        if isinstance(lengths, int):
            sums = self.spark.read.schema("token string, df long, uses long, bucket int").parquet(f"{at}/stats")
            lengths = sums.agg(F.lit(lengths).cast("long").alias("n"), F.coalesce(F.sum("uses"), F.lit(0)).cast("long").alias("words"))
        lengths.coalesce(1).write.mode("overwrite").parquet(f"{at}/lengths")

    def add(self, docs: DataFrame, number: int, id_col: str = "doc_id", text_col: str = "text") -> None:
        """The documents of batch ``number``: their texts are taken apart once, by this call only, and their tokens shuffled once: what
        lies in a bucket is counted there."""
        name = f"{number:012d}"
        if any(n.startswith("upto=") and n[5:] >= name for n in self.segments()):
            return
        deleted(self.spark, f"{self.folder}/seg={name}/lengths")
        words = docs.select(F.col(id_col).cast(self.id_type).alias("id"), X.tokens(F.col(text_col)).alias("w"))
        each = X.unrolled(words.select("id", F.size("w").alias("dl"), F.explode_outer("w").alias("token")), "token")
        each = self._dealt(each.withColumn("bucket", self._bucket(F.col("token"))))
        posts = each.groupBy("bucket", "salt", "id", "dl", "token").agg(F.count(F.lit(1)).alias("tf")).select("token", "id", "tf", "dl", "bucket")
        self._write(f"seg={name}", posts, None, docs.count())
        if len(self.segments()) > self.most:
            self.compact()

    def compact(self) -> None:
        """All live segments in one; the old ones go when it is there."""
        live = self.segments()
        if len(live) < 2:
            return
        sums = self._read("lengths", "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        self._write(f"upto={live[-1].split('=')[1]}", self._dealt(self.postings()), self.stats(), sums)
        for n in live:
            deleted(self.spark, f"{self.folder}/{n}")

    def search(self, queries: DataFrame, k: int = 15, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
        """Rows ``(qid, id, score, rank)`` as of ``retrieval.bm25``, from the buckets of the queries' tokens. Postings of other tokens go
        before they meet a query, and scores are made within tasks, of which only the k best of a query leave."""
        words = queries.select(F.col(query_id).alias("qid"), F.explode(X.tokens(F.col(query_text))).alias("token"))
        said = written(words.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times")).withColumn("bucket", self._bucket(F.col("token"))), "asked")
        used = [r[0] for r in said.select("bucket").distinct().collect()]  # no more than there are buckets
        n, avgdl = self.sizes()
        in_use = F.col("bucket").isin(used)
        numbered = written(said.select("qid").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
        known = self.stats().where(in_use).join(said.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi")
        known = written(known.select("bucket", "token", "df", idf_of(n).alias("idf")).withColumn("t", F.monotonically_increasing_id()), "vocabulary")
        asked = said.join(known, ["bucket", "token"]).join(numbered, F.equal_null(said["qid"], numbered["qid"])).select("q", "t", (F.col("times") * F.col("idf")).alias("weight"))
        tokens = known.select("bucket", "token", "t")
        tokens = F.broadcast(tokens) if tokens.count() <= FEW else tokens
        posts = self.postings().where(in_use).join(tokens, ["bucket", "token"]).select("id", "t", tf_part(avgdl).alias("part"))
        hits = ranked(posts, written(asked, "weights"), k, numbered.count(), known.agg(F.sum("df")).first()[0] or 0)
        return top_k(hits, ["q"], [F.round("score", 9).desc(), F.col("id")], k).join(numbered, "q").select("qid", "id", "score", "rank")
