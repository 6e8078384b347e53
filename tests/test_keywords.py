"""The index on disk equals a rebuild after every batch, and is searched without the texts."""

import pytest
from pyspark.sql import functions as F

from scholium.operators import retrieval as S
from scholium.operators.keywords import KeywordIndex
from scholium.plans import lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return d.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "ab cd")], "doc_id long, text string")).persist()


def same(a, b):
    return sorted((r["qid"], r["id"], round(r["score"], 6), r["rank"]) for r in a.collect()) == sorted((r["qid"], r["id"], round(r["score"], 6), r["rank"]) for r in b.collect())


@pytest.mark.parametrize("n", [1, 2, 5])
def test_equal_to_a_rebuild_after_each_batch(spark, tmp_path, docs, n):
    index = KeywordIndex(spark, f"file://{tmp_path}/index", buckets=5, most=3)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for k in range(n):
        index.add(docs.where(F.pmod("doc_id", F.lit(n)) == k), k)
        so_far = docs.where(F.pmod("doc_id", F.lit(n)) <= k)
        posts = S.postings(so_far, "doc_id", "text")
        want = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
        assert sorted(map(tuple, index.stats().select("token", "df", "uses").collect())) == sorted(map(tuple, want.collect()))
        assert len(index.segments()) <= 3
        if k in (0, n - 1):
            assert same(index.search(items), S.bm25(so_far, items))
    # In another session's hands: the folder is all there is.
    again = KeywordIndex(spark, index.folder, buckets=5)
    assert again.sizes()[0] == docs.count() and same(again.search(items, k=3), S.bm25(docs, items, k=3))


def test_a_batch_again_and_one_that_broke_off(spark, tmp_path, docs):
    index = KeywordIndex(spark, f"file://{tmp_path}/index", buckets=4)
    for k in range(3):
        index.add(docs.where(f"doc_id % 3 = {k}"), k)
    want = index.sizes(), index.postings().count()
    index.add(docs.where("doc_id % 3 = 1"), 1)
    assert (index.sizes(), index.postings().count()) == want
    # A segment without its last part is not there, until its batch is added again.
    lineage.deleted(spark, f"{index.folder}/seg={2:012d}/lengths")
    assert index.sizes()[0] == docs.where("doc_id % 3 < 2").count()
    index.add(docs.where("doc_id % 3 = 2"), 2)
    index.compact()
    assert index.segments() == [f"upto={2:012d}"] and (index.sizes(), index.postings().count()) == want
    index.add(docs.where("doc_id % 3 = 1"), 1)
    assert (index.sizes(), index.postings().count()) == want


def test_search_reads_its_buckets_only(spark, tmp_path, docs):
    index = KeywordIndex(spark, f"file://{tmp_path}/index", buckets=16)
    index.add(docs, 0)
    asked = spark.createDataFrame([(1, "the the")], "item_id long, text string")
    hits = index.search(asked)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 0 and "BroadcastHashJoin" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert hits.count() and {f.split("bucket=")[1].split("/")[0] for f in index.postings().where(index._bucket(F.lit("the")) == F.col("bucket")).inputFiles()} != set()


def test_empty_index_and_queries(spark, tmp_path, docs):
    index = KeywordIndex(spark, f"file://{tmp_path}/index")
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert index.sizes() == (0, 0.0) and index.search(items).count() == 0
    index.add(docs.limit(0), 0)
    assert index.sizes()[0] == 0 and index.search(items).count() == 0
    index.add(docs, 1)
    assert index.search(items.limit(0)).count() == 0 and index.search(items).count() > 0
