"""Exact products by blocks, and the index of lists with its measured recall."""

import numpy as np
import pytest

from scholium.operators import ann, blocks
from scholium.operators import graph as G
from scholium.operators import linkage as L


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    # One cluster holds a third of all rows.
    x = np.array([centres[0 if k % 3 == 0 else k % 12] + 0.4 * r.normal(size=16) for k in range(1500)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(len(x))], "id long, embedding array<double>").persist()


def exact(x, q, k):
    sim = np.round(x @ x[q], 6)
    return [(int(i), float(sim[i])) for i in sorted((i for i in range(len(x)) if i != q), key=lambda i: (-sim[i], i))[:k]]


@pytest.mark.parametrize("few", [2048, 0])
def test_nearest_by_scan_and_by_blocks(spark, clustered, monkeypatch, few):
    x, v = clustered
    monkeypatch.setattr(blocks, "FEW", few)
    got = blocks.nearest(v, v.where("id % 100 = 7"), 5, rows=32).collect()
    found = {q: [(r["id"], r["sim"]) for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q] for q in range(7, 1500, 100)}
    assert found == {q: exact(x, q, 5) for q in found}


def test_pairs_meet_once_in_groups(spark, clustered, monkeypatch):
    x, v = clustered
    monkeypatch.setattr(blocks, "HELD", 3)
    got = blocks.similar_pairs(v.where("id < 300"), 0.8, rows=16).collect()
    sim = np.round(x[:300] @ x[:300].T, 6)
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a in range(300) for b in range(a + 1, 300) if sim[a, b] >= 0.8]


def test_index_reaches_its_recall(spark, clustered):
    x, v = clustered
    index = ann.built(v, k=10, recall=0.97)
    assert index.lists.selectExpr("sum(size(ids))").first()[0] == 1500 and index.recall >= 0.97
    assert 0.95 <= ann.recall(index, v, v.where("id % 10 = 3"), 10) <= 1
    assert index.probes < len(index.centroids)
    # With all lists probed the search is the exact one.
    same = {(r["qid"], r["rank"]): (r["id"], r["sim"]) for r in ann.search(index, v.where("id % 300 = 1"), 4, probes=len(index.centroids)).collect()}
    assert same == {(q, k + 1): p for q in range(1, 1500, 300) for k, p in enumerate(exact(x, q, 4))}


def test_only_probed_lists_are_met(spark, clustered):
    _, v = clustered
    index = ann.built(v, k=10)
    one = ann._probed(v.where("id = 5"), index.centroids, 1)
    mine = one.first()["list"]
    inside = {i for r in index.lists.where(f"list = {mine}").collect() for i in r["ids"]}
    assert {r["id"] for r in ann.search(index, v.where("id = 5"), 50, probes=1).collect()} <= inside


def test_index_serves_the_linkers(spark, clustered):
    _, v = clustered
    index = ann.built(v, k=5, recall=1.0, least=0.9)
    some, old = v.where("id % 7 = 0"), v
    assert {r["id"] for r in L.repeated_vectors(some, old, 0.95, index).collect()} <= {r["id"] for r in L.repeated_vectors(some, old, 0.95).collect()}
    whole = v.selectExpr("id", "embedding", "array(cast(id % 50 as string)) as docs")
    exact_, found = ({(r["a"], r["b"]) for r in G.latent_links(whole, 6, 0.9, index=i).collect()} for i in (None, index))
    assert found and len(exact_ & found) >= 0.95 * len(exact_)


def test_small_and_empty_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(ann.built(v), v.where("id = 1"), 3).collect()] == [(1, 3, 0.0, 1)]
    empty = v.limit(0)
    assert ann.search(ann.built(empty), empty, 3).count() == blocks.nearest(v.where("id <> 2"), empty, 3).count() == blocks.similar_pairs(empty, 0.5).count() == 0
