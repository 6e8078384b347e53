"""Approximate neighbours by coarse centroids with probes: an index of every vector, searched by list, with exact products in what is probed.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors); every vector is then filed under its nearest centroid, and lists lie in
blocks of bounded size, so that a list that holds a third of all rows is many blocks. A search meets, for each query, the blocks of the
lists nearest to it and no others. How many lists are probed is measured: the fewest with which ``MEASURED`` vectors find the asked
share of their exact neighbours (``blocks.nearest``, which stays the exact way).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .blocks import best, nearest
from .retrieval import top_k

#: Vectors that centroids are fitted on, vectors whose recall is measured, the most centroids, vectors a block.
SAMPLE, MEASURED, MOST_LISTS, BLOCK = 20_000, 256, 4096, 1024


@dataclass(frozen=True)
class Index:
    """``lists``: rows ``(list, part, ids, flat)``; ``sizes``: the parts of each list; ``probes`` reach ``recall`` on the measured vectors."""

    lists: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    probes: int
    recall: float


def fitted(x: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``n`` unit centroids of the rows of ``x`` by spherical k-means."""
    centroids = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[k : k + 4096] @ centroids.T).argmax(1) for k in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _probed(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows ``(id, embedding, list, place)``: the nearest ``probes`` lists of each vector, from 0."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = f"id {dict(df.dtypes)['id']}, embedding array<double>, list int, place int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                x = np.array(part["embedding"].tolist(), float)
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(part)), near.shape[1])
                yield pd.DataFrame({"id": part["id"].to_numpy()[rows], "embedding": [x[k] for k in rows], "list": near.ravel(), "place": np.tile(np.arange(near.shape[1]), len(part))})

    return df.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").mapInPandas(run, schema)


def _searched(index: Index, probed: DataFrame, k: int, least: float, among: str = "others") -> DataFrame:
    """The ``k`` nearest among what the lists of ``probed`` hold, and the ``place`` of the list each was found in."""
    kind = dict(probed.dtypes)["id"]
    # A query meets a part of a list in a block of queries; all parts are of one size, whatever the list's.
    asked = probed.join(F.broadcast(index.sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    counts = asked.groupBy("list", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n"))
    dealt = asked.join(counts, ["list", "part"]).withColumn("share", F.pmod(F.xxhash64("id"), F.col("n")))
    packed = dealt.groupBy("list", "part", "share").agg(F.collect_list(F.struct("id", "place", "embedding")).alias("q"))
    met = packed.select("list", "part", F.col("q.id").alias("qids"), F.col("q.place").alias("places"), F.flatten("q.embedding").alias("x")).join(index.lists, ["list", "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qids, places, x, ids, flat in zip(*(pdf[c] for c in ("qids", "places", "x", "ids", "flat"))):
                qids = np.asarray(qids)
                sim = np.round(np.asarray(x, float).reshape(len(qids), -1) @ np.asarray(flat, float).reshape(len(ids), -1).T, 6)
                found = best(qids, np.asarray(ids), sim, k, least, among)
                yield found.assign(place=found["qid"].map(dict(zip(qids, places))))

    return met.mapInPandas(run, f"qid {kind}, id {dict(index.lists.dtypes)['ids'][6:-1]}, sim double, place int")


def built(vectors: DataFrame, k: int = 15, recall: float = 0.95, lists: int | None = None, least: float = -np.inf) -> Index:
    """An index of ``vectors (id, embedding)``, all of them; null embeddings are left out.

    ``recall``: the share of the ``k`` exact neighbours (of those above ``least``) that the probes must find.
    """
    vectors = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n = vectors.count()
    lists = lists or int(np.clip(np.sqrt(n), 1, MOST_LISTS))
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    by = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = np.array([r[0] for r in vectors.where(by).orderBy("id").select("embedding").limit(SAMPLE).collect()], float)
    if not len(sample):
        sample = np.zeros((1, 1))
    centroids = fitted(sample, min(lists, len(sample)))
    filed = _probed(vectors, centroids, 1)
    # One row a list: at most MOST_LISTS.
    sizes = written(filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_parts")), "listsizes")
    dealt = filed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("int"))
    packed = dealt.groupBy("list", "part").agg(F.collect_list(F.struct("id", "embedding")).alias("p"))
    found = written(packed.select("list", "part", F.col("p.id").alias("ids"), F.flatten("p.embedding").alias("flat")), "lists")
    index = Index(found, sizes, centroids, len(centroids), 1.0)
    asked = written(vectors.orderBy(F.xxhash64(F.lit("measured"), "id")).limit(MEASURED), "measured")
    want = nearest(vectors, asked, k, least).select("qid", "id", "sim")
    got = _searched(index, _probed(asked, centroids, len(centroids)), k, least)
    # Where the exact neighbours lie among a query's lists, nearest first.
    places = want.join(got.select("qid", "id", "place"), ["qid", "id"]).groupBy("place").count().collect()
    counts = np.zeros(len(centroids))
    for place, c in places:
        counts[place] += c
    if not counts.sum():
        return index
    reached = np.cumsum(counts) / counts.sum()
    probes = int(np.searchsorted(reached, recall - 1e-12)) + 1
    return Index(found, sizes, centroids, probes, float(reached[probes - 1]))


def search(index: Index, queries: DataFrame, k: int, least: float = -np.inf, probes: int | None = None, among: str = "others") -> DataFrame:
    """Rows ``(qid, id, sim, rank)`` as of ``blocks.nearest``, among the vectors of each query's probed lists; products are exact."""
    found = _searched(index, _probed(queries, index.centroids, probes or index.probes), k, least, among).drop("place")
    return top_k(found, ["qid"], [F.desc("sim"), F.col("id")], k)


def recall(index: Index, vectors: DataFrame, queries: DataFrame, k: int, least: float = -np.inf) -> float:
    """The share of exact neighbours that a search finds."""
    want = nearest(vectors, queries, k, least).select("qid", "id")
    got = search(index, queries, k, least).select("qid", "id").withColumn("found", F.lit(1))
    n, hit = want.join(got, ["qid", "id"], "left").agg(F.count(F.lit(1)), F.count("found")).first()
    return hit / n if n else 1.0
