"""Keyword and vector retrieval for tables of queries: postings, BM25, exact top-k, fusion, diversity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import written
from .blocks import nearest

K1, B, RRF_K, BOOST = 1.5, 0.75, 60, 1.3
#: Queries that a task holds, postings of documents that it streams past them, and scores that it has at once.
ASKED, READ, CELLS = 16_384, 2_000_000, 1 << 22
#: In so many pairs of a query and a document a token is shared once, if its product is made as a matrix, and tokens of such a matrix.
OFTEN, TOKENS = 300, 256


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(token, id, tf, dl)``. The length is taken before the explosion, so one shuffle, partially aggregated, suffices."""
    words = docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("w"))
    return X.unrolled(words.select("id", F.size("w").alias("dl"), F.explode_outer("w").alias("token")), "token").groupBy("id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def token_stats(posts: DataFrame, n_docs: int) -> DataFrame:
    """Uses, document frequency and inverse document frequency of each token, in one aggregation."""
    df = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
    return df.withColumn("idf", idf_of(n_docs))


def idf_of(n_docs: int) -> Column:
    return F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def tf_part(avgdl: float) -> Column:
    """The share of ``tf`` and ``dl`` in what a token adds to a document's BM25 score."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / max(avgdl, 1.0)))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark keeps k rows a task and key before the shuffle, so that hot keys do not gather."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, w)``: each document's tokens, written so that they are made once."""
    return written(docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("w")), "tokens")


class _Best:
    """The ``k`` best documents of each of ``size`` queries among those shown so far: by score to 9 digits, then by id."""

    def __init__(self, size: int, k: int) -> None:
        self.k, self.floor, self.held, self.rows = k, np.zeros(size), [], 0

    def show(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, len(ids) - self.k, axis=1)[:, -self.k])
        q, d = np.nonzero((scores > 0) & (scores >= self.floor[:, None] - 2e-9))  # what rounding may still lift
        self.held.append(pd.DataFrame({"q": q, "id": ids[d], "score": scores[q, d]}))
        self.rows += len(q)
        if self.rows > 4 * self.k * len(self.floor):
            self.cut()

    def cut(self) -> pd.DataFrame:
        whole = pd.concat(self.held) if self.held else pd.DataFrame({"q": [], "id": [], "score": []})
        whole = whole.assign(r=whole["score"].round(9)).sort_values(["q", "r", "id"], ascending=[True, False, True])
        whole["at"] = whole.groupby("q").cumcount()
        last = whole[whole["at"] == self.k - 1]
        self.floor[last["q"]] = np.maximum(self.floor[last["q"]], last["r"])
        whole = whole.loc[whole["at"] < self.k, ["q", "id", "score"]]
        self.held, self.rows = [whole], len(whole)
        return whole


def _scored(asked: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, docs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``docs (id, t, part)`` and the matrix of scores of ``size`` queries, ``asked`` as sorted tokens, their queries and weights.

    Tokens that one in ``OFTEN`` pairs of a query and a document share are multiplied as matrices, others added pair by pair.
    """
    at, ids = pd.factorize(docs["id"])
    rows = pd.DataFrame({"t": docs["t"].to_numpy(), "d": at, "part": docs["part"].to_numpy()}).groupby(["t", "d"], as_index=False)["part"].sum()
    t, d, part = (rows[c].to_numpy() for c in ("t", "d", "part"))
    out, (tokens, queries, weights) = np.zeros((size, len(ids))), asked
    each, first = np.unique(t, return_index=True)
    ends = np.append(first[1:], len(t))
    left, right = np.searchsorted(tokens, each, "left"), np.searchsorted(tokens, each, "right")
    pairs = (right - left) * (ends - first)
    often = pairs * OFTEN > out.size
    for some in np.array_split(np.nonzero(often)[0], -(-often.sum() // TOKENS) or 1):
        theirs, mine = np.zeros((len(some), size)), np.zeros((len(some), len(ids)))
        for row, i in enumerate(some):
            q, own = slice(left[i], right[i]), slice(first[i], ends[i])
            theirs[row, queries[q]], mine[row, d[own]] = weights[q], part[own]
        out += theirs.T @ mine
    for i in np.nonzero((pairs > 0) & ~often)[0]:
        q, own = slice(left[i], right[i]), slice(first[i], ends[i])
        out[queries[q][:, None], d[own][None, :]] += weights[q][:, None] * part[own][None, :]
    return np.asarray(ids), out


def ranked(posts: DataFrame, asked: DataFrame, k: int, n_queries: int, n_posts: int | None = None) -> DataFrame:
    """Rows ``(q, id, score)``, the k best of each query and task, of ``posts (id, t, part)`` and ``asked (q, t, weight)``.

    Queries are dealt into groups of ``ASKED`` and documents into groups of some ``READ`` postings. A task holds a group of queries and
    streams a group of documents past it, so that what a query shares with a document never becomes a row. ``n_posts``: how many postings, if known.
    """
    n, m = -(-n_queries // ASKED) or 1, max(posts.sparkSession.sparkContext.defaultParallelism, -(-(posts.count() if n_posts is None else n_posts) // READ))
    group = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    kind = dict(posts.dtypes)["id"]
    mine = asked.select(group("q", n).alias("i"), every(m).alias("j"), F.lit(0).alias("side"), "q", F.lit(None).cast(kind).alias("id"), "t", F.col("weight").alias("part"))
    yours = posts.select(every(n).alias("i"), group("id", m).alias("j"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("q"), "id", "t", "part")
    met = yours.unionByName(mine).repartitionById(min(n * m, 1 << 16), F.col("i") * m + F.col("j")).sortWithinPartitions("i", "j", "side", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs() -> Iterator[tuple[tuple, pd.DataFrame]]:
            for pdf in batches:
                yield from pdf.groupby(["i", "j", "side"], sort=True)

        for _, parts in groupby(pairs(), lambda x: x[0][:2]):
            held, wait, rows, best = [], [], 0, None

            def look(docs: pd.DataFrame) -> None:
                _, first = np.unique(pd.factorize(docs["id"])[0], return_index=True)
                ends = np.append(first[step::step], len(docs))
                for a, b in zip(first[::step], ends):
                    best.show(*_scored(words, len(names), docs.iloc[a:b]))

            for (_, _, side), pdf in parts:
                if side == 0:
                    held.append(pdf[["q", "t", "part"]])
                    continue
                if not held:
                    continue
                if best is None:
                    whole = pd.concat(held).sort_values("t", kind="stable")
                    at, names = pd.factorize(whole["q"].astype("int64"))
                    words, best, step = (whole["t"].to_numpy(), at, whole["part"].to_numpy()), _Best(len(names), k), max(1, CELLS // len(names))
                wait.append(pdf[["id", "t", "part"]])
                rows += len(pdf)
                if rows >= 100_000:
                    docs = pd.concat(wait)
                    # The last document may go on in the next batch.
                    last = (docs["id"] == docs["id"].iloc[-1]).to_numpy()
                    look(docs[~last])
                    wait, rows = [docs[last]], 0
            if best is not None:
                look(pd.concat(wait))
                found = best.cut()
                yield pd.DataFrame({"q": np.asarray(names)[found["q"].to_numpy(int)], "id": found["id"].to_numpy(), "score": found["score"].to_numpy()})

    return met.mapInPandas(run, f"q long, id {kind}, score double")


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 15) -> DataFrame:
    """Rows ``(query_id, id, score, rank)``: the k best documents of each query with a positive score.

    Documents are tokenised once; of their tokens only the queries' are counted, so that other postings are never formed. Scores are
    made within tasks, of which only the k best of a query leave.
    """
    said = queries.groupBy(F.col(query_id).alias("qid")).agg(F.flatten(F.collect_list(X.tokens(F.col(query_text)))).alias("w"))
    said = written(said.where(F.size("w") > 0).withColumn("q", F.monotonically_increasing_id()), "asked")
    vocabulary = written(said.select(F.explode("w").alias("token")).distinct().withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    words = tokenised(docs, id_col, text_col)
    n, avgdl = words.agg(F.count(F.lit(1)), F.avg(F.coalesce(F.size("w"), F.lit(0)))).first()  # a null text is an empty one
    each = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("token")).join(vocabulary, "token")
    counted = each.groupBy("id", "dl", "t").agg(F.count(F.lit(1)).alias("tf"))
    posts = written(counted.select("id", "t", tf_part(avgdl or 0.0).alias("part")), "postings")
    df = posts.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    times = said.select("q", F.explode("w").alias("token")).groupBy("q", "token").agg(F.count(F.lit(1)).alias("times"))
    asked = written(times.join(vocabulary, "token").join(df.select("t", idf_of(n or 0).alias("idf")), "t").select("q", "t", (F.col("times") * F.col("idf")).alias("weight")), "weights")
    hits = ranked(posts, asked, k, said.count())
    best = top_k(hits, ["q"], [F.round("score", 9).desc(), F.col("id")], k)
    return best.join(said.select("q", "qid"), "q").select("qid", "id", "score", "rank")


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact inner-product top-k of every query against every vector, by products of blocks."""
    q, v = (df.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding")) for df in (queries, vectors))
    return nearest(v, q, k).withColumnRenamed("id", id_col)


def rrf(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """Reciprocal-rank fusion of ``(qid, id, rank)`` lists (rank from 1) with a boost each: rows ``(qid, id, rrf)``."""
    parts = [df.select("qid", "id", (F.lit(boost) / (RRF_K + F.col("rank"))).alias("part")) for df, boost in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("qid", "id").agg(F.sum("part").alias("rrf"))


def diversify(ranked: DataFrame, limit: int) -> DataFrame:
    """``(qid, id, doc, is_proposition, score)``: keep propositions, and of a document's chunks only one that comes first of all its rows."""
    by = [F.round("score", 9).desc(), F.col("id")]
    first = ranked.withColumn("in_doc", F.row_number().over(W.partitionBy("qid", "doc").orderBy(*by)))
    return top_k(first.where("is_proposition or in_doc = 1").drop("in_doc"), ["qid"], by, limit)


def recommend(vectors: DataFrame, liked: DataFrame, disliked: DataFrame, k: int) -> DataFrame:
    """Rows ``(id, score)``: nearness to the mean of ``liked`` less nearness to that of ``disliked``; the given rows left out."""
    mean = lambda df, name: df.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias(name))
    # Without disliked rows only the liked ones pull; without liked ones nothing is recommended.
    centre = mean(liked, "p").join(mean(disliked, "n"), "i", "left").select("i", (F.col("p") - F.coalesce("n", F.lit(0.0))).alias("w"))
    axis = [r["w"] for r in centre.orderBy("i").collect()]  # as many numbers as the vectors have dimensions
    if not axis:
        return vectors.select("id", F.lit(0.0).alias("score")).limit(0)
    known = liked.select("id").unionByName(disliked.select("id"))
    scored = vectors.join(known, "id", "left_anti").select("id", F.round(X.dot(F.col("embedding"), F.array(*map(F.lit, axis))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)
