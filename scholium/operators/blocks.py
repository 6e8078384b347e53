"""Exact inner products of many vectors: blocks of them meet as products of matrices, and only what is asked for leaves a task.

Few queries are broadcast (``FEW``, counted first) and the vectors are scanned once where they lie. Otherwise blocks are dealt into groups of
``HELD``; a task takes one group of either side, holds one and streams the other past it, so that a block is shipped once for each
group of the other side, not for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Queries that are broadcast, and blocks that a task holds.
FEW, HELD = 2048, 16


def blocks(vectors: DataFrame, rows: int = 1024) -> DataFrame:
    """Rows ``(block, ids, flat)`` of ``vectors (id, embedding)``: some ``rows`` vectors each, side by side in one array."""
    n = max(1, -(-vectors.count() // rows))
    dealt = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
    packed = F.collect_list(F.struct("id", "embedding"))
    return written(dealt.groupBy("block").agg(packed.alias("p")).select("block", F.col("p.id").alias("ids"), F.flatten("p.embedding").alias("flat")), "blocks")


def _met(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Rows ``(i, j, side, block, ids, flat)``: the groups ``i`` of the left and ``j`` of the right side, the left one first, a task for each
    pair of groups. Without a right side the left one meets itself, each pair of groups once."""
    other = left if right is None else right
    size = lambda df: max(1, -(-df.count() // HELD))
    n, m = size(left), size(other)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    mine = left.withColumn("i", F.pmod("block", F.lit(n)).cast("int")).withColumn("j", every(m)).withColumn("side", F.lit(0))
    yours = other.withColumn("j", F.pmod("block", F.lit(m)).cast("int")).withColumn("i", every(n)).withColumn("side", F.lit(1))
    both = mine.unionByName(yours).where("i <= j" if right is None else "true")
    return both.repartitionById(min(n * m, 1 << 16), F.col("i") * m + F.col("j")).sortWithinPartitions("i", "j", "side", "block").select("i", "j", "side", "block", "ids", "flat")


def _pairs(batches: Iterator[pd.DataFrame], once: bool) -> Iterator[tuple]:
    """Numbers, ids and vectors of two blocks; ``once`` for a side that meets itself."""
    at, held = None, []
    for pdf in batches:
        for i, j, side, block, ids, flat in zip(*(pdf[c] for c in ("i", "j", "side", "block", "ids", "flat"))):
            x = np.array(flat, float).reshape(len(ids), -1)
            if (i, j) != at:
                at, held = (i, j), []
            if side == 0:
                held.append((block, np.array(ids), x))
                continue
            for mine, ia, xa in held:
                if once and i == j and mine > block:
                    continue
                yield mine, ia, xa, block, np.asarray(ids), x


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of two blocks and their products to six digits."""
    for _, ia, xa, _, ib, xb in _pairs(batches, False):
        yield ia, ib, np.round(xa @ xb.T, 6)


def _alike(xa: np.ndarray, xb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in two blocks whose product to six digits is ``least`` or more, and these products. Products in single precision, which err by
    less than ``slack``, say which pairs are multiplied again."""
    longest = [float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))) for x in (xa, xb)]
    slack = 1e-6 + 1.2e-7 * (xa.shape[1] + 3) * longest[0] * longest[1]
    near = np.flatnonzero(xa.astype(np.float32) @ xb.T.astype(np.float32) >= least - slack)
    if 20 * len(near) > len(xa) * len(xb):
        sim = np.round(xa @ xb.T, 6)
        u, v = np.nonzero(sim >= least)
        return u, v, sim[u, v]
    u, v = np.divmod(near, len(xb))
    sim = np.round(np.einsum("ij,ij->i", xa[u], xb[v]), 6)
    return u[sim >= least], v[sim >= least], sim[sim >= least]


def similar_pairs(vectors: DataFrame, least: float, rows: int = 1024) -> DataFrame:
    """Pairs ``(a, b, sim)``, a < b, of ``vectors (id, embedding)`` with an inner product of ``least`` or more, to 6 digits.

    Exact: every block of vectors meets every other once; only pairs found leave a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for mine, ia, xa, theirs, ib, xb in _pairs(batches, True):
            u, v, sim = _alike(xa, xb, least)
            a, b = ia[u], ib[v]
            keep = (a < b) if mine == theirs else (a != b)
            yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": sim[keep]})

    return _met(blocks(vectors, rows)).mapInPandas(run, "a long, b long, sim double")


def similar_places(dealt: DataFrame, least: float) -> DataFrame:
    """Rows ``(a, b, na, nb, links)``: for two of the blocks that ``blocks`` has dealt their numbers, sizes, and pairs of places with an inner
    product of ``least`` or more, the place in ``a`` times 65,536 plus that in ``b``; of a block and itself each pair once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, frame = [], lambda rows: pd.DataFrame(rows, columns=["a", "b", "na", "nb", "links"])
        for mine, ia, xa, theirs, ib, xb in _pairs(batches, True):
            u, v, _ = _alike(xa, xb, least)
            keep = u < v if mine == theirs else slice(None)
            found.append((mine, theirs, len(ia), len(ib), (u[keep] << 16 | v[keep]).astype(np.int32)))
            if len(found) == HELD:
                yield frame(found)
                found = []
        yield frame(found)

    return _met(dealt).mapInPandas(run, "a long, b long, na int, nb int, links array<int>")


def best(qids: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int, least: float, among: str = "others") -> pd.DataFrame:
    """The ``k`` nearest of each query in a matrix of products, among ``others`` than itself, ``earlier`` ids or ``all``; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, sim = ids[order], sim[:, order]
    out = sim < least
    if among != "all":
        out |= ids[None, :] >= qids[:, None] if among == "earlier" else qids[:, None] == ids[None, :]
    sim = np.where(out, -np.inf, sim)
    if sim.shape[1] > 4 * k:
        # What is under a query's k-th largest product cannot be among the first k.
        floor = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k][:, None]
        u, v = np.nonzero((sim >= floor) & (sim > -np.inf))
        found = pd.DataFrame({"q": u, "v": v, "s": sim[u, v]}).sort_values(["q", "s", "v"], ascending=[True, False, True], kind="stable")
        found = found[found.groupby("q").cumcount() < k]
        u, v = found["q"].to_numpy(), found["v"].to_numpy()
    else:
        first = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        u, v = np.repeat(np.arange(len(qids)), first.shape[1]), first.ravel()
        keep = sim[u, v] > -np.inf
        u, v = u[keep], v[keep]
    return pd.DataFrame({"qid": qids[u], "id": ids[v], "sim": sim[u, v]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -np.inf, rows: int = 1024, among: str = "others") -> DataFrame:
    """Rows ``(qid, id, sim, rank)``: for ``queries (id, embedding)`` the ``k`` nearest of ``vectors (id, embedding)``, itself left out (``among``
    as of ``best``; ``all`` where the two sides' ids name different things).

    Exact. A block hands on at most ``k`` rows a query; ties go to the smaller id. Products under ``least`` are left out.
    """
    from .retrieval import top_k

    types = dict(queries.dtypes)["id"], dict(vectors.dtypes)["id"]
    schema, order = f"qid {types[0]}, id {types[1]}, sim double", [F.desc("sim"), F.col("id")]
    some = queries.select("id", "embedding").where("embedding is not null").limit(FEW + 1).toPandas()
    if len(some) <= FEW:
        if not len(some):
            return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
        asked = np.array(some["id"]), np.array(some["embedding"].tolist(), float)
        shared = vectors.sparkSession.sparkContext.broadcast(asked)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, x = shared.value
            for pdf in batches:
                for at in range(0, len(pdf), rows):
                    part = pdf.iloc[at : at + rows]
                    yield best(qids, part["id"].to_numpy(), np.round(x @ np.array(part["embedding"].tolist(), float).T, 6), k, least, among)

        return top_k(vectors.select("id", "embedding").where("embedding is not null").mapInPandas(scan, schema), ["qid"], order, k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ia, ib, sim in _products(batches):
            yield best(ia, ib, sim, k, least, among)

    return top_k(_met(blocks(queries, rows), blocks(vectors, rows)).mapInPandas(run, schema), ["qid"], order, k)
