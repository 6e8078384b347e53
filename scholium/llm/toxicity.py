"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Each dictionary is trained on short windows of the texts of its class, every distinct window counting once, so that copies
of a text do not outweigh what recurs; both end with the same background of ordinary windows. A window's margin is its
length under the ordinary dictionary minus its length under the toxic one. A second round trains both anew on the windows
of the largest margins (those of toxic texts that do look toxic, and the ordinary ones most like them); calibration keeps
the better round. A logistic threshold over a text's largest margins is calibrated on labelled texts that neither
dictionary has seen.

Dictionaries and calibration are fitted on a bounded sample of labelled rows and of their windows (``max_toxic``,
``max_ordinary``, ``max_windows``, none longer than ``WIDEST`` bytes); scoring covers every window of every whole text. Null
and empty texts have no window and get the score of no margin. Rows with a null label are never learned from. If a class is
missing, the score is that of the only class known (0 without any). Repeated rows score alike and rows without an id get a
row each; ties in margins do not matter; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import bounded, fold, utf8, word_blocks

#: Words of a window that is scored and of one that is learned from, and the largest margins of a text that count.
WINDOW, LEARNED, TOP = 6, 2, 3
#: A margin that a chance match hardly reaches.
CLEAR = 7
#: Sizes of the dictionaries' own part and of the background, and of the pieces that training picks: about a word each.
OWN, BACKGROUND, PIECE = 1 << 14, 1 << 15, 28
#: Bytes of the longest window that is learned from.
WIDEST = 400
MARKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
#: Lower case for ASCII letters; other ASCII characters become spaces.
CLEAN = bytes(32 if b in MARKS else (b + 32 if 65 <= b <= 90 else b) for b in range(256))
#: A word is written three times, in shifted bytes, so that a match of a whole word outweighs the cost of coding a match.
SHIFTED = [bytes((b + s) % 256 for b in range(256)) for s in (85, 170)]
LONGEST = 48
_written: dict[bytes, bytes] = {}


def spelled(word: bytes) -> bytes:
    """A word as the dictionaries see it; very long ones are written once."""
    if (known := _written.get(word)) is not None:
        return known
    if len(word) > LONGEST:
        return b" " + word
    out = b" " + word + word.translate(SHIFTED[0]) + word.translate(SHIFTED[1])
    if len(_written) >= 200_000:
        _written.clear()
    _written[word] = out
    return out


def windows(text: object, size: int = WINDOW) -> Iterator[list[bytes]]:
    """The text's words in windows of ``size`` words; a block of windows at a time."""
    for words in word_blocks(utf8(text.lower() if isinstance(text, str) else text).translate(CLEAN)):
        coded = [_written[w] if w in _written else spelled(w) for w in words]
        yield [b"".join(coded[k : k + size]) + b" " for k in range(0, len(coded), size)]


class Coder:
    """Lengths of windows under one raw dictionary. Short matches count, so that single words are found."""

    def __init__(self, content: bytes):
        params = zstd.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=17, search_log=6, min_match=4, target_length=32, strategy=zstd.STRATEGY_LAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )
        content = content if len(content) >= 8 else content + b" " * 8
        shared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=params)
        self.make = zstd.ZstdCompressor(dict_data=shared, compression_params=params).compress

    def lengths(self, many: list[bytes]) -> np.ndarray:
        make = self.make
        return np.fromiter((len(make(w)) for w in many), np.int32, len(many))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content; too few samples are taken as they are."""
    try:
        return zstd.train_dictionary(size, samples, k=PIECE, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.ordinary, self.toxic = Coder(ordinary), Coder(toxic)

    def margins(self, many: list[bytes]) -> np.ndarray:
        return self.ordinary.lengths(many) - self.toxic.lengths(many)

    def features(self, text: object) -> list[float]:
        """The ``TOP`` largest margins of a text's different windows, and the logarithms of how many are clear and of their number."""
        best, n, clear = np.zeros(TOP, np.int32), 0, 0
        for many in windows(text):
            many = list(dict.fromkeys(many))
            gain = self.margins(many)
            n, clear = n + len(many), clear + int((gain >= CLEAR).sum())
            best = np.sort(np.concatenate([best, np.minimum(gain, 2 * CLEAR)]))[-TOP:]
        return [*map(float, np.maximum(best[::-1], 0)), math.log1p(clear), math.log1p(n)]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> list[tuple[bytes, bytes]]:
    """A toxic and an ordinary dictionary from windows of each class, by the first round and, if windows stand out, the second."""
    background = trained(ordinary, BACKGROUND)
    pair = lambda t, o: (trained(t, OWN) + background, trained(o, OWN) + background)
    out = [pair(toxic, ordinary)]
    distance = Distance(*out[0])
    t, o = distance.margins(toxic), distance.margins(ordinary)
    keep = np.flatnonzero(t > max(np.percentile(o, 99), 1))
    if len(keep) >= 100:
        hard = np.argsort(-o, kind="stable")[: max(len(keep), 2000)]
        out.append(pair([toxic[i] for i in keep], [ordinary[i] for i in hard]))
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) by ridge-regularised Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 2.0
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def log_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _learned_windows(fit: DataFrame, most: dict[int, int]) -> dict[int, list[bytes]]:
    """Distinct windows of the rows of each class; of more than ``most`` a share by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                for many in windows(text, LEARNED):
                    many = [w for w in dict.fromkeys(many) if len(w) <= WIDEST]
                    yield pd.DataFrame({"toxic": [toxic] * len(many), "w": many})

    found = written(fit.select("toxic", "text").mapInPandas(run, "toxic int, w binary").distinct(), "toxicwindows")
    counts = {r[0]: r[1] for r in found.groupBy("toxic").count().collect()}
    parts = {k: bounded(found.where(F.col("toxic") == k), F.col("w"), most[k], counts.get(k, 0)).orderBy("w").toPandas()["w"] for k in (0, 1)}
    return {k: [bytes(w) for w in part] for k, part in parts.items()}


def learn(labelled: DataFrame, max_toxic: int = 2500, max_ordinary: int = 5000, max_windows: tuple[int, int] = (60_000, 120_000)) -> tuple | None:
    """Dictionaries and weights from rows ``(doc_id, text, toxic)``; None if a class has no row.

    ``max_windows`` bounds the windows of toxic and of ordinary texts that reach the driver, ``WIDEST`` each one's bytes.
    """
    counts = {r[0]: r[1] for r in labelled.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    nt, no = counts.get(1, 0), counts.get(0, 0)
    if not nt or not no:
        return None
    labelled = labelled.withColumn("toxic", F.col("toxic").cast("int"))
    # By id and text, so that rows without an id, or many of one, are sampled too.
    key = F.concat_ws(":", F.lit("tox"), F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    sample = written(
        bounded(labelled.where("toxic = 1"), key, max_toxic, nt).unionByName(bounded(labelled.where("toxic = 0"), key, max_ordinary, no)).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(4)) == 0),
        "toxicsample",
    )
    seen = _learned_windows(sample.where("not held"), {1: max_windows[0], 0: max_windows[1]})
    if not seen[0] or not seen[1]:
        seen = _learned_windows(sample, {1: max_windows[0], 0: max_windows[1]})
    best = None
    for pair in dictionaries(seen[1] or [b" "], seen[0] or [b" "]):
        scored = features(sample.where("held"), pair, ["toxic"]).toPandas()
        if scored["toxic"].nunique() < 2:
            scored = features(sample, pair, ["toxic"]).toPandas()
        x, y = np.array(scored["x"].tolist(), float).reshape(-1, TOP + 2), scored["toxic"].to_numpy(float)
        weights = logistic(x, y)
        loss = log_loss(weights, x, y)
        if best is None or loss < best[0]:
            best = loss, pair, weights
    return best[1:]


def features(docs: DataFrame, pair: tuple[bytes, bytes], keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distance = Distance(*shared.value)
        for pdf in batches:
            yield pdf[keep].assign(x=[distance.features(t) for t in pdf["text"]])

    types = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", x array<double>")


def scores(docs: DataFrame, model: tuple | None, known: float = 0.0) -> DataFrame:
    """Rows ``(doc_id, score)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(known).alias("score"))
    dictionaries, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((dictionaries, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionaries, w = shared.value
        distance = Distance(*dictionaries)
        for pdf in batches:
            x = np.array([distance.features(t) for t in pdf["text"]], float).reshape(len(pdf), TOP + 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))})

    return docs.mapInPandas(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; labels are learned only where crc32 of the id modulo 5 is not 0."""
    seen = labels.where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    labelled = docs.where(fold("doc_id", 5) != 0).select("doc_id", "text").join(seen, "doc_id")
    model = learn(labelled)
    only = 0.0
    if model is None:
        only = float(seen.where("toxic = 1").limit(1).count())
    out = scores(docs, model, only)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
