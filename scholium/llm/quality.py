"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, the shapes of its words (classes of characters, repeats taken once), how large a share of the text one
word makes (by the length of the text), and how many words equal the one before; each kind counts as square roots of relative
frequencies, at hashed places. Latent-semantic vectors are products with the leading singular directions of the labelled texts'
weighted terms. The labelled vectors are broadcast; every document's cosines with all of them are exact products, a block of
documents at a time, and the ``NEAREST`` vote with their labels, weighted by a power of the similarity.

Directions, term weights and neighbours come from a bounded sample of labelled rows (``max_rows``, by a hash of the id, broadcast to the
documents); texts that occur more than once in it vote once, with their mean label. Every document is scored by its whole text.
Null and empty texts have no vector and score the mean label of the neighbours, as a text does that is like none. Rows with a null
label teach nothing; without a row that teaches every score is 0.5. Ties in similarity (compared to six decimals) go to the
neighbour whose text has the smaller hash, so equal texts score alike in every block. Repeated rows and rows without an id get
a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import bounded, few_rows, fold, utf8, word_blocks

#: Places for words, for shapes, for shares by length, and for equal neighbours; weights of the four kinds.
SIZES, WEIGHTS = (1024, 512, 240, 2), (0.2, 1.0, 0.7, 1.5)
#: Length of the vectors, neighbours that vote, and the power of a similarity that is its weight.
DIMENSIONS, NEAREST, POWER = 64, 15, 16
#: Rows that are multiplied with all neighbours at once.
BLOCK = 128
#: Classes of bytes: capitals, digits, other letters (all bytes beyond ASCII too); any other byte is its own.
SHAPE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_places: dict[bytes, tuple[int, int]] = {}


def places(word: bytes) -> tuple[int, int]:
    """Where a word and its shape count. Of a very long word's shape the first 32 classes tell."""
    if (known := _places.get(word)) is not None:
        return known
    shape = word.translate(SHAPE)
    shape = bytes(b for k, b in enumerate(shape) if k == 0 or b != shape[k - 1])[:32]
    out = zlib.crc32(word.lower()) % SIZES[0], SIZES[0] + zlib.crc32(shape) % SIZES[1]
    if len(word) <= 64:
        if len(_places) >= 200_000:
            _places.clear()
        _places[word] = out
    return out


def terms(text: object) -> np.ndarray:
    """Square roots of relative frequencies, by kind of term; zeros for a text without words."""
    counts: Counter[bytes] = Counter()
    same, last = 0, b""
    for words in word_blocks(utf8(text)):
        counts.update(words)
        same, last = same + (words[0] == last) + sum(map(eq, words, words[1:])), words[-1]
    out = np.zeros(sum(SIZES))
    if not counts:
        return out
    n = np.fromiter(counts.values(), float, len(counts))
    total = n.sum()
    n /= total
    at = np.array([places(w) for w in counts])
    length = min(int(np.log2(total) / 2), 9)
    share = SIZES[0] + SIZES[1] + np.minimum(np.floor(-np.log2(n)), 23).astype(int) * 10 + length
    for k, kind in enumerate((at[:, 0], at[:, 1], share)):
        out += WEIGHTS[k] * np.sqrt(np.bincount(kind, n, len(out)))
    same /= max(total - 1, 1)
    out[-2:] = WEIGHTS[3] * np.sqrt([same, 1 - same])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 1e-12, length, 1)


class Model:
    """Term weights, directions, and the neighbours with their labels. Singles are weighted in place: the sample is held once."""

    def __init__(self, x: np.ndarray, label: np.ndarray, dimensions: int = DIMENSIONS):
        # Terms that most labelled texts have say little: inverse document frequencies over them.
        self.weight = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1
        x = np.asarray(x, np.float32)
        x *= self.weight.astype(np.float32)
        _, vectors = np.linalg.eigh((x.T @ x).astype(float))
        self.directions = vectors[:, ::-1][:, :dimensions].copy()
        self.neighbours, self.label, self.base = unit((x @ self.directions.astype(np.float32)).astype(float)), label, float(label.mean())

    def scores(self, x: np.ndarray) -> np.ndarray:
        some = x.any(1)
        z = unit((x * self.weight) @ self.directions)
        near = np.rint((z @ self.neighbours.T) * 1e6).astype(np.int64)
        n, k = len(self.label), min(NEAREST, len(self.label))
        # One key a neighbour, so that no two are equal: by similarity, then by place.
        best = np.argpartition(near * n - np.arange(n), n - k, axis=1)[:, n - k :]
        best.sort(axis=1)
        weight = np.maximum(np.take_along_axis(near, best, 1) / 1e6, 0) ** POWER
        total = weight.sum(1)
        out = np.where(total > 0, (weight * self.label[best]).sum(1) / np.where(total > 0, total, 1), self.base)
        return np.where(some, np.clip(out, 0, 1), self.base)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model | None:
    """A model from documents ``(doc_id, text)`` and labels ``(doc_id, label)``; None if no labelled row has a document.

    About ``max_rows`` labels are taken, by a hash of their ids.
    """
    seen = written(labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")), "qualitylabels")
    some = F.broadcast(bounded(seen, F.concat(F.lit("quality"), F.col("doc_id").cast("string")), max_rows, seen.count()))
    sample = docs.select("doc_id", "text").join(some, "doc_id").where("text is not null").groupBy("text").agg(F.avg("label").alias("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few_rows(batches):
            found = [terms(t) for t in pdf["text"]]
            at = [np.flatnonzero(x) for x in found]
            yield pd.DataFrame({"hash": pdf["hash"], "label": pdf["label"], "at": at, "x": [x[k].astype(np.float32) for x, k in zip(found, at)]})

    rows = written(sample.select(F.xxhash64("text").alias("hash"), "label", "text").mapInPandas(run, "hash long, label double, at array<long>, x array<float>"), "qualitysample").orderBy("hash", "label").toPandas()
    if not len(rows):
        return None
    x = np.zeros((len(rows), sum(SIZES)), np.float32)
    for k, (at, values) in enumerate(zip(rows["at"], rows["x"])):
        x[k, np.asarray(at, int)] = values
    return Model(x, rows["label"].to_numpy(float))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows ``(doc_id, score)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in few_rows(batches, BLOCK):
            x = np.array([terms(t) for t in pdf["text"]]).reshape(len(pdf), -1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": model.scores(x)})

    return docs.mapInPandas(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; labels are learned only where crc32 of the id modulo 5 is not 0."""
    model = learn(docs, labels.where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label")))
    out = scores(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
