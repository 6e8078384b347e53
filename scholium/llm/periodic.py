"""Periodic runs of words by block convolution: exact number-theoretic transforms of squared differences at dyadic scales.

At scale B every second block of B words is compared with the windows that follow it at distances B to 2B - 1: the sum of
squared differences of word numbers, a block's squares and a window's less twice their correlation, is zero where the block
recurs. Correlations are transforms modulo a prime, computed as products with the transform's matrix in doubles that hold every
integer exactly. A run of period q and length 4q or more holds such a block of the scale with B <= q < 2B and the place q
words further, whatever the alignment, so none is missed. A zero is a residue, hence a seed: it is extended word by word both
ways, which also drops the rare sum that is a multiple of the prime, and a stretch is a run if it is long enough and no part of
its period divides it. Runs of smaller scales mask the blocks that lie in them, so that a text of one word is no worse than others.

Texts are taken whole; several stand in one sequence, parted by numbers of their own. A text's words stay in memory as numbers and
as a vocabulary; blocks beyond ``LONGEST`` words are looked for by their first ``LONGEST``. Null and empty texts, and those without
a run: no run, the collapsed text is the words joined by single spaces. Rows without an id are never planted in; repeated rows
get a row each. Ties between longest runs go to the smallest start, then period. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, utf8, word_blocks

#: A prime that is 1 more than a multiple of 2**20: 64 products of centred residues sum to less than 2**53.
PRIME, ORDER, RADIX = 7340033, 1 << 20, 64
#: Words of the longest block that is transformed, and numbers that one step of work holds.
LONGEST, WORK = 1 << 18, 1 << 18
#: Words of texts that are put into one sequence, and different words after which their numbers begin anew.
SEQUENCE, VOCABULARY = 1 << 17, 1 << 20
#: A run is at least so long, and so many times its period.
SHORTEST, TIMES = 6, 4


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues between -PRIME/2 and PRIME/2, in place."""
    x -= np.rint(x * (1 / PRIME)) * PRIME
    return x


@lru_cache(maxsize=None)
def _root(n: int, inverse: bool) -> int:
    """A root of unity of order ``n``."""
    g = next(g for g in range(2, PRIME) if pow(g, (PRIME - 1) // 2, PRIME) != 1 and pow(g, (PRIME - 1) // 7, PRIME) != 1)
    root = pow(g, (PRIME - 1) // n, PRIME)
    return pow(root, -1, PRIME) if inverse else root


def _powers(root: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    at = 1
    while at < n:
        out[at : 2 * at] = out[: len(out[at : 2 * at])] * pow(root, at, PRIME) % PRIME
        at *= 2
    return out


@lru_cache(maxsize=None)
def _matrix(n: int, inverse: bool) -> np.ndarray:
    """The transform of ``n`` values as a matrix; the inverse is divided by ``n``."""
    k = np.arange(n)
    out = _powers(_root(n, inverse), n)[np.outer(k, k) % n]
    return reduced((out * pow(n, -1, PRIME) % PRIME if inverse else out).astype(float))


@lru_cache(maxsize=16)
def _twiddles(rows: int, cols: int, inverse: bool) -> np.ndarray:
    return reduced(_powers(_root(rows * cols, inverse), rows * cols)[np.outer(np.arange(rows), np.arange(cols)) % (rows * cols)].astype(float))


def transform(x: np.ndarray) -> np.ndarray:
    """The transforms of the last axis (a power of two), in an order of their own that ``inverse`` undoes."""
    n = x.shape[-1]
    if n <= RADIX:
        return reduced(x @ _matrix(n, False))
    rows = min(RADIX, n // RADIX)
    y = reduced(np.matmul(_matrix(rows, False), x.reshape(*x.shape[:-1], rows, n // rows)))
    y *= _twiddles(rows, n // rows, False)
    return transform(reduced(y)).reshape(x.shape)


def inverse(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    if n <= RADIX:
        return reduced(x @ _matrix(n, True))
    rows = min(RADIX, n // RADIX)
    y = inverse(x.reshape(*x.shape[:-1], rows, n // rows))
    y *= _twiddles(rows, n // rows, True)
    return reduced(np.matmul(_matrix(rows, True), reduced(y))).reshape(x.shape)


def seeds(v: np.ndarray, squares: np.ndarray, starts: np.ndarray, scale: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of blocks and distances from ``scale`` to ``2 * scale - 1`` at which they recur. ``v`` goes on for ``3 * scale`` zeros."""
    b = min(scale, longest)
    block, window = sliding_window_view(v, b), sliding_window_view(v, 2 * b)
    step = max(1, WORK // (2 * b))
    for k in range(0, len(starts), step):
        s = starts[k : k + step]
        mine = np.zeros((len(s), 2 * b))
        mine[:, :b] = block[s][:, ::-1]
        mine, own = transform(mine), squares[s + b] - squares[s]
        for first in range(scale, 2 * scale, b):
            cross = inverse(reduced(mine * transform(window[s + first])))[:, b - 1 : 2 * b - 1]
            at = s[:, None] + np.arange(first, first + b)
            i, d = np.nonzero(reduced(own[:, None] + squares[at + b] - squares[at] - 2 * cross) == 0)
            if len(i):
                yield s[i], first + d


def _same(w: np.ndarray, a: int, b: int, most: int, back: bool) -> int:
    """How many words from ``a`` and ``b`` on, or before them, are equal, ``most`` at most."""
    done, step = 0, 64
    while done < most:
        n = min(step, most - done)
        x, y = (w[a - done - n : a - done][::-1], w[b - done - n : b - done][::-1]) if back else (w[a + done : a + done + n], w[b + done : b + done + n])
        if (differ := x != y).any():
            return done + int(differ.argmax())
        done, step = done + n, 2 * step
    return done


def _primitive(w: np.ndarray, lo: int, hi: int, d: int) -> bool:
    """No smaller period: one of a stretch of more than twice ``d`` would divide ``d``."""
    left, p = d, 2
    while left > 1:
        p = left if p * p > left else p
        if left % p == 0:
            q = d // p
            if np.array_equal(w[lo : hi - q], w[lo + q : hi]):
                return False
            while left % p == 0:
                left //= p
        p += 1
    return True


def found_runs(w: np.ndarray, ends: np.ndarray, longest: int = LONGEST) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a sequence of positive numbers, in texts that end before the places ``ends``.

    The last number of every text occurs nowhere else, so that no run leaves its text.
    """
    n, most = len(w), int(np.diff(ends, prepend=0).max(initial=0))
    v = np.zeros(n + 3 * max(1, most // TIMES) + 2)
    v[:n] = w
    reduced(v)
    squares = np.concatenate([[0.0], np.cumsum(reduced(v * v))])
    begins = np.concatenate([[0], ends[:-1]])
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the known run that goes furthest from a place
    out, scale = [], 1
    while TIMES * scale <= most:
        b = min(scale, longest)
        s = np.arange(0, n, 2 * scale)
        text = np.searchsorted(ends, s, "right")
        open_ = (s + 2 * scale < ends[text]) & (TIMES * scale < ends[text] - begins[text])
        s = s[open_ & (reach[s] < np.minimum(s + 3 * scale - 1, ends[text] - 1))]
        some = list(seeds(v, squares, s, scale, longest)) if len(s) else []
        if some:
            s, d = (np.concatenate(x) for x in zip(*some))
            known = (reach[s] >= s + b + d) & (d % period[s] == 0)
            s, d = s[~known], d[~known]
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            # A first few words for all seeds at once: most chance hits end there.
            lo, hi = s.copy(), s.copy()
            for _ in range(12):
                lo -= (lo > 0) & (w[lo - 1] == w[np.minimum(lo - 1 + d, n - 1)])
            for _ in range(12):
                ahead = hi + d
                hi += (ahead < n) & (w[np.minimum(hi, n - 1)] == w[np.minimum(ahead, n - 1)])
            ended = (hi < s + 12) & (lo > s - 12)
            keep = ~ended | (hi - lo + d >= np.maximum(SHORTEST, TIMES * d))
            last = (0, 0, 0)
            for s, d in zip(s[keep].tolist(), d[keep].tolist()):
                if last[0] == d and last[1] <= s < last[2]:
                    continue
                lo = s - _same(w, s, s + d, s, True)
                hi = s + _same(w, s, s + d, n - s - d, False)
                last = d, lo, max(hi, s + 1)
                hi += d
                if hi - lo >= max(SHORTEST, TIMES * d) and _primitive(w, lo, hi, d):
                    out.append((lo, hi - lo, d))
                    further = reach[lo:hi] < hi
                    reach[lo:hi][further], period[lo:hi][further] = hi, d
        scale *= 2
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def planted(w: np.ndarray, doc_id: int) -> np.ndarray:
    """The contract's repetition, planted in a tenth of the texts."""
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = w.copy()
    out[a:] = w[a + np.arange(n - a) % p]
    return out


def numbered(text: object, known: dict[bytes, int]) -> np.ndarray:
    """A text's words as numbers from 1; new words are added to ``known``."""
    parts = [np.zeros(0, np.int64)]
    for words in word_blocks(utf8(text)):
        for x in dict.fromkeys(words):
            if x not in known:
                known[x] = len(known) + 1
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return np.concatenate(parts)


def collapsed(w: np.ndarray, runs: list[tuple[int, int, int]], words: list[bytes]) -> bytes:
    """The words that are in no run, or in the first period of every run that they are in."""
    if runs:
        change = np.zeros(len(w) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        w = w[np.cumsum(change[:-1]) == 0]
    return b" ".join([words[k - 1] for k in w.tolist()])


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Rows ``(doc_id, runs, collapsed)``: all runs of a text by start and period, and the text with each run cut to its first period.

    ``plant`` takes the texts with the contract's repetition in them.
    """

    def done(many: list[tuple[object, np.ndarray]], known: dict[bytes, int]) -> pd.DataFrame:
        words = list(known)
        # Each text is followed by a number of its own.
        ends = np.cumsum([len(w) + 1 for _, w in many])
        w = np.concatenate([x for k, (_, w) in enumerate(many) for x in (w, [len(words) + 1 + k])])
        runs = found_runs(w, ends)
        text = np.searchsorted(ends, [r[0] for r in runs], "right").tolist()
        mine: list[list[tuple[int, int, int]]] = [[] for _ in many]
        for k, (start, length, period) in zip(text, runs):
            mine[k].append((start - (int(ends[k - 1]) if k else 0), length, period))
        return pd.DataFrame({
            "doc_id": pd.array([i for i, _ in many], "Int64"), "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in mine],
            "collapsed": [collapsed(w, r, words).decode("utf-8", "replace") for (_, w), r in zip(many, mine)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many, known, size = [], {}, 0
        for pdf in few_rows(batches):
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                w = numbered(text, known)
                many.append((doc_id, planted(w, doc_id) if plant and doc_id is not None else w))
                size += len(w) + 1
                if size >= SEQUENCE or len(known) >= VOCABULARY:
                    yield done(many, known)
                    many, known, size = [], {}, 0
        if many:
            yield done(many, known)

    kind = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, kind)


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = periodic_runs(docs, plant=True)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
