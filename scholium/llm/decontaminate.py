"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick five of up to ten neighbouring words and ignore the others, so that substituted words do not hide a passage.
Hashes of the test items under every mask are joined with those of the training texts; around a hit, the words of both sides
are laid side by side and compared. A document leaks an item if, somewhere, ``WINDOW`` consecutive words of the item (all of
them, if it has fewer) stand in it with at least ``SIMILARITY`` of the positions equal. The masks find every such place:
no distribution of the allowed substitutions avoids them all (a test goes through all of them). Items of 5 to 11 words must
stand whole; items of fewer than five words say too little and match nothing.

Words are runs of ASCII letters and digits, without case, and of other characters. Null and empty texts have no words.
Repeated rows and repeated places give one row for each (doc_id, item_id); rows without an id appear with a null id. Empty
tables give empty results; further columns are ignored. Of several places the one with most equal words counts, ties going
to the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import utf8

SEED_WORDS, SIMILARITY, WINDOW, SHORTEST = 5, 0.8, 20, 12
#: Words kept on either side of a hit; more than a window reaches.
REACH = 40
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text hashed at a time.
BLOCK = 1 << 21
#: Places whose hits go into one stretch, so that its words are bounded however many hits follow each other.
STRETCH = 512
#: Rows of one hash, on either side of the join, that one task takes; a hash with more is dealt over several.
HEAVY = 4096


def allowed(n: int) -> int:
    """Substitutions that n compared words may have."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def masks_for(lengths: range = range(SHORTEST, WINDOW + 1), weight: int = SEED_WORDS, span: int = 10) -> list[tuple[int, ...]]:
    """A set of masks, chosen greedily, such that each way to substitute words leaves one of them untouched somewhere."""
    open_cases = {(n, bad) for n in lengths for bad in combinations(range(n), allowed(n))}
    shapes = [(0, *rest) for s in range(weight - 1, span) for rest in combinations(range(1, s + 1), weight - 1) if rest[-1] == s]
    # The hardest lengths decide: those with the largest share of substitutions.
    hard = {c for c in open_cases if c[0] in (15, 20)} or open_cases
    chosen: list[tuple[int, ...]] = []
    while hard:
        best = max(shapes, key=lambda m: sum(spared(m, n, bad) for n, bad in hard))
        chosen.append(best)
        hard = {c for c in hard if not spared(best, *c)}
        open_cases = {c for c in open_cases if not spared(best, *c)}
        hard = hard or open_cases
    return chosen


def spared(mask: tuple[int, ...], n: int, bad: tuple[int, ...]) -> bool:
    hit = set(bad)
    return any(all(at + k not in hit for k in mask) for at in range(n - mask[-1]))


#: What ``masks_for()`` returns; fixed, since it takes a while. A test compares.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(max(n, BLOCK + (1 << 16)), base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words, by differences of a running polynomial."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], _is_word[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_lower[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hashes under a mask at each place where it fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(number + 1), np.uint64)
    for k in mask:
        out = out * np.uint64(BASE) + words[k : k + n]
    return mixed(out)


class Filter:
    """A Bloom filter of fixed size: two bits for each hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(1 << bits, bool) if data is None else data

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h >> np.uint64(64 - self.bits), h & np.uint64((1 << self.bits) - 1)

    def add(self, h: np.ndarray) -> None:
        for at in self.places(h):
            self.data[at] = True

    def may(self, h: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(self.data[h >> np.uint64(64 - self.bits)])
        return first[self.data[h[first] & np.uint64((1 << self.bits) - 1)]]


def item_seeds(items: DataFrame) -> DataFrame:
    """Rows ``(h, item_id, place, n)`` of the test items' hashes; ``words`` are kept apart, by ``item_words``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"]):
                words, _ = word_hashes(utf8(text))
                n = len(words)
                if n < SEED_WORDS:
                    continue
                used = list(enumerate(MASKS)) if n >= SHORTEST else [(100 + n, tuple(range(n)))]
                for number, mask in used:
                    h = seeds(words, mask, number)
                    yield pd.DataFrame({"h": h.view(np.int64), "item_id": item, "place": np.arange(len(h)), "n": n})

    return items.select("item_id", "text").mapInPandas(run, "h long, item_id long, place int, n int")


def item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"].astype("Int64"), "words": [word_hashes(utf8(t))[0].view(np.int64) for t in pdf["text"]]})

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(run, "item_id long, words array<long>")


_overlap = re.compile(rb"[0-9A-Za-z\x80-\xff]*(?:[^0-9A-Za-z\x80-\xff]+[0-9A-Za-z\x80-\xff]+){0,%d}" % (2 * REACH))


def pieces(data: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text in overlapping pieces, and the bytes before each; the overlap, in whole words, exceeds what a comparison looks at."""
    at = 0
    while len(data) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(data) and _is_word[data[cut]]:
            cut += 1
        end = _overlap.match(data, cut).end()
        yield data[at:end], at
        if end == len(data):
            return
        at = cut
    yield data[at:], at


def regions(docs: DataFrame, items: DataFrame, bits: int) -> DataFrame:
    """Rows ``(region, doc_id, words, hits)``: stretches of training texts around places that pass the filter.

    ``hits`` are (hash, place in the stretch). The filter's size is fixed by ``bits``, at most 2**26 cells, however many
    test hashes there are; what passes it by chance drops out in the join.
    """
    spark = docs.sparkSession
    packed = np.zeros(1 << (bits - 3), np.uint8)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Filter(bits)
        for pdf in batches:
            f.add(pdf["h"].to_numpy().view(np.uint64))
        yield pd.DataFrame({"bits": [np.packbits(f.data).tobytes()]})

    for row in items.select("h").coalesce(4).mapInPandas(gather, "bits binary").toLocalIterator():
        packed |= np.frombuffer(row[0], np.uint8)
    short = sorted(r[0] for r in items.where(F.col("n") < SHORTEST).select("n").distinct().collect())  # 5 to 11
    used = [*enumerate(MASKS), *((100 + n, tuple(range(n))) for n in short)]
    shared = spark.sparkContext.broadcast(packed.tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Filter(bits, np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool))
        for pdf in batches:
            out = []
            group: list[tuple[int, bytes]] = []

            def flush() -> None:
                if not group:
                    return
                # Texts of a group are hashed together; seeds that straddle two texts are told apart afterwards.
                joined, owner_start, at = bytearray(), [], 0
                for _, part in group:
                    owner_start.append(at)
                    joined += part + b"\n"
                    at += len(part) + 1
                words, starts = word_hashes(bytes(joined))
                first = np.searchsorted(starts, np.array([*owner_start, at]))
                found: list[tuple[np.ndarray, np.ndarray]] = []
                spans = []
                for number, mask in used:
                    h = seeds(words, mask, number)
                    place = f.may(h)
                    found.append((place, h[place]))
                    spans.append(np.full(len(place), mask[-1]))
                place, h, span = np.concatenate([p for p, _ in found]), np.concatenate([x for _, x in found]), np.concatenate(spans)
                order = np.argsort(place, kind="stable")
                place, h, span = place[order], h[order], span[order]
                text = np.searchsorted(first, place, "right") - 1
                whole = place + span < first[text + 1]
                place, h, text = place[whole], h[whole], text[whole]
                if not len(place):
                    return
                # Every hit has its own REACH on both sides, so a stretch may be cut between any two.
                cut = np.flatnonzero((np.diff(place) > 2 * REACH) | (np.diff(text) != 0) | (np.diff(place // STRETCH) != 0)) + 1
                for p, x, t in zip(np.split(place, cut), np.split(h, cut), np.split(text, cut)):
                    lo, hi = max(first[t[0]], p[0] - REACH), min(first[t[0] + 1], p[-1] + REACH)
                    out.append((group[t[0]][0], words[lo:hi].view(np.int64), x.view(np.int64), (p - lo).astype(np.int32)))

            size = 0
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for part, _ in pieces(utf8(text)):
                    if size + len(part) > BLOCK:
                        flush()
                        group.clear()
                        size = 0
                    group.append((doc, part))
                    size += len(part) + 1
            flush()
            group.clear()
            if out:
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(o[0]) else int(o[0]) for o in out], "Int64"), "words": [o[1] for o in out], "h": [o[2] for o in out], "place": [o[3] for o in out]})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, words array<long>, h array<long>, place array<int>")
    return written(found.withColumn("region", F.monotonically_increasing_id()), "regions")


def dealt(hits: DataFrame, hashed: DataFrame, n_hits: int, n_seeds: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns ``left`` and ``right``, by which they join besides ``h``: equal for every pair, exactly once.

    A hash that is frequent on one side or both has its hits dealt over ``left`` and its items over ``right``, and each side is repeated
    for the parts of the other, so no task gets more than some ``HEAVY`` rows of it from either side. Frequent is a hash with more rows than ``HEAVY``
    and than a 65,536th of its side: at most 131,072 hashes are broadcast, however large the tables are.
    """

    def frequent(side: DataFrame, total: int, name: str) -> DataFrame:
        return side.groupBy("h").agg(F.count("*").alias(name)).where(F.col(name) > max(HEAVY, total >> 16))

    def parts(name: str) -> Column:
        return F.coalesce(F.ceil(F.col(name) / HEAVY).cast("int"), F.lit(1))

    parted = frequent(hits, n_hits, "k").join(frequent(hashed, n_seeds, "m"), "h", "full").select("h", parts("k").alias("lefts"), parts("m").alias("rights"))
    parted = F.broadcast(written(parted, "frequentseeds"))

    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(f"{mine}s"), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}s"), F.lit(1)) - 1))
        return df.join(parted, "h", "left").select(*df.columns, spread.alias(mine), every.alias(other))

    return side(hits, "left", "right"), side(hashed, "right", "left")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows ``(doc_id, item_id, matched, compared, similarity)`` of the items that leak into documents."""
    hashed = written(item_seeds(items), "itemseeds")
    n = hashed.count()
    near = regions(docs, hashed, max(16, min(26, (max(n, 1) * 128).bit_length())))
    hits = near.select("region", F.explode(F.arrays_zip("h", "place")).alias("x")).select("region", F.col("x.h").alias("h"), F.col("x.place").alias("at"))
    n_hits = near.select(F.sum(F.size("place"))).first()[0] or 0
    hits, hashed = dealt(hits, hashed, n_hits, n)
    lined = hits.join(hashed, ["h", "left", "right"]).select("region", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    both = lined.join(near.select("region", "doc_id", "words"), "region").join(item_words(items).withColumnRenamed("words", "item"), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for shift, text, item in zip(pdf["shift"], pdf["words"], pdf["item"]):
                size = min(WINDOW, len(item)) if len(item) >= SHORTEST else len(item)
                k = np.arange(len(item)) + shift
                ok = (k >= 0) & (k < len(text))
                same = np.zeros(len(item), np.int64)
                same[ok] = text[k[ok]] == item[ok]
                sums = np.convolve(same, np.ones(size, np.int64), "valid")
                need = size - (allowed(size) if len(item) >= SHORTEST else 0)
                rows.append((int(sums.max()), size, bool(sums.max() >= need)))
            got = pdf[["doc_id", "item_id"]].assign(matched=[r[0] for r in rows], compared=[r[1] for r in rows])
            yield got[np.array([r[2] for r in rows], bool)]

    found = both.select("doc_id", "item_id", "shift", "words", "item").mapInPandas(run, "doc_id long, item_id long, matched long, compared long")
    best = found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))
    return best.withColumn("similarity", F.col("matched") / F.col("compared"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows without an id are matched by their text's other rows only and stay."""
    found = written(leaks(docs, items).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items)
