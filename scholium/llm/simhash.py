"""SimHash near-duplicate classes by tiled exact comparison.

Distinct fingerprints are grouped into cells by population counts (of 16-bit lanes, or of the whole fingerprint within a
band of text lengths); a cell's fingerprints form tiles of bounded size. Two tiles are compared, all against all with numpy
exclusive-or and bit counts, only where the population counts of their cells differ by no more than the radius allows. A
comparison returns a spanning forest of the links it found, never all pairs, and the forests meet in connected components.
Near-duplicates by Jaccard similarity take the same tiles to find candidates, again as forests; the documents of a component of candidates
meet in small tiles that carry their shingle sets, where they are compared exactly. What is carried grows with the documents that
have candidates, and with the square of a group of them only beyond a tile.

Nulls, empty texts: fingerprint zero, linked like any other. A null id gets a row with a null component. Repeated rows have
equal fingerprints, hence one class. An empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.lineage import written
from .common import arrow_rows, few_rows, partitions, utf8, word_blocks

#: Odd constants that spread one 64-bit shingle hash over further words of a wide fingerprint (finaliser of a public 64-bit mixer).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: Sets of 5 shingles and 4 of them differ by 48 bits of 256 on average, more than larger sets of similarity 0.8. Up to so many
#: shingles the radius is wider, by so many bits a word.
SHORT, SHORT_BITS = 6, 2.75
#: Tiles that meet another one in one share of work, and tiles up to whose number the list of them is broadcast.
GROUP, FEW = 24, 1 << 20
#: Hashes of a set that one row carries, rows of them and whole tiles that go to a Python worker at once.
PIECE, PIECES, WHOLE = 1 << 14, 256, 32


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return h
    x = h + np.uint64((MIX[0] * k) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def _shingles(text: object, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, block by block; a text of fewer words is one shingle."""
    some, carry = False, []
    for block in word_blocks(utf8(text).lower()):
        block = carry + block
        if len(block) >= shingle:
            many = [b" ".join(x) for x in zip(*(block[i:] for i in range(shingle)))]
            some = True
            yield np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in many), np.uint64, len(many))
        carry = block[-(shingle - 1) :] if shingle > 1 else []
    if not some and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), 42)], np.uint64)


def shingle_set(text: object, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    found = list(_shingles(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _majority(blocks: Iterable[np.ndarray], words: int) -> tuple[list[int], int]:
    ones, n = np.zeros((words, 64), np.int64), 0
    for h in blocks:
        n += len(h)
        for k in range(words):
            bits = np.unpackbits(_mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(0, dtype=np.int64)
    on = (2 * ones > n).astype(np.uint8)
    return [int(x) for x in np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]], n


def fingerprint(text: object, shingle: int = 3, words: int = 1) -> tuple[list[int], int]:
    """Unsigned 64-bit words of the fingerprint, and the number of shingles."""
    return _majority(_shingles(text, shingle), words)


def set_fingerprint(hashes: np.ndarray, words: int = 4) -> tuple[list[int], int]:
    """As ``fingerprint``, of a shingle set; and a signed digest of the set."""
    fp, _ = _majority((hashes[i : i + 65536] for i in range(0, len(hashes), 65536)), words)
    return fp, int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """Rows ``(doc_id, n, fp)``; ``fp`` holds the fingerprint's words as signed longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few_rows(batches):
            found = [fingerprint(t, shingle, words) for t in pdf["text"]]
            fps = [np.array(f, np.uint64).view(np.int64) for f, _ in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [n for _, n in found], "fp": fps})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n long, fp array<long>")


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let ``label`` (a root for each node) respect the links i-j."""
    while True:
        a, b = label[i], label[j]
        if not (differ := a != b).any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def compared(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 256) -> np.ndarray:
    """A spanning forest, as pairs of ids, of the links between tiles ``a`` and ``b`` (or inside ``a``); columns: id, words."""
    same = b is None
    other = a if same else b
    left, right = a[:, 1:].view(np.uint64), other[:, 1:].view(np.uint64)
    label, shift = np.arange(len(a) + (0 if same else len(other))), 0 if same else len(a)
    pops = np.bitwise_count(right).sum(1, dtype=np.int64)
    order = np.argsort(pops, kind="stable")
    right, pops = np.ascontiguousarray(right[order]), pops[order]
    mine = np.bitwise_count(left).sum(1, dtype=np.int64)
    rows = np.argsort(mine, kind="stable")
    for s in range(0, len(a), block):
        part = rows[s : s + block]
        lo, hi = np.searchsorted(pops, mine[part[0]] - radius), np.searchsorted(pops, mine[part[-1]] + radius, "right")
        for c in range(lo, hi, 8192):
            d = np.zeros((len(part), min(hi, c + 8192) - c), np.uint16)
            for k in range(left.shape[1]):
                d += np.bitwise_count(left[part, k, None] ^ right[None, c : c + d.shape[1], k])
            i, j = np.nonzero(d <= radius)
            i, j = part[i], order[c + j]
            if same:
                keep = i != j
                i, j = i[keep], j[keep]
            if len(i):
                _merge(label, i, j + shift)
    ids = a[:, 0] if same else np.concatenate([a[:, 0], other[:, 0]])
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return np.stack([ids[moved], ids[label[moved]]], 1) if len(moved) else np.zeros((0, 2), np.int64)


def _cells(words: int, radius: int, lanes: int) -> tuple[F.Column, list[int]]:
    """A cell number for each fingerprint, and the offsets (not negative) of the cells to compare it with."""
    if radius <= 4:
        # Population counts of equal lanes of the first word; their distances sum to the radius at most.
        width, key = 64 // lanes, F.lit(0).cast("long")
        for k in range(lanes):
            key = key + F.bit_count(F.shiftrightunsigned(F.col("fp")[0], k * width).bitwiseAND((1 << width) - 1)) * F.lit(1000**k).cast("long")
        near = [o for o in product(range(-radius, radius + 1), repeat=lanes) if sum(map(abs, o)) <= radius]
        return key, sorted({x for o in near if (x := sum(v * 1000**k for k, v in enumerate(o))) >= 0})
    # A band of lengths (a similarity of 0.8 bounds the ratio of shingle counts) and a band of population counts.
    pop = sum((F.bit_count(F.col("fp")[k]) for k in range(1, words)), F.bit_count(F.col("fp")[0]))
    length = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / math.log(1.25))
    return (length * 1000 + F.floor(pop / (radius + 1))).cast("long"), [0, 1, 999, 1000, 1001]


def radius_for(similarity: float, words: int, deviations: float = 4) -> int:
    """Bits by which fingerprints of two shingle sets of this Jaccard similarity differ: the mean and ``deviations`` standard
    deviations. With four, some 3 in 100,000 pairs of just this similarity differ by more, and fewer of higher ones."""
    bits, p = 64 * words, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _tiles(reps: DataFrame, offsets: list[int], tiles: F.Column) -> tuple[DataFrame, DataFrame]:
    """A number of its tile (``part``) for each ``rep``, and rows ``(target, slots, n_shares)``: a cell's tiles, and into how many shares of
    about ``GROUP`` what meets one of them is dealt, so that what one share reads does not grow with the input.

    ``tiles``: into how many tiles a cell is cut, an aggregate of its rows; never more than rows, and only tiles in which a row lies.
    """
    # One row for each cell: at most 17**4 lane counts, or length bands times population bands, whatever the input's size.
    sizes = written(reps.groupBy("cell").agg(F.least(F.count(F.lit(1)), F.ceil(tiles)).cast("int").alias("n_tiles")), "sizes")
    dealt = reps.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("n_tiles")).cast("int")).drop("n_tiles")
    full = written(dealt.groupBy("cell").agg(F.collect_set("part").alias("slots")), "slots")
    met = full.select(F.explode(F.array(*(F.col("cell") + F.lit(o) for o in offsets))).alias("target"), F.size("slots").alias("n")).groupBy("target").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("n_shares"))
    there = full.select(F.col("cell").alias("target"), "slots").join(met, "target")
    few = (full.agg(F.sum(F.size("slots"))).first()[0] or 0) <= FEW
    return dealt, F.broadcast(there) if few else there


def _grouped(sets: DataFrame, tiles: F.Column) -> DataFrame:
    """``sets`` with their tile (``part``) in their component (``cell``), its ``slots`` and ``n_shares`` as of ``_tiles``; most components are one tile."""
    large = sets.where("piece = 0").groupBy("cell").agg(F.least(F.count(F.lit(1)), F.ceil(tiles)).cast("int").alias("n_tiles")).where("n_tiles > 1")
    large = written(large, "large")
    some = F.broadcast if large.count() <= FEW // 16 else (lambda df: df)
    part = F.pmod(F.xxhash64("rep"), F.coalesce("n_tiles", F.lit(1))).cast("int")
    dealt = sets.join(some(large), "cell", "left").withColumn("part", part).drop("n_tiles")
    full = written(dealt.where("piece = 0").join(some(large.select("cell")), "cell", "left_semi").groupBy("cell").agg(F.collect_set("part").alias("slots")), "slots")
    return dealt.join(some(full), "cell", "left").withColumn("slots", F.coalesce("slots", F.array(F.lit(0)))).withColumn("n_shares", F.ceil(F.size("slots") / GROUP).cast("int"))


def _work(rows: DataFrame, there: DataFrame | None, offsets: list[int], *order: str) -> DataFrame:
    """Rows ``(target, slot, share, own, ...)``: what stands in tiles that meet the tile ``slot`` of the cell ``target``, by share; and
    that tile itself for each share (``own`` 1, and 2 for the one in which it is compared with itself). ``there`` is of ``_tiles``, or None where
    ``rows`` hold it and cells meet themselves alone."""
    moved = rows.withColumn("off", F.explode(F.array(*map(F.lit, offsets)))).withColumn("target", F.col("cell") + F.col("off"))
    placed = (moved if there is None else moved.join(there, "target")).withColumn("slot", F.explode("slots")).where("off > 0 or part <= slot")
    mine = (F.col("off") == 0) & (F.col("slot") == F.col("part"))
    shares = F.when(mine, F.sequence(F.lit(0), F.col("n_shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cell", "part"), F.col("n_shares")).cast("int")))
    return (
        placed.withColumn("share", F.explode(shares)).withColumn("own", F.when(~mine, 0).when(F.col("share") == 0, 2).otherwise(1))
        .select("target", "slot", "share", "own", *(c for c in rows.columns if c not in ("slots", "n_shares")))
        .repartition(4 * partitions(rows.sparkSession), "target", "slot", "share").sortWithinPartitions("target", "slot", "share", F.col("own").desc(), "cell", "part", *order)
    )


def _met(batches: Iterator[pd.DataFrame], parsed: Callable[[list[tuple]], object]) -> Iterator[tuple[object, object | None]]:
    """The pairs of tiles of ``_work``, each parsed once from its rows: a tile and one that meets it, or None for itself."""
    at, own, tile, rows = None, None, None, []

    def ended() -> Iterator[tuple[object, object | None]]:
        nonlocal at, own
        if tile is None:
            return
        here, mine = tile[:3], tile[3]
        if mine:
            at, own = here, parsed(rows)
            if mine == 2:
                yield own, None
        elif at == here:
            yield own, parsed(rows)

    for pdf in batches:
        rest = [c for c in pdf.columns if c not in ("target", "slot", "share", "own", "cell", "part")]
        keys = zip(pdf["target"], pdf["slot"], pdf["share"], pdf["own"], pdf["cell"], pdf["part"])
        for key, row in zip(keys, zip(*(pdf[c] for c in rest))):
            if key != tile:
                yield from ended()
                tile, rows = key, []
            rows.append(row)
    yield from ended()


def _flat(dealt: DataFrame, row: F.Column) -> DataFrame:
    """A row for each tile."""
    return dealt.groupBy("cell", "part").agg(F.flatten(F.collect_list(row)).alias("flat"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, radius: int = 2, lanes: int = 4, tile: int = 2048) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``: one for each input row, with the smallest id reachable over links of ``radius`` bits."""
    fps = written(fingerprints(docs, id_col, text_col, shingle, words), "fps")
    key, offsets = _cells(words, radius, lanes)
    reps = written(fps.withColumn("cell", key).groupBy("fp", "cell").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    dealt, there = _tiles(reps, offsets, F.count(F.lit(1)) / tile)
    work = _work(_flat(dealt, F.concat(F.array("rep"), "fp")), there, offsets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, other in _met(batches, lambda rows: np.array(rows[0][0], np.int64).reshape(-1, 1 + words)):
            if len(links := compared(own, other, radius)):
                yield pd.DataFrame({"src": links[:, 0], "dst": links[:, 1]})

    with arrow_rows(docs.sparkSession, WHOLE):
        links = written(work.mapInPandas(run, "src long, dst long"), "links")
    found = connected_components(links)
    named = reps.join(found, reps["rep"] == found["node"], "left").select("fp", "cell", F.coalesce("component", "rep").alias("component_id"))
    return fps.withColumn("cell", key).join(named, ["fp", "cell"], "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def candidates(a: np.ndarray, b: np.ndarray | None, similarity: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of tiles ``a`` and ``b`` (or inside ``a``) that may be similar; columns: id, shingles, words."""
    same = b is None
    other = a if same else b
    left, right = a[:, 2:].view(np.uint64), np.ascontiguousarray(other[:, 2:]).view(np.uint64)
    radius = radius_for(similarity, left.shape[1])
    wide = radius + round(SHORT_BITS * left.shape[1])
    for s in range(0, len(a), block):
        part = a[s : s + block]
        for c in range(0, len(other), 8192):
            you = other[c : c + 8192]
            d = np.zeros((len(part), len(you)), np.uint16)
            for k in range(left.shape[1]):
                d += np.bitwise_count(left[s : s + block, k, None] ^ right[None, c : c + 8192, k])
            i, j = np.nonzero(d <= wide)
            n, m = part[i, 1], you[j, 1]
            most = np.maximum(n, m)
            keep = (part[i, 0] > you[j, 0]) if same else (part[i, 0] != you[j, 0])
            keep &= (np.minimum(n, m) >= similarity * most - 1e-6) & ((d[i, j] <= radius) | (most <= SHORT))
            if keep.any():
                yield i[keep] + s, j[keep] + c


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share, a piece at a time."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    n = 0
    for k in range(0, len(a) if len(b) else 0, 1 << 16):
        part = a[k : k + (1 << 16)]
        at = np.searchsorted(b, part)
        n += int((b[np.minimum(at, len(b) - 1)] == part).sum())
    return n


class Sets:
    """The shingle sets of a tile, and how many of their members each shares with another set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.index = sets, None

    def shared(self, mine: np.ndarray, which: np.ndarray) -> np.ndarray:
        if len(which) <= 4:
            return np.array([_common(mine, self.sets[j]) for j in which])
        if self.index is None:
            whole = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            order = np.argsort(whole, kind="stable")
            known, starts = np.unique(whole[order], return_index=True)
            self.index = known, np.append(starts, len(whole)), owner[order]
        known, starts, owner = self.index
        at = np.searchsorted(known, mine)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == mine)]
        sizes = starts[at + 1] - starts[at]
        places = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(at) else np.zeros(0, int)
        return np.bincount(owner[places], minlength=len(self.sets))[which]


def linked(a: tuple[np.ndarray, Sets], b: tuple[np.ndarray, Sets] | None, similarity: float) -> np.ndarray:
    """A spanning forest, as pairs of ids, of the rows whose sets have the similarity. A pair that links found before already
    connect is not compared."""
    (rows, mine), same = a, b is None
    others, sets = a if same else b
    shift = 0 if same else len(rows)
    label, out = np.arange(len(rows) + (0 if same else len(others))), []
    for i, j in candidates(rows, None if same else others, similarity):
        cuts = np.flatnonzero(np.diff(i)) + 1
        for row, near in zip(i[np.concatenate([[0], cuts])], np.split(j, cuts)):
            near = near[label[near + shift] != label[row]]
            if not len(near):
                continue
            both = sets.shared(mine.sets[row], near)
            near = near[both >= similarity * (rows[row, 1] + others[near, 1] - both) - 1e-9]
            if len(near):
                roots, first = np.unique(label[near + shift], return_index=True)
                out += [(rows[row, 0], others[k, 0]) for k in near[first]]
                label[np.isin(label, roots)] = label[row]
    return np.array(out, np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 4, tile: int = 8192, small: int = 256, hashes: int = 1 << 16) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``: classes of documents linked by a Jaccard similarity of their shingle sets.

    Fingerprints of the distinct shingles, ``words`` of 64 bits, only say which documents may be linked, as a forest. The documents of
    one of its components meet again, in tiles of ``small`` documents or ``hashes`` shingles, where every candidate is compared by
    its whole set unless verified links already connect the two. A large group of near copies, linked or not, makes no rows for its pairs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n long, sig long, fp array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few_rows(batches):
            found = [(len(x), *set_fingerprint(x, words)) for t in pdf["text"] for x in [shingle_set(t, shingle)]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [n for n, _, _ in found], "sig": [x for _, _, x in found], "fp": [np.array(f, np.uint64).view(np.int64) for _, f, _ in found]})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """As ``run``, with the sets: a set that is longer than ``PIECE`` takes several rows."""
        rows, size = [], 0
        made = lambda: pd.DataFrame(rows, columns=["doc_id", "n", "sig", "fp", "cell", "piece", "s"]).astype({"doc_id": "Int64"})
        for pdf in few_rows(batches):
            for doc_id, text, cell in zip(pdf["doc_id"], pdf["text"], pdf["cell"]):
                x = shingle_set(text, shingle)
                f, sig = set_fingerprint(x, words)
                for k in range(0, max(len(x), 1), PIECE):
                    rows.append((doc_id, len(x), sig, np.array(f, np.uint64).view(np.int64), cell, k // PIECE, x[k : k + PIECE].view(np.int64)))
                    size += PIECE if len(x) > PIECE else len(x)
                    if size >= 1 << 20:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()

    key, offsets = _cells(words, radius_for(similarity, words) + round(SHORT_BITS * words), 4)
    fps = written(texts.mapInPandas(run, schema).withColumn("cell", key), "fps")
    same = ["fp", "sig", "n", "cell"]
    reps = written(fps.groupBy(*same).agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, other in _met(batches, lambda rows: np.array(rows[0][0], np.int64).reshape(-1, 2 + words)):
            you = own if other is None else other
            shift = 0 if other is None else len(own)
            label = np.arange(len(own) + (0 if other is None else len(you)))
            for i, j in candidates(own, other, similarity):
                _merge(label, i, j + shift)
            ids = own[:, 0] if other is None else np.concatenate([own[:, 0], you[:, 0]])
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pd.DataFrame({"src": ids[moved], "dst": ids[label[moved]]})

    dealt, there = _tiles(reps, offsets, F.count(F.lit(1)) / tile)
    with arrow_rows(docs.sparkSession, WHOLE):
        likely = written(_work(_flat(dealt, F.concat(F.array("rep", "n"), "fp")), there, offsets).mapInPandas(search, "src long, dst long"), "likely")
    groups = written(connected_components(likely).select(F.col("node").alias("doc_id"), F.col("component").alias("cell")), "groups")
    # Of an id with several texts all come along.
    some = texts.join(groups, "doc_id").mapInPandas(pieces, f"{schema}, cell long, piece int, s array<long>")
    sets = written(some.dropDuplicates(["doc_id", "sig", "piece"]).withColumnRenamed("doc_id", "rep"), "sets")

    def parsed(rows: list[tuple]) -> tuple[np.ndarray, Sets]:
        # Rows (rep, n, sig, fp, piece, s), the pieces of a set one after another.
        cuts = [k for k, r in enumerate(rows) if r[4] == 0] + [len(rows)]
        first = np.array([[rows[k][0], rows[k][1], *rows[k][3]] for k in cuts[:-1]], np.int64)
        return first, Sets([np.concatenate([np.asarray(r[5], np.int64) for r in rows[a:b]]).view(np.uint64) for a, b in zip(cuts, cuts[1:])])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, other in _met(batches, parsed):
            if len(links := linked(own, other, similarity)):
                yield pd.DataFrame({"src": links[:, 0], "dst": links[:, 1]})

    dealt = _grouped(sets, F.greatest(F.count(F.lit(1)) / small, F.sum("n") / hashes))
    work = _work(dealt.select("cell", "part", "slots", "n_shares", "rep", "n", "sig", "fp", "piece", "s"), None, [0], "rep", "sig", "piece")
    with arrow_rows(docs.sparkSession, PIECES):
        links = written(work.mapInPandas(verify, "src long, dst long"), "links")
    found = connected_components(links)
    named = reps.join(found, reps["rep"] == found["node"], "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, same, "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate class; rows without an id stay."""
    kept = near_duplicates(docs, similarity).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi").select(*docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    out = classes(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
