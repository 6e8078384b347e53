"""Merkle dataset manifest: a tree over the rows of each source, a tree over the sources, and proofs, by a persistent path-copying tree.

Leaves are numbered in their source by ranges, without one task for a source, and stand in aligned blocks of ``RUN ** LEVELS`` rows. A
block's root is a node of the next tree above, whose nodes stand in blocks again; so a tree of any size takes a few rounds, each
with a ``RUN ** LEVELS``-th of the rows of the one before. A tampered leaf makes a version of its block: its ancestors are copied,
all other nodes are shared with the untampered tree. The version goes on above its block with the path of that block.

A leaf is the lower-case hex SHA-256 of the row's fields, ``-`` for a null, else byte count, colon and value. Nulls in any column are
fields like others; a null source is a tree of its own and comes first; a row without an id comes first in its source and is never
tampered with. Empty and very long texts are hashed whole, in the JVM. Ties: rows of one id stand by their leaf, and equal rows are equal
leaves next to each other, so every order of them gives the same digests. An empty table gives an empty result. Columns that
are no fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Nodes that make one of the next level, and levels inside a block: a block has 729 nodes.
RUN, LEVELS = 3, 6
#: Rows of a written table up to which it is broadcast: a path has some 1,500 bytes.
SMALL = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """A row's digest, as bytes."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def levels(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes of ``up`` levels and of the one above them."""
    out = [nodes]
    for _ in range(up):
        out.append([digest(out[-1][i : i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    """What stands to the left and to the right of a node and of its ancestors in their runs."""
    out = []
    for nodes in tree[:-1]:
        start = i - i % RUN
        out.append((nodes[start:i], nodes[i + 1 : start + RUN]))
        i //= RUN
    return out


def copied(leaf: str, siblings: list[tuple[list[str], list[str]]]) -> list[str]:
    """The version that a leaf makes: its copied ancestors, upwards; all other nodes are shared."""
    out = []
    for left, right in siblings:
        leaf = digest([*left, leaf, *right])
        out.append(leaf)
    return out


def depth(n: int) -> int:
    """Levels between ``n`` nodes and the only one that remains."""
    deep = 0
    while n > 1:
        n, deep = -(-n // RUN), deep + 1
    return deep


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcasting if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place in ``tree`` (``pos`` from 0) and its size (``total``): ranges are sorted and written, and what is added
    is one row a tree and range, at most as many as there are trees and ranges together."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).withColumn("place", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("range", F.shiftright("place", 33))
    sizes = written(ranged.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "sizes")
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total")), "starts")
    return ranged.join(_small(starts), ["tree", "range"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("pos"), "total")


def blocks(nodes: DataFrame, deep: int, *kept: str) -> DataFrame:
    """Rows ``(tree, block, total, pos, hash, ...)``: the nodes of a block and what is kept with them, as arrays in their order."""
    found = nodes.groupBy("tree", F.floor(F.col("pos") / RUN**deep).alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", *kept))).alias("rows"))
    return found.select("tree", "block", "total", *(F.col("rows")[c].alias(c) for c in ("pos", "hash", *kept)))


def _hex(many: list[bytes]) -> list[str]:
    return [b.hex() for b in many]


def block_roots(found: DataFrame, deep: int) -> DataFrame:
    """Rows ``(tree, pos, total, hash)``: a node of the tree above for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [bytes.fromhex(levels(_hex(r["hash"]), min(deep, depth(r["total"])))[-1][0]) for r in rows]
            totals = [-(-r["total"] // RUN**deep) for r in rows]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["block"], pa.array(totals, pa.int64()), pa.array(out, pa.binary())], names=["tree", "pos", "total", "hash"])

    return found.select("tree", "block", "total", "hash").mapInArrow(run, "tree string, pos long, total long, hash binary")


#: A path as a column: what stands left and right of a node, level by level.
PATH = "array<struct<l: array<string>, r: array<string>>>"


def paths(nodes: DataFrame, deep: int) -> DataFrame:
    """Rows ``(tree, pos, root, path)`` for nodes ``(tree, pos, total, hash)``, a round for every ``deep`` levels."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    if most <= 1:
        return nodes.select("tree", "pos", F.hex("hash").alias("root"), F.array().cast(PATH).alias("path")).withColumn("root", F.lower("root"))
    found = written(blocks(nodes, deep), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("l", pa.list_(pa.string())), ("r", pa.list_(pa.string()))]))
        for batch in batches:
            for r in batch.to_pylist():
                tree = levels(_hex(r["hash"]), min(deep, depth(r["total"])))
                mine = [[{"l": a, "r": b} for a, b in path(tree, i)] for i in range(len(tree[0]))]
                n = len(mine)
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, pa.string()), pa.array(r["pos"], pa.int64()), pa.array([r["block"]] * n, pa.int64()), pa.array(mine, kind)], names=["tree", "pos", "block", "inner"])

    inner = found.mapInArrow(run, f"tree string, pos long, block long, inner {PATH}")
    above = paths(written(block_roots(found, deep), "roots"), deep).withColumnRenamed("pos", "block")
    return written(inner.join(above, ["tree", "block"]).select("tree", "pos", "root", F.concat("inner", "path").alias("path")), "paths")


def manifest(docs: DataFrame, changed: dict[str, Column], when: Column, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, deep: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs``: its id, ``leaf``, ``subroot``, ``root``, ``siblings`` (level by level, left to right),
    ``folded_root`` and ``copied``, the ancestors of the version that its tampered leaf makes, up to that root.

    A row is tampered with where ``when`` holds: its fields are replaced by ``changed``, and its version keeps all other leaves.
    """
    now = [F.col(c) for c in fields]
    then = [changed.get(c, F.col(c)) for c in fields]
    tree = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(group_col).cast("string")))
    leaves = written(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf(now).alias("hash"), F.when(when, leaf(then)).alias("bad")), "leaves")
    found = written(blocks(placed(leaves, ["id", "hash"]), deep, "id", "bad"), "leafblocks")
    upper = paths(written(block_roots(found, deep), "roots"), deep).withColumnRenamed("pos", "block")
    sources = placed(upper.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.unhex("root").alias("hash")), ["name"])
    sources = written(sources, "sources")
    crown = paths(sources.drop("name"), deep).join(sources.select("pos", "name"), "pos").select(F.col("name").alias("tree"), F.col("root").alias("top"), F.col("path").alias("last"))
    # One row for each block of leaves.
    above = written(upper.join(crown, "tree").select("tree", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "last").alias("path")), "above")
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"{id_col} {kind}, leaf string, subroot string, root string, siblings array<string>, folded_root string, copied array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.to_pylist()):
                tree, top = levels(_hex(r["hash"]), min(deep, depth(r["total"]))), [(s["l"], s["r"]) for s in r["path"]]
                shared = [h for a, b in top for h in (*a, *b)]
                siblings, folded, versions = [], [], []
                for i, bad in enumerate(r["bad"]):
                    mine = path(tree, i)
                    siblings.append([h for a, b in mine for h in (*a, *b)] + shared)
                    version = copied(bad.hex() if bad else tree[0][i], mine + top)
                    folded.append(version[-1] if version else bad.hex() if bad else tree[0][i])
                    versions.append(version if bad else [])
                n, texts = len(folded), pa.list_(pa.string())
                columns = [batch["id"][k].values, pa.array(tree[0]), pa.array([r["subroot"]] * n), pa.array([r["root"]] * n), pa.array(siblings, texts), pa.array(folded), pa.array(versions, texts)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "leaf", "subroot", "root", "siblings", "folded_root", "copied"])

    return found.join(_small(above), ["tree", "block"]).select("total", "hash", "id", "bad", "subroot", "root", "path").mapInArrow(run, out)


def query(docs: DataFrame, deep: int = LEVELS) -> DataFrame:
    """The contract's columns; tampering deletes the line breaks of texts whose id has an even crc32."""
    out = manifest(docs, {"text": F.translate("text", "\n", "")}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, deep=deep)
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field(c: str) -> str:
    return f"coalesce(cast(octet_length(encode({c})) as varchar) || ':' || {c}, '-')"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)) + ")"


ORACLE = f"""
with recursive crcs as (
  select *, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::ubigint)), lambda a, i: xor(a >> 1, 3988292384::ubigint * (a & 1)))) as crc
  from documents),
hashed as (select doc_id, source, {_row('text')} as leaf, case when (xor(crc, 4294967295::ubigint) & 1) = 0 then {_row("replace(text, chr(10), '')")} end as bad from crcs),
leaves as (
  select *, row_number() over (order by doc_id) as id, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from hashed),
tree(source, lev, pos, n, h) as (
  select source, 0, pos, n, leaf from leaves
  union all
  select source, lev + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' order by pos)) from tree where n > 1 group by source, lev, pos // 3),
subroots as (select source, lev as deep, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
crown(lev, pos, n, h) as (
  select 0, pos, n, h from subroots
  union all
  select lev + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' order by pos)) from crown where n > 1 group by lev, pos // 3),
near as (
  select l.id, t.lev, l.pos // cast(pow(3, t.lev) as bigint) as own, t.pos, t.h from leaves l join tree t on l.source is not distinct from t.source and t.n > 1 and t.pos // 3 = l.pos // cast(pow(3, t.lev + 1) as bigint)
  union all
  select l.id, s.deep + c.lev, s.pos // cast(pow(3, c.lev) as bigint), c.pos, c.h from leaves l join subroots s on l.source is not distinct from s.source join crown c on c.n > 1 and c.pos // 3 = s.pos // cast(pow(3, c.lev + 1) as bigint)),
steps as (select id, lev, coalesce(string_agg(h, '' order by pos) filter (pos < own), '') as l, coalesce(string_agg(h, '' order by pos) filter (pos > own), '') as r from near group by id, lev),
fold(id, lev, h) as (
  select id, 0, coalesce(bad, leaf) from leaves
  union all
  select f.id, f.lev + 1, sha256(s.l || f.h || s.r) from fold f join steps s on s.id = f.id and s.lev = f.lev),
ends as (select id, max_by(h, lev) as folded from fold group by id),
proofs as (select id, sha256(string_agg(l || r, '' order by lev)) as proof from steps group by id)
select l.doc_id, l.leaf, s.h as subroot, c.h as root, coalesce(p.proof, sha256('')) as proof_sha256, e.folded as folded_root, e.folded = c.h as verified
from leaves l join subroots s on l.source is not distinct from s.source join crown c on c.n = 1 join ends e on e.id = l.id left join proofs p on p.id = l.id
"""
