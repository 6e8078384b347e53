"""Graph analytics on edge tables: hops, bounded paths, closure, bridges, latent links, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import numbered, written
from .ann import Index, search
from .blocks import nearest, similar_pairs  # noqa: F401  (part of this module's interface)
from .components import connected_components
from .retrieval import top_k


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``(id, ord, component)`` for ``nodes (id, ord)``: components numbered densely by their first node; lone nodes too."""
    found = connected_components(edges.select("src", "dst"))
    whole = nodes.join(found, nodes["id"] == found["node"], "left").select("id", "ord", F.coalesce("component", "id").alias("root"))
    firsts = whole.groupBy("root").agg(F.min("ord").alias("first"))
    # A row for each component, numbered by ranges: lone nodes make as many rows as nodes.
    roots = numbered(firsts.select("first", "root"), ["first", "root"], "component", 0).select("root", F.col("component").cast("int").alias("component"))
    return whole.join(roots, "root").select("id", "ord", "component")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """``pairs (a, b)`` with ``path``: length of a shortest undirected path, 0 for a node itself, -1 beyond ``max_depth``."""
    seen = reachable(written(undirected(edges), "both"), pairs.select(F.col("a").alias("seed")), max_depth)
    return pairs.join(seen, (F.col("a") == F.col("seed")) & (F.col("b") == F.col("node")), "left").select("a", "b", F.coalesce("depth", F.lit(-1)).alias("path"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Rows ``(seed, node, depth)``: what ``seeds (seed)`` reach along directed edges, themselves included.

    Seeds are numbered, and 64 of them are the bits of one number, so that a round's joins and sums have a row for a node and 64 seeds;
    a row for each seed is made from what was found, at the end.
    """
    known = numbered(seeds.select("seed").distinct(), ["seed"], "no", 0)
    known = written(known.select("seed", F.shiftright("no", 6).alias("word"), F.col("no").bitwiseAND(63).cast("int").alias("bit")), "seeds")
    front = written(known.groupBy(F.col("seed").alias("node"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "front")
    steps, layers = edges.select("src", F.col("dst").alias("node")), [front.withColumn("depth", F.lit(0))]
    seen = front
    for depth in range(1, max_depth + 1):
        step = front.withColumnRenamed("node", "src").join(steps, "src").groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        before = seen.groupBy("node", "word").agg(F.bit_or("bits").alias("old"))
        new = step.join(before, ["node", "word"], "left").select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits"))
        front = written(new.where("bits <> 0"), "front")
        if front.isEmpty():
            break
        layers.append(front.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    whole = layers[0]
    for layer in layers[1:]:
        whole = whole.unionByName(layer)
    each = whole.select("node", "depth", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)).alias("bit"))
    return each.join(known, ["word", "bit"]).select("seed", "node", "depth")


def directed(cites: DataFrame, direction: str = "references") -> DataFrame:
    """Edges ``(src, dst, is_influential)`` of ``cites (citing, cited, is_influential)`` as steps: to what a paper refers to, to what cites it, or ``both``."""
    back = cites.select(F.col("citing").alias("src"), F.col("cited").alias("dst"), "is_influential")
    forth = cites.select(F.col("cited").alias("src"), F.col("citing").alias("dst"), "is_influential")
    return {"references": back, "citations": forth, "both": back.unionByName(forth)}[direction]


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_hop: int = 20, influential_only: bool = False, by_parents: bool = False) -> DataFrame:
    """Layered expansion over ``edges (src, dst, is_influential)``: rows ``(node, depth, influential, parents)``.

    A hop keeps the ``per_hop`` new nodes with an influential edge first, or with most parents first, then by id.
    """
    order = [F.desc(F.size("parents")), F.col("dst")] if by_parents else [(~F.col("influential")).cast("int"), F.col("dst")]
    known = seeds.select(F.col("seed").alias("node")).distinct()
    front, layers = known, []
    use = edges.where("is_influential") if influential_only else edges
    for d in range(1, depth + 1):
        new = (
            use.join(front.select(F.col("node").alias("src")), "src").join(known.select(F.col("node").alias("dst")), "dst", "left_anti")
            .groupBy("dst").agg(F.max("is_influential").alias("influential"), F.array_sort(F.collect_set("src")).alias("parents"))
            .orderBy(*order).limit(per_hop)
        )
        layer = written(new.select(F.col("dst").alias("node"), F.lit(d).alias("depth"), "influential", "parents"), "hop")
        layers.append(layer)
        front, known = layer.select("node"), known.unionByName(layer.select("node"))
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def bridges(entities: DataFrame, least: int = 2) -> DataFrame:
    """``(id, doc)`` rows to ``(id, docs)`` for ids in ``least`` distinct documents or more."""
    return entities.groupBy("id").agg(F.array_sort(F.collect_set("doc")).alias("docs")).where(F.size("docs") >= least)


def latent_links(vectors: DataFrame, k: int = 6, least: float = 0.8, known: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """``vectors (id, embedding, docs)``: each one's k nearest (itself included), then those similar enough with disjoint documents that
    ``known (a, b)``, in either order, does not hold yet. With an ``index`` of the vectors the nearest are those of its probed lists."""
    found = search(index, vectors, k - 1) if index else nearest(vectors, vectors, k - 1)
    near = found.select(F.col("qid").alias("a"), F.col("id").alias("b"), "sim").where(F.col("sim") >= least)
    of = lambda end, name: vectors.select(F.col("id").alias(end), F.col("docs").alias(name))
    kept = near.join(of("a", "da"), "a").join(of("b", "db"), "b").where(~F.arrays_overlap("da", "db"))
    pairs = kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()
    return pairs if known is None else unknown(pairs, known)


def unknown(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links (a, b, sim)``, a before b, that ``known (a, b)``, in either order, does not hold yet."""
    return links.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """Rows ``(seed, node, path)``: how far undirected edges lead from each of ``seeds (seed)``, itself included at 0, to ``max_depth``."""
    return reachable(written(undirected(edges), "both"), seeds.distinct(), max_depth).withColumnRenamed("depth", "path")


def matched_communities(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, component)`` snapshots to ``(component, outcome, old_component)``: same members, one parent, or fresh.

    Members are counted, not gathered: two sets are the same if they have one parent between them and as many members each.
    """
    met = new.join(old.withColumnRenamed("component", "old"), "id", "left").groupBy("component", "old").agg(F.count_distinct("id").alias("k"))
    parents = met.groupBy("component").agg(F.count("old").alias("n_old"), F.min("old").alias("old_component"), F.sum("k").alias("now"), F.sum(F.when(F.col("old").isNotNull(), F.col("k"))).alias("shared"))
    sizes = old.groupBy(F.col("component").alias("old_component")).agg(F.count_distinct("id").alias("before"))
    one = F.col("n_old") == 1
    outcome = F.when(one & (F.col("now") == F.col("shared")) & (F.col("before") == F.col("shared")), "same").when(one, "carried").otherwise("fresh")
    return parents.join(sizes, "old_component", "left").select("component", outcome.alias("outcome"), F.when(one, F.col("old_component")).alias("old_component"))


def stale(communities: DataFrame) -> DataFrame:
    """``(component, size, dirty, size_at_last_summary)``: those to be summarised anew: dirty ones, and those that have more than doubled."""
    return communities.where(F.col("dirty") | ((F.col("size_at_last_summary") > 0) & (F.col("size") > 2 * F.col("size_at_last_summary"))))


def community_relations(relations: DataFrame, members: DataFrame, most: int = 20) -> DataFrame:
    """Rows ``(component, source_id, target_id, relation_type, rank)``: the first relations with both ends in one community."""
    of = lambda end, name: members.select(F.col("id").alias(end), F.col("component").alias(name))
    inside = relations.join(of("source_id", "component"), "source_id").join(of("target_id", "other"), "target_id").where("component = other")
    return top_k(inside.select("component", "source_id", "target_id", "relation_type"), ["component"], [F.col("source_id"), F.col("target_id"), F.col("relation_type")], most)


def key_concepts(members: DataFrame, k: int = 5) -> DataFrame:
    """``(component, name, mentions)`` to each component's k most mentioned names, in order."""
    top = members.withColumn("rn", F.row_number().over(W.partitionBy("component").orderBy(F.desc("mentions"), "name"))).where(F.col("rn") <= k)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"])
    return top.groupBy("component").agg(F.concat_ws("|", names).alias("concepts"), F.count(F.lit(1)).alias("n"))
