"""Bibliographic records: canonical form, deduplication, scores, ranking, roots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import Funnel, written
from .components import connected_components
from .graph import hops, reachable
from .retrieval import recommend, top_k

#: Weights of the two rankings.
DEEP = {"relevance": 0.55, "in_set": 0.12, "influence": 0.10, "author": 0.05, "velocity": 0.08, "venue": 0.05, "survey": 0.05}
META = {"velocity": 0.25, "in_set": 0.20, "influence": 0.20, "author": 0.10, "diversity": 0.05, "venue": 0.10, "survey": 0.10}


def canonical(records: DataFrame, source: str | None = None) -> DataFrame:
    """Collapsed white space, lower-case DOI, trimmed arXiv id, one-element source list."""
    out = records.withColumn("title", X.normal_text(F.col("title"))).withColumn("doi", F.lower(F.trim("doi"))).withColumn("arxiv_id", F.trim("arxiv_id"))
    return out.withColumn("sources", F.array(F.lit(source)) if source else F.array("source"))


def _keys(records: DataFrame) -> DataFrame:
    keys = F.array(
        F.when(F.col("doi") != "", F.concat(F.lit("d:"), "doi")),
        F.when(F.col("arxiv_id") != "", F.concat(F.lit("a:"), "arxiv_id")),
        F.when(F.col("key_title") != "", F.concat(F.lit("t:"), "key_title")),
    )
    return records.withColumn("key_title", X.normal_title(F.col("title"))).withColumn("keys", F.filter(keys, lambda k: k.isNotNull()))


def same_records(records: DataFrame) -> DataFrame:
    """Rows ``(ord, cluster)``: records that share a DOI, arXiv id or title, transitively. Records of equal keys count once, each key links
    what is left in a star; a record without a key is alone."""
    rows = written(_keys(records).select("ord", "keys"), "keyed")
    same = written(rows.where(F.size("keys") > 0).groupBy("keys").agg(F.min("ord").alias("first")), "same")
    keyed = same.select("first", F.explode("keys").alias("key"))
    star = keyed.groupBy("key").agg(F.min("first").alias("dst"))
    found = connected_components(keyed.join(star, "key").where("first <> dst").select(F.col("first").alias("src"), "dst"))
    placed = same.join(found, F.col("first") == F.col("node"), "left").select("keys", F.coalesce("component", "first").alias("cluster"))
    return rows.join(placed, "keys", "left").select("ord", F.coalesce("cluster", "ord").alias("cluster"))


def _text(name: str) -> F.Column:
    # The longest value; ties keep the first record's.
    return F.max_by(name, F.struct(F.length(name), -F.col("ord")))


def deduplicated(records: DataFrame) -> DataFrame:
    """One row for each transitive cluster: longest title, abstract and url, first of other values that is there, most citations,
    sorted sources and search angles. Columns that the records lack are left out."""
    has = set(records.columns)
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c)), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("ord")))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",")
    found = [_text(c).alias(c) for c in ("title", "abstract", "url") if c in has] + [first(c).alias(c) for c in ("doi", "arxiv_id", "year", "venue") if c in has]
    if "authors" in has:
        found.append(F.min_by(F.when(F.size("authors") > 0, F.col("authors")), F.when(F.size("authors") > 0, F.col("ord"))).alias("authors"))
    if "search_angles" in has:
        found.append(listed("search_angles").alias("search_angles"))
    sources = F.array_join(F.array_sort(F.collect_set("source")), ",")
    return records.join(same_records(records), "ord").groupBy("cluster").agg(*found, F.max("citation_count").alias("citation_count"), sources.alias("sources"), F.count(F.lit(1)).alias("n"))


def _replayed(open_: DataFrame) -> DataFrame:
    """Rows ``(ord)``: the founders among ``open_ (component, ord, keys)``, by the sequential rule, component by component in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, set()
        for batch in batches:
            found = []
            for component, ord_, keys in zip(*(batch.column(c).to_pylist() for c in ("component", "ord", "keys"))):
                if component != at:
                    at, held = component, set()
                if held.isdisjoint(keys):
                    held.update(keys)
                    found.append(ord_)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["ord"])

    return open_.repartition("component").sortWithinPartitions("component", "ord").mapInArrow(run, "ord long")


def _decided(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Founders among ``open_ (ord, keys)`` that this round finds, and what is then still open.

    A record is first under all of its keys: it founds. One that shares keys with a single earlier open record does what that one
    does not: such records make chains, and pointers along them, doubled, decide a chain of any length in as many rounds as its length
    has digits. What shares a key with a founder is no founder.
    """
    each = written(open_.select("ord", F.explode("keys").alias("key")), "openkeys")
    first = each.groupBy("key").agg(F.min("ord").alias("one"))
    second = each.join(first, "key").where("ord > one").groupBy("key").agg(F.min("ord").alias("two"))
    # Of each record and key: who is before it. From the third place on there is more than one.
    before = each.join(first, "key").join(second, "key", "left").select("ord", F.when(F.col("ord") > F.col("one"), F.col("one")).alias("one"), (F.col("ord") > F.col("two")).alias("more"))
    held = before.groupBy("ord").agg(F.min("one").alias("up"), F.max("one").alias("last"), F.max(F.coalesce("more", F.lit(False))).alias("more"))
    chain = written(held.select("ord", F.when((F.col("up") == F.col("last")) & ~F.col("more"), F.col("up")).alias("up"), F.col("last").isNull().alias("root")), "chain")
    # up: the record that decides; flip: whether this one does the opposite of it. Ends are roots (they found) or undecided records.
    now = chain.select("ord", "up", F.lit(True).alias("flip"))
    while not now.where("up is not null").join(now.where("up is not null").select(F.col("ord").alias("up")), "up", "left_semi").isEmpty():
        above = now.where("up is not null").select(F.col("ord").alias("via"), F.col("up").alias("next"), F.col("flip").alias("other"))
        step = now.join(above, now["up"] == above["via"], "left")
        further = F.col("next").isNotNull()
        after = written(step.select("ord", F.when(further, F.col("next")).otherwise(F.col("up")).alias("up"), F.when(further, F.col("flip") != F.col("other")).otherwise(F.col("flip")).alias("flip")), "chain")
        now = after
    roots = chain.where("root").select(F.col("ord").alias("up"))
    known = now.join(roots, "up", "left_semi").select("ord", (~F.col("flip")).alias("founds")).unionByName(roots.select(F.col("up").alias("ord"), F.lit(True).alias("founds")))
    known = written(known, "decided")
    founders = open_.join(known.where("founds").select("ord"), "ord", "left_semi")
    taken = founders.select(F.explode("keys").alias("key")).distinct()
    gone = each.join(taken, "key", "left_semi").select("ord").unionByName(known.select("ord")).distinct()
    return written(founders, "founders"), written(open_.join(gone, "ord", "left_anti"), "open")


def greedy_clusters(records: DataFrame, replay: int = 50_000) -> DataFrame:
    """Rows ``(ord, cluster)`` of the sequential rule: a record joins the first cluster that holds its DOI, else arXiv id, else
    title; keys gained by joining are not registered.

    A record founds a cluster if no earlier founder registered one of its keys; founders of one component of shared keys do not
    depend on another's. Components of up to ``replay`` different records are replayed in order, many to a task; larger ones go
    through rounds of joins and partial aggregations until what is open falls into small ones.
    """
    rows = written(_keys(records).select("ord", "keys"), "keyed")
    # Equal key lists behave like their first record, except that only that one can found.
    open_, founders = written(rows.groupBy("keys").agg(F.min("ord").alias("ord")), "open"), []
    while not open_.isEmpty():
        each = open_.select("ord", F.explode("keys").alias("key"))
        star = each.groupBy("key").agg(F.min("ord").alias("dst"))
        found = connected_components(each.join(star, "key").where("ord <> dst").select(F.col("ord").alias("src"), "dst"))
        placed = written(open_.join(found, F.col("ord") == F.col("node"), "left").select("ord", "keys", F.coalesce("component", "ord").alias("component")), "placed")
        large = placed.groupBy("component").count().where(F.col("count") > replay).select("component")
        large = written(large, "large")
        small = placed.join(large, "component", "left_anti")
        founders.append(written(placed.select("ord", "keys").join(_replayed(small), "ord", "left_semi"), "founders"))
        if large.isEmpty():
            break
        new, open_ = _decided(placed.join(large, "component", "left_semi").select("ord", "keys"))
        founders.append(new)
    whole = rows.limit(0) if not founders else founders[0]
    for part in founders[1:]:
        whole = whole.unionByName(part)
    held = whole.select(F.col("ord").alias("home"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("home").alias("home"))
    place = rows.select("ord", F.posexplode("keys").alias("at", "key")).join(held, "key")
    # DOI before arXiv id before title: the first of a record's keys that is held by a founder no later than itself.
    settled = place.where("home <= ord").groupBy("ord").agg(F.min_by("home", "at").alias("cluster"))
    return records.select("ord").join(settled, "ord", "left").select("ord", F.coalesce("cluster", "ord").alias("cluster"))


def relevant(papers: DataFrame, scores: DataFrame, least: int = 5) -> DataFrame:
    """``papers`` with ``relevance``: clamped model score, 5 where it is missing; rows under ``least`` go."""
    joined = papers.join(scores, "id", "left")
    return joined.withColumn("relevance", X.clamp_score(F.col("model_score"))).drop("model_score").where(F.col("relevance") >= least)


def single_edges(cites: DataFrame) -> DataFrame:
    """One row for each citing and cited paper: influential, or methodological, if any of its citations is."""
    return cites.groupBy("citing", "cited").agg(F.max("is_influential").alias("is_influential"), F.max("is_methodology").alias("is_methodology"))


def touching(cites: DataFrame, ids: DataFrame, ends: tuple[str, ...] = ("citing", "cited")) -> DataFrame:
    """The single edges of which one of ``ends`` is among ``ids (id)``. Citations are looked up, in one pass, before they are
    made single, so that where few papers are asked for only their citations are shuffled."""
    asked, out = ids.select("id").distinct(), cites
    for end in ends:
        out = out.join(asked.select(F.col("id").alias(end), F.lit(True).alias(f"at_{end}")), end, "left")
    return single_edges(out.where(" or ".join(f"at_{end}" for end in ends)))


def edges_by_paper(edges: DataFrame, references: int = 1000, citations: int = 1000) -> DataFrame:
    """Rows ``(id, way, other, is_influential, is_methodology)``: each paper's first references and citations, by the other's id."""
    back = top_k(edges.select(F.col("citing").alias("id"), F.lit("reference").alias("way"), F.col("cited").alias("other"), "is_influential", "is_methodology"), ["id"], [F.col("other")], references)
    ahead = top_k(edges.select(F.col("cited").alias("id"), F.lit("citation").alias("way"), F.col("citing").alias("other"), "is_influential", "is_methodology"), ["id"], [F.col("other")], citations)
    return back.unionByName(ahead).drop("rank")


def papers_by_id(papers: DataFrame, ids: DataFrame, angle: str = "graph_expansion") -> DataFrame:
    """The records of ``ids (id)`` that there are, marked with how they were found."""
    return papers.join(ids.select("id").distinct(), "id", "left_semi").withColumn("search_angles", F.array(F.lit(angle)))


def most_cited(papers: DataFrame, top: int) -> DataFrame:
    return papers.orderBy(F.desc("citation_count"), "id").limit(top).select("id")


def in_set_citations(papers: DataFrame, edges: DataFrame, top: int = 20, refs: int = 50) -> DataFrame:
    """Rows ``(id, in_set)``: how often the ``top`` most cited papers (``refs`` references each) cite a paper of the set."""
    some = edges.join(most_cited(papers, top).withColumnRenamed("id", "citing"), "citing", "left_semi")
    some = top_k(some.select("citing", "cited"), ["citing"], [F.col("cited")], refs)
    return some.groupBy(F.col("cited").alias("id")).agg(F.count(F.lit(1)).alias("in_set")).join(papers.select("id"), "id", "left_semi")


def influence(papers: DataFrame, edges: DataFrame, top: int = 20, each: int = 100) -> DataFrame:
    """Rows ``(id, influence)``: influential edges between the set and its ``top`` most cited papers, of which the first ``each``
    references and citations are looked at; methodological ones count twice. The paper at the other end is credited."""
    best = most_cited(papers, top)
    near = edges.join(best.withColumnRenamed("id", "citing"), "citing", "left_semi").unionByName(edges.join(best.withColumnRenamed("id", "cited"), "cited", "left_semi").select(*edges.columns)).distinct()
    seen = edges_by_paper(near, each, each).join(best, "id", "left_semi").where("is_influential")
    found = seen.groupBy(F.col("other").alias("id")).agg(F.sum(F.when(F.col("is_methodology"), 2).otherwise(1)).alias("influence"))
    return found.join(papers.select("id"), "id", "left_semi")


def author_reputation(authors: DataFrame) -> DataFrame:
    """``(id, author_id)`` to ``(id, author)``: a paper's share of the authors with two papers or more."""
    authors = authors.distinct()
    repeat = authors.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("author_id")
    total = repeat.count()
    own = authors.join(repeat, "author_id").groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return authors.select("id").distinct().join(own, "id", "left").select("id", F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / max(1, total)).alias("author"))


def scored(papers: DataFrame, cites: DataFrame, authors: DataFrame, year_now: int, top: int = 20) -> DataFrame:
    """``papers`` with every ranking feature; counts are divided by their maximum over the set. ``top``: most cited papers asked.

    Papers, edges and features are written once each: what is ranked by them does not read the tables again.
    """
    papers, edges = written(papers, "papers"), written(single_edges(cites), "edges")
    whole = (
        papers.join(in_set_citations(papers, edges, top), "id", "left").join(influence(papers, edges, top), "id", "left").join(author_reputation(written(authors, "authors")), "id", "left")
        .fillna(0, ["in_set", "influence"]).fillna(0.0, ["author"]).withColumn("raw_velocity", X.velocity(F.col("citation_count"), F.col("year"), year_now))
        .withColumn("venue_score", X.venue_score(F.col("venue"))).withColumn("survey", X.is_survey(F.col("title"), F.col("abstract")).cast("int"))
    )
    whole = written(whole, "features")
    most = whole.agg(*(F.max(c).alias(c) for c in ("in_set", "influence", "raw_velocity"))).first()
    share = lambda c: F.col(c) / (most[c] or 1)
    return (
        whole.withColumn("velocity_share", share("raw_velocity")).withColumn("velocity_capped", F.least(F.col("raw_velocity") / 100, F.lit(1.0)))
        .withColumn("in_set", share("in_set")).withColumn("influence", share("influence"))
    )


def scored_sets(sets: DataFrame, papers: DataFrame, cites: DataFrame, authors: DataFrame, year_now: int, top: int = 15, refs: int = 50, each: int = 100) -> DataFrame:
    """The features of ``scored`` for many result sets ``(qid, id, ...)`` at once, each within its own set: which papers are most cited, whom they
    cite, which authors come again, and by what maximum counts are divided."""
    sets = written(sets, "sets")
    own = written(sets.join(papers, "id"), "own")
    pairs = own.select("qid", "id")
    tops = written(top_k(own.select("qid", "id", "citation_count"), ["qid"], [F.desc("citation_count"), F.col("id")], top).select("qid", "id"), "tops")
    asked = written(tops.select("id").distinct(), "asked")
    near = written(touching(cites, asked), "near")
    cited = top_k(near.join(asked.withColumnRenamed("id", "citing"), "citing", "left_semi").select("citing", "cited"), ["citing"], [F.col("cited")], refs)
    in_set = tops.join(cited, F.col("id") == F.col("citing")).select("qid", F.col("cited").alias("id")).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("in_set"))
    seen = edges_by_paper(near, each, each).where("is_influential").join(tops, "id")
    weight = F.sum(F.when(F.col("is_methodology"), 2).otherwise(1)).alias("influence")
    influential = seen.groupBy("qid", F.col("other").alias("id")).agg(weight)
    those = written(pairs.select("id").distinct(), "those")
    wrote = written(pairs.join(authors.join(those, "id", "left_semi").distinct(), "id"), "wrote")
    again = wrote.groupBy("qid", "author_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("qid", "author_id")
    of_set = again.groupBy("qid").agg(F.count(F.lit(1)).alias("all_again"))
    author = wrote.join(again, ["qid", "author_id"]).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("k")).join(of_set, "qid").select("qid", "id", F.least(F.lit(1.0), F.col("k") / F.col("all_again")).alias("author"))
    whole = own
    for part in (in_set, influential, author):
        whole = whole.join(part, ["qid", "id"], "left")
    whole = whole.fillna(0, ["in_set", "influence"]).fillna(0.0, ["author"]).withColumn("raw_velocity", X.velocity(F.col("citation_count"), F.col("year"), year_now))
    whole = written(whole.withColumn("venue_score", X.venue_score(F.col("venue"))).withColumn("survey", X.is_survey(F.col("title"), F.col("abstract")).cast("int")), "features")
    most = whole.groupBy("qid").agg(*(F.max(c).alias(f"most_{c}") for c in ("in_set", "influence", "raw_velocity")))
    share = lambda c: F.col(c) / F.when(F.col(f"most_{c}") > 0, F.col(f"most_{c}")).otherwise(1)
    out = whole.join(most, "qid").withColumn("velocity_share", share("raw_velocity")).withColumn("velocity_capped", F.least(F.col("raw_velocity") / 100, F.lit(1.0)))
    return out.withColumn("in_set", share("in_set")).withColumn("influence", share("influence")).drop("most_in_set", "most_influence", "most_raw_velocity")


def deep_score(relevance: F.Column) -> F.Column:
    """Importance from the features of ``scored`` and a relevance of 0 to 10, which outweighs them all."""
    w = DEEP
    return (
        w["relevance"] * relevance + w["in_set"] * F.col("in_set") + w["influence"] * F.col("influence") + w["author"] * F.col("author")
        + w["velocity"] * F.col("velocity_capped") + w["venue"] * F.col("venue_score") + w["survey"] * 0.3 * F.col("survey")
    )


def deep_rank(features: DataFrame) -> DataFrame:
    return features.select("id", F.round(deep_score(F.col("llm_relevance")), 4).alias("importance"))


def metadata_rank(features: DataFrame) -> DataFrame:
    w = META
    diversity = F.when(F.col("n_sources") >= 3, 1.0).when(F.col("n_sources") == 2, 0.5).otherwise(0.0)
    score = (
        w["velocity"] * F.col("velocity_share") + w["in_set"] * F.col("in_set") + w["influence"] * F.col("influence") + w["author"] * F.col("author")
        + w["diversity"] * diversity + w["venue"] * F.col("venue_score") + w["survey"] * F.col("survey")
    )
    return features.select("id", F.round(score, 4).alias("importance"))


def select_seeds(papers: DataFrame, least: int = 6, most: int = 20) -> DataFrame:
    """Rows ``(seed)``: the most relevant papers that reach ``least``."""
    return papers.where(F.col("relevance") >= least).orderBy(F.desc("relevance"), "id").limit(most).select(F.col("id").alias("seed"))


def multi_hop(papers: DataFrame, edges: DataFrame, seeds: DataFrame, known: DataFrame, relevance: DataFrame, n_hops: int = 2, cap: int = 40) -> tuple[DataFrame, DataFrame]:
    """Papers found over the seeds' citations, ``(id, hop, relevance)``, and a funnel ``(hop, stage, n)``.

    The first hop follows influential edges only and keeps 2 * ``cap`` new neighbours, later ones all edges and ``cap``; neighbours without
    a record go; those of relevance 5 or more (``relevance (id, model_score)``, 5 where missing) stay, and the 20 best of 6 or more lead on.
    """
    front, found, funnel = seeds, None, Funnel()
    known = written(known.select("id").distinct(), "known")
    for hop in range(1, n_hops + 1):
        use = edges.where("is_influential") if hop == 1 else edges
        ways = use.select(F.col("citing").alias("seed"), F.col("cited").alias("id")).unionByName(use.select(F.col("cited").alias("seed"), F.col("citing").alias("id")))
        front = funnel.stage(front, hop=hop, stage="seeds")
        near = written(funnel.stage(ways.join(front, "seed", "left_semi").select("id").distinct(), hop=hop, stage="neighbours"), "near")
        fresh = near.join(known, "id", "left_anti").orderBy("id").limit((cap if hop == 1 else cap // 2) * 2)
        fresh = written(funnel.stage(fresh, hop=hop, stage="new"), "fresh")
        got = relevant(papers_by_id(papers, fresh).select("id"), relevance).withColumn("hop", F.lit(hop)).select("id", "hop", "relevance")
        got = written(funnel.stage(got, hop=hop, stage="approved"), "hop")
        found = got if found is None else found.unionByName(got)
        known, front = known.unionByName(fresh), select_seeds(got)
    return found, funnel.rows(seeds.sparkSession, "hop int, stage string, n long")


def backward_layers(edges: DataFrame, seeds: DataFrame, depth: int = 2, refs: int = 120, width: int = 60) -> DataFrame:
    """Rows ``(citing, cited, is_influential, is_methodology, hop)``: references of the seeds and of the ``width`` most referred-to new
    papers of each layer, ``refs`` of each paper; every edge met is kept."""
    front, seen, layers = seeds.select(F.col("seed").alias("citing")).distinct(), None, []
    known = front.select(F.col("citing").alias("cited"))
    for hop in range(1, depth + 1):
        met = top_k(edges.join(front, "citing", "left_semi"), ["citing"], [F.col("cited")], refs).drop("rank").withColumn("hop", F.lit(hop))
        met = written(met, "layer")
        layers.append(met)
        new = met.join(known, "cited", "left_anti").groupBy("cited").agg(F.count(F.lit(1)).alias("n"))
        known = written(known.unionByName(new.select("cited")).distinct(), "known")
        front = written(new.orderBy(F.desc("n"), "cited").limit(width).select(F.col("cited").alias("citing")), "front")
    for layer in layers:
        seen = layer if seen is None else seen.unionByName(layer)
    return seen


def find_roots(papers: DataFrame, edges: DataFrame, ranked: DataFrame, judged: DataFrame | None = None, n_seeds: int = 15, least: int = 6, roots: int = 5) -> DataFrame:
    """Where the references of the best papers, ``ranked (id, relevance)``, meet: candidates with a record, judged ``least`` or better.

    ``judged (id, judge)`` are a model's scores of the candidates, 5 where one is missing, which fails; without a table all pass.
    """
    seeds = written(ranked.orderBy(F.desc("relevance"), "id").limit(n_seeds).select(F.col("id").alias("seed")), "seeds")
    met = backward_layers(edges, seeds)
    known = root_candidates(met, seeds).join(papers.select("id", "title", "year"), "id")
    if judged is not None:
        known = known.join(judged, "id", "left").where(F.coalesce("judge", F.lit(5)) >= least).drop("judge")
    return known.orderBy(F.desc("score"), "id").limit(roots)


def hybrid_expand(edges: DataFrame, vectors: DataFrame, seeds: DataFrame, per_hop: int = 15, liked: int = 5, near: int = 20, most: int = 50) -> DataFrame:
    """Rows ``(id, way)``: papers one influential hop away, and those whose vectors are nearest to the first of them, without the seeds."""
    ways = edges.select(F.col("citing").alias("src"), F.col("cited").alias("dst"), "is_influential").unionByName(edges.select(F.col("cited").alias("src"), F.col("citing").alias("dst"), "is_influential"))
    graph = hops(ways, seeds, 1, per_hop, True).select(F.col("node").alias("id"))
    graph = written(graph, "graph")
    chosen = vectors.join(graph, "id", "left_semi").orderBy("id").limit(liked)
    semantic = recommend(vectors, chosen, vectors.limit(0), near).select("id")
    both = graph.select("id", F.lit("graph").alias("way")).unionByName(semantic.select("id", F.lit("semantic").alias("way")))
    new = both.join(seeds.select(F.col("seed").alias("id")), "id", "left_anti").groupBy("id").agg(F.min("way").alias("way"))
    return new.orderBy("id").limit(most)


def root_candidates(cites: DataFrame, seeds: DataFrame, depth: int = 2, keep: int = 15, influential_only: bool = False) -> DataFrame:
    """Rows ``(id, convergence, influential, methodology, score)``: where the seeds' references meet, best first.

    All references count; ``influential_only`` follows the influential ones alone.
    """
    edges = (cites.where("is_influential") if influential_only else cites).select(F.col("citing").alias("src"), F.col("cited").alias("dst")).distinct()
    closure = reachable(edges, seeds, depth)
    n = seeds.count()
    met = closure.where("node <> seed").groupBy("node").agg((F.count_distinct("seed") / F.lit(n)).alias("convergence"))
    quality = cites.groupBy("cited").agg(F.avg(F.col("is_influential").cast("double")).alias("influential"), F.avg(F.col("is_methodology").cast("double")).alias("methodology"))
    out = met.join(seeds.select(F.col("seed").alias("node")), "node", "left_anti").join(quality, F.col("node") == F.col("cited"), "left").fillna(0.0, ["influential", "methodology"])
    score = F.round(0.5 * F.col("convergence") + 0.3 * F.col("influential") + 0.2 * F.col("methodology"), 6)
    return out.select(F.col("node").alias("id"), F.round("convergence", 6).alias("convergence"), F.round("influential", 6).alias("influential"), F.round("methodology", 6).alias("methodology"), score.alias("score")).orderBy(F.desc("score"), "id").limit(keep)
