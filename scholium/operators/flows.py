"""Compositions: fan-out retrieval, paper search, community upkeep, graph and chat context, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import written
from . import documents as D
from . import graph as G
from . import inference as I
from . import linkage as L
from . import papers as P
from . import retrieval as S
from .counts import nearest_counts

#: Results that each source gives to a query.
PER_SOURCE = {"s2": 50, "arxiv": 15, "openalex": 30}


def fanned_out(papers: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows ``(qid, source, label, id, score, rank)``: every planned query against the papers of its source.

    ``papers (id, source, text)``; each source is an index of its own, with its own statistics and limit. A source without
    papers contributes nothing.
    """
    papers, plans, out = written(papers, "papers"), written(plans, "plans"), None
    for source, k in PER_SOURCE.items():
        asked = plans.where(F.col("source") == source).select(F.struct("qid", "label").alias("key"), F.col("query").alias("q"))
        hits = S.bm25(papers.where(F.col("source") == source), asked, id_col="id", text_col="text", query_id="key", query_text="q", k=k)
        hits = hits.select("qid.qid", F.lit(source).alias("source"), "qid.label", "id", "score", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


def searched(papers: DataFrame, plans: DataFrame, records: DataFrame, cites: DataFrame, authors: DataFrame, year_now: int, least: int = 5, limit: int = 20) -> DataFrame:
    """Rows ``(qid, id, relevance, importance, rank)``: retrieve, keep one row a paper, judge, keep the relevant, rank.

    ``records`` have title, abstract, venue, year and citation_count. Ranking features are taken within each query's relevant results, and
    relevance is the retrieval score scaled by the query's best.
    """
    limit = max(5, min(100, limit))
    found = written(fanned_out(papers, plans).groupBy("qid", "id").agg(F.max(F.round("score", 6)).alias("score")), "found")
    best = found.groupBy("qid").agg(F.max("score").alias("best"))
    judged = found.join(best, "qid").select("qid", "id", F.round(10 * F.col("score") / F.col("best"), 0).cast("int").alias("relevance")).where(F.col("relevance") >= least)
    ranked = P.scored_sets(judged, records, cites, authors, year_now).withColumn("importance", F.round(P.deep_score(F.col("relevance")), 4))
    return S.top_k(ranked.select("qid", "id", "relevance", "importance"), ["qid"], [F.desc("importance"), F.col("id")], limit)


def ranked_communities(communities: DataFrame, members: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``communities (component, size, text)`` for ``queries (qid, keywords)``: rows ``(qid, component, score, rank)``.

    A community scores its size, 20 if one of its ``members (component, name)`` is a keyword, and 3 for each keyword in its
    text; those without text are left out. Every community has a score for every query, so the queries are a stated, small set.
    """
    asked = queries.select("qid", F.explode("keywords").alias("name"))
    named = asked.join(members.select("component", "name"), "name").select("qid", "component", F.lit(20).alias("boost")).distinct()
    both = communities.where(F.trim("text") != "").join(queries, F.lit(True)).join(named, ["qid", "component"], "left")
    said = F.size(F.filter("keywords", lambda w: F.lower("text").contains(w)))
    score = F.col("size") + F.coalesce("boost", F.lit(0)) + 3 * said
    return S.top_k(both.select("qid", "component", score.cast("long").alias("score")), ["qid"], [F.desc("score"), F.desc("component")], k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, props: DataFrame, n_words: int = 15, n_chunks: int = 15, n_props: int = 20) -> DataFrame:
    """Rows ``(qid, id, doc_id, is_proposition, score, rank)`` for ``queries (qid, query)``, chunks and propositions ``(id, doc_id, text)``.

    Nearest chunks and propositions make one list, ranked by similarity, propositions boosted; the chunks' best by words another. The lists
    are fused by rank, and of a document's chunks only one stays that comes first of all its rows.
    """
    asked = I.hashed_cells(queries, "qid", "query")
    by_cells = lambda df, k, p: nearest_counts(I.hashed_cells(df, "id", "text"), asked, k, I.DIM).withColumn("p", F.lit(p))
    near = by_cells(chunks, n_chunks, False).unionByName(by_cells(props, n_props, True))
    near = written(near.drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "id"))), "near")
    words = S.bm25(chunks, queries, id_col="id", text_col="text", query_id="qid", query_text="query", k=n_words).select("qid", "id", "rank")
    fused = S.rrf([(near.where("p"), S.BOOST), (near.where("not p"), 1.0), (words, 1.0)])
    known = chunks.select("id", "doc_id", F.lit(False).alias("is_proposition")).unionByName(props.select("id", "doc_id", F.lit(True).alias("is_proposition")))
    ranked = fused.join(known, "id").select("qid", "id", F.col("doc_id").alias("doc"), "is_proposition", F.col("rrf").alias("score"))
    return S.diversify(ranked, n_chunks + n_props).withColumnRenamed("doc", "doc_id")


def chat_context(messages: DataFrame, chunks: DataFrame, props: DataFrame, graph: DataFrame | None = None, n_facts: int = 15, n_passages: int = 10, n_sources: int = 10) -> DataFrame:
    """Rows ``(conv_id, turn, query, facts, passages, sources, history, prompt)``: what an answering model is given for each user turn.

    ``graph (conv_id, turn, text)`` is the graph's context for a turn, if there is any.
    """
    asked = written(D.context_queries(messages).withColumn("qid", F.concat_ws(":", "conv_id", "turn")), "asked")
    props = written(props.select("id", "doc_id", "text"), "props")
    found = written(hybrid_search(asked.select("qid", "query"), chunks, props), "found")
    text = chunks.select("id", "text").unionByName(props.select("id", "text"))
    told = found.join(text, "id").withColumn("nth", F.row_number().over(W.partitionBy("qid", "is_proposition").orderBy("rank")))
    said = F.when(F.col("is_proposition") & (F.col("nth") <= n_facts), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "text"))
    shown = F.when(~F.col("is_proposition") & (F.col("nth") <= n_passages), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]\n"), F.substring("text", 1, 500)))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("rank", c.alias("t"))))), lambda x: x["t"]), "\n\n")
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") <= n_sources, F.struct("rank", "id", "doc_id", F.substring("text", 1, 200).alias("text"), F.round("score", 3).alias("score")))))
    context = told.groupBy("qid").agg(lines(said).alias("facts"), lines(shown).alias("passages"), listed.alias("sources"))
    whole = asked.join(context, "qid", "left").join(D.chat_history(messages), ["conv_id", "turn"])
    if graph is not None:
        whole = whole.join(graph.select("conv_id", "turn", F.col("text").alias("graph")), ["conv_id", "turn"], "left").withColumn("facts", F.concat_ws("\n\n", "graph", "facts"))
    last = messages.select("conv_id", "turn", F.col("text").alias("question"))
    return I.prompts(whole.join(last, ["conv_id", "turn"])).select("conv_id", "turn", "query", "facts", "passages", "sources", "history", "prompt")


def graph_context(names: DataFrame, entities: DataFrame, relations: DataFrame, neighbours: int = 5, most: int = 15, each: int = 5) -> DataFrame:
    """Rows ``(qid, id, named, rank, relations)`` for ``names (qid, id)``: named entities, some neighbours, their relations.

    ``entities (id, mentions)``; ``relations (source_id, target_id, relation_type)``. Named entities come first, then their
    neighbours (the first ``neighbours`` of each by id), ``most`` a query; an entity's first ``each`` relations follow.
    """
    ends = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit("->").alias("way"), "relation_type").unionByName(
        relations.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("<-").alias("way"), "relation_type")
    )
    # Only the named entities' edges are kept before any window.
    around = ends.join(names.select("id").distinct(), "id", "left_semi").select("id", "other").distinct()
    near = S.top_k(around, ["id"], [F.col("other")], neighbours, "at")
    wide = names.select("qid", "id", F.lit(True).alias("named")).unionByName(names.join(near, "id").select("qid", F.col("other").alias("id"), F.lit(False).alias("named")))
    chosen = wide.join(entities.select("id"), "id", "left_semi").groupBy("qid", "id").agg(F.max("named").alias("named"))
    top = S.top_k(chosen, ["qid"], [F.desc("named"), F.col("id")], most)
    own = S.top_k(ends.join(top.select("id").distinct(), "id", "left_semi"), ["id"], [F.col("way").desc(), F.col("other"), F.col("relation_type")], each, "at")
    said = own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(" ", "way", "relation_type", "other").alias("s")))), lambda x: x["s"]), "; ").alias("relations"))
    return top.join(said, "id", "left").select("qid", "id", "named", "rank", F.coalesce("relations", F.lit("")).alias("relations"))


def graph_notes(names: DataFrame, bridges: DataFrame, links: DataFrame, most: int = 5, shown: int = 3) -> DataFrame:
    """Rows ``(qid, kind, id, text, rank)`` for ``names (qid, id)``: the first bridges among a query's entities, with some of their documents
    (``bridges (id, docs)``), and the first confirmed links that touch one (``links (a, b)``)."""
    spread = names.join(bridges, "id").select("qid", F.lit("bridge").alias("kind"), "id", F.array_join(F.slice("docs", 1, shown), ", ").alias("text"))
    touched = names.join(links.withColumn("id", F.col("a")), "id").select("qid", "a", "b").unionByName(names.join(links.withColumn("id", F.col("b")), "id").select("qid", "a", "b")).distinct()
    joined = touched.select("qid", F.lit("link").alias("kind"), F.col("a").alias("id"), F.col("b").cast("string").alias("text"))
    return S.top_k(spread.unionByName(joined), ["qid", "kind"], [F.col("id"), F.length("text"), F.col("text")], most)


def updated_communities(nodes: DataFrame, edges: DataFrame, members: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Rows ``(component, size, summary, outcome)``: components, their key concepts and summaries, matched with ``old``.

    ``nodes (id, ord)``, ``edges (src, dst)``, ``members (id, name, mentions)``; ``old (id, component)`` is the last snapshot.
    """
    now = written(G.communities(nodes, edges), "communities")
    named = now.join(members, "id").select("id", "component", "name", "mentions", F.concat(F.lit("mentioned "), F.col("mentions").cast("string"), F.lit(" times")).alias("description"))
    told = I.community_summaries(named, G.key_concepts(named.select("component", "name", "mentions")))
    if old is None:
        return told.withColumn("outcome", F.lit("fresh"))
    return told.join(G.matched_communities(old, now.select("id", "component")).select("component", "outcome"), "component", "left")


def ingested(docs: DataFrame, fewest: int = 2, most: int = 50) -> DataFrame:
    """Rows ``(doc_id, chunks, propositions, entities, relations)``: what ingestion derives from each document."""
    props = written(D.propositions(docs).select("doc_id", "n", "text"), "props")
    names = L.entities(docs, fewest, most).select("name")
    words = docs.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("name")).where(F.length("name") >= 8)
    counted = (
        (D.chunks(docs), "chunks"), (props, "propositions"), (words.join(names, "name"), "entities"), (I.relations_of(props, names), "relations"),
    )
    parts = [df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).select("doc_id", F.lit(what).alias("what"), "k") for df, what in counted]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    count = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("k"))), F.lit(0)).alias(what)
    found = whole.groupBy("doc_id").agg(*(count(what) for _, what in counted))
    return docs.select("doc_id").join(found, "doc_id", "left").fillna(0)


def readable(papers: DataFrame, identifier: Column, notes: DataFrame | None = None) -> DataFrame:
    """``papers`` with the way to read each: the kind of its identifier, and where its content is fetched or taken from.

    ``notes (doc_id, relative_path)``: with them, a paper without a place of its own is read from the stored note of its ``doc_id``, before its
    title and abstract are taken. Notes without a ``doc_id`` are told by their names alone, which end with its first eight characters: among
    millions of notes some papers share these.
    """
    kind = X.identifier_kind(identifier)
    place = F.when(kind == "arxiv", F.concat(F.lit("https://arxiv.org/pdf/"), X.no_version(identifier))).when(kind == "doi", F.concat(F.lit("https://doi.org/"), identifier)).when(kind == "url", identifier)
    if notes is not None:
        whole = "doc_id" in notes.columns
        key = F.col("doc_id") if whole else F.regexp_extract("relative_path", r"_([0-9a-f]{8})\.md$", 1)
        named = notes.select(key.alias("key"), F.col("relative_path").alias("note")).where("key <> ''").groupBy("key").agg(F.min("note").alias("note"))
        papers = papers.withColumn("key", F.col("doc_id") if whole else F.substring("doc_id", 1, 8)).join(named, "key", "left").drop("key")
        place = F.coalesce(place, "note")
    return papers.withColumn("kind", kind).withColumn("locator", F.coalesce(place, F.concat_ws("\n\n", "title", "abstract")))
