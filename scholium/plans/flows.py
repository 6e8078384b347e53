"""More registered queries: dumps, stored tables, model-step defaults and compositions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import flows as C
from ..operators import graph as G
from ..operators import inference as I
from ..operators import linkage as L
from ..operators import papers as P
from ..operators import retrieval as S
from ..sources import dumps, stored
from ..sources.fixtures import table, view
from .catalogue import CHUNKS, MARKDOWN, ORACLES, YEAR_NOW, query, ranked_sql
from .lineage import new_path

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 20)"
TOKENS = r"list_filter(string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda x: length(x) > 2)"


# Dumps: written in the public formats from the given tables, then read.


@query(
    """select id, title, abstract, venue, case when citation_count % 5 = 0 then null else year end as year, case when citation_count % 7 = 0 then 0 else citation_count end as citation_count,
'10.1000/' || lower(id) as doi, 'semantic_scholar' as sources, 1 as n_authors from v_paper""",
    ("v_paper",),
)
def papers_from_graph_api(spark, sf_dir):
    """Years and counts that the dump holds as strings are no whole numbers; an author without an id goes."""
    p = view(spark, sf_dir, "v_paper")
    author = lambda i, name: F.struct(i.cast("string").alias("authorId"), F.lit(name).alias("name"))
    line = lambda year, cites: F.to_json(F.struct(
        F.substring("id", 4, 100).alias("paperId"), F.concat(F.lit("  "), "title").alias("title"), "abstract", "venue", year.alias("year"), cites.alias("citationCount"),
        F.struct(F.concat(F.lit(" 10.1000/"), F.upper("id")).alias("DOI")).alias("externalIds"), F.array(author(F.lit("7"), "A"), author(F.lit(""), "B")).alias("authors"),
    ))
    year, cites = F.col("year"), F.col("citation_count")
    text = F.when((cites % 5 == 0) & (cites % 7 == 0), line(F.concat(year, F.lit("")), F.concat(cites, F.lit("")))).when(cites % 5 == 0, line(F.concat(year, F.lit("")), cites)).when(cites % 7 == 0, line(year, F.concat(cites, F.lit("")))).otherwise(line(year, cites))
    path = new_path(spark, "graphdump")
    p.select(text.alias("value")).write.text(path)
    got = dumps.from_graph_api(spark, path)
    return got.select("id", "title", "abstract", "venue", "year", "citation_count", "doi", F.array_join("sources", ",").alias("sources"), F.size("authors").alias("n_authors"))


@query("select 'openalex:W' || id as id, title, substr(title || ' ' || abstract, 1, 900) as abstract, venue, year, citation_count, '10.1000/' || id as doi from v_paper", ("v_paper",))
def papers_from_works_api(spark, sf_dir):
    p = view(spark, sf_dir, "v_paper")
    words = F.split(F.concat_ws(" ", "title", "abstract"), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("k"), F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w).alias("v"))))
    path = new_path(spark, "worksdump")
    stored.write_json(
        p.select(
            F.concat(F.lit("W"), "id").alias("id"), F.col("title").alias("display_name"), F.concat(F.lit("https://doi.org/10.1000/"), "id").alias("doi"), index.alias("abstract_inverted_index"),
            F.col("year").alias("publication_year"), F.col("citation_count").alias("cited_by_count"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
        ), path,
    )
    return dumps.from_works_api(spark, path).select("id", "title", "abstract", "venue", "year", "citation_count", "doi")


@query("select 'arxiv:' || id as id, title, abstract, 'http://arxiv.org/abs/' || id as url, id as arxiv_id from v_paper", ("v_paper",))
def papers_from_atom(spark, sf_dir):
    p, path = view(spark, sf_dir, "v_paper"), new_path(spark, "atomdump")
    entries = p.select(F.concat(F.lit("http://arxiv.org/abs/"), "id").alias("id"), "title", F.col("abstract").alias("summary"))
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return dumps.from_atom(spark, path).select("id", "title", "abstract", "url", "arxiv_id")


# Stored tables and logs.


@query(
    """with n as (select *, substr(sha256(cast(doc_id as varchar)), 1, 16) as id, replace(substr(text, 1, 40), chr(10), ' ') as title from documents)
select id as doc_id, 'ingested/' || source || '/' || substr(regexp_replace(regexp_replace(lower(trim(title, ' ')), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', '_', 'g'), 1, 60) || '_' || substr(id, 1, 8) || '.md' as relative_path,
source as source_type, md5(text) as content_md5 from n where length(trim(text, ' ')) >= 50"""
)
def stored_notes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(X.content_id(F.col("doc_id").cast("string")).alias("doc_id"), F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")).alias("title"), F.col("source").alias("source_type"), F.lit("").alias("source_url"), F.col("text").alias("content"))
    path = new_path(spark, "notes")
    stored.write_notes(stored.notes(rows), path)
    return stored.read_notes(spark, path).select("doc_id", "relative_path", "source_type", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("select cast(paper_id as varchar) as paper_id, 'p' || paper_id as title, arg_max(status, seq) as status, max(seq) as seq from v_registry_event group by paper_id", ("v_registry_event",))
def registry_file(spark, sf_dir):
    events, path = view(spark, sf_dir, "v_registry_event"), new_path(spark, "registry")
    last = events.groupBy(F.col("paper_id").cast("string").alias("paper_id")).agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    stored.write_json(last.select("paper_id", F.concat(F.lit("p"), "paper_id").alias("title"), "status", "seq", F.lit(1).alias("unknown_key")), path)
    return stored.read_registry(spark, path)


@query("select conv_id, turn, role, text as content, case when role = 'assistant' then 1 else 0 end as n_sources from conversations")
def chat_file(spark, sf_dir):
    said, path = table(spark, sf_dir, "conversations"), new_path(spark, "chat")
    sources = F.when(F.col("role") == "assistant", F.array(F.lit("doc")))
    stored.write_json(said.select("conv_id", "turn", "role", F.col("text").alias("content"), sources.alias("sources")), path)
    return stored.read_chat(spark, path).select("conv_id", "turn", "role", "content", F.size("sources").alias("n_sources"))


@query("select event_id as seq, case when event_type = 'signup' then 'add' else 'merge' end as op, user_id as id, value as payload from events where event_id % 11 <> 0 and event_type <> 'purchase'")
def change_log_file(spark, sf_dir):
    """Lines with a cut end are dropped, synced ones left out; a second append continues the log."""
    events, path = table(spark, sf_dir, "events"), new_path(spark, "changes")
    line = F.to_json(F.struct(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "add").otherwise("merge").alias("op"), F.col("user_id").alias("id"), F.col("value").alias("payload"), (F.col("event_type") == "purchase").alias("synced")))
    lines = events.select("event_type", F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    for part in (F.col("event_type") == "signup", F.col("event_type") != "signup"):
        lines.where(part).select("value").write.mode("append").text(path)
    return stored.read_changes(spark, path, unsynced=True).select("seq", "op", "id", "payload")


@query(
    """with r as (select distinct citing as a, cited as b from v_cite), n as (select a as id, b as other from r union select b, a from r), d as (select id, count(*) as degree from n group by id),
al as (select lower(title) as k, min(id) as entity from v_paper group by 1)
select p.id, al.entity, coalesce(degree, 0) as degree from v_paper p join al on al.k = lower(p.title) left join d using (id)""",
    ("v_paper", "v_cite"),
)
def graph_snapshot(spark, sf_dir):
    entities = view(spark, sf_dir, "v_paper").select("id", F.col("title").alias("name"))
    relations = view(spark, sf_dir, "v_cite").select(F.col("citing").alias("source_id"), F.col("cited").alias("target_id")).distinct()
    path = new_path(spark, "graph")
    stored.write_graph(entities, relations, path)
    entities, _, aliases, adjacency = stored.read_graph(spark, path)
    degree = adjacency.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    named = entities.withColumn("normalized_name", F.lower(F.trim("name"))).join(aliases, "normalized_name")
    return named.join(degree, "id", "left").select("id", "entity", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("select 'tokens' as what, count(distinct token) as n, count(*) as uses from v_token union all select 'vectors', count(*), count(*) from embeddings", ("v_token",))
def index_snapshot(spark, sf_dir):
    path = new_path(spark, "index")
    stored.write_index(S.postings(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    posts, vectors = stored.read_index(spark, path)
    by_token = posts.groupBy("token").agg(F.sum("tf").alias("tf")).agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("uses")).select(F.lit("tokens").alias("what"), "n", "uses")
    return by_token.unionByName(vectors.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vectors").alias("what"), "n", F.col("n").alias("uses")))


@query("select label as community_id, count(*) as size, min(vec_id) as first_id, max(vec_id) as last_id from embeddings group by label")
def property_graph_import(spark, sf_dir):
    v, path = table(spark, sf_dir, "embeddings"), new_path(spark, "propertygraph")
    nodes = v.select(F.col("vec_id").alias("id"), F.lit("Entity").alias("kind"), F.concat(F.lit("v"), "vec_id").alias("name"))
    v.select(F.col("vec_id").alias("src"), F.col("label").alias("dst"), F.lit("MEMBER_OF").alias("kind"), F.lit(1.0).alias("weight")).write.parquet(f"{path}/edges")
    nodes.write.parquet(f"{path}/nodes")
    return stored.imported_property_graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))[1]


# Defaults of the model steps.


@query(
    """with c as (select doc_id, cast(('0x' || substr(md5(token), 1, 8))::bigint % 256 as int) as i, count(*) as n from v_token group by all), s as (select doc_id, sqrt(sum(n * n)) as norm from c group by doc_id)
select doc_id, i, round(n / norm, 6) as x from c join s using (doc_id)""",
    ("v_token",),
)
def hashed_embeddings(spark, sf_dir):
    return I.hashed_embedding(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "i", F.round("x", 6).alias("x"))


@query(
    f"""with e as (select token from v_token where length(token) >= 8 group by token having count(distinct doc_id) between 2 and 50),
s as (select doc_id, unnest({SENTENCES}) as text, generate_subscripts({SENTENCES}, 1) as n from documents),
t as (select doc_id, n, unnest({TOKENS.format('text')}) as token, generate_subscripts({TOKENS.format('text')}, 1) as pos from s),
p as (select doc_id, token as source, lead(token) over (partition by doc_id, n order by pos) as target from t semi join e using (token))
select source as source_id, target as target_id, count(*) as seen, 1.0::double + 0.5::double * (count(*) - 1) as weight from p where target is not null and source <> target group by all""",
    ("v_token",),
)
def sentence_relations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = I.relations_of(D.propositions(docs), L.entities(docs, 2, 50))
    out = L.upserted(rows.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("related_to").alias("relation_type")))
    return out.select("source_id", "target_id", "seen", "weight")


@query(f"select doc_id, trim(source || ': ' || coalesce(({SENTENCES.replace('>= 20', '>= 1')})[1], ''), ' ') as prefix from documents where text is not null")
def context_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", I.context_prefix(F.col("source"), F.col("text")).alias("prefix"))


@query(
    ORACLES["bm25_benchmark_topk"].replace(
        "select item_id, doc_id, round(score, 4) as score, cast(rank as int) as rank from r where rank <= 15",
        ", m as (select item_id, max(round(score, 6)) as best from r group by 1) select item_id, doc_id, cast(round(10 * round(score, 6) / best, 0) as int) as relevance from r join m using (item_id) where rank <= 50",
    )
)
def relevance_scores(spark, sf_dir):
    hits = I.relevance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), F.col("model_score").alias("relevance"))


@query(ORACLES["trigram_name_join"].replace("select a, b, round(c / (x.k + y.k - c), 6) as jaccard", "select a, b, case when c / (x.k + y.k - c) >= 0.5 then 'merge' else 'separate' end as decision"))
def gray_merges(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return I.merge_or_keep(L.trigram_join(names, 0.4).select("a", "b")).select("a", "b", "decision")


@query(
    """with p as (select a.vec_id as name, b.vec_id as target, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a join embeddings b on a.vec_id % 5 = 0 and b.vec_id % 5 <> 0),
r as (select *, row_number() over (partition by name order by sim desc, target desc) as rn from p) select name, case when sim > 0.35 then target end as target from r where rn = 1"""
)
def ambiguous_merges(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = S.vector_top_k(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), 3)
    return I.merge_or_new(near.select(F.col("qid").alias("name"), F.col("vec_id").alias("target"), "sim"), 0.35)


@query(
    """with l as (select *, round(sim * case when a.label <> b.label then 1.0::double else 0.3::double end, 6) as novelty from v_link join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst)
select src as source_id, dst as target_id, 'deep_connection' as relation_type, novelty as weight from l where novelty > 0.1 order by novelty desc, src, dst limit 10""",
    ("v_link",),
)
def confirmed_connections(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    of = lambda end, name: v.select(F.col("vec_id").alias(end), F.col("label").alias(name))
    links = view(spark, sf_dir, "v_link").withColumnsRenamed({"src": "a", "dst": "b"}).join(of("a", "ca"), "a").join(of("b", "cb"), "b")
    scored = links.withColumn("novelty", F.round(X.novelty(F.col("sim"), F.lit(-1), F.col("ca"), F.col("cb")), 6))
    return I.confirmed(scored, 0.1)[1]


@query("select item_id as qid, 'direct_query' as label, s as source, text as query from benchmark, (values ('arxiv'), ('openalex'), ('s2')) t(s) where trim(text, ' ') <> ''")
def query_plans(spark, sf_dir):
    return I.single_angle(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(
    ORACLES["chat_history_window"].replace(
        "select m.conv_id, m.turn, coalesce(history, '') as history from m",
        "select m.conv_id, m.turn, case when coalesce(history, '') <> '' then 'History:' || chr(10) || history || chr(10) || chr(10) else '' end || case when coalesce(m.text, '') <> '' then 'Question:' || chr(10) || m.text else '' end as prompt from m",
    )
)
def answer_prompts(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    rows = D.chat_history(said).join(said.select("conv_id", "turn", F.col("text").alias("question")), ["conv_id", "turn"]).withColumn("facts", F.lit(""))
    return I.prompts(rows).select("conv_id", "turn", "prompt")


# Compositions.


_TITLES = "with q as (select distinct p_name as name from part), pp as (select id, title || ' ' || abstract as text, case cast(substr(id, 4) as bigint) % 3 when 0 then 's2' when 1 then 'arxiv' else 'openalex' end as source from v_paper),"
FANOUT = (
    _TITLES
    + f"""tk as (select source, id, unnest({TOKENS.format('text')}) as token from pp), ln as (select source, id, count(*) as dl from tk group by all), st as (select source, count(*) as n, avg(dl) as avgdl from ln group by source),
tf as (select source, id, token, count(*) as tf from tk group by all), df as (select source, token, count(*) as df from tf group by all),
qt as (select name, token, count(*) as times from (select name, unnest({TOKENS.format('name')}) as token from q) group by all),
sc as (select name, source, id, sum(times * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / greatest(avgdl, 1)))) as score
       from qt join tf using (token) join df using (source, token) join ln using (source, id) join st using (source) group by all),
rk as (select *, row_number() over (partition by name, source order by round(score, 9) desc, id) as rank from sc where score > 0),
fo as (select * from rk where rank <= case source when 's2' then 50 when 'arxiv' then 15 else 30 end)"""
)


def _paper_sources(spark, sf_dir, papers=None):
    third = F.substring("id", 4, 100).cast("long") % 3
    source = F.when(third == 0, "s2").when(third == 1, "arxiv").otherwise("openalex")
    papers = (view(spark, sf_dir, "v_paper") if papers is None else papers).select("id", source.alias("source"), F.concat_ws(" ", "title", "abstract").alias("text"))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return papers, I.single_angle(names, "name", "name")


@query(FANOUT + " select name, source, id, round(score, 4) as score, cast(rank as int) as rank from fo", ("v_paper",))
def fanout_retrieval(spark, sf_dir):
    papers, plans = _paper_sources(spark, sf_dir)
    return C.fanned_out(papers, plans).select(F.col("qid").alias("name"), "source", "id", F.round("score", 4).alias("score"), "rank")


@query(FANOUT + " select name, source, label, id, round(score, 4) as score, cast(rank as int) as rank from fo, (values ('direct_query'), ('raw_query')) t(label) where label = 'direct_query' or source <> 'arxiv'", ("v_paper",))
def fanout_angles(spark, sf_dir):
    papers, plans = _paper_sources(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return C.fanned_out(papers, I.with_raw(plans, names, "name", "name")).select(F.col("qid").alias("name"), "source", "label", "id", F.round("score", 4).alias("score"), "rank")


#: Features within each query's relevant results: its most cited papers, their references and influential edges, authors who come again.
WITHIN = (
    FANOUT
    + """, be as (select name, id, max(round(score, 6)) as score from fo group by all), mx as (select name, max(score) as best from be group by name),
rr as (select name, id, cast(round(10 * score / best, 0) as int) as relevance from be join mx using (name)), se as (select rr.*, p.* exclude (id) from rr join v_paper_rich p using (id) where relevance >= 5),
tp as (select name, id from (select name, id, row_number() over (partition by name order by citation_count desc, id) as k from se) where k <= 15),
ed as (select citing, cited, max(is_influential) as is_influential, max(is_methodology) as is_methodology from v_cite group by all),
er as (select citing, cited, row_number() over (partition by citing order by cited) as rn from ed),
ins as (select tp.name, er.cited as id, count(*) as ins from tp join er on er.citing = tp.id and rn <= 50 group by all),
w as (select citing as id, cited as other, is_influential, is_methodology, row_number() over (partition by citing order by cited) as rn from ed union all select cited, citing, is_influential, is_methodology, row_number() over (partition by cited order by citing) from ed),
inf as (select tp.name, w.other as id, sum(case when is_methodology then 2 else 1 end) as inf from tp join w on w.id = tp.id where rn <= 100 and is_influential group by all),
wr as (select name, id, author_id from se join v_author using (id)), ag as (select name, author_id from wr group by all having count(*) >= 2), na as (select name, count(*) as n from ag group by name),
au as (select name, id, least(1.0, count(*) / any_value(n)) as author from wr join ag using (name, author_id) join na using (name) group by all),"""
)


@query(
    WITHIN
    + ranked_sql(15).split("f as (select p.*")[1].join(["f as (select p.*", ""]).replace("coalesce(influence, 0) as inf, coalesce(in_set, 0) as ins, least(1.0, coalesce(k, 0) / n) as author", "coalesce(inf, 0) as inf_, coalesce(ins, 0) as ins_, coalesce(author, 0) as author_")
    .split("from v_paper_rich p left join")[0]
    + """ from se p left join ins using (name, id) left join inf using (name, id) left join au using (name, id)),
g as (select *, inf_ / greatest(max(inf_) over (partition by name), 1) as infn, ins_ / greatest(max(ins_) over (partition by name), 1) as insn from f),
im as (select name, id, relevance, round(0.55::double * relevance + 0.12::double * insn + 0.10::double * infn + 0.05::double * author_ + 0.08::double * least(vel / 100, 1) + 0.05::double * ven + 0.05::double * 0.3::double * sur, 4) as importance from g),
ou as (select *, row_number() over (partition by name order by importance desc, id) as rank from im) select name, id, relevance, importance, cast(rank as int) as rank from ou where rank <= 20""",
    ("v_paper", "v_paper_rich", "v_cite", "v_author"),
)
def search_papers(spark, sf_dir):
    papers, plans = _paper_sources(spark, sf_dir)
    found = C.searched(papers, plans, view(spark, sf_dir, "v_paper_rich"), view(spark, sf_dir, "v_cite"), view(spark, sf_dir, "v_author"), YEAR_NOW)
    return found.withColumnRenamed("qid", "name")


def _part_communities(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    members = parts.groupBy(F.col("p_size").alias("component"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("mentions"))
    return members, G.key_concepts(members)


PART_COMMUNITIES = """with c as (select p_size as component, p_name as name, count(*) as mentions from part group by all), r as (select *, row_number() over (partition by component order by mentions desc, name) as rn from c),
k as (select component, string_agg(name, '|' order by rn) as concepts from r where rn <= 5 group by component), z as (select component, count(*) as size, min(name || ': mentioned ' || mentions) as own from c group by component),
s as (select component, size, case when size = 1 then own else 'Cluster: ' || replace(concepts, '|', ', ') end as summary from z join k using (component))"""


@query(PART_COMMUNITIES + " select component, size, summary from s")
def community_summaries(spark, sf_dir):
    members, concepts = _part_communities(spark, sf_dir)
    return I.community_summaries(members.withColumn("description", F.concat(F.lit("mentioned "), F.col("mentions").cast("string"))), concepts)


@query(
    PART_COMMUNITIES
    + """, q as (select distinct p_type as qid, string_split(p_type, ' ') as kw from part), t as (select qid, component, s.size + 3 * len(list_filter(kw, lambda w: contains(lower(summary), w)))
 + case when exists (select 1 from c where c.component = s.component and list_contains(kw, c.name)) then 20 else 0 end as score from s, q),
o as (select *, row_number() over (partition by qid order by score desc, component desc) as rank from t) select qid, component, cast(score as bigint) as score, cast(rank as int) as rank from o where rank <= 5"""
)
def community_ranking(spark, sf_dir):
    members, concepts = _part_communities(spark, sf_dir)
    told = I.community_summaries(members.withColumn("description", F.concat(F.lit("mentioned "), F.col("mentions").cast("string"))), concepts)
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("qid"), F.split("p_type", " ").alias("keywords")).distinct()
    return C.ranked_communities(told.select("component", "size", F.col("summary").alias("text")), members, asked)


@query(
    """with nm as (select vec_id as qid, vec_id as id from embeddings where vec_id % 100 = 0), e as (select src as id, dst as other, '->' as way from v_link union all select dst, src, '<-' from v_link),
nb as (select id, other, row_number() over (partition by id order by other) as k from (select distinct id, other from e semi join nm using (id))),
w as (select qid, id, true as named from nm union all select qid, other, false from nm join nb using (id) where k <= 5), g as (select qid, id, max(named) as named from w group by all),
t as (select *, row_number() over (partition by qid order by named desc, id) as rank from g), o as (select *, row_number() over (partition by id order by way desc, other) as k from e),
s as (select id, string_agg(way || ' links ' || other, '; ' order by k) as relations from o where k <= 5 group by id)
select qid, id, named, cast(rank as int) as rank, coalesce(relations, '') as relations from t left join s using (id) where rank <= 15""",
    ("v_link",),
)
def graph_context(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    links = view(spark, sf_dir, "v_link").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("links").alias("relation_type"))
    return C.graph_context(v.where("id % 100 = 0").select(F.col("id").alias("qid"), "id"), v, links)


@query(
    """with nm as (select vec_id as qid, vec_id as id from embeddings), b as (select qid, 'bridge' as kind, id, array_to_string(list_sort(list_distinct([id % 50, id % 7, id % 3]))[1:3], ', ') as text from nm where len(list_distinct([id % 50, id % 7, id % 3])) >= 2),
l as (select distinct qid, 'link' as kind, src as id, cast(dst as varchar) as text from nm join v_link on id = src or id = dst), r as (select *, row_number() over (partition by qid, kind order by id, length(text), text) as rank from (select * from b union all select * from l))
select qid, kind, id, text, cast(rank as int) as rank from r where rank <= 5""",
    ("v_link",),
)
def graph_notes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    bridges = G.bridges(v.select("id", F.explode(F.array(F.col("id") % 50, F.col("id") % 7, F.col("id") % 3)).alias("doc")))
    links = view(spark, sf_dir, "v_link").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return C.graph_notes(v.select(F.col("id").alias("qid"), "id"), bridges, links)


@query(
    """with recursive b as (select src, dst from v_link union select dst, src from v_link), w as (select vec_id as id, vec_id as c from embeddings union select b.dst, w.c from w join b on b.src = w.id where w.c < b.dst),
m as (select id, min(c) as root from w group by id), n as (select id, dense_rank() over (order by root) - 1 as component, 'vector ' || id as name, id % 7 + 1 as mentions, label from m join embeddings on vec_id = id),
k as (select *, row_number() over (partition by component order by mentions desc, name) as r from n), c as (select component, count(*) as size, string_agg(name, ', ' order by r) filter (r <= 5) as concepts, min(name || ': mentioned ' || mentions || ' times') as own, count(distinct label) as parents, min(label) as label from k group by component),
o as (select label, count(*) as before from embeddings group by label)
select cast(component as int) as component, size, case when size = 1 then own else 'Cluster: ' || concepts end as summary, case when parents > 1 then 'fresh' when before = size then 'same' else 'carried' end as outcome from c join o using (label)""",
    ("v_link",),
)
def community_update(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("component"))
    members = v.select("id", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("name"), (F.col("id") % 7 + 1).alias("mentions"))
    return C.updated_communities(v.select("id", F.col("id").alias("ord")), view(spark, sf_dir, "v_link").select("src", "dst"), members, v)


@query(
    f"""with recursive {CHUNKS.replace(MARKDOWN, 'text')}, e as (select token from v_token where length(token) >= 8 group by token having count(distinct doc_id) between 2 and 50),
s as (select doc_id, unnest({SENTENCES}) as text, generate_subscripts({SENTENCES}, 1) as n from documents),
t as (select doc_id, n, unnest({TOKENS.format('text')}) as token, generate_subscripts({TOKENS.format('text')}, 1) as pos from s),
p as (select doc_id, token as source, lead(token) over (partition by doc_id, n order by pos) as target from t semi join e using (token)),
cc as (select doc_id, count(*) as k from al group by 1), pp as (select doc_id, count(*) as k from s group by 1), ee as (select doc_id, count(distinct token) as k from v_token semi join e using (token) group by 1), rr as (select doc_id, count(*) as k from p where target is not null and source <> target group by 1)
select d.doc_id, coalesce(cc.k, 0) as chunks, coalesce(pp.k, 0) as propositions, coalesce(ee.k, 0) as entities, coalesce(rr.k, 0) as relations from documents d left join cc using (doc_id) left join pp using (doc_id) left join ee using (doc_id) left join rr using (doc_id)""",
    ("v_token",),
)
def ingest_documents(spark, sf_dir):
    return C.ingested(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    """with b as (select *, coalesce(nullif(arxiv_id, ''), nullif(doi, ''), 'https://example.org/' || ord) as best from v_paper_raw)
select ord, case when regexp_matches(best, '^\\d{4}\\.\\d{4,5}(v\\d+)?$') then 'arxiv' when starts_with(best, '10.') then 'doi' else 'url' end as kind,
case when regexp_matches(best, '^\\d{4}\\.\\d{4,5}(v\\d+)?$') then 'https://arxiv.org/pdf/' || best when starts_with(best, '10.') then 'https://doi.org/' || best when starts_with(best, 'http') then best else best end as locator from b""",
    ("v_paper_raw",),
)
def read_paper_routes(spark, sf_dir):
    raw = view(spark, sf_dir, "v_paper_raw").withColumn("abstract", F.lit(""))
    best = F.coalesce(F.nullif("arxiv_id", F.lit("")), F.nullif("doi", F.lit("")), F.concat(F.lit("https://example.org/"), F.col("ord").cast("string")))
    return C.readable(raw, best).select("ord", "kind", "locator")
