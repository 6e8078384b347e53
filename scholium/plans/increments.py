"""Queries of what is kept and changed: model steps, indexes on disk, change logs, sessions, communities; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann
from ..operators import documents as D
from ..operators import flows as C
from ..operators import graph as G
from ..operators import linkage as L
from ..operators import models as M
from ..operators import search as H
from ..operators.communities import Communities
from ..operators.keywords import KeywordIndex
from ..sources.fixtures import rich, table, view
from ..streaming import jobs
from .catalogue import ORACLES, SEEDS, YEAR_NOW, query, ranked_sql
from .flows import WITHIN, _paper_sources
from .lineage import new_path, written
from .workflows import NAMED, _named, _resolved


@query(
    """select id, case when length(title) % 7 = 0 or length(title) % 5 = 0 then 5 else cast(greatest(0, least(10, length(title) - 10)) as int) end as llm_relevance,
case when length(title) % 7 = 0 then 'not scored' else length(title) || ' characters' end as llm_rationale from v_paper""",
    ("v_paper",),
)
def model_relevance(spark, sf_dir):
    """Papers judged by a function in the place of a model: answers that it leaves out, and scores that are no number, are 5."""
    return M.relevance(view(spark, sf_dir, "v_paper").select("id", "title", "abstract"), M.title_model)


def _propositions(spark, sf_dir):
    return M.propositions(D.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")), M.sentence_model)


@query()
def model_propositions(spark, sf_dir):
    return _propositions(spark, sf_dir)


@query()
def model_entities(spark, sf_dir):
    """Entities of the documents' sentences, each document's once."""
    return M.entities(D.propositions(table(spark, sf_dir, "documents").select("doc_id", "text")), M.keyword_model)[0]


@query()
def vector_index_topk(spark, sf_dir):
    """As ``vector_topk``, over an index whose probes find 95 % of the exact neighbours."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ann.search(ann.built(v, 15), v.where("id % 100 = 0"), 15).withColumnRenamed("id", "vec_id")


_indexes: dict[tuple[str, str], KeywordIndex] = {}


def _index(spark, sf_dir) -> KeywordIndex:
    """The keyword index of ``documents``, three batches compacted into one; built once in an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        index, docs = KeywordIndex(spark, most=2), table(spark, sf_dir, "documents").select("doc_id", "text")
        for k in range(3):
            index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k), k)
        _indexes[key] = index
    return _indexes[key]


@query(ORACLES["corpus_token_stats"])
def keyword_index_stats(spark, sf_dir):
    index = _index(spark, sf_dir)
    n = index.sizes()[0]
    return index.stats().select("token", "df", "uses", F.round(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@query(ORACLES["bm25_benchmark_topk"])
def keyword_index_topk(spark, sf_dir):
    hits = _index(spark, sf_dir).search(table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


@query(ORACLES["change_log_replay"])
def stream_change_log(spark, sf_dir):
    """The change log applied to a table of nodes as a stream, and all of it once more."""
    path = f"{sf_dir}/events.parquet"
    changes = lambda df: df.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "signup", "add").otherwise("merge").alias("op"), F.col("value").cast("string").alias("payload"))
    sync = jobs.ChangeSync(spark).run(changes(jobs._stream(spark, path)))
    sync.apply(changes(table(spark, sf_dir, "events")), "again")
    return sync.nodes().select("id", F.col("payload").cast("double").alias("value"), "mentions")


@query(
    """with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 0 else 1 end as opens, event_id from events),
s as (select *, sum(opens) over (partition by user_id order by ts, event_id) as k from e), g as (select user_id, min(ts) as a, max(ts) + interval 6 hour as b, count(*) as n from s group by user_id, k)
select user_id, strftime(a, '%Y-%m-%d %H:%M:%S') as start, strftime(b, '%Y-%m-%d %H:%M:%S') as "end", n from g where b <= (select max(ts) - interval 10 minute from events)"""
)
def stream_sessions(spark, sf_dir):
    found = jobs.session_stream(spark, f"{sf_dir}/events.parquet", "6 hours")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


@query()
def resolve_entities_in_order(spark, sf_dir):
    """As ``resolve_entities``, with entities that the batch itself founds among the candidates."""
    new, old = _named(spark, sf_dir)
    return L.resolved(new, old, threshold=0.3, name_overlap=0.2, ambiguous=0.25, within=True).select("ord", "name", "tier", "reason", "entity_id")


@query(
    """with recursive b as (select src, dst from v_link union select dst, src from v_link), w as (select vec_id as id, vec_id as c from embeddings union select b.dst, w.c from w join b on b.src = w.id where w.c < b.dst),
m as (select id, min(c) as component from w group by id), r as (select *, row_number() over (partition by component order by id % 7 desc, 'vector ' || id) as k from m)
select component, count(*) as size, string_agg('vector ' || id, '|' order by k) filter (k <= 5) as concepts from r group by component""",
    ("v_link",),
)
def incremental_communities(spark, sf_dir):
    """Vectors and their links in two batches."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    nodes = v.select("id", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).alias("mentions"))
    links, kept = view(spark, sf_dir, "v_link").select("src", "dst").persist(), Communities(spark, new_path(spark, "communities"))
    kept.add(nodes, links.where("(src + dst) % 2 = 0"), "even")
    kept.add(nodes.limit(0), links.where("(src + dst) % 2 = 1"), "odd")
    links.unpersist()
    return kept.communities().select("component", "size", "concepts")


#: Search with expansion: two hops a query, the nearest vectors to its best papers, ranking within all of these, and roots.
EXPANDED = (
    WITHIN.split("se as (select rr.*")[0]
    + """fd as (select rr.* from rr where relevance >= 5), jd as (select id, case when llm_relevance is null then 5 else cast(llm_relevance as int) end as relevance from v_paper),
ed as (select citing, cited, max(is_influential) as is_influential, max(is_methodology) as is_methodology from v_cite group by all), wy as (select citing as seed, cited as id, is_influential from ed union all select cited, citing, is_influential from ed),
s1 as (select name, id from (select *, row_number() over (partition by name order by relevance desc, id) as k from fd where relevance >= 6) where k <= 20),
n1 as (select distinct s1.name, wy.id from s1 join wy on wy.seed = s1.id where is_influential), f1 as (select name, id from (select *, row_number() over (partition by name order by id) as k from n1 anti join fd using (name, id)) where k <= 80),
g1 as (select name, id, relevance from f1 join jd using (id) where relevance >= 5), s2 as (select name, id from (select *, row_number() over (partition by name order by relevance desc, id) as k from g1 where relevance >= 6) where k <= 20),
n2 as (select distinct s2.name, wy.id from s2 join wy on wy.seed = s2.id), f2 as (select name, id from (select *, row_number() over (partition by name order by id) as k from n2 anti join fd using (name, id) anti join f1 using (name, id)) where k <= 40),
g2 as (select name, id, relevance from f2 join jd using (id) where relevance >= 5), vc as (select 's2:' || (vec_id + 1) as id, embedding::double[] as x from embeddings),
lk as (select name, id from (select *, row_number() over (partition by name order by relevance desc, id) as k from fd) where k <= 5),
ax as (select name, i, avg(v) as w from (select name, unnest(x) as v, generate_subscripts(x, 1) as i from lk join vc using (id)) group by all), ay as (select name, list(w order by i) as c from ax group by name),
nr as (select name, id, row_number() over (partition by name order by round(list_dot_product(x, c), 6) desc, id) as k from ay, vc where (name, id) not in (select name, id from lk)),
g3 as (select name, id, relevance from nr join jd using (id) where k <= 50 and relevance >= 5 and (name, id) not in (select name, id from fd union select name, id from f1 union select name, id from f2)),
al as (select name, id, relevance, 'found' as way from fd union all select *, 'hop1' from g1 union all select *, 'hop2' from g2 union all select *, 'recommended' from g3),
se as (select al.*, p.* exclude (id) from al join v_paper_rich p using (id)),"""
    + WITHIN.split("where relevance >= 5),", 1)[1].replace("ed as (select citing, cited, max(is_influential) as is_influential, max(is_methodology) as is_methodology from v_cite group by all),", "")
)
RANKED = (
    EXPANDED
    + "f as (select p.*" + ranked_sql(15).split("f as (select p.*")[1].replace("coalesce(influence, 0) as inf, coalesce(in_set, 0) as ins, least(1.0, coalesce(k, 0) / n) as author", "coalesce(inf, 0) as inf_, coalesce(ins, 0) as ins_, coalesce(author, 0) as author_").split("from v_paper_rich p left join")[0]
    + """ from se p left join ins using (name, id) left join inf using (name, id) left join au using (name, id)),
g as (select *, inf_ / greatest(max(inf_) over (partition by name), 1) as infn, ins_ / greatest(max(ins_) over (partition by name), 1) as insn from f),
im as (select name, id, relevance, way, round(0.55::double * relevance + 0.12::double * insn + 0.10::double * infn + 0.05::double * author_ + 0.08::double * least(vel / 100, 1) + 0.05::double * ven + 0.05::double * 0.3::double * sur, 4) as importance from g),
ou as (select * from (select *, row_number() over (partition by name order by importance desc, id) as rank from im) where rank <= 20)"""
)
ROOTS = """, sd as (select name, id from (select *, row_number() over (partition by name order by relevance desc, id) as k from ou) where k <= 15),
l1 as (select sd.name, ed.* from sd join (select *, row_number() over (partition by citing order by cited) as rn from ed) ed on ed.citing = sd.id where rn <= 120),
w1 as (select name, id from (select name, cited as id, row_number() over (partition by name order by count(*) desc, cited) as k from l1 where (name, cited) not in (select name, id from sd) group by name, cited) where k <= 50),
l2 as (select w1.name, ed.* from w1 join (select *, row_number() over (partition by citing order by cited) as rn from ed) ed on ed.citing = w1.id where rn <= 120),
ly as (select * from l1 union all select * from l2), c1 as (select name, citing as seed, cited as node from l1), c2 as (select c1.name, c1.seed, ly.cited as node from c1 join ly on ly.name = c1.name and ly.citing = c1.node),
cm as (select name, node, count(distinct seed) as k from (select * from c1 union all select * from c2) where node <> seed and (name, node) not in (select name, id from sd) group by all), ns as (select name, count(*) as n from sd group by name),
qu as (select name, cited as node, avg(is_influential::int) as i, avg(is_methodology::int) as m from ly group by all),
rt as (select name, node as id, round(k / n, 6) as convergence, round(0.5::double * k / n + 0.3::double * i + 0.2::double * m, 6) as score from cm join ns using (name) join qu using (name, node)),
rb as (select rt.* from (select *, row_number() over (partition by name order by score desc, id) as k from rt) rt join jd using (id) where rt.k <= 15 and jd.relevance >= 6),
rx as (select *, row_number() over (partition by name order by score desc, id) as rank from rb)
select name, id, convergence, score, cast(rank as int) as rank from rx where rank <= 5"""


def _searched(spark, sf_dir):
    whole = written(view(spark, sf_dir, "v_paper"), "whole")
    papers, plans = _paper_sources(spark, sf_dir, whole)
    given = whole.select("id", F.col("llm_relevance").cast("string").alias("model_score"))
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s2:"), (F.col("vec_id") + 1).cast("string")).alias("id"), "embedding")
    records, cites, judge = rich(whole), written(view(spark, sf_dir, "v_cite"), "cites"), lambda pairs: pairs.join(given, "id")
    return H.search(papers, plans, records, cites, view(spark, sf_dir, "v_author"), YEAR_NOW, judge, vectors), cites, records, judge


@query(RANKED + " select name, id, relevance, way, importance, cast(rank as int) as rank from ou", ("v_paper", "v_paper_rich", "v_cite", "v_author"))
def search_expanded(spark, sf_dir):
    """Search with two hops over citations and recommendations by vectors."""
    return _searched(spark, sf_dir)[0].withColumnRenamed("qid", "name")


@query(RANKED + ROOTS, ("v_paper", "v_paper_rich", "v_cite", "v_author"))
def search_roots(spark, sf_dir):
    """The roots of each query's results."""
    return H.roots(*_searched(spark, sf_dir)).withColumnRenamed("qid", "name")


# Entities: names that lead to them, and what was merged.


@query(f"with {NAMED}, kn as (select lower(trim(name)) as normalized_name, cast(min(id) as varchar) as entity_id from ol group by 1) select * from kn union all select key, min(entity_id) from rs where key not in (select normalized_name from kn) group by key")
def entity_aliases(spark, sf_dir):
    found, _, old = _resolved(spark, sf_dir)
    return L.aliases(found, old)


@query(
    f"""with {NAMED}, fo as (select entity_id, min(ord) as founder, arg_min(name, ord) as into_name from rs where reason = 'new' group by 1), na as (select cast(id as varchar) as entity_id, name as into_name from ol union all select entity_id, into_name from fo)
select ord, rs.name as merged_from_name, rs.entity_id as merged_into, na.into_name as merged_into_name, case when reason = 'new' then 'exact' else reason end as reason
from rs join na using (entity_id) left join fo using (entity_id) where reason <> 'new' or ord > founder"""
)
def entity_merge_log(spark, sf_dir):
    found, _, old = _resolved(spark, sf_dir)
    return L.merge_log(found, old)


@query(
    f"""with {SEEDS}, wy as (select citing as src, cited as dst, is_influential from v_cite union all select cited, citing, is_influential from v_cite),
h1 as (select dst as node, 1 as depth, max(is_influential) as influential, array_to_string(list_sort(list(distinct src)), ',') as parents from wy join p on src = p.id where dst not in (select id from p) group by 1 order by not max(is_influential), node limit 20),
k as (select id from p union select node from h1),
h2 as (select dst as node, 2 as depth, max(is_influential) as influential, array_to_string(list_sort(list(distinct src)), ',') as parents from wy join h1 on src = h1.node where dst not in (select id from k) group by 1 order by not max(is_influential), node limit 20)
select * from h1 union all select * from h2""",
    ("v_paper", "v_cite"),
)
def citation_hops_both(spark, sf_dir):
    """Hops over references and citations."""
    seeds = view(spark, sf_dir, "v_paper").orderBy(F.desc("citation_count"), "id").limit(15).select(F.col("id").alias("seed"))
    return G.hops(G.directed(view(spark, sf_dir, "v_cite"), "both"), seeds, 2, 20).select("node", "depth", "influential", F.array_join("parents", ",").alias("parents"))


@query(
    """with b as (select *, coalesce(nullif(arxiv_id, ''), nullif(doi, '')) as best, substr(sha256(cast(ord as varchar)), 1, 16) as doc_id from v_paper_raw)
select ord, case when regexp_matches(best, '^\\d{4}\\.\\d{4,5}(v\\d+)?$') then 'https://arxiv.org/pdf/' || best when starts_with(best, '10.') then 'https://doi.org/' || best
when ord % 2 = 0 then 'ingested/url/t_' || substr(doc_id, 1, 8) || '.md' else title end as locator from b""",
    ("v_paper_raw",),
)
def read_stored_notes(spark, sf_dir):
    """Papers without an identifier are read from their stored notes, where there is one."""
    raw = view(spark, sf_dir, "v_paper_raw").withColumn("doc_id", F.substring(F.sha2(F.col("ord").cast("string"), 256), 1, 16)).withColumn("abstract", F.lit(None).cast("string"))
    notes = raw.where("ord % 2 = 0").select("doc_id", F.concat(F.lit("ingested/url/t_"), F.substring("doc_id", 1, 8), F.lit(".md")).alias("relative_path"))
    best = F.coalesce(F.nullif("arxiv_id", F.lit("")), F.nullif("doi", F.lit("")))
    return C.readable(raw, best, notes).select("ord", "locator")
