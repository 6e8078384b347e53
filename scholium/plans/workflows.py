"""Registered queries of the knowledge graph, citation search, the registry and the streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import flows as C
from ..operators import graph as G
from ..operators import inference as I
from ..operators import linkage as L
from ..operators import papers as P
from ..operators import registry as R
from ..operators import retrieval as S
from ..sources import stored
from ..sources.fixtures import table, view
from ..streaming import jobs
from .catalogue import CHUNKS, MARKDOWN, ORACLES, markdown, query
from .lineage import new_path, numbered

EDGES = "ed as (select citing, cited, max(is_influential) as is_influential, max(is_methodology) as is_methodology from v_cite group by all)"


def _edges(spark, sf_dir):
    return P.single_edges(view(spark, sf_dir, "v_cite"))


# Citations.


@query(
    f"""with {EDGES}, w as (select citing as id, 'reference' as way, cited as other, is_influential, is_methodology, row_number() over (partition by citing order by cited) as rn from ed
union all select cited, 'citation', citing, is_influential, is_methodology, row_number() over (partition by cited order by citing) from ed) select id, way, other, is_influential, is_methodology from w where rn <= 1000""",
    ("v_cite",),
)
def edges_by_paper(spark, sf_dir):
    return P.edges_by_paper(_edges(spark, sf_dir))


@query(f"with {EDGES} select id, title, year, 'graph_expansion' as angle from v_paper where id in (select cited from ed where is_methodology and is_influential)", ("v_paper", "v_cite"))
def papers_by_id(spark, sf_dir):
    ids = _edges(spark, sf_dir).where("is_methodology and is_influential").select(F.col("cited").alias("id"))
    return P.papers_by_id(view(spark, sf_dir, "v_paper"), ids).select("id", "title", "year", F.element_at("search_angles", 1).alias("angle"))


MULTI_HOP = f"""with {EDGES}, p as (select id, cast(least(10, greatest(0, llm_relevance)) as int) as relevance from v_paper), res as (select id from p where relevance >= 8),
wy as (select citing as seed, cited as id, is_influential from ed union all select cited, citing, is_influential from ed),
s1 as (select id from p where relevance >= 8 order by relevance desc, id limit 20), n1 as (select distinct id from wy where is_influential and seed in (select id from s1)),
f1 as (select id from n1 where id not in (select id from res) order by id limit 80), g1 as (select id, 1 as hop, relevance from p where id in (select id from f1) and relevance >= 5),
s2 as (select id from g1 where relevance >= 6 order by relevance desc, id limit 20), n2 as (select distinct id from wy where seed in (select id from s2)),
f2 as (select id from n2 where id not in (select id from res) and id not in (select id from f1) order by id limit 40), g2 as (select id, 2 as hop, relevance from p where id in (select id from f2) and relevance >= 5)"""


def _expanded(spark, sf_dir):
    papers = view(spark, sf_dir, "v_paper").withColumn("relevance", F.col("llm_relevance"))
    found = papers.where("relevance >= 8").select("id", "relevance")
    return P.multi_hop(papers, _edges(spark, sf_dir), P.select_seeds(found), found, papers.select("id", F.col("llm_relevance").cast("string").alias("model_score")))


@query(MULTI_HOP + " select * from g1 union all select * from g2", ("v_paper", "v_cite"))
def multi_hop_expand(spark, sf_dir):
    return _expanded(spark, sf_dir)[0]


@query(
    MULTI_HOP + " " + " union all ".join(f"select {h} as hop, '{stage}' as stage, count(*) as n from {t}{h}" for h in (1, 2) for t, stage in (("s", "seeds"), ("n", "neighbours"), ("f", "new"), ("g", "approved"))),
    ("v_paper", "v_cite"),
)
def stage_funnel(spark, sf_dir):
    return _expanded(spark, sf_dir)[1]


LAYERS = f"""with {EDGES}, sd as (select id from v_paper order by llm_relevance desc, id limit 15), er as (select *, row_number() over (partition by citing order by cited) as rn from ed),
l1 as (select citing, cited, is_influential, is_methodology, 1 as hop from er where rn <= 120 and citing in (select id from sd)),
f1 as (select cited as id from l1 where cited not in (select id from sd) group by cited order by count(*) desc, cited limit 60),
ly as (select * from l1 union all select citing, cited, is_influential, is_methodology, 2 from er where rn <= 120 and citing in (select id from f1))"""


def _best(spark, sf_dir):
    return view(spark, sf_dir, "v_paper").select("id", F.col("llm_relevance").alias("relevance"))


@query(LAYERS + " select citing, cited, is_influential, is_methodology, hop from ly", ("v_paper", "v_cite"))
def backward_layers(spark, sf_dir):
    seeds = _best(spark, sf_dir).orderBy(F.desc("relevance"), "id").limit(15).select(F.col("id").alias("seed"))
    return P.backward_layers(_edges(spark, sf_dir), seeds).select("citing", "cited", "is_influential", "is_methodology", "hop")


@query(
    LAYERS
    + """, c1 as (select sd.id as seed, cited as node from sd join ly on citing = sd.id), c as (select * from c1 union select c1.seed, ly.cited from c1 join ly on ly.citing = c1.node),
m as (select node, count(distinct seed) / 15::double as convergence from c where node <> seed and node not in (select id from sd) group by node),
q as (select cited, avg(is_influential::int) as i, avg(is_methodology::int) as mm from ly group by cited),
t as (select node as id, round(convergence, 6) as convergence, round(0.5::double * convergence + 0.3::double * i + 0.2::double * q.mm, 6) as score from m join q on q.cited = node order by score desc, id limit 15)
select t.id, title, year, convergence, score from t join v_paper p on p.id = t.id where case when llm_relevance = 0 then 5 else llm_relevance end >= 6 order by score desc, t.id limit 5""",
    ("v_paper", "v_cite"),
)
def find_roots(spark, sf_dir):
    """Judged by the given relevance; papers of relevance 0 count as not judged."""
    papers = view(spark, sf_dir, "v_paper")
    judged = papers.where("llm_relevance > 0").select("id", F.col("llm_relevance").alias("judge"))
    return P.find_roots(papers, _edges(spark, sf_dir), _best(spark, sf_dir), judged).select("id", "title", "year", "convergence", "score")


@query(
    f"""with {EDGES}, sd as (select id from v_paper order by citation_count desc, id limit 5), wy as (select citing as src, cited as dst, is_influential from ed union all select cited, citing, is_influential from ed),
gr as (select dst as id from wy where is_influential and src in (select id from sd) and dst not in (select id from sd) group by dst order by dst limit 15),
vc as (select 's2:' || (vec_id + 1) as id, embedding::double[] as x from embeddings), lk as (select id from vc where id in (select id from gr) order by id limit 5),
ax as (select i, avg(v) as w from (select unnest(x) as v, generate_subscripts(x, 1) as i from vc where id in (select id from lk)) group by i),
se as (select id, round(sum(v * w), 6) as score from (select id, unnest(x) as v, generate_subscripts(x, 1) as i from vc) join ax using (i) where id not in (select id from lk) group by id order by score desc, id limit 20),
al as (select id, 'graph' as way from gr union all select id, 'semantic' from se) select id, min(way) as way from al where id not in (select id from sd) group by id order by id limit 50""",
    ("v_paper", "v_cite"),
)
def hybrid_expand(spark, sf_dir):
    seeds = P.most_cited(view(spark, sf_dir, "v_paper"), 5).withColumnRenamed("id", "seed")
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s2:"), (F.col("vec_id") + 1).cast("string")).alias("id"), "embedding")
    return P.hybrid_expand(_edges(spark, sf_dir), vectors, seeds)


@query("select cast(case when llm_relevance = 0 then 5 else llm_relevance end as int) as relevance, count(*) as n from v_paper where case when llm_relevance = 0 then 5 else llm_relevance end >= 5 group by 1", ("v_paper",))
def score_histogram(spark, sf_dir):
    papers = view(spark, sf_dir, "v_paper").select("id", "llm_relevance")
    kept = P.relevant(papers.select("id"), papers.where("llm_relevance > 0").select("id", F.col("llm_relevance").cast("string").alias("model_score")))
    return kept.groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))


# Documents.


@query(
    """with m as (select id, case when cast(substr(id, 4, 20) as bigint) % 5 = 0 then '' else title end as title, venue, year, case when cast(substr(id, 4, 20) as bigint) % 3 = 0 then '' else abstract end as abstract from v_paper_rich),
c as (select id, concat_ws(chr(10), '# ' || title, 'Venue: ' || venue, 'Year: ' || year, chr(10) || '## Abstract' || chr(10) || abstract) as content from m where title <> '' or abstract <> '')
select id, content, substr(sha256(content), 1, 16) as doc_id from c""",
    ("v_paper_rich",),
)
def metadata_documents(spark, sf_dir):
    nth = F.substring("id", 4, 20).cast("long")
    papers = view(spark, sf_dir, "v_paper_rich")
    return D.from_metadata(papers.withColumn("title", F.when(nth % 5 == 0, "").otherwise(F.col("title"))).withColumn("abstract", F.when(nth % 3 == 0, "").otherwise(F.col("abstract"))))


TOKENS = r"list_filter(string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda x: length(x) > 2)"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 20)"


@query(
    f"""with recursive {CHUNKS}, pr as (select doc_id, unnest({SENTENCES.format('text')}) as text, generate_subscripts({SENTENCES.format('text')}, 1) as n from md),
pw as (select distinct doc_id, n, unnest({TOKENS.format('text')}) as w from pr), cw as (select distinct doc_id, i, unnest({TOKENS.format('text')}) as w from al),
cn as (select doc_id, i, count(*) as k from cw group by all), sh as (select doc_id, n, i, count(*) as shared from pw join cw using (doc_id, w) group by all),
ok as (select doc_id, i from sh join cn using (doc_id, i) where shared >= greatest(3.0, 0.05::double * k)),
fb as (select doc_id, i, unnest({SENTENCES.format('text')}) as s from al where (doc_id, i) not in (select (doc_id, i) from ok))
select doc_id || '_c' || i as chunk_id, 'assigned' as way, count(*) as n from ok group by doc_id, i union all select doc_id || '_c' || i, 'sentence', count(*) from fb group by doc_id, i"""
)
def proposition_assignment(spark, sf_dir):
    docs = markdown(spark, sf_dir)
    got = D.chunk_propositions(D.propositions(docs), D.chunks(docs))
    return got.groupBy("chunk_id", "way").agg(F.count(F.lit(1)).alias("n"))


CONTENT = "case when doc_id % 2 = 0 then chr(10) || '# Doc ' || doc_id || chr(10) else '' end || case when doc_id % 3 = 0 then 'ABSTRACT: ' else '' end || text"


@query(
    f"""with c as (select doc_id, {CONTENT} as content from documents where text is not null), a as (select *, position('abstract:' in lower(content)) as mark from c)
select doc_id, case when doc_id % 2 = 0 then 'Doc ' || doc_id end as title,
md5(regexp_replace(substr(case when mark > 0 then regexp_replace(substr(content, mark + 9, 1000), '^\\s+|\\s+$', '', 'g') else content end, 1, 500), '^\\s+|\\s+$', '', 'g')) as abstract_md5,
substr(md5(cast(doc_id as varchar)), 1, 11) as video, case when doc_id % 4 = 0 then content else 'About ' || doc_id || '.' || chr(10) || chr(10) || content end as prefixed, cast(greatest(2, least(10, 2 * (doc_id % 7))) as bigint) as size from a"""
)
def document_scalars(spark, sf_dir):
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    content = F.concat(F.when(i % 2 == 0, F.concat(F.lit("\n# Doc "), i.cast("string"), F.lit("\n"))).otherwise(""), F.when(i % 3 == 0, "ABSTRACT: ").otherwise(""), F.col("text"))
    docs = docs.select("doc_id", content.alias("content"))
    url = F.concat(F.lit("https://youtu.be/"), F.substring(F.md5(i.cast("string").cast("binary")), 1, 11))
    prefix = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("About "), i.cast("string")))
    return docs.select("doc_id", X.title_of(F.col("content")).alias("title"), F.md5(X.abstract_of(F.col("content")).cast("binary")).alias("abstract_md5"), X.video_id(url).alias("video"), X.with_context(prefix, F.col("content")).alias("prefixed"), X.node_size(i % 7).alias("size"))


@query()
def cleaned_documents(spark, sf_dir):
    """Without boilerplate above and below, and of long ones the key sections only; the rules have hand-written tests."""
    measures = X.bound(X.key_sections(X.strip_boilerplate(F.col("text"))), lambda x: F.struct(F.length(x).cast("long").alias("n_chars"), F.md5(x.cast("binary")).alias("text_md5")))
    return markdown(spark, sf_dir).select("doc_id", measures.alias("m")).select("doc_id", "m.n_chars", "m.text_md5")


@query(f"select doc_id, count(*) as propositions from (select substr(sha256(cast(doc_id as varchar)), 1, 16) as doc_id, unnest({SENTENCES.format('text')}) as s from documents where length(trim(text, ' ')) >= 50) group by doc_id")
def rebuild_corpus(spark, sf_dir):
    """Everything derived again from stored notes: written by source type, read back, notes of 50 characters or more ingested."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "vault")
    rows = docs.select(X.content_id(F.col("doc_id").cast("string")).alias("doc_id"), F.lit("t").alias("title"), F.col("source").alias("source_type"), F.lit("").alias("source_url"), F.col("text").alias("content"))
    stored.write_notes(stored.notes(rows), path)
    again = stored.read_notes(spark, path).select("doc_id", F.col("content").alias("text"))
    return D.propositions(again).groupBy("doc_id").agg(F.count(F.lit(1)).alias("propositions"))


# Entities and the graph.


@query(
    """with e as (select id, case cast(substr(id, 4, 20) as bigint) % 8 when 0 then 'The Model' when 1 then 'Table ' || cast(substr(id, 4, 20) as bigint) when 2 then 'ab' when 3 then 'Appendix' else title end as name, abstract from v_paper),
d as (select id, name, case cast(substr(id, 4, 20) as bigint) % 5 when 0 then ' ' when 1 then upper(name) else abstract end as description from e)
select id, length(name) >= 3 and lower(name) not in ('the model', 'appendix') and not regexp_matches(lower(name), '^(section|table|figure|equation)\\s*\\d+') and trim(description) <> '' and lower(description) <> lower(name) as valid from d""",
    ("v_paper",),
)
def entity_validity(spark, sf_dir):
    n = F.substring("id", 4, 20).cast("long")
    name = F.when(n % 8 == 0, "The Model").when(n % 8 == 1, F.concat(F.lit("Table "), n.cast("string"))).when(n % 8 == 2, "ab").when(n % 8 == 3, "Appendix").otherwise(F.col("title"))
    rows = view(spark, sf_dir, "v_paper").select("id", name.alias("name"), F.when(n % 5 == 0, " ").when(n % 5 == 1, F.upper(name)).otherwise(F.col("abstract")).alias("description"))
    return rows.select("id", I.valid_entity(F.col("name"), F.col("description")).alias("valid"))


ENTITIES = ORACLES["entity_merge"]


@query(f"select name, confidence from ({ENTITIES}) where confidence >= 2 order by confidence desc, name limit 100")
def entities_by_confidence(spark, sf_dir):
    """The hundred most certain: a report."""
    return L.entities(table(spark, sf_dir, "documents"), 2, 50).where("confidence >= 2").orderBy(F.desc("confidence"), "name").limit(100).select("name", "confidence")


@query("with c as (select label as component, count(*) as size, label % 4 = 0 as dirty, count(*) filter (where vec_id % 3 = 0) as size_at_last_summary from embeddings group by label) select component, size from c where dirty or (size_at_last_summary > 0 and size > 2 * size_at_last_summary)")
def stale_communities(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("component")).agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("vec_id") % 3 == 0).cast("int")).alias("size_at_last_summary"))
    return G.stale(c.withColumn("dirty", F.col("component") % 4 == 0)).select("component", "size")


@query(
    f"""with {EDGES}, al as (select lower(trim(title)) as key, min(id) as id from v_paper group by 1), rl as (select lower(trim(a.title)) as s, lower(trim(b.title)) as t, 'cites' as relation_type from ed join v_paper a on a.id = citing join v_paper b on b.id = cited)
select distinct x.id as source_id, y.id as target_id, relation_type from rl join al x on x.key = s join al y on y.key = t where x.id <> y.id and (x.id, y.id) not in (select (citing, cited) from ed where is_influential)""",
    ("v_paper", "v_cite"),
)
def new_relationships(spark, sf_dir):
    papers, edges = view(spark, sf_dir, "v_paper"), _edges(spark, sf_dir)
    of = lambda end, name: papers.select(F.col("id").alias(end), F.concat(F.lit(" "), F.upper("title")).alias(name))
    rows = edges.join(of("citing", "source_name"), "citing").join(of("cited", "target_name"), "cited").withColumn("relation_type", F.lit("cites"))
    names = papers.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.min("id").alias("id"))
    known = edges.where("is_influential").select(F.col("citing").alias("source_id"), F.col("cited").alias("target_id"), F.lit("cites").alias("relation_type"))
    return L.new_relations(rows, names, known)


@query("select n.vec_id from embeddings n where n.vec_id % 5 = 0 and exists (select 1 from embeddings o where o.vec_id % 5 <> 0 and round(list_dot_product(n.embedding::double[], o.embedding::double[]), 6) >= 0.35)")
def near_duplicate_chunks(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return L.repeated_vectors(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 0.35).select(F.col("id").alias("vec_id"))


@query("with b as (select p_name as id, count(distinct p_brand) as n_docs from part group by 1 having count(distinct p_brand) >= 2), e as (select p_name as id, count(*) as mentions, min(p_type) as type from part where p_size > 5 group by 1) select id, n_docs, mentions, type from b join e using (id)")
def bridge_details(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    found = G.bridges(parts.select(F.col("p_name").alias("id"), F.col("p_brand").alias("doc"))).select("id", F.size("docs").cast("long").alias("n_docs"))
    return found.join(parts.where("p_size > 5").groupBy(F.col("p_name").alias("id")).agg(F.count(F.lit(1)).alias("mentions"), F.min("p_type").alias("type")), "id")


@query(
    """with r as (select src as source_id, dst as target_id, a.label as component, row_number() over (partition by a.label order by src, dst) as rank from v_link join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst where a.label = b.label)
select component, source_id, target_id, cast(rank as int) as rank from r where rank <= 20""",
    ("v_link",),
)
def community_relations(spark, sf_dir):
    links = view(spark, sf_dir, "v_link").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("links").alias("relation_type"))
    return G.community_relations(links, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("component"))).select("component", "source_id", "target_id", "rank")


#: Entities with names, some shared, some vague, and vectors; every fifth is new.
NAMED = """nm as (select vec_id as id, case when vec_id % 3 = 0 then p_name when vec_id % 11 = 1 then 'aa' || (vec_id % 7) else p_name || ' ' || vec_id end as name, cast(label as varchar) as type, embedding::double[] as x, p_type as description from embeddings join part on p_partkey = vec_id + 1),
nw as (select id as ord, lower(trim(name)) as key, * from nm where id % 5 = 0), ol as (select * from nm where id % 5 <> 0), xa as (select lower(trim(name)) as key, min(id) as exact from ol group by 1),
fk as (select key, min(ord) as ord from nw group by key), op as (select nw.* from fk join nw using (key, ord) where key not in (select key from xa)),
ch as (select ord, c, count(*) as k from (select ord, unnest(string_split(lower(name), '')) as c from op) group by all), en as (select ord, abs(sum(-(k / t) * log2(k / t))) as e from ch join (select ord, sum(k) as t from ch group by ord) using (ord) group by ord),
vg as (select op.*, e < 1.5 or length(name) < 6 as vague from op join en using (ord)),
sm as (select v.ord, o.id as old_id, round(list_dot_product(v.x, o.x), 6) as sim, v.vague, v.name as na, o.name as nb, v.type = o.type or v.type = 'concept' as typed from vg v, ol o where v.ord <> o.id),
rk as (select *, row_number() over (partition by ord order by sim desc, old_id) as rn from sm),
gr as (select *, list_distinct(list_transform(range(1, length(na) - 1), lambda i: substr(lower(na), i, 3))) as ga, list_distinct(list_transform(range(1, length(nb) - 1), lambda i: substr(lower(nb), i, 3))) as gb from rk where rn <= 5 and not vague and sim >= 0.9::double * 0.3::double and typed),
jc as (select *, case when len(list_distinct(ga || gb)) = 0 then 0 else len(list_intersect(ga, gb)) / len(list_distinct(ga || gb)) end as j from gr),
bd as (select *, case when sim >= 0.3 and j >= 0.2 then 'embedding' when sim >= 0.95::double * 0.3::double then 'gray' end as reason from jc), b1 as (select *, row_number() over (partition by ord order by rn) as f from bd where reason is not null),
fd as (select ord, old_id, reason from b1 where f = 1 and (reason = 'embedding' or j >= 0.5) union all select ord, old_id, 'ambiguous' from rk where vague and rn = 1 and sim > 0.25),
rs as (select nw.ord, nw.name, nw.key, case when exact is not null then 1 when vague then 3 else 2 end as tier, case when exact is not null then 'exact' else coalesce(reason, 'new') end as reason, coalesce(cast(exact as varchar), cast(old_id as varchar), 'new:' || nw.key) as entity_id
      from nw left join xa using (key) left join fk on fk.key = nw.key left join vg on vg.ord = fk.ord left join fd on fd.ord = fk.ord)"""


def _named(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("vec_id"), "p_name", "p_type")
    i = F.col("vec_id")
    name = F.when(i % 3 == 0, F.col("p_name")).when(i % 11 == 1, F.concat(F.lit("aa"), (i % 7).cast("string"))).otherwise(F.concat_ws(" ", "p_name", i.cast("string")))
    v = table(spark, sf_dir, "embeddings").join(parts, "vec_id").select(i.alias("id"), name.alias("name"), F.col("label").cast("string").alias("type"), "embedding", F.col("p_type").alias("description"))
    return v.where("id % 5 = 0").withColumnRenamed("id", "ord"), v.where("id % 5 <> 0")


def _resolved(spark, sf_dir):
    new, old = _named(spark, sf_dir)
    return L.resolved(new, old, threshold=0.3, name_overlap=0.2, ambiguous=0.25), new, old


@query(f"with {NAMED} select ord, name, cast(tier as int) as tier, reason, entity_id from rs")
def resolve_entities(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("ord", "name", "tier", "reason", "entity_id")


@query(
    f"""with {NAMED}, al as (select cast(id as varchar) as entity_id, id as ord, description, type, 1 as mentions, id % 50 as doc, 0 as old from ol union all select entity_id, rs.ord, description, type, 1, rs.ord % 50, 1 from rs join nw using (ord))
select entity_id, count(*) as mentions, array_to_string(list_sort(list(distinct doc)), ',') as docs, arg_max(description, (length(description), -(old * 1000000 + ord))) as description, arg_min(type, old * 1000000 + ord) as type from al group by entity_id"""
)
def merged_entities(spark, sf_dir):
    found, new, old = _resolved(spark, sf_dir)
    row = lambda df, entity, ord_: df.select(entity.cast("string").alias("entity_id"), ord_.alias("ord"), "description", "type", F.lit(1).alias("mentions"), F.array(F.col("doc")).alias("docs"))
    rows = row(old.withColumn("doc", F.col("id") % 50), F.col("id"), F.col("id")).unionByName(row(new.join(found.select("ord", "entity_id"), "ord").withColumn("doc", F.col("ord") % 50), F.col("entity_id"), F.col("ord") + 1_000_000_000))
    return L.merged(rows).select("entity_id", "mentions", F.array_join("docs", ",").alias("docs"), "description", "type")


@query(
    """with c as (select citing, cited, count(*) as n, arg_min(case when is_influential then 'influential' else 'plain' end, k) as description from (select *, row_number() over (order by citing, cited, is_influential, is_methodology) as k from v_cite) group by all)
select citing as source_id, cited as target_id, 1.0::double + 0.5::double * (n - 1) as weight, description from c""",
    ("v_cite",),
)
def described_relations(spark, sf_dir):
    """The first row, by its own values, describes a relation."""
    rows = view(spark, sf_dir, "v_cite").select(F.col("citing").alias("source_id"), F.col("cited").alias("target_id"), F.lit("cites").alias("relation_type"), F.when(F.col("is_influential"), "influential").otherwise("plain").alias("description"), F.lit(0).alias("doc_id"), F.struct("is_influential", "is_methodology").alias("ord"))
    return L.upserted(rows).select("source_id", "target_id", "weight", "description")


@query(
    """with d as (select vec_id as id, list_distinct([vec_id % 50, vec_id % 7]) as docs, label from embeddings), p as (select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by a order by sim desc, b) as rn from p), lt as (select distinct least(a, b) as a, greatest(a, b) as b, sim from r join d x on x.id = a join d y on y.id = b where rn <= 5 and sim >= 0.3 and not list_has_any(x.docs, y.docs))
select 'e' || src as src, 'e' || dst as dst, 'RELATES' as kind, sim as weight from v_link union all select 'e' || id, 'c' || label, 'MEMBER_OF', 1.0 from d union all select 'e' || id, 'b' || id, 'IS_BRIDGE', cast(len(docs) as double) from d where len(docs) >= 2
union all select 'e' || a, 'e' || b, 'LATENT_CONNECTION', sim from lt""",
    ("v_link",),
)
def property_graph_edges(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.array_distinct(F.array(F.col("vec_id") % 50, F.col("vec_id") % 7)).alias("docs"), F.col("label").alias("component"))
    links = view(spark, sf_dir, "v_link").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("sim").alias("weight"))
    bridges = G.bridges(v.select("id", F.explode("docs").alias("doc")))
    return stored.exported_property_graph(v.select("id", "component"), links, bridges, G.latent_links(v.select("id", "embedding", "docs"), 6, 0.3))


@query(
    """select 'entities' as what, (select count(distinct p_name) from part) as n union all select 'relationships', (select count(*) from (select distinct citing, cited from v_cite)) union all select 'communities', (select count(distinct label) from embeddings)
union all select 'bridges', (select count(*) from (select p_name from part group by 1 having count(distinct p_brand) >= 2)) union all select 'latent', (select count(*) from v_link) union all select 'documents', (select count(*) from documents)""",
    ("v_cite", "v_link"),
)
def knowledge_stats(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    counted = {
        "entities": parts.select("p_name").distinct(), "relationships": _edges(spark, sf_dir), "communities": table(spark, sf_dir, "embeddings").select("label").distinct(),
        "bridges": G.bridges(parts.select(F.col("p_name").alias("id"), F.col("p_brand").alias("doc"))), "latent": view(spark, sf_dir, "v_link"), "documents": table(spark, sf_dir, "documents"),
    }
    out = None
    for what, df in counted.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select community_id as workspace, count(*) filter (where kind = 'chunk') as chunks, count(*) filter (where kind = 'proposition') as propositions from v_vector group by 1", ("v_vector",))
def index_stats(spark, sf_dir):
    v = view(spark, sf_dir, "v_vector").groupBy(F.col("community_id").alias("workspace")).pivot("kind", ["chunk", "proposition"]).count()
    return v.select("workspace", F.coalesce("chunk", F.lit(0)).alias("chunks"), F.coalesce("proposition", F.lit(0)).alias("propositions"))


# Chat.


CHAT = f"""with m as (select *, row_number() over (partition by conv_id order by turn) as nth from conversations),
aq as (select a.conv_id || ':' || a.turn as qid, a.conv_id, a.turn, case when a.nth >= 3 then (select string_agg(b.text, ' ' order by b.turn) from m b where b.conv_id = a.conv_id and b.nth between a.nth - 2 and a.nth and b.role = 'user') else a.text end as query from m a where a.role = 'user'),
ck as (select 'c' || doc_id as id, doc_id, text from documents), pp as (select doc_id || '_p' || (n - 1) as id, doc_id, text from (select doc_id, unnest({SENTENCES.format('text')}) as text, generate_subscripts({SENTENCES.format('text')}, 1) as n from documents)),
ts as (select 'q' as what, qid as id, unnest({TOKENS.format('query')}) as token from aq union all select 'c', id, unnest({TOKENS.format('text')}) from ck union all select 'p', id, unnest({TOKENS.format('text')}) from pp),
ce as (select what, id, cast(('0x' || substr(md5(token), 1, 8))::bigint % 256 as int) as i, count(*) as n from ts group by all), nr as (select what, id, sqrt(sum(n * n)) as norm from ce group by all), em as (select what, id, i, n / norm as x from ce join nr using (what, id)),
sm as (select q.id as qid, e.what, e.id, round(sum(q.x * e.x), 6) as sim from em q join em e on q.what = 'q' and e.what <> 'q' and q.i = e.i group by all),
ns as (select *, row_number() over (partition by qid, what order by sim desc, id) as k from sm), nk as (select *, row_number() over (partition by qid order by sim desc, id) as rank from ns where k <= case what when 'c' then 15 else 20 end),
tc as (select id, token, count(*) as tf from ts where what = 'c' group by all), dl as (select ck.id, coalesce(sum(tf), 0) as dl from ck left join tc using (id) group by ck.id), av as (select count(*) as n, avg(dl) as avgdl from dl), df as (select token, count(*) as df from tc group by 1),
qt as (select id as qid, token, count(*) as times from ts where what = 'q' group by all),
bs as (select qid, id, sum(times * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / greatest(avgdl, 1)))) as score from qt join tc using (token) join df using (token) join dl using (id), av group by all),
bk as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from bs where score > 0),
un as (select qid, id, (case what when 'p' then 1.3::double else 1.0::double end) / (60 + rank) as part from nk union all select qid, id, 1.0::double / (60 + rank) from bk where rank <= 15), fu as (select qid, id, sum(part) as rrf from un group by all),
kn as (select id, doc_id, false as p from ck union all select id, doc_id, true from pp), dv as (select *, row_number() over (partition by qid, doc_id order by round(rrf, 9) desc, id) as in_doc from fu join kn using (id)),
fd as (select *, row_number() over (partition by qid order by round(rrf, 9) desc, id) as rank from dv where p or in_doc = 1)"""


@query(CHAT + " select conv_id, turn, count(*) filter (where p) as n_facts, count(*) filter (where not p) as n_passages, string_agg(id, ' ' order by rank) filter (where rank <= 10) as sources from fd join aq using (qid) where rank <= 35 group by all")
def chat_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), "doc_id", "text")
    out = C.chat_context(table(spark, sf_dir, "conversations"), chunks, D.propositions(docs).select(F.col("prop_id").alias("id"), "doc_id", "text"), n_facts=35, n_passages=35).where("sources is not null")
    count = lambda c, mark: F.when(F.col(c) == "", 0).otherwise(F.size(F.regexp_extract_all(c, F.lit(mark), F.lit(0)))).cast("long")
    return out.select("conv_id", "turn", count("facts", r"(?:^|\n\n)\[\d+\] ").alias("n_facts"), count("passages", r"(?:^|\n\n)\[\d+\]\n").alias("n_passages"), F.array_join("sources.id", " ").alias("sources"))


# The registry and the streams.


@query(
    """with r as (select 'p' || ord as paper_id, doi, arxiv_id from v_paper_raw where ord % 3 = 0), i as (select paper_id, doi as identifier from r where doi <> '' union select paper_id, arxiv_id from r where arxiv_id <> ''),
f as (select identifier, min(paper_id) as found from i group by 1), a as (select distinct identifier from (select doi as identifier from v_paper_raw union select arxiv_id from v_paper_raw) where identifier <> '')
select identifier, coalesce(found, 'manual:' || identifier) as paper_id, case when found is null then 'registered' else 'requeued' end as outcome from a left join f using (identifier)""",
    ("v_paper_raw",),
)
def register_or_requeue(spark, sf_dir):
    """A third of the records are registered; every identifier is asked for."""
    raw = view(spark, sf_dir, "v_paper_raw")
    asked = raw.select(F.explode(F.array("doi", "arxiv_id")).alias("identifier")).where("identifier <> ''")
    return R.register_or_requeue(asked, raw.where("ord % 3 = 0").select(F.concat(F.lit("p"), F.col("ord").cast("string")).alias("paper_id"), "doi", "arxiv_id"))


STATES = """with e as (select *, last_value(case when status <> 'queued' then status end ignore nulls) over (partition by paper_id order by seq rows between unbounded preceding and current row) as state from v_registry_event),
g as (select *, status = 'queued' and coalesce(state in ('ingesting', 'ingested'), false) as refuse from e)
select paper_id, arg_max(status, seq) filter (where not refuse) as status, count(*) filter (where refuse) as refused from g group by paper_id"""


@query(
    f"select paper_id, status, row_number() over (order by list_position(['ingesting', 'queued', 'ingested', 'shortlisted', 'failed'], status), paper_id) as place from ({STATES})",
    ("v_registry_event",),
)
def registry_by_status(spark, sf_dir):
    """The registry in its order of statuses, numbered by ranges."""
    place = F.array_position(F.array(*map(F.lit, R.ORDER)), F.col("status"))
    return numbered(R.states(view(spark, sf_dir, "v_registry_event")).withColumn("at", place), ["at", "paper_id"], "place").select("paper_id", "status", "place")


@query(
    "select ord, case when ord % 4 = 0 then 'k' || ord when arxiv_id <> '' then 'ARXIV:' || arxiv_id end as key from v_paper_raw", ("v_paper_raw",)
)
def citation_keys(spark, sf_dir):
    raw = view(spark, sf_dir, "v_paper_raw")
    return raw.select("ord", X.citation_key(F.when(F.col("ord") % 4 == 0, F.concat(F.lit("s2:k"), F.col("ord").cast("string"))).otherwise("manual"), F.concat("arxiv_id", F.when(F.col("arxiv_id") != "", "v2").otherwise(""))).alias("key"))


@query("select vec_id, round(list_dot_product(embedding::double[], embedding::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * 3), 6) as scaled from embeddings")
def unit_vectors(spark, sf_dir):
    """Vectors thrice as long are brought to length one; their product with the given ones."""
    v = table(spark, sf_dir, "embeddings").withColumn("long", F.transform("embedding", lambda x: x.cast("double") * 3))
    return v.select("vec_id", F.round(X.dot(X.unit(F.col("long")), F.col("embedding")) / 3, 6).alias("scaled"))


@query(STATES, ("v_registry_event",))
def registry_states(spark, sf_dir):
    return R.states(view(spark, sf_dir, "v_registry_event"))


@query(STATES, ("v_registry_event",))
def stream_states(spark, sf_dir):
    return jobs.state_stream(spark, f"{sf_dir}/events.parquet")


@query("select distinct user_id from events")
def stream_dedup(spark, sf_dir):
    return jobs.dedup_stream(spark, f"{sf_dir}/events.parquet", "user_id")


@query("with w as (select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all) select cast(start as varchar) as start, event_type, n from w where start + interval 1 hour <= (select max(ts) - interval 10 minute from events)")
def stream_windows(spark, sf_dir):
    return jobs.windowed_stream(spark, f"{sf_dir}/events.parquet").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("select token, count(distinct doc_id) as df, count(*) as uses from v_token group by token", ("v_token",))
def stream_index(spark, sf_dir):
    return jobs.Ingest(spark).run(f"{sf_dir}/documents.parquet").tokens()


@query("select doc_id, case when text is null then 'failed' else 'ingested' end as status from documents")
def stream_ingest(spark, sf_dir):
    return jobs.Ingest(spark).run(f"{sf_dir}/documents.parquet").registry().select("doc_id", "status")
