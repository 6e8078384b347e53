"""Views over the given tables in the shape of the data model, for Spark and (as common table expressions) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.blocks import similar_pairs
from ..plans.lineage import numbered

#: Views that both engines read alike.
COMMON = {
    "v_paper": """select concat('s2:', cast(p_partkey as string)) as id, p_name as title, p_type as abstract, p_brand as venue,
       cast(year(min(l_shipdate)) as int) as year, count(*) as citation_count, p_partkey % 11 as llm_relevance
from part join lineitem on l_partkey = p_partkey group by p_partkey, p_name, p_type, p_brand""",
    "v_author": "select distinct concat('s2:', cast(l_partkey as string)) as id, concat('a', cast(l_suppkey as string)) as author_id from lineitem",
    "v_cite": """select concat('s2:', cast(a.l_partkey as string)) as citing, concat('s2:', cast(b.l_partkey as string)) as cited,
       a.l_returnflag = 'R' as is_influential, a.l_linestatus = 'O' as is_methodology
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber where a.l_partkey <> b.l_partkey""",
    "v_paper_raw": """select row_number() over (order by l_partkey, l_suppkey) as ord, concat('src', cast(l_suppkey % 3 as string)) as source,
       case when l_suppkey % 2 = 0 then concat('10.1000/', cast(l_partkey as string)) else '' end as doi,
       case when l_suppkey % 3 = 0 then concat('2401.', lpad(cast(l_partkey as string), 5, '0')) else '' end as arxiv_id,
       case when l_suppkey % 5 = 0 then upper(concat(p_name, ' no ', cast(p_partkey as string), '!')) else concat(p_name, ' no ', cast(p_partkey as string)) end as title,
       l_suppkey as citation_count
from (select distinct l_partkey, l_suppkey from lineitem) x join part on p_partkey = l_partkey""",
    "v_paper_rich": """select id, concat(title, case cast(substr(id, 4, 20) as bigint) % 7 when 0 then ': a survey' when 1 then ', the landscape' when 2 then ' reviewed' else '' end) as title, abstract,
       case cast(substr(id, 4, 20) as bigint) % 6 when 0 then 'Proc. NeurIPS' when 1 then 'IEEE Transactions on Pattern Analysis' when 2 then 'KDD' when 3 then '' else venue end as venue,
       year, citation_count, llm_relevance, cast(substr(id, 4, 20) as bigint) % 4 as n_sources from (V_PAPER) p""",
    "v_registry_event": """select event_id as seq, user_id as paper_id, case event_type when 'click' then 'shortlisted' when 'signup' then 'queued'
            when 'view' then 'ingesting' when 'purchase' then 'ingested' else 'failed' end as status, ts from events""",
    "v_vector": """select cast(vec_id as string) as id, embedding, case when vec_id % 2 = 0 then 'chunk' else 'proposition' end as kind,
       cast(vec_id % 50 as string) as doc_id, label as community_id from embeddings""",
}
RICH = COMMON["v_paper_rich"]
COMMON["v_paper_rich"] = COMMON["v_paper_rich"].replace("V_PAPER", COMMON["v_paper"])
LINK = 0.35
DUCK = {
    **COMMON,
    "v_link": f"""select a.vec_id as src, b.vec_id as dst, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as sim
from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) >= {LINK}""",
    "v_token": r"""select doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: length(x) > 2)) as token from documents""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts that come in few files, or in one large group of rows, are dealt to all cores, since what is done with them is work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() <= cores else df


def rich(papers: DataFrame) -> DataFrame:
    """``v_paper_rich`` of the rows of ``v_paper``, where these are there already."""
    return papers.sparkSession.sql(RICH.replace("(V_PAPER)", "{papers}"), papers=papers)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, over the tables of ``sf_dir``."""
    if name == "v_link":
        v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return similar_pairs(v, LINK).select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim")
    if name == "v_token":
        return X.unrolled(table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(X.tokens(F.col("text"))).alias("token")), "token")
    if name == "v_paper_raw":
        # Numbered by ranges of the same order, not in one task, and before the texts are made, which are then neither sampled nor sorted.
        columns, source = COMMON[name].replace("row_number() over (order by l_partkey, l_suppkey) as ord", "ord").split("\nfrom ")
        source = source.replace("from lineitem", "from {lineitem}").replace("join part", "join {part}")
        rows = spark.sql(f"select l_partkey, l_suppkey, p_partkey, p_name from {source}", lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))
        return spark.sql(f"{columns} from {{rows}}", rows=numbered(rows, ["l_partkey", "l_suppkey"], "ord"))
    sql = COMMON[name]
    frames = {t: table(spark, sf_dir, t) for t in ("part", "lineitem", "events", "embeddings") if t in sql}
    # Each name becomes a frame of this call, so that no temporary view outlives it or meets another's.
    for t in frames:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that sees the named views."""
    ctes = ", ".join(f"{n} as ({DUCK[n]})" for n in names)
    head = "with recursive " if "recursive" in sql[:20] else "with "
    body = sql.strip()
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{head}{ctes}, {body[len(start):]}"
    return f"{head}{ctes} {body}"
