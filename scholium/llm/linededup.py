"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

A line is its trimmed text, known by two hashes and its length. Lines that occur often enough get a HyperLogLog sketch of
their sites; sketches merge by aggregation. Where an estimate lies near the threshold, distinct sites are counted exactly. A
line on ``min_sites`` sites or more is boilerplate: it stays in the row with the smallest id that has it and leaves every
other row, so that no line vanishes from the corpus and one copy of a widely copied text stays whole.

Nulls: a null text stays null; a null site counts as no site; a row without an id keeps all its lines. Blank lines are
neither counted nor removed. A text that loses all its lines is empty, and its row stays. Repeated rows are treated alike.
Empty tables give empty results; other columns pass through unchanged, whatever their names. Lines of equal text are equal, so
there are no ties; very long lines are known by their hashes and length like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import free

#: Production parameters: sites that make a line boilerplate, the sketch's size (relative error about 1.04 / 2**(k/2)), and
#: the share around the threshold within which estimates are not trusted (over five standard errors).
MIN_SITES, LG_K, BAND = 10, 12, 0.1


def line_key(line: Column) -> Column:
    """A line's identity: 160 bits from two hash functions and the length."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"), F.length(line).alias("n"))


def lines(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, source, h, g, n)``: one for each line that is not blank."""
    split = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return split.where("line <> ''").select("doc_id", "source", line_key(F.col("line")).alias("k")).select("doc_id", "source", "k.*")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows ``(h, g, n, first_doc)`` of the lines on ``min_sites`` sites or more."""
    all_lines = lines(docs)
    # A line on so many sites occurs at least that often: only such lines need a sketch.
    often = all_lines.groupBy("h", "g", "n").agg(F.count("source").alias("uses"), F.min("doc_id").alias("first_doc")).where(F.col("uses") >= min_sites)
    often = written(often.drop("uses"), "oftenlines")
    seen = all_lines.join(often, ["h", "g", "n"])
    sketched = seen.where("source is not null").groupBy("h", "g", "n").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sites"), F.min("first_doc").alias("first_doc"))
    estimated = written(sketched.select("h", "g", "n", "first_doc", F.hll_sketch_estimate("sites").alias("sites")), "linesites")
    low, high = min(min_sites * (1 - BAND), min_sites - 1), max(min_sites * (1 + BAND), min_sites + 1)
    sure = estimated.where(F.col("sites") > high)
    near = estimated.where(F.col("sites").between(low, high))
    exact = (
        all_lines.join(near, ["h", "g", "n"], "left_semi").where("source is not null").select("h", "g", "n", "source").distinct()
        .groupBy("h", "g", "n").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    )
    return sure.unionByName(near.join(exact, ["h", "g", "n"], "left_semi")).select("h", "g", "n", "first_doc")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; a last column, ``lines_removed`` if that name is free (else with
    underscores behind), counts them. Other columns as they were."""
    spread = written(boilerplate(docs, min_sites), "boilerplate")
    gone = lines(docs).join(spread, ["h", "g", "n"]).where("doc_id > first_doc").select("doc_id", F.struct("h", "g", "n").alias("k")).distinct()
    owner, keys, counted = free(docs, "line_owner"), free(docs, "line_keys"), free(docs, "lines_removed")
    gone = gone.groupBy("doc_id").agg(F.collect_list("k").alias(keys)).withColumnRenamed("doc_id", owner)
    whole = docs.join(gone, docs["doc_id"] == gone[owner], "left")
    kept = F.filter(F.split("text", "\n"), lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(keys), line_key(F.trim(line))))
    text = F.when(F.col(keys).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col(keys).isNull() | F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")) - F.size(kept))
    return whole.withColumn(counted, removed.cast("long")).withColumn("text", text).select(*docs.columns, counted)


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lines_removed, n_chars of the text that stays, and its SHA-256."""
    out = cleaned(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = f"""
with l as (select doc_id, source, i, trim(line, ' ') as line
           from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
b as (select line, min(doc_id) as first_doc from l where line <> '' group by line having count(distinct source) >= {MIN_SITES}),
k as (select l.doc_id, l.i, b.line is not null and l.doc_id > b.first_doc as gone,
             (select 1) as one from l left join b using (line)),
r as (select d.doc_id, s.i, s.line, k.gone
      from documents d,
           lateral (select unnest(string_split(d.text, chr(10))) as line, generate_subscripts(string_split(d.text, chr(10)), 1) as i) s
           join k on k.doc_id = d.doc_id and k.i = s.i),
t as (select doc_id, count(*) filter (where gone) as lines_removed, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as text from r group by doc_id)
select doc_id, cast(lines_removed as bigint) as lines_removed, cast(length(text) as bigint) as n_chars, sha256(text) as text_sha256 from t
"""
