"""Bibliographic dumps to one table of papers: id, title, abstract, url, doi, arxiv_id, year, citation_count, venue, sources, search_angles, authors.

Null or missing fields become empty strings, a null year or a count of 0; so do years and counts that are no whole numbers.
Records without an identifier get one from their title. Empty folders of the right format give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.documents import from_inverted_index_column

AUTHORS = "array<struct<authorId:string,name:string>>"
#: The fields of the public dump formats that are read; whole numbers are told from strings by their variant's type.
GRAPH_API = f"paperId string, title string, abstract string, year variant, url string, externalIds struct<ArXiv:string,DOI:string>, citationCount variant, venue string, authors {AUTHORS}"
WORKS_API = "id string, display_name string, doi string, abstract_inverted_index map<string,array<int>>, publication_year variant, cited_by_count variant, primary_location struct<landing_page_url:string,source:struct<display_name:string>>"
ATOM = "id string, title string, summary string"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _whole(c: Column) -> Column:
    return F.when(F.schema_of_variant(c) == "BIGINT", F.try_variant_get(c, "$", "bigint"))


def _papers(rows: DataFrame, source: str, angle: str, **cols: Column) -> DataFrame:
    given = {"doi": F.lit(""), "arxiv_id": F.lit(""), "year": F.lit(None), "citation_count": F.lit(0), "venue": F.lit(""), "authors": F.array(), **cols}
    return rows.select(
        given["id"].alias("id"), X.normal_text(_text(given["title"])).alias("title"), X.normal_text(_text(given["abstract"])).alias("abstract"), _text(given["url"]).alias("url"),
        F.lower(F.trim(_text(given["doi"]))).alias("doi"), F.trim(_text(given["arxiv_id"])).alias("arxiv_id"), given["year"].cast("int").alias("year"),
        F.coalesce(given["citation_count"].cast("long"), F.lit(0).cast("long")).alias("citation_count"), _text(given["venue"]).alias("venue"), F.array(F.lit(source)).alias("sources"),
        F.array(*([F.lit(angle)] if angle else [])).cast("array<string>").alias("search_angles"), F.coalesce(given["authors"], F.array()).cast(AUTHORS).alias("authors"),
    )


def _or_title(prefix: str, given: Column, title: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(given, F.lit("")), X.content_id(_text(F.col(title)))))


def from_graph_api(spark: SparkSession, path: str, angle: str = "") -> DataFrame:
    """JSON lines with ``paperId``; authors without an id go; abstracts are cut to 900 characters."""
    rows = spark.read.schema(GRAPH_API).json(path)
    return _papers(
        rows, "semantic_scholar", angle, id=_or_title("s2:", F.col("paperId"), "title"), title=F.col("title"), abstract=F.substring("abstract", 1, 900), url=F.col("url"),
        doi=F.col("externalIds.DOI"), arxiv_id=F.col("externalIds.ArXiv"), year=_whole(F.col("year")), citation_count=_whole(F.col("citationCount")), venue=F.col("venue"),
        authors=F.filter("authors", lambda a: _text(a["authorId"]) != ""),
    )


def from_works_api(spark: SparkSession, path: str, angle: str = "") -> DataFrame:
    """JSON lines of works whose abstracts are inverted indexes."""
    rows = spark.read.schema(WORKS_API).json(path)
    return _papers(
        rows, "openalex", angle, id=_or_title("openalex:", F.col("id"), "display_name"), title=F.col("display_name"),
        abstract=F.substring(from_inverted_index_column(F.col("abstract_inverted_index")), 1, 900), url=F.col("primary_location.landing_page_url"),
        doi=F.replace("doi", F.lit("https://doi.org/"), F.lit("")), year=_whole(F.col("publication_year")), citation_count=_whole(F.col("cited_by_count")), venue=F.col("primary_location.source.display_name"),
    )


def from_atom(spark: SparkSession, path: str, angle: str = "") -> DataFrame:
    """Atom feeds; abstracts are cut to 1000 characters."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    arxiv = F.when(F.col("id").contains("/abs/"), F.element_at(F.split("id", "/abs/"), -1)).otherwise("")
    return _papers(rows, "arxiv", angle, id=_or_title("arxiv:", arxiv, "title"), title=F.trim("title"), abstract=F.substring(F.trim("summary"), 1, 1000), url=F.trim("id"), arxiv_id=arxiv)
