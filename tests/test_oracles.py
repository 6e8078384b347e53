"""A few registered queries against DuckDB on the smallest tables, and the contract's shape."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "bm25_benchmark_topk", "vector_topk", "trigram_name_join", "relation_upsert", "bridges", "root_convergence", "registry_latest", "stream_registry", "chat_history_window",
    "chunk_documents", "section_spans", "deep_rank", "metadata_rank", "influential_citations", "entity_mentions", "shortest_paths", "multi_hop_expand", "find_roots", "hybrid_expand", "proposition_assignment",
    "document_scalars", "resolve_entities", "merged_entities", "property_graph_edges", "register_or_requeue", "registry_states", "stream_states", "stream_windows", "community_matching", "latent_connections",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in duck.description]
    assert sorted(names) == cols
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in duck.fetchall())
    assert got == want


def test_roots_over_all_references_equal_sql(spark, duck):
    test_query_equals_sql(spark, duck, "root_convergence_influential")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
