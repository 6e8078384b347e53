"""Hand-computed cases for scalar functions, retrieval, graph and bibliography."""

import pytest
from pyspark.sql import functions as F

from scholium.functions import text as X
from scholium.operators import documents as D
from scholium.operators import graph as G
from scholium.operators import linkage as L
from scholium.operators import papers as P
from scholium.operators import registry as R
from scholium.operators import retrieval as S
from scholium.operators.blocks import nearest
from scholium.operators.components import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: X.name_entropy(F.lit("aaaa")), 0.0), (lambda: X.name_entropy(F.lit("abcd")), 2.0), (lambda: X.name_entropy(F.lit("")), 0.0),
        (lambda: F.round(X.confidence(F.lit(3), F.lit(0), F.lit("technique")), 3), 0.6), (lambda: X.confidence(F.lit(3), F.lit(2), F.lit("concept")), 0.8),
        (lambda: X.confidence(F.lit(1), F.lit(3), F.lit("technique")), 1.0), (lambda: X.gram_jaccard(F.lit("ab"), F.lit("ab")), 0.0),
        (lambda: X.gram_jaccard(F.lit("abcd"), F.lit("abcx")), 1 / 3), (lambda: X.clamp_score(F.lit("11")), 10), (lambda: X.clamp_score(F.lit("x")), 5),
        (lambda: X.identifier_kind(F.lit("2401.01234v2")), "arxiv"), (lambda: X.identifier_kind(F.lit("10.1000/5")), "doi"),
        (lambda: X.best_identifier(F.lit("2401.01234v2"), F.lit("d"), F.lit(None).cast("string"), F.lit("p")), "2401.01234"),
        (lambda: X.video_id(F.lit("https://youtu.be/abcdefghijk")), "abcdefghijk"), (lambda: X.title_of(F.lit("x\n# A title\n")), "A title"),
        (lambda: X.velocity(F.lit(10), F.lit(2020), 2024), 2.0), (lambda: X.venue_score(F.lit("Proc. NeurIPS")), 1.0), (lambda: X.venue_score(F.lit("")), 0.0),
        (lambda: X.is_survey(F.lit("A survey of things"), F.lit("")), True), (lambda: X.novelty(F.lit(0.9), F.lit(-1), F.lit(1), F.lit(2)), 0.9),
        (lambda: X.slug(F.lit(" A b!c ")), "a_bc"), (lambda: X.normal_title(F.lit("  A--B ")), "a b"), (lambda: X.with_context(F.lit("p"), F.lit("t")), "p.\n\nt"),
        (lambda: X.model_json(F.lit("so: {\"a\": 1} ok")).cast("string"), '{"a":1}'), (lambda: X.model_json(F.lit("[1, 2")).cast("string"), None),
        (lambda: X.node_size(F.lit(9)), 10),
    ],
)
def test_scalars(spark, column, expected):
    got = one(spark, column())
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_bm25_counts_repeated_query_tokens(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma gamma"), (3, "alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "gamma gamma beta")], "item_id long, text string")
    got = S.bm25(docs, asked).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]


def test_chunks_edges(spark):
    rows = [(1, "x" * 399), (2, "x" * 400), (3, "x" * 3200), (4, "x" * 3204), (5, "\n\n".join(["y" * 1200] * 4)), (6, ""), (7, None), (8, "## A\n" + "z" * 500 + "\n# B\nshort\n### C\n" + "\n\n".join(["w" * 2000] * 3))]
    got = {}
    for r in D.chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(len(r["text"]))
    assert got == {1: [399], 2: [400], 3: [3200], 4: [3204], 5: [2402, 2402], 8: [500, 2000, 2000, 2000]}


def test_sections_and_clean_up(spark):
    content = "Preamble\n# Title here\nfirst\n\n\n\nsecond\n## 1. Introduction\nbody\n#### deep\n## Appendix\nmore"
    got = [(s["title"], s["body"]) for s in one(spark, X.split_sections(F.lit(content)))]
    assert got == [("", "Preamble"), ("Title here", "first\n\n\n\nsecond"), ("1. Introduction", "body\n#### deep"), ("Appendix", "more")]
    assert one(spark, X.key_sections(F.lit(content))) == content
    long = f"Top\n# 2. Methods\n{'m ' * 5000}\n# Funding\n{'f ' * 5000}\n## Conclusions\nend"
    kept = one(spark, X.key_sections(F.lit(long)))
    assert kept.startswith("Top\n\n# 2. Methods") and "Funding" not in kept and kept.endswith("## Conclusions\nend")
    page = "menu\nskip\n# The title\ntext\n\n\n\nmore\nWhy HTML?\nReport GitHub issue"
    assert one(spark, X.strip_boilerplate(F.lit(page))) == "# The title\ntext\n\nmore\nWhy HTML?"
    assert one(spark, X.abstract_of(F.lit("x\nAbstract: first.\n\nnext\n## Abstract\nreal one\n\nrest"))) == "real one"
    assert one(spark, X.abstract_of(F.lit("no marker"))) == "no marker"


def test_diversity_drops_a_chunk_after_its_document(spark):
    rows = [(0, 1, 7, True, 0.9), (0, 2, 7, False, 0.8), (0, 3, 8, False, 0.7), (0, 4, 8, False, 0.6)]
    got = S.diversify(spark.createDataFrame(rows, "qid long, id long, doc long, is_proposition boolean, score double"), 35)
    assert sorted(r["id"] for r in got.collect()) == [1, 3]


def test_components_are_the_same_in_any_order(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    for some in (edges, [(b, a) for a, b in reversed(edges)]):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(some, "src long, dst long")).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 10), (0, 11), (0, 99)], "a long, b long")
    assert {r["b"]: r["path"] for r in G.shortest_paths(edges, pairs).collect()} == {0: 0, 1: 1, 10: 10, 11: -1, 99: -1}


def test_greedy_refines_transitive(spark):
    rows = [(1, "s", "10.1/a", "", "one", 1), (2, "s", "", "2401.00001", "two", 2), (3, "t", "10.1/a", "2401.00001", "three", 3)]
    records = spark.createDataFrame(rows, "ord long, source string, doi string, arxiv_id string, title string, citation_count long")
    assert {r["ord"]: r["cluster"] for r in P.greedy_clusters(records).collect()} == {1: 1, 2: 2, 3: 1}
    assert [(r["n"], r["title"], r["sources"]) for r in P.deduplicated(records).collect()] == [(3, "three", "s,t")]


def test_greedy_equals_the_sequential_rule(spark):
    import random

    r = random.Random(8)
    rows = [(i, "s", r.choice(["", f"10.1/{r.randint(0, 40)}"]), r.choice(["", f"2401.{r.randint(0, 40):05d}"]), r.choice(["", f"title {r.randint(0, 60)}"]), 1) for i in range(300)]
    seen, want = {}, {}
    for i, _, doi, arxiv, title, _ in rows:
        mine = [x for x in (("d", doi), ("a", arxiv), ("t", title)) if x[1]]
        want[i] = next((seen[x] for x in mine if x in seen), None)
        if want[i] is None:
            want[i] = i
            seen.update((x, i) for x in mine)
    records = spark.createDataFrame(rows, "ord long, source string, doi string, arxiv_id string, title string, citation_count long")
    assert {x["ord"]: x["cluster"] for x in P.greedy_clusters(records).collect()} == want


def test_nearest_equals_brute_force(spark):
    import numpy as np

    x = np.round(np.random.default_rng(1).normal(size=(70, 8)), 1)
    rows = [(i, [float(v) for v in x[i]]) for i in range(70)] + [(100, [float(v) for v in x[3]])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {(r["qid"], r["rank"]): (r["id"], r["sim"]) for r in nearest(v, v.where("id < 9"), 4, rows=16).collect()}
    for q in range(9):
        want = sorted(((-round(float(np.dot(x[q], e)), 6), i) for i, e in rows if i != q))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, -s) for s, i in want]


def test_entities_resolve_by_tier(spark):
    unit = lambda *v: [float(a) / sum(b * b for b in v) ** 0.5 for a in v]
    old = [(1, "Neural network", "method", unit(1, 0, 0)), (2, "Graph store", "tool", unit(0, 1, 0)), (3, "Other", "tool", unit(0, 0, 1)), (4, "More things", "tool", unit(1, 1, 1)), (5, "aaaa", "tool", unit(1, -1, 0))]
    new = [(1, " neural NETWORK ", "tool", None), (2, "Neural networks", "method", unit(1, 0.05, 0)), (3, "quite different", "method", unit(1, 0.1, 0)), (4, "aaab", "tool", unit(1, -1, 0.1)), (5, "bbb", "tool", unit(-1, 0, 0)), (6, "quite different ", "tool", None), (7, None, "tool", None)]
    schema = "{} long, name string, type string, embedding array<double>"
    got = {r["ord"]: (r["tier"], r["reason"], r["entity_id"]) for r in L.resolved(spark.createDataFrame(new, schema.format("ord")), spark.createDataFrame(old, schema.format("id"))).collect()}
    assert got == {1: (1, "exact", "1"), 2: (2, "embedding", "1"), 3: (2, "new", "new:quite different"), 4: (3, "ambiguous", "5"), 5: (3, "new", "new:bbb"), 6: (2, "new", "new:quite different")}


def test_registry_refuses_and_requeues(spark):
    rows = [(1, "a", "queued"), (2, "a", "ingesting"), (3, "a", "queued"), (4, "a", "failed"), (5, "a", "queued"), (6, "b", "ingested"), (7, "b", "queued"), (8, "c", "queued"), (9, "c", "queued")]
    got = {r["paper_id"]: (r["status"], r["refused"]) for r in R.states(spark.createDataFrame(rows, "seq long, paper_id string, status string")).collect()}
    assert got == {"a": ("queued", 1), "b": ("ingested", 1), "c": ("queued", 0)}


def test_linkage(spark):
    names = spark.createDataFrame([("steel ring",), ("steel rings",), ("blue pin",), ("ab",)], "name string")
    assert [(r["a"], r["b"]) for r in L.trigram_join(names, 0.6).collect()] == [("steel ring", "steel rings")]
    rows = spark.createDataFrame([("a", "b", "r"), ("a", "b", "r"), ("a", "a", "r")], "source_id string, target_id string, relation_type string")
    assert [(r["weight"], r["seen"]) for r in L.upserted(rows).collect()] == [(1.5, 2)]


def test_replay_resets_at_an_add(spark):
    log = spark.createDataFrame([(1, 5, "add", "x"), (2, 5, "merge", None), (3, 5, "add", "y"), (4, 5, "merge", None), (5, 6, "merge", None)], "seq long, id long, op string, payload string")
    assert [tuple(r) for r in R.replayed(log).collect()] == [(5, "y", 2)]


def test_inverted_index_round_trip(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "x")], "doc_id long, text string")
    assert {r[0]: r[1] for r in D.from_inverted_index(D.inverted_index(docs)).collect()} == {1: "a b a c", 2: "x"}


def test_roots_follow_references_that_are_not_influential(spark):
    rows = [("s1", "a", False, False), ("s2", "b", True, False), ("a", "root", False, True), ("b", "root", True, False)]
    cites = spark.createDataFrame(rows, "citing string, cited string, is_influential boolean, is_methodology boolean")
    got = {r["id"]: r["convergence"] for r in P.root_candidates(cites, spark.createDataFrame([("s1",), ("s2",)], "seed string")).collect()}
    assert got == {"root": 1.0, "a": 0.5, "b": 0.5}
