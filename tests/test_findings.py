"""Cases that larger tables brought up."""

import math

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.functions import text as X
from scholium.operators import blocks as K
from scholium.operators import counts as N
from scholium.operators import flows as C
from scholium.operators import graph as G
from scholium.operators import inference as I
from scholium.operators import reach
from scholium.operators import retrieval as S
from scholium.sources import fixtures


def test_sentences_lose_spaces_only(spark):
    text = " 0.5 of them were kept in the end 0. 18.68.191.238 was the address of host 1. 2 and 2 are 4, or so it was said 22"
    got = spark.range(1).select(X.sentences(F.lit(text)).alias("s"), I.context_prefix(F.lit("t"), F.lit(text)).alias("p")).first()
    assert got["s"] == ["0.5 of them were kept in the end 0.", "18.68.191.238 was the address of host 1.", "2 and 2 are 4, or so it was said 22"]
    assert got["p"] == "t: 0.5 of them were kept in the end 0."


def test_a_note_is_read_by_the_paper_that_it_belongs_to(spark):
    rows = spark.createDataFrame([("0123456789abcdef", "one"), ("01234567ffffffff", "two")], "doc_id string, title string").selectExpr("*", "cast(null as string) as abstract", "cast(null as string) as i")
    notes = spark.createDataFrame([("0123456789abcdef", "ingested/url/t_01234567.md")], "doc_id string, relative_path string")
    assert {r["title"]: r["locator"] for r in C.readable(rows, F.col("i"), notes).collect()} == {"one": "ingested/url/t_01234567.md", "two": "two"}
    assert {r["locator"] for r in C.readable(rows, F.col("i"), notes.select("relative_path")).collect()} == {"ingested/url/t_01234567.md"}


def test_scores_are_made_in_groups_and_equal_those_of_all_pairs(spark, monkeypatch):
    """Words of all documents and all queries: few queries to a task, few postings to a group of documents, few scores at once."""
    for name, few in (("ASKED", 3), ("READ", 40), ("CELLS", 12)):
        monkeypatch.setattr(S, name, few)
    texts = {f"d{i}": f"common word{i % 3} " + "common again " * (i % 4) + f"rare{i}" for i in range(30)} | {"d30": None, "d31": ""}
    asked = {i: f"common common word{i % 3} rare{2 * i}" for i in range(8)} | {8: "nothing here", 9: None}
    docs, queries = spark.createDataFrame(list(texts.items()), "doc_id string, text string"), spark.createDataFrame(list(asked.items()), "item_id long, text string")
    words = {i: (t or "").split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    want = set()
    for q, text in asked.items():
        scores = {}
        for i, w in words.items():
            for t in (text or "").split():
                if n := w.count(t):
                    df = sum(t in x for x in words.values())
                    scores[i] = scores.get(i, 0.0) + math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(w) / mean))
        want |= {(q, i, round(s, 6), k + 1) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4])}
    assert {(r["qid"], r["id"], round(r["score"], 6), r["rank"]) for r in S.bm25(docs, queries, k=4).collect()} == want


def test_paths_of_many_seeds_are_carried_as_bits(spark, monkeypatch):
    """More seeds than a number has bits, and no table between the rounds with a row for each seed."""
    given = [(i, 1000) for i in range(140)] + [(1000, 1001), (1001, 1002), (1002, 1003), (1003, 1004), (200, 201)]
    edges = spark.createDataFrame(given, "src long, dst long")
    near = {i: set() for pair in given for i in pair}
    for a, b in given:
        near[a].add(b)
        near[b].add(a)
    want, seeds = set(), [*range(0, 140), 200, 999]
    for s in seeds:
        at, front, depth = {s: 0}, {s}, 0
        while front and depth < 4:
            depth += 1
            front = {n for x in front for n in near.get(x, ())} - set(at)
            at |= dict.fromkeys(front, depth)
        want |= {(s, n, d) for n, d in at.items()}
    rows, plain = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: (lambda out: (rows.append(out.count()) if name in ("front", "seen") else None, out)[1])(plain(df, name)))
    got = G.reached(edges, spark.createDataFrame([(s,) for s in seeds], "seed long"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(rows) < len(want) / 2


def test_nearest_vectors_are_found_once_for_latent_connections(spark, monkeypatch):
    calls, plain = [], G.nearest
    monkeypatch.setattr(G, "nearest", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    entry.queries()["latent_connections"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def _near(texts, asked, k):
    """Rows ``(qid, id, sim, rank)`` by all pairs of lists of cells."""
    count = lambda cells: np.bincount(cells or [], minlength=16).astype(float)
    out = []
    for q, own in asked.items():
        sims = {i: float(count(own) @ count(c)) / math.sqrt(float(count(own) @ count(own)) * float(count(c) @ count(c))) for i, c in texts.items() if c and own and set(c) & set(own)}
        best = sorted((-math.floor(s * 1e6 + 0.5) / 1e6, i) for i, s in sims.items())[:k]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def celled():
    r = np.random.default_rng(3)
    some = lambda n: [int(x) for x in r.integers(0, 15, n)]
    # Many copies, some of them nearest of all, and texts that share no cell with most queries.
    texts = {f"t{i}": [1, 2, 2] if i % 3 == 0 else [15] if i % 50 == 1 else some(1 + i % 9) for i in range(400)} | {"u0": [], "u1": None, "u2": [0] * 5000}
    asked = {f"q{i}": some(1 + 2 * i) for i in range(25)} | {"q25": [], "q26": None, "q27": [1, 2, 2], "q28": [15]}
    return texts, asked


def test_nearest_texts_equal_those_of_all_pairs(spark, celled, monkeypatch):
    for name, few in (("ASKED", 7), ("READ", 60), ("ROWS", 16)):
        monkeypatch.setattr(N, name, few)
    texts, asked = (spark.createDataFrame(list(x.items()), "id string, cells array<int>") for x in celled)
    got = N.nearest_counts(texts, asked, 6, 16).collect()
    assert sorted((r["qid"], r["id"], r["sim"], r["rank"]) for r in got) == _near(*celled, 6)


@pytest.mark.parametrize("single", [1 << 24, 0])
def test_nearest_texts_in_blocks_of_either_precision(celled, monkeypatch, single):
    monkeypatch.setattr(N, "ROWS", 8)
    monkeypatch.setattr(N, "SINGLE", single)
    texts, asked = ({i: c for i, c in sorted(x.items()) if c} for x in celled)
    count = lambda x: np.array([np.bincount(c, minlength=16) for c in x.values()], np.int32)
    ids, names, best = list(texts), list(asked), N._Nearest(count(asked), 6)
    for at in range(0, len(ids), 8):
        best.show(count(texts)[at : at + 8], np.arange(at, min(at + 8, len(ids))))
    got = [(names[lo + q], ids[d], float(s)) for lo in best.held for q, d, s in zip(*best.cut(lo))]
    assert sorted(got) == [x[:3] for x in _near(texts, asked, 6)]


def test_hybrid_search_makes_no_dense_vectors_and_no_rows_for_texts_without_a_word_in_common(spark, monkeypatch):
    monkeypatch.setattr(I, "dense", lambda *a: pytest.fail("a vector of all cells for each text"))
    queries = spark.createDataFrame([("q", "graphs")], "qid string, query string")
    chunks = spark.createDataFrame([("c1", 1, "graphs and trees"), ("c2", 2, "nothing else")], "id string, doc_id long, text string")
    props = spark.createDataFrame([("1_p0", 1, "graphs"), ("2_p0", 2, "nothing")], "id string, doc_id long, text string")
    assert {r["id"] for r in C.hybrid_search(queries, chunks, props).collect()} == {"c1", "1_p0"}


def test_common_words_are_scored_as_matrices_and_rare_ones_apart(monkeypatch):
    r, pd = np.random.default_rng(9), S.pd
    docs = pd.DataFrame([(f"d{d}", t, float(r.random())) for d in range(30) for t in range(12) if r.random() < (0.9 if t < 6 else 0.05)], columns=["id", "t", "part"])
    asked = pd.DataFrame([(t, q, float(r.random())) for t in range(14) for q in range(9) if r.random() < (0.9 if t < 6 else 0.1)], columns=["t", "q", "w"])
    own = asked["t"].to_numpy(), asked["q"].to_numpy(), asked["w"].to_numpy()
    found = {}
    for often, tokens in ((0, 4), (8, 4), (8, 256), (10**6, 5)):  # none, the common ones, all as matrices
        monkeypatch.setattr(S, "OFTEN", often)
        monkeypatch.setattr(S, "TOKENS", tokens)
        found[often, tokens] = S._scored(own, 9, docs)
    want = {(q, i): sum(w * p for t, x, w in asked.itertuples(index=False) if x == q for j, u, p in docs.itertuples(index=False) if j == i and u == t) for q in range(9) for i in docs["id"].unique()}
    for ids, scores in found.values():
        assert {(q, i): round(s, 9) for q, row in enumerate(scores) for i, s in zip(ids, row)} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("depth", [2, 10])
def test_similar_vectors_are_reached_by_bits(spark, monkeypatch, depth):
    """More seeds than a row of bits has, more blocks than a group has; a vector without a value reaches itself."""
    monkeypatch.setattr(reach, "SLAB", 64)
    monkeypatch.setattr(reach, "HELD", 2)
    r = np.random.default_rng(4)
    x = r.normal(size=(260, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (np.round(x @ x.T, 6) >= 0.9) & ~np.eye(len(x), dtype=bool)
    seeds, want = [*range(0, 260, 2)], {(900, 900, 0)}
    for seed in seeds:
        at, front = {seed: 0}, {seed}
        for d in range(1, depth + 1):
            front = {int(n) for f in front for n in np.flatnonzero(near[f])} - set(at)
            at |= dict.fromkeys(front, d)
        want |= {(seed, n, d) for n, d in at.items()}
    assert (max(d for _, _, d in want) > 2) == (depth > 2)
    vectors = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(len(x))] + [(900, None)], "id long, embedding array<double>")
    got = reach.reached_by_similarity(vectors, 0.9, spark.createDataFrame([(s,) for s in [*seeds, 900]], "seed long"), depth, rows=24).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_links_never_become_rows_for_shortest_paths(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "similar_pairs", lambda *a: pytest.fail("a row for each link"))
    assert entry.queries()["shortest_paths"](spark, "/root/testdata/sf0.001").where("path > 0").count() > 0


@pytest.mark.parametrize("least", [-1.0, 0.1, 0.5, 0.9, 2.0])
def test_products_in_single_precision_lose_no_pair(least):
    r = np.random.default_rng(6)
    a, b = r.normal(size=(50, 16)), 3 * r.normal(size=(70, 16))
    b[:10] = a[:10]
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    sim = np.round(a @ b.T, 6)
    for exact in (least, *sim.ravel()[:20]):
        u, v, s = K._alike(a, b, exact)
        assert sorted(zip(u, v, s)) == sorted((i, j, sim[i, j]) for i, j in zip(*np.nonzero(sim >= exact)))
