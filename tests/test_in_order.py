"""Rules that are sequential in the reading, as rounds: equal to a replay, one row after another."""

import random

import numpy as np
import pytest

from scholium.operators import linkage as L
from scholium.operators import papers as P

RECORD = "ord long, source string, doi string, arxiv_id string, title string, citation_count long"


def replay(rows):
    seen, want = {}, {}
    for i, _, doi, arxiv, title, _ in rows:
        mine = [x for x in (("d", doi), ("a", arxiv), ("t", title)) if x[1]]
        want[i] = next((seen[x] for x in mine if x in seen), None)
        if want[i] is None:
            want[i] = i
            seen.update((x, i) for x in mine)
    return want


def clusters(spark, rows, **kw):
    return {x["ord"]: x["cluster"] for x in P.greedy_clusters(spark.createDataFrame(rows, RECORD), **kw).collect()}


@pytest.mark.parametrize("replayed", [50_000, 0])
def test_a_long_chain(spark, replayed):
    n = 10_000 if replayed else 40
    rows = [(i, "s", f"10.1/{i // 2}" if i % 2 else f"10.1/{i // 2}", f"2401.{(i + 1) // 2:05d}", "", 1) for i in range(n)]
    assert clusters(spark, rows, replay=replayed) == replay(rows)


@pytest.mark.parametrize("seed", [2])
def test_rounds_alone_equal_the_replay(spark, seed):
    r = random.Random(seed)
    rows = [(i, "s", r.choice(["", f"10.1/{r.randint(0, 60)}"]), r.choice(["", f"2401.{r.randint(0, 60):05d}"]), r.choice(["", f"title {r.randint(0, 80)}"]), 1) for i in range(60)]
    assert clusters(spark, rows, replay=3) == clusters(spark, rows) == replay(rows)


def grams(s):
    s = s.lower()
    return {s[i : i + 3] for i in range(len(s) - 2)}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def one_by_one(new, old, t, f):
    known = [(False, i, name, kind, np.array(x)) for i, name, kind, x in old]
    out = {}
    for o, name, kind, x in new:
        near = sorted(((-round(float(np.dot(x, e)), 6), founded, i, n, k) for founded, i, n, k, e in known))[:5]
        took = (None, None, None)
        for s, founded, i, n, k in near:
            if -s < 0.9 * t:
                break
            if k != kind and kind != "concept":
                continue
            if -s >= t and jaccard(name, n) >= f:
                took = (founded, i, "high")
                break
            if -s >= 0.95 * t:
                took = (founded, i, "gray")
                break
        out[o] = took
        if took[1] is None:
            known.append((True, o, name, kind, np.array(x)))
    return out


@pytest.mark.parametrize("seed", [1])
def test_entities_of_a_batch_meet_each_other(spark, seed):
    r = random.Random(seed)
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, 5))

    def row(i):
        c = r.randrange(6)
        x = centres[c] + 0.35 * g.normal(size=5)
        return (i, f"{('graph', 'vector', 'neural', 'token', 'search', 'index')[c]} {r.choice(['store', 'model', 'method', 'tree'])} {r.randint(0, 3)}", r.choice(["method", "tool", "concept"]), [float(v) for v in x / np.linalg.norm(x)])

    new, old = [row(i) for i in range(50)], [row(i) for i in range(12)]
    schema = "{} long, name string, type string, embedding array<double>"
    got = {x["ord"]: (x["founded"], x["found"], x["band"]) for x in L.in_order(spark.createDataFrame(new, schema.format("ord")), spark.createDataFrame(old, schema.format("id")), 0.9, 0.5).collect()}
    want = one_by_one(new, old, 0.9, 0.5)
    assert got == want and any(w[0] for w in want.values())


def test_a_batch_resolves_within_itself(spark):
    unit = lambda *v: [float(a) / sum(b * b for b in v) ** 0.5 for a in v]
    new = [(1, "Graph databases", "tool", unit(1, 0, 0)), (2, "graph database", "tool", unit(1, 0.05, 0)), (3, "aaab", "tool", unit(0, 1, 0.1)), (4, "Something else", "tool", unit(0, 1, 0)), (5, "graph databases", "tool", None), (6, "graph database", "tool", None)]
    old = [(k, f"old entity {k}", "x", unit(0, 0, 1)) for k in range(1, 6)]
    schema = "{} long, name string, type string, embedding array<double>"
    frames = spark.createDataFrame(new, schema.format("ord")), spark.createDataFrame(old, schema.format("id"))
    got = {r["ord"]: (r["reason"], r["entity_id"]) for r in L.resolved(*frames, within=True).collect()}
    assert got == {1: ("new", "new:graph databases"), 2: ("embedding", "new:graph databases"), 3: ("ambiguous", "new:something else"), 4: ("new", "new:something else"), 5: ("new", "new:graph databases"), 6: ("embedding", "new:graph databases")}
    assert {r["ord"]: r["entity_id"] for r in L.resolved(*frames).collect()}[2] == "new:graph database"
