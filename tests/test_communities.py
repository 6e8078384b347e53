"""Communities kept by batches equal those of all edges at once, and what no edge touches is not written."""

import random
from collections import defaultdict

import pytest

from scholium.operators.communities import Communities


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return out


@pytest.mark.parametrize("seed", [1])
def test_batches_equal_a_recomputation(spark, tmp_path, seed):
    r = random.Random(seed)
    kept, nodes, edges, state = Communities(spark, f"file://{tmp_path}/c", 4), {}, [], {}
    for batch in range(2):
        came = {r.randint(0, 60): r.randint(1, 9) for _ in range(15)}
        nodes.update({**came})
        links = [(r.choice(list(nodes)), r.choice([*nodes, 999])) for _ in range(6)]
        edges += links
        frames = spark.createDataFrame([(i, f"n{i}", m) for i, m in came.items()], "id long, name string, mentions long"), spark.createDataFrame([*links, (None, 1), (2, 2)], "src long, dst long")
        for _ in range(2 if batch == 1 else 1):
            kept.add(*frames, f"b{batch}")
        now, want = components(nodes, edges), {}
        for c, members in now.items():
            old = {o for o, s in state.items() if s["members"] & members}
            p = state[next(iter(old))] if len(old) == 1 else None
            same = p is not None and p["members"] == members
            want[c] = {"members": members, "summary": p["summary"] if p else "", "dirty": p["dirty"] if same else True, "last": p["last"] if p else 0, "day": p["day"] if same else None}
        got = {x["component"]: x for x in kept.communities().collect()}
        assert {c: (x["size"], x["summary"], x["dirty"], x["size_at_last_summary"], x["last_updated"]) for c, x in got.items()} == {c: (len(w["members"]), w["summary"], w["dirty"], w["last"], w["day"]) for c, w in want.items()}
        assert {c: x["concepts"] for c, x in got.items()} == {c: "|".join(f"n{i}" for i in sorted(m, key=lambda i: (-nodes[i], f"n{i}"))[:5]) for c, m in now.items()}
        state = want
        some = [c for c in want if c % 2]
        if some:
            kept.summarised(spark.createDataFrame([(c, f"about {c} in {batch}") for c in some], "component long, summary string"), f"day {batch}", f"s{batch}")
        for c in some:
            state[c] |= {"summary": f"about {c} in {batch}", "dirty": False, "last": len(want[c]["members"]), "day": f"day {batch}"}
    assert {(x["id"], x["component"]) for x in kept.members().collect()} == {(i, c) for c, m in now.items() for i in m}


def test_untouched_communities_are_not_written(spark, tmp_path):
    kept = Communities(spark, f"file://{tmp_path}/c", 64)
    kept.add(spark.createDataFrame([(i, f"n{i}", 1) for i in range(100)], "id long, name string, mentions long"), spark.createDataFrame([(i, i + 1) for i in range(0, 100, 2)], "src long, dst long"), "first")
    kept.add(spark.createDataFrame([], "id long, name string, mentions long"), spark.createDataFrame([(0, 2)], "src long, dst long"), "second")
    last = [f for f in kept.told.read().inputFiles() if "/000000000002/" in f]
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in last}) <= 2
    assert not [f for f in kept.nodes.read().inputFiles() if "/000000000002/" in f]
    assert {x["size"] for x in kept.communities().collect()} == {2, 4} and kept.stale().count() == 49
