"""Periodic runs, quality votes and Merkle manifests against brute force; near duplicates of very long texts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import merkle, periodic, quality, simhash

SF = "/root/testdata/sf0.001"
R = random.Random(9)
SAME = "one two one two one two one two\nand\nmore"
LONG = " ".join(R.choice(("the", "of", "mit", "license")) for _ in range(60_000))
CLASH = ("hash", "tree", "pos", "bad", "total", "runs", "collapsed", "label", "score", "leaf", "root", "id")
ROWS = [(1, SAME), (1, SAME), (2, None), (3, ""), (4, " \n\t"), (None, SAME), (None, None), (5, LONG), (6, "y" * 200_000), (7, "É日本 ½ \x00 z"), (8, "a " * 3000)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, (None, "s1", "s2", "é")[k % 4], ("en", None)[k % 2], None if t is None else len(t), t) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("clash") for c in CLASH})


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(6, 4 * q) and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a, old = g % n, w[:]
            p = 1 + (n - a) // (3 + g % 8)
            w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_equal_brute_force(spark, edges):
    r = random.Random(3)
    cases = [(i, t) for i, t in ROWS if t is None or len(t) < 1000]
    for i in range(10, 240):
        w = [r.choice("abc") if i % 2 else f"w{r.randint(0, 40)}" for _ in range(r.choice((5, 6, 30, 90)))]
        a, p = r.randrange(len(w)), r.randint(1, 9)
        for k in range(a + p, min(len(w), a + p * r.randint(2, 8))):
            w[k] = w[k - p]
        cases.append((i, " ".join(w)))
    got = periodic.query(spark.createDataFrame(cases, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(row_by_hand(i, t)) for i, t in cases)
    assert len(periodic.query(edges).collect()) == len(ROWS) and periodic.query(edges.limit(0)).count() == 0
    long = {x["doc_id"]: x["runs"] for x in periodic.periodic_runs(edges).collect() if x["doc_id"] in (5, 8)}
    assert [tuple(x) for x in long[8]] == [(0, 3000, 1)] and all(x["length"] >= max(6, 4 * x["period"]) for x in long[5]) and long[5]


@pytest.mark.parametrize("longest", [periodic.LONGEST, 2, 8])
def test_runs_at_every_block_length(longest):
    r = random.Random(longest)
    for _ in range(60):
        many = [[r.randint(1, r.choice((1, 2, 3, 12))) for _ in range(r.choice((0, 1, 6, 40, 130)))] for _ in range(3)]
        for w in many:
            if w and r.random() < 0.7:
                a, p = r.randrange(len(w)), r.randint(1, max(1, len(w) // 4))
                for k in range(a + p, len(w)):
                    w[k] = w[k - p]
        ends = np.cumsum([len(w) + 1 for w in many])
        seq = np.array([x for k, w in enumerate(many) for x in (*w, 100 + k)])
        want = [(s + int(ends[k]) - len(w) - 1, n, q) for k, w in enumerate(many) for s, n, q in all_runs(w)]
        assert periodic.found_runs(seq, ends, longest) == want


def test_transforms_are_exact():
    x = np.random.default_rng(1).integers(0, periodic.PRIME, (2, 1 << 13)).astype(float)
    for n in (2, 64, 128, 4096, 8192):
        part = periodic.reduced(x[:, :n].copy())
        assert np.array_equal(periodic.inverse(periodic.transform(part.copy())), part)
    a, b = x[0, :40] % 1000, x[1, :40] % 1000
    pad = lambda v: periodic.transform(np.concatenate([v, np.zeros(128 - len(v))])[None])
    got = periodic.inverse(periodic.reduced(pad(a) * pad(b)))[0, :79]
    assert np.array_equal(np.mod(got, periodic.PRIME), np.mod(np.convolve(a, b), periodic.PRIME))


def test_quality_votes(spark, edges):
    r = random.Random(2)
    clean = lambda: " ".join(r.choice(("the", "of", "reth", "ing", "wheth", "and", "ration")) + str(r.randint(0, 9)) * (r.random() < 0.05) for _ in range(r.randint(30, 90))) + "."
    junk = lambda: r.choice((" ".join(r.choice(("the&&&", "of###", "reth%%%")) for _ in range(60)), "WHY!! " * 40, "same same " * 50))
    rows = [(i, clean() if i % 3 else junk()) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(10_000, 1), (None, 0), (5, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.query(docs, labels).collect()}
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x["score"] <= 1 for i, x in got.items())
    held = [i for i, x in got.items() if x["held_out"]]
    assert len(held) > 100 and sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) >= 0.97 * len(held)
    # Equal texts score alike, however they are dealt; labels of held-out rows do not matter.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {x["doc_id"]: x["score"] for x in quality.query(docs.repartition(7), flipped).collect()} == {i: x["score"] for i, x in got.items()}
    out = quality.query(edges, labels).collect()
    assert len(out) == len(ROWS) and len({x["score"] for x in out if x["doc_id"] in (2, 3, 4)}) == 1
    assert quality.query(edges.limit(0), labels).count() == 0
    assert {x["score"] for x in quality.query(edges, labels.limit(0)).collect()} == {0.5}


def test_quality_vote_equals_all_cosines():
    g = np.random.default_rng(4)
    x, y = np.abs(g.normal(size=(300, sum(quality.SIZES)))) * (g.random((300, sum(quality.SIZES))) < 0.05), (g.random(300) < 0.8).astype(float)
    m = quality.Model(x, y)
    got = m.scores(x[:20])
    z = (x[:20] * m.weight) @ m.directions
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for k in range(20):
        sim = np.round(z[k] @ m.neighbours.T, 6)
        best = sorted(range(300), key=lambda j: (-sim[j], j))[: quality.NEAREST]
        w = np.maximum(sim[best], 0) ** quality.POWER
        assert abs((w * y[best]).sum() / w.sum() - got[k]) < 1e-6
    assert m.scores(np.zeros((2, x.shape[1]))).tolist() == [y.mean()] * 2


def by_hand(docs):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    trees, rows = {}, []
    for r in docs:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        text = r["text"].replace("\n", "") if bad and r["text"] is not None else r["text"]
        trees.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, text), r["doc_id"]))

    def climbed(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = range(i - i % 3, min(i - i % 3 + 3, len(nodes)))
                paths[k].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
            nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
        return nodes[0], paths

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: (sorted(trees[s]), *climbed([x[2] for x in sorted(trees[s])])) for s in names}
    root, tops = climbed([built[s][1] for s in names])
    for s, top in zip(names, tops):
        mine, sub, paths = built[s]
        for (_, _, leaf_, bad, i), path in zip(mine, paths):
            folded, proof = bad, ""
            for left, right in path + top:
                folded, proof = sha("".join(left) + folded + "".join(right)), proof + "".join(left + right)
            rows.append(str((i, leaf_, sub, root, sha(proof), folded, folded == root)))
    return sorted(rows)


@pytest.mark.parametrize("deep", [1, 2, 6])
def test_manifest_equals_brute_force(spark, edges, deep):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edges.select("doc_id", "text", "lang", "source", "n_chars"))
    got = sorted(str(tuple(r)) for r in merkle.query(docs, deep).collect())
    assert got == by_hand([r.asDict() for r in docs.collect()])


def test_manifest_sql_and_edges(spark, edges):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(str(tuple(r)) for r in merkle.query(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == sorted(str(r) for r in con.execute(merkle.ORACLE).fetchall())
    assert merkle.query(edges.limit(0)).count() == 0
    alone = merkle.query(edges.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0]["leaf"] == alone[0]["subroot"] == alone[0]["root"] and alone[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    out = merkle.manifest(edges, {"text": F.lit("other")}, F.col("doc_id") == 3).collect()
    assert [len(r["copied"]) > 0 for r in out if r["doc_id"] == 3] == [True] and not any(r["copied"] for r in out if r["doc_id"] != 3)


def test_long_near_copies_are_not_multiplied(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    near, far = base[:], [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    near[100] = "changed"
    rows, seen = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), *((10 + i, "a b c d e f g") for i in range(5))], []
    work = simhash._work
    monkeypatch.setattr(simhash, "_work", lambda rows_, *a: seen.append(work(rows_, *a)) or seen[-1])
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, **{10 + i: 10 for i in range(5)}}
    # Two sets of some 300,000 hashes, each once for the pair that they make and at most once more, in rows of a bounded size.
    hashes, longest = seen[-1].where("piece is not null").agg(F.sum(F.size("s")), F.max(F.size("s"))).first()
    assert hashes <= 3 * 600_000 and longest <= simhash.PIECE
