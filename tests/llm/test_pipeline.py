"""Each stage of the pipeline against brute force over its own input, with nulls, empty and repeated rows and clashing columns."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import decontaminate, langid, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cp():
    return pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark, cp):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    first = whole.orderBy("doc_id").first()
    extra = [(9001, None, "en", "s1", 0), (9002, "", "en", None, 0), (9003, "12 + 3", None, "s1", 6), (None, first["text"], None, "s2", 5), (first["doc_id"], first["text"], first["lang"], first["source"], first["n_chars"])]
    out = whole.unionByName(spark.createDataFrame(extra, whole.schema)).withColumns({c: F.lit(c) for c in ("line_keys", "lines_removed", "component_id", "h", "row")})
    return out.persist()


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_language_stage(spark, cp, docs):
    out = cp.STAGES[0][1](spark, docs, SF)
    assert out.columns == docs.columns
    pieces = langid.default_pieces()
    langs, logp = langid.learn(docs.select("doc_id", "text", "lang"), pieces)
    split = [(r, langid.LETTERS.findall((r["text"] or "").lower())) for r in docs.collect()]
    every, want = sorted({w for _, words in split for w in words}), []
    known = dict(zip(every, langid.Lattice(pieces, logp).log_likelihood(["▁" + w for w in every])))
    for r, words in split:
        if not words:
            continue
        total = sum(known[w] for w in words) / len(words) ** 0.5
        if 1 / np.exp(total - total.max()).sum() >= 0.5:
            want.append(str(r.asDict()))
    assert rows(out) == sorted(want) and len(want) < docs.count()


def test_line_stage(spark, cp, docs):
    out = cp.STAGES[1][1](spark, docs, SF)
    assert out.columns == docs.columns
    sites, first = defaultdict(set), {}
    for r in docs.collect():
        for line in {x.strip(" ") for x in (r["text"] or "").split("\n")} - {""}:
            if r["source"] is not None:
                sites[line].add(r["source"])
            if r["doc_id"] is not None:
                first[line] = min(first.get(line, r["doc_id"]), r["doc_id"])
    gone = {line for line, s in sites.items() if len(s) >= 10}
    want = []
    for r in docs.collect():
        d = r.asDict()
        if d["text"] is not None and d["doc_id"] is not None:
            lines = d["text"].split("\n")
            kept = [x for x in lines if x.strip(" ") not in gone or d["doc_id"] <= first[x.strip(" ")]]
            if len(kept) < len(lines):
                d["text"], d["n_chars"] = "\n".join(kept), len("\n".join(kept))
        want.append(str(d))
    assert rows(out) == sorted(want)


def test_near_duplicate_stage(spark, cp, docs):
    out = cp.STAGES[2][1](spark, docs, SF)
    assert out.columns == docs.columns
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"]).tolist()) for r in docs.collect() if r["doc_id"] is not None}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                    label[a], changed = label[b], True
    want = [str(r.asDict()) for r in docs.collect() if r["doc_id"] is None or label[r["doc_id"]] == r["doc_id"]]
    assert rows(out) == sorted(want) and len(want) < docs.count()


def leaked(text, item):
    size = min(20, len(item)) if len(item) >= 12 else len(item)
    need = size - (int(size * 0.2 + 1e-9) if len(item) >= 12 else 0)
    if len(item) < 5 or not len(text):
        return False
    at, place = np.nonzero(text[:, None] == item[None, :])
    shift, n = np.unique(at - place, return_counts=True)
    for s in shift[n >= need]:
        k = np.arange(len(item)) + s
        same = np.zeros(len(item), int)
        ok = (k >= 0) & (k < len(text))
        same[ok] = text[k[ok]] == item[ok]
        if np.convolve(same, np.ones(size, int), "valid").max() >= need:
            return True
    return False


def test_benchmark_stage(spark, cp, docs):
    out = cp.STAGES[3][1](spark, docs, SF)
    assert out.columns == docs.columns
    number = defaultdict(lambda: len(number))
    words = lambda t: np.array([number[w] for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())], int)
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None for text in [words(r["text"])] if any(leaked(text, item) for item in items)}
    want = [str(r.asDict()) for r in docs.collect() if r["doc_id"] not in bad]
    assert rows(out) == sorted(want) and bad
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {d for d, _ in pairs if d is not None} == bad


def test_empty_table_and_whole_run(spark, cp, docs):
    for k, (_, stage) in enumerate(cp.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0, k
    assert 0 < cp.run(spark, SF).count() < 200
