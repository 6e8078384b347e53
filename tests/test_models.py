"""Model steps: every row comes back once, whatever the model does, and the answers are those of a sequential replay."""

import json
from collections import defaultdict

from pyspark.sql import types as T

from scholium.operators import models as M

CHUNK = "doc_id long, chunk_id string, chunk_index int, section string, text string"
ONE = T.StructType([T.StructField("n", T.LongType())])


def chunks(n_docs=12):
    out = []
    for d in range(n_docs):
        for k in range(d % 11):
            body = " ".join(f"Sentence {s} of chunk {k} in document {d} says that {'word' * (s % 3 + 1)} matters." for s in range(1 + (d * k) % 40))
            out.append((d, f"{d}_c{k}", k, None if k % 2 else "Intro", body + (" fail!" if d == 7 and k == 2 else "")))
    return out


def test_propositions_equal_a_sequential_replay(spark):
    rows = chunks()
    got = sorted((r["doc_id"], r["prop_id"], r["chunk_id"], r["text"], r["way"]) for r in M.propositions(spark.createDataFrame(rows, CHUNK).repartition(5), M.sentence_model).collect())
    by_doc, want = defaultdict(list), []
    for r in rows:
        by_doc[r[0]].append(r)
    for doc, mine in by_doc.items():
        batches, size = [[]], 0
        for r in mine:
            if batches[-1] and (len(batches[-1]) == 8 or size + len(r[4]) + 60 > 8000):
                batches.append([])
                size = 0
            batches[-1].append(r)
            size += len(r[4]) + 60
        n = 0
        for batch in batches:
            try:
                text = "\n\n---CHUNK BOUNDARY---\n\n".join(f"[Section: {r[3] or 'untitled'}]\n{r[4]}" for r in batch)
                said = [s for s in json.loads(M.sentence_model(text[:8000])[8:-4]) if len(s) > 10]
            except RuntimeError:
                said = []
            for r in batch:
                words = set(r[4].lower().split())
                mine = sorted(((len(words & set(p.lower().split())), p) for p in said), reverse=True)
                mine = [p for k, p in mine if k >= max(3, 0.05 * len(words))]
                for p in mine or M.sentences(r[4]):
                    want.append((doc, f"{doc}_p{n}", r[1], p, "model" if mine else "default"))
                    n += 1
    assert got == sorted(want) and {w[4] for w in want} == {"model", "default"} and max(len(b) for b in [want]) > 100


def test_no_row_is_lost_or_doubled(spark):
    df = spark.createDataFrame([(i % 5, i, "x" * (i % 90)) for i in range(400)] + [(None, 900, None)], "g long, i long, text string")
    for parse in (lambda t, b: [], lambda t, b: [[{"n": 1}]], lambda t, b: [[{"n": 1}, {"n": 2}]] * 50, lambda t, b: 1 / 0, lambda t, b: [None, []]):
        step = M.Step(lambda b: "".join(r["text"] or "" for r in b), parse, lambda r: [{"n": -1}], 7, 200, lambda r: len(r["text"] or ""))
        for group, order in ((["g"], ["i"]), ([], [])):
            got = M.infer(df, lambda p: p, step, ONE, group, order, ["g", "i"]).collect()
            assert sorted((r["i"] for r in got)) == sorted(r["i"] for r in df.collect())
            assert all(r["way"] == "model" or [a["n"] for a in r["answers"]] == [-1] for r in got)
    assert M.infer(df.limit(0), lambda p: p, step, ONE, ["g"], ["i"], ["i"]).count() == 0


def test_batches_keep_the_budgets():
    step = M.Step(lambda b: "", lambda t, b: [], lambda r: [], 8, 100, lambda r: r["size"])
    rows = [{"g": k // 20, "size": (k * 37) % 120} for k in range(100)]
    batches = list(M.packed(iter(rows), step, ["g"]))
    assert [r for b in batches for r in b] == rows
    assert all(len(b) <= 8 and len({r["g"] for r in b}) == 1 and (len(b) == 1 or sum(r["size"] for r in b) <= 100) for b in batches)


def test_entities_and_relations(spark):
    props = spark.createDataFrame([(1, 0, "learning transformers helps retrieval systems"), (1, 1, "transformers and retrieval matter; Section 3 not"), (2, 0, "short words only"), (3, 0, None)], "doc_id long, n int, text string")
    found, ends = M.entities(props, M.keyword_model, rows=1)
    assert {(r["doc_id"], r["name"]) for r in found.collect()} == {(1, "learning"), (1, "transformers"), (1, "retrieval")}
    assert sorted((r["source_name"], r["target_name"]) for r in ends.collect()) == [("learning", "transformers"), ("transformers", "retrieval"), ("transformers", "retrieval")]
    broken, none = M.entities(props, lambda p: "no json {", rows=2)
    assert broken.count() == none.count() == 0
    odd = json.dumps({"entities": [{"name": "ab", "description": "d"}, {"name": "figure 3", "description": "d"}, {"name": "Same", "description": "same"}, {"name": None}, 5, {"name": "Good one", "description": "fine"}], "relationships": [{"source": "Good one", "target": "ab"}, {"source": "good ONE", "target": "Good one"}]})
    found, ends = M.entities(props, lambda p: odd)
    assert {(r["doc_id"], r["name"], r["type"]) for r in found.collect()} == {(d, "Good one", "concept") for d in (1, 2, 3)} and ends.count() == 3


def test_relevance_pads_and_clamps(spark):
    papers = spark.createDataFrame([(f"p{k}", "t" * k, None) for k in range(1, 40)], "id string, title string, abstract string")
    got = {r["id"]: (r["llm_relevance"], r["llm_rationale"]) for r in M.relevance(papers.repartition(3), M.title_model, rows=4).collect()}
    for k in range(1, 40):
        assert got[f"p{k}"] == ((5, "not scored") if k % 7 == 0 else (5 if k % 5 == 0 else max(0, min(10, k - 10)), f"{k} characters"))


def test_json_of_an_answer():
    assert M.parsed_json('```json\n["a"]\n``` more') == ["a"] and M.parsed_json('so: [1, 2] ok') == [1, 2] and M.parsed_json("[1, 2") is None and M.parsed_json("") is None
    assert M.parsed_json('x {"a": 1} y', "{") == {"a": 1} and M.parsed_json('["a"]', "{") is None


def test_entities_are_told_apart_where_they_were_asked_for(spark):
    """Names that a document has had, in whatever case and prompt, are dropped in the task that asks; nothing is shuffled or sorted once more, and no relation is made to be thrown away."""
    rows = [(1, 0, "Learning and retrieval"), (1, 1, "learning"), (1, 2, "RETRIEVAL and ranking"), (2, 0, "learning"), (None, 0, "ranking"), (None, 1, "Ranking"), (3, 0, None)]
    props = spark.createDataFrame(rows, "doc_id long, n int, text string").repartition(3)
    said = lambda prompt: json.dumps({"entities": [{"name": w, "description": f"from {prompt[3:11]}"} for w in prompt.translate(str.maketrans("", "", '-"')).split() if len(w) > 5], "relationships": [{"source": "learning", "target": "learning"}]})
    for size in (1, 30):
        found = M.entities(props, said, rows=size)[0]
        assert sorted(((r["doc_id"] or 0), r["name"]) for r in found.collect()) == [(0, "ranking"), (1, "Learning"), (1, "ranking"), (1, "retrieval"), (2, "learning")]
    plan = M.entities(props, said)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Aggregate" not in plan
    assert M.entity_step(relations=False).parse(said('- "learning"'), [{"text": ""}, {"text": ""}])[0][0]["name"] == "learning"
    assert [len(x) for x in M.entity_step(relations=False).parse(said('- "learning"'), [{}, {}])] == [1, 0] and len(M.entity_step().parse(said('- "learning"'), [{}])[0]) == 2
