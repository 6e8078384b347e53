"""Dump readers, stored tables, model-step defaults and compositions on small hand-written rows."""

import json

from pyspark.sql import functions as F

from scholium.operators import flows as C
from scholium.operators import inference as I
from scholium.sources import dumps, stored


def test_graph_api_dump(spark, tmp_path):
    rows = [
        {"paperId": "a", "title": " T  x ", "abstract": "y" * 1000, "year": 2020, "citationCount": 3, "externalIds": {"DOI": " 10.1/A", "ArXiv": "2401.00001"}, "authors": [{"authorId": "1", "name": "A"}, {"name": "B"}]},
        {"paperId": "b", "title": None, "year": "2020", "citationCount": "many", "unknown": 1},
        {"title": "no id", "year": 2020.5},
    ]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r["id"]: r for r in dumps.from_graph_api(spark, str(tmp_path), "angle").collect()}
    a, b = got["s2:a"], got["s2:b"]
    assert (a["title"], len(a["abstract"]), a["year"], a["citation_count"], a["doi"], a["arxiv_id"], len(a["authors"]), a["search_angles"]) == ("T x", 900, 2020, 3, "10.1/a", "2401.00001", 1, ["angle"])
    assert (b["title"], b["abstract"], b["year"], b["citation_count"], b["authors"]) == ("", "", None, 0, [])
    assert len(got) == 3 and all(r["year"] is None for k, r in got.items() if k not in ("s2:a",))


def test_works_dump_and_atom(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "d.json").write_text(json.dumps({"id": "W1", "display_name": "N", "doi": "https://doi.org/10.1/B", "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}}) + "\n" + json.dumps({"id": "W2"}))
    got = {r["id"]: r for r in dumps.from_works_api(spark, str(tmp_path / "w")).collect()}
    assert (got["openalex:W1"]["abstract"], got["openalex:W1"]["doi"], got["openalex:W2"]["abstract"]) == ("a b a b", "10.1/b", "")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.xml").write_text("<feed><entry><id>http://h/abs/2401.1v2</id><title>T\n u</title><summary>S</summary></entry><entry><title>V</title></entry></feed>")
    rows = dumps.from_atom(spark, str(tmp_path / "x")).collect()
    assert {(r["title"], r["arxiv_id"]) for r in rows} == {("T u", "2401.1v2"), ("V", "")}


def test_notes_keep_their_content(spark, tmp_path):
    text = "---\nlooks like front matter\n---\n" + "x" * 60
    docs = spark.createDataFrame([("abcdefghij", "A Title!", "web", "u", text), ("b", None, "web", None, "short"), ("c", "t", None, "u", None)], "doc_id string, title string, source_type string, source_url string, content string")
    stored.write_notes(stored.notes(docs), str(tmp_path / "n"))
    got = stored.read_notes(spark, str(tmp_path / "n")).collect()
    assert [(r["relative_path"], r["content"]) for r in got] == [("ingested/web/a_title_abcdefgh.md", text)]


def test_scan_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.md").write_text("# One\n\nbody")
    (tmp_path / "two.txt").write_text("no note")
    (row,) = stored.scan_notes(spark, str(tmp_path)).collect()
    assert (row["title"], row["body"], row["size"]) == ("one", "# One\n\nbody", 11)


def test_changes_skip_corrupt_lines(spark, tmp_path):
    (tmp_path / "log").write_text('{"seq": 1, "op": "add", "id": 5, "payload": 1.5, "synced": true}\n{"seq": 2, "op"\n{"seq": 3, "op": "merge", "id": 5}\n')
    assert sorted(r["seq"] for r in stored.read_changes(spark, str(tmp_path / "log")).collect()) == [1, 3]
    assert [r["seq"] for r in stored.read_changes(spark, str(tmp_path / "log"), unsynced=True).collect()] == [3]


def test_hashed_embedding_is_unit(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, ""), (3, None)], "doc_id long, text string")
    got = I.hashed_embedding(docs, "doc_id", "text").groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("n")).collect()
    assert [r["id"] for r in got] == [1] and abs(got[0]["n"] - 1) < 1e-9


def test_neighbouring_names_are_related(spark):
    s = spark.createDataFrame([(1, 0, "longname1 and longname2 or longname3 with longname3"), (1, 1, "longname1"), (2, 0, None)], "doc_id long, n int, text string")
    names = spark.createDataFrame([("longname1",), ("longname2",), ("longname3",)], "name string")
    assert sorted(tuple(r) for r in I.relations_of(s, names).collect()) == [("longname1", "longname2", 1), ("longname2", "longname3", 1)]


def test_valid_entity(spark):
    rows = spark.createDataFrame([("Graph", "a structure"), ("ab", "x"), ("the", "x"), ("Table 3", "x"), ("Graph", "graph"), ("Graph", None)], "name string, description string")
    assert [r[0] for r in rows.select(I.valid_entity(F.col("name"), F.col("description"), ["the"])).collect()] == [True, False, False, False, False, False]


def test_community_ranking(spark):
    c = spark.createDataFrame([(0, 5, "about trees"), (1, 2, "about cats"), (2, 30, " ")], "component int, size int, text string")
    m = spark.createDataFrame([(1, "cats"), (0, "oak")], "component int, name string")
    q = spark.createDataFrame([(7, ["cats"]), (8, ["none"])], "qid int, keywords array<string>")
    got = sorted((r["qid"], r["rank"], r["component"], r["score"]) for r in C.ranked_communities(c, m, q).collect())
    assert got == [(7, 1, 1, 25), (7, 2, 0, 5), (8, 1, 0, 5), (8, 2, 1, 2)]


def test_ingestion_counts(spark):
    docs = spark.createDataFrame([(1, "The framework uses embedding. The embedding helps the framework here."), (2, "A framework with an embedding is shown here."), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["propositions"], r["entities"], r["relations"]) for r in C.ingested(docs).collect()}
    assert got == {1: (2, 2, 2), 2: (1, 2, 1), 3: (0, 0, 0), 4: (0, 0, 0)}
    assert C.ingested(docs.where("false")).count() == 0


def test_routes(spark):
    rows = spark.createDataFrame([("2401.00001v2",), ("10.1234/x",), ("http://h/x",), ("s2:1",)], "i string").selectExpr("i", "'t' as title", "'a' as abstract")
    assert [(r["kind"], r["locator"]) for r in C.readable(rows, F.col("i")).collect()] == [
        ("arxiv", "https://arxiv.org/pdf/2401.00001"), ("doi", "https://doi.org/10.1234/x"), ("url", "http://h/x"), ("s2", "t\n\na"),
    ]
