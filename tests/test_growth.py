"""Work that grew faster than its input."""

import re
import time

import __spark_entry__ as entry
from pyspark.sql import functions as F

from scholium.functions import text as X
from scholium.operators import blocks as B
from scholium.operators import documents as D
from scholium.operators import papers as P
from scholium.operators import retrieval as S
from scholium.operators.keywords import KeywordIndex


def test_lines_are_made_once_for_a_text_and_not_once_for_each_line(spark):
    n = 20_000
    text = "# A title\n" + "\n".join(f"  line {i} " for i in range(n)) + "\nWhy HTML?\nlast"
    began = time.time()
    got = spark.createDataFrame([(text,)], "text string").select(X.strip_boilerplate(F.col("text")).alias("t")).first()["t"]
    assert time.time() - began < 30
    assert got.startswith("# A title\n  line 0 \n") and got.endswith(f"line {n - 1}")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_taken_apart_once_and_not_for_a_filter_too(spark):
    docs = spark.createDataFrame([(1, "a word and a word"), (2, ""), (3, None)], "doc_id long, text string")
    assert plan_of(S.postings(docs, "doc_id", "text")).count("regexp_replace") == 1
    assert plan_of(D.propositions(docs)).count("split(") == 1
    assert sorted(map(tuple, S.postings(docs, "doc_id", "text").select("token", "tf").collect())) == [("and", 1), ("word", 2)]


def test_an_index_is_searched_within_tasks(spark, tmp_path):
    """Words of all documents and queries: what a query shares with a document is no row of a join."""
    index = KeywordIndex(spark, f"file://{tmp_path}/index", buckets=4)
    docs = spark.createDataFrame([(i, f"common words{i % 3} " + "common " * (i % 4)) for i in range(40)], "doc_id long, text string")
    index.add(docs, 0)
    items = spark.createDataFrame([(i, f"common words{i % 3}") for i in range(9)] + [(None, "common")], "item_id long, text string")
    hits = index.search(items, k=5)
    assert "MapInPandas" in plan_of(hits) and index.sizes() == (40, sum(2 + i % 4 for i in range(40)) / 40)
    key = lambda df: sorted(map(str, df.selectExpr("qid", "id", "round(score, 6)", "rank").collect()))
    assert key(hits) == key(S.bm25(docs, items, k=5)) and hits.where("qid is null").count() == 5


def test_an_inverted_index_shuffles_texts_and_not_words(spark):
    docs = spark.createDataFrame([(1, "b a b"), (1, "c"), (2, ""), (3, None)], "doc_id long, text string")
    index = D.inverted_index(docs)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    assert {r["doc_id"]: {k: sorted(v) for k, v in r["index"].items()} for r in index.collect()} == {1: {"a": [1], "b": [0, 2], "c": [0]}, 2: {"": [0]}}


def test_blocks_that_one_task_holds_are_few(spark):
    """Forty blocks meet in more than one task, and all pairs are found."""
    v = spark.range(400).selectExpr("id", "array(cast(id % 7 as float), 1.0f) as embedding")
    met = B._met(B.blocks(v, 10))
    most = met.groupBy("i", "j", "side").count().agg(F.max("count")).first()[0]
    assert most <= 16 and met.select("i", "j").distinct().count() > 1
    assert B.similar_pairs(v, 0.5, 10).count() == 400 * 399 // 2


def test_encoding_tries_only_lengths_that_tokens_with_these_last_symbols_have():
    from scholium.llm.bpe import Encoder

    merges = ["a b", "ab c</w>", "c d", "ab cd", "abcd e</w>"]
    vocab = {t: i for i, t in enumerate([*"abcde", *(f"{x}</w>" for x in "abcde"), *(m.replace(" ", "") for m in merges)])}
    encoder = Encoder({"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}})
    assert encoder.sizes == {"abc</w>": [3, 2, 1], "bcd": [4, 2, 1], "cde</w>": [5, 2, 1]}
    assert encoder.short("abcdabc") == ["abcd", "abc</w>"] and encoder.short("eab") == ["e", "a", "b</w>"]


def test_citations_are_looked_up_before_they_are_made_single(spark, tmp_path):
    rows = [(f"p{i % 40}", f"p{i * 7 % 40}", i % 2 == 0, i % 3 == 0) for i in range(400)] * 2
    spark.createDataFrame(rows, "citing string, cited string, is_influential boolean, is_methodology boolean").write.parquet(f"{tmp_path}/cites")
    spark.createDataFrame([("p3",), ("p5",), ("p3",), (None,)], "id string").write.parquet(f"{tmp_path}/ids")
    cites, ids = spark.read.parquet(f"{tmp_path}/cites"), spark.read.parquet(f"{tmp_path}/ids")
    some, single = P.touching(cites, ids), P.single_edges(cites)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, single.where("citing in ('p3', 'p5') or cited in ('p3', 'p5')").collect()))
    assert sorted(map(tuple, P.touching(cites, ids, ("cited",)).collect())) == sorted(map(tuple, single.where("cited in ('p3', 'p5')").collect()))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [citing") < plan.index("Join LeftOuter")


def test_a_search_makes_papers_and_citations_once(spark, monkeypatch):
    """Each table that is made of line items is made once, however many steps look it up; no roots where none are asked for."""
    from scholium.plans import increments

    made, plain = [], increments.view
    monkeypatch.setattr(increments, "view", lambda spark, sf_dir, name: (made.append(name), plain(spark, sf_dir, name))[1])
    monkeypatch.setattr(increments.H, "roots", lambda *a: made.append("roots"))
    found = entry.queries()["search_expanded"](spark, "/root/testdata/sf0.001")
    assert sorted(made) == ["v_author", "v_cite", "v_paper"] and found.count()
    assert not re.search("lineitem", found._jdf.queryExecution().optimizedPlan().toString())


def test_records_are_numbered_before_their_texts_are_made(spark, monkeypatch):
    """Numbering samples, sorts and writes keys and names only; the records are those of the view's SQL."""
    import duckdb

    from scholium.sources import fixtures

    seen, plain = [], fixtures.numbered
    monkeypatch.setattr(fixtures, "numbered", lambda df, *a: (seen.append(df.columns), plain(df, *a))[1])
    sf = "/root/testdata/sf0.001"
    got = fixtures.view(spark, sf, "v_paper_raw")
    assert seen == [["l_partkey", "l_suppkey", "p_partkey", "p_name"]]
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({fixtures.COMMON['v_paper_raw']})").fetchall())


def test_titles_lose_everything_but_letters_and_digits_in_one_pass(spark):
    titles = [" A--b\t\n c ", "Ünïcode—title 9", "…", "", None, "x 1", "🙂 y🙂🙂z"]
    column = X.normal_title(F.col("t"))
    got = [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").orderBy("i").select(column.alias("n")).collect()]
    assert got == [None if t is None else re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t.lower(), flags=re.ASCII), flags=re.ASCII).strip(" ") for t in titles]
    assert str(column).count("regexp_replace") == 1
