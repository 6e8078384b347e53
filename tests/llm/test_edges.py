"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables: a row for each row, equal for equal."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.llm import bpe, decontaminate, langid, licenses, linededup, media, simhash, toxicity, warc

CLASH = ("score", "component_id", "row", "h", "n", "digest", "fp", "labels", "found", "toxic", "held_out", "region", "words", "line_keys", "share")
R = random.Random(6)
LONG = " ".join(R.choice(("the", "of", "mit", "license", "under", "reth", "blely", "idiot")) for _ in range(120_000))
SAME = "released under the mit license\nthe thing and the other"
ROWS = [(1, SAME), (1, SAME), (2, None), (3, ""), (4, " \n\t"), (None, SAME), (None, None), (5, LONG), (6, "y" * 300_000), (7, "É日本 ½ \x00 z"), *((20 + i, SAME) for i in range(30))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[k % 3], f"s{k % 12}") for k, (i, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def labels(spark):
    return spark.createDataFrame([(i, int(i is not None and i % 2)) for i, _ in ROWS], "doc_id long, toxic int")


OPERATORS = {
    "op2": lambda spark, d: toxicity.query(d, labels(spark)),
    "op3": lambda spark, d: langid.query(d, ["▁the", "▁t", "h", "e", "▁m", "it", "▁"]),
    "op4": lambda spark, d: simhash.query(d),
    "op5": lambda spark, d: linededup.query(d),
    "op7": lambda spark, d: bpe.query(d),
    "op9": lambda spark, d: media.query(d),
    "op10": lambda spark, d: licenses.query(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, docs, name):
    if name == "op7":
        pytest.importorskip("public_tokenizers")
    run = OPERATORS[name]
    got = run(spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert len({str(r) for r in got if r["doc_id"] == 1}) == 1
    assert run(spark, docs.limit(0)).count() == 0


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(1, "released under the mit license the thing and the other"), (1, "released under the mit license the thing and the other"), (2, None), (3, "")], "item_id long, text string")
    items = items.withColumns({c: F.lit("clash") for c in CLASH})
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.query(docs, items).collect()]
    assert sorted(map(str, got)) == sorted(str((i, 1)) for i in {i for i, t in ROWS if t == SAME})
    assert decontaminate.query(docs.limit(0), items).count() == decontaminate.query(docs, items.limit(0)).count() == 0


def test_warc_edges(spark):
    rows = [(1, "u", "x" * 2000), (1, "u", "x" * 2000), (2, None, "x" * 2000), (3, "u", None), (4, "u", ""), (5, "u", LONG), (6, "u", "short"), (7, "v", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("payload_digest", "chunk", "kind", "offset", "score")})
    got = warc.query(pages).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6, 7]
    by = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert by[1] == ("revisit", 2) and by[2] == ("response", None) and by[6] == by[7] == ("response", None)
    assert warc.query(pages.limit(0)).count() == 0
