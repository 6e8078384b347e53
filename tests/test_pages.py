"""Pages by their tree: against a parser of the standard library, and in linear time."""

import time
from html.parser import HTMLParser

import pytest

from scholium.operators import pages as P

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Words outside what is left out, by a parser that is not ours."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.out += tag in P.LEFT_OUT or tag == "title"

    def handle_endtag(self, tag):
        self.out -= tag in P.LEFT_OUT or tag == "title"

    def handle_data(self, data):
        if not self.out:
            self.words += data.split()


def test_given_pages_keep_their_words(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = Plain()
        plain.feed(r["html"] or "")
        title, content = P.document(r["html"])
        # Blocks cut words where no space stood; letters are the same, in order.
        assert "".join("".join(plain.words).split()) == "".join(x for x in content.replace("\n\n", " ").split(" ") if x not in ("#", "##", "###"))
        assert title and f"<title>{title}" in " ".join(r["html"].split()) or "&" in r["html"]


def test_documents_have_their_parts(spark):
    body = "<h1>Main &amp; first</h1><p>Opening words<p>second<br>line<h2>Abstract</h2><div>What it is about.</div><nav><a>menu</a></nav><h2>Other</h2>tail &lt;kept&gt;"
    rows = [(1, "u1", f"<html><head><title> Page\n title </title><style>p {{}}</style></head><body><header>top</header>{body}<script>if (a < b) x('</p>')</script></body></html>"), (2, "u2", None), (3, "u3", ""), (4, "u4", "<title>Only</title>plain a < b text"), (5, "u5", "<nav><nav>in</nav>still in</nav>out<!-- gone --><p>x")]
    got = {r["page_id"]: r for r in P.documents(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["title"] == "Main & first" and got[1]["abstract"] == "What it is about."
    assert got[1]["content"].split("\n\n") == ["# Main & first", "Opening words", "second", "line", "## Abstract", "What it is about.", "## Other", "tail <kept>"]
    assert (got[2]["title"], got[2]["content"], got[3]["content"]) == (None, "", "")
    assert (got[4]["title"], got[4]["content"]) == ("Only", "plain a < b text") and got[5]["content"] == "out\n\nx"
    assert P.documents(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    long = "# T\n\n".join(["<h1>T</h1>", *(f"<h2>{name}</h2><p>{'word ' * 2000}</p>" for name in ("Introduction", "Gossip", "Conclusion"))])
    kept = P.documents(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).first()["content"]
    assert "## Introduction" in kept and "## Conclusion" in kept and "## Gossip" not in kept


@pytest.mark.parametrize("page", ["<nav x>" * 150_000, "<a " * 350_000, "<!-- " * 250_000, "<b>" * 150_000 + "</i>" * 150_000 + "</b>" * 150_000, "<script>" * 130_000, "<" * 1_000_000, "<p><div>" * 130_000])
def test_a_megabyte_takes_seconds(page):
    began = time.time()
    P.document(page)
    assert time.time() - began < 10
