"""Pages to documents by their tree: one linear pass over the tags, headings kept, title, key sections and abstract taken from them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Elements whose content is no part of the document; those without an end tag; those whose text ends only at their own end tag.
LEFT_OUT = frozenset("head script style nav header footer aside form noscript template svg iframe button select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: Elements that begin a block of their own; headings by level.
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form header hr li main nav ol p pre section table td th tr ul".split())
HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### "}
TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
SPACE = re.compile(r"\s+")


def tags(page: str) -> Iterator[tuple[str, str]]:
    """``("text", ...)``, ``("open", name)`` and ``("close", name)``, in order. What opens and never ends is text, looked for only once."""
    at, end, low = 0, len(page), page.lower()
    gone: set[str] = set()  # ends that do not come any more

    def find(what: str, start: int, where: str) -> int:
        if what in gone:
            return -1
        k = where.find(what, start)
        if k < 0:
            gone.add(what)
        return k

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            yield "text", page[at:start]
        if start == end:
            return
        if page.startswith("<!--", start):
            stop = find("-->", start + 4, page)
            at = stop + 3 if stop >= 0 else end
            continue
        stop = find(">", start, page)
        if stop < 0:
            yield "text", page[start:]
            return
        if page[start + 1 : start + 2] in ("!", "?"):
            at = stop + 1
            continue
        tag = TAG.match(page, start, stop)
        if not tag:
            yield "text", "<"
            at = start + 1
            continue
        name, at = tag.group(1).lower(), stop + 1
        if page[start + 1] == "/":
            yield "close", name
            continue
        yield "open", name
        if name in RAW:
            stop = find(f"</{name}", at, low)
            stop = end if stop < 0 else stop
            yield "text", page[at:stop]
            at = stop


def document(page: object) -> tuple[str | None, str]:
    """A page's ``<title>`` (null where there is none or a blank one), and its text: blocks a paragraph each, headings marked."""
    title, blocks, now, mark = None, [], [], ""
    stack: list[str] = []
    open_: Counter[str] = Counter()
    out = 0  # open elements that are left out

    def flush() -> None:
        nonlocal now, mark
        said = SPACE.sub(" ", html.unescape("".join(now)).replace("\xa0", " ")).strip()
        if said:
            blocks.append(mark + said)
        now, mark = [], ""

    def shut() -> None:
        nonlocal out
        name = stack.pop()
        open_[name] -= 1
        out -= name in LEFT_OUT

    for kind, what in tags(page if isinstance(page, str) else ""):
        if kind == "text":
            if stack and stack[-1] == "title":
                title = title or SPACE.sub(" ", html.unescape(what)).strip() or None
            elif not out:
                now.append(what)
            continue
        if (what in BLOCKS or what in HEADINGS or what == "br") and not out:
            flush()
        if kind == "open":
            if what in VOID:
                continue
            if what == "p" and stack and stack[-1] == "p":
                shut()
            if what == "body":
                # A head that was not ended ends here.
                while open_["head"]:
                    shut()
            stack.append(what)
            open_[what] += 1
            out += what in LEFT_OUT
            if what in HEADINGS and not out:
                mark = HEADINGS[what]
        elif open_[what]:
            while stack[-1] != what:
                shut()
            shut()
    flush()
    return title, "\n\n".join(blocks)


def documents(pages: DataFrame) -> DataFrame:
    """Rows ``(doc_id, page_id, title, content, abstract, source_type, source_url)`` of ``pages (page_id, url, html)``.

    The title is the first top heading, else the page's own; of a long document the preamble and the key sections stay; null pages are
    empty documents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [document(p) for p in pdf["html"]]
            yield pdf[["page_id", "url"]].assign(page_title=[t for t, _ in found], whole=[c for _, c in found])

    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, page_title string, whole string")
    title = F.coalesce(F.nullif(X.title_of(F.col("whole")), F.lit("")), "page_title")
    return rows.select(X.content_id(F.col("url")).alias("doc_id"), "page_id", title.alias("title"), X.key_sections(F.col("whole")).alias("content"), X.abstract_of(F.col("whole")).alias("abstract"), F.lit("url").alias("source_type"), F.col("url").alias("source_url"))
