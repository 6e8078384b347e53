"""Scalar text functions as Columns: all of them run inside the JVM. Null in, null out, unless stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Venues of the first tier, and the phrases that mark a survey.
TIER_ONE = (
    "neurips", "nips", "icml", "iclr", "cvpr", "iccv", "eccv", "acl", "emnlp", "naacl", "aaai", "ijcai", "icra", "iros",
    "nature", "science", "cell", "pnas", "jmlr", "tmlr", "transactions on pattern analysis",
)
SURVEY_WORDS = ("survey", "review", "overview", "tutorial", "systematic review", "meta-analysis", "a comprehensive", "state of the art", "landscape", "taxonomy")
#: Signs of a page's footer, and the headings of the sections that a long paper keeps.
FOOTER_SIGNS = ("generated by latexml", "beta", "convert latex packages", "developer contributions", "why html?", "report github issue", "accessibility forum", "arxiv accessibility")
KEY_HEADINGS = (
    "abstract", "introduction", r"method(?:ology|s)?|approach|proposed\s+(?:method|approach|framework)", r"model|architecture|framework|system\s+(?:design|overview)",
    r"experiment(?:s|al)?|results?|evaluation|empirical", "discussion", r"conclusion(?:s)?|summary", r"related\s+work|background|prior\s+work|literature\s+review",
)
#: Where a section starts: a heading of one to three marks.
HEADING = r"(?m)(?=^#{1,3}\s+.+$)"
HEAD_LINE = r"\A(#{1,3})\s+(.+)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores with more than two characters."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda x: F.length(x) > 2)


def normal_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def slug(text: Column, size: int = 80) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(kept, r"\s+", "_"), 1, size)


def safe_key(text: Column, size: int = 64) -> Column:
    return F.substring(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "")), 1, size)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` made once a row, however often ``use`` names it, and inside of its lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unrolled(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` from an outer explosion, without the rows that an inner one would not make. Of an inner one Spark infers that the
    array is not empty, and makes all of it again to test that before the explosion."""
    return df.where(F.col(name).isNotNull())


def token_estimate(text: Column, least: int = 0) -> Column:
    return F.greatest(F.floor(F.length(text) / 4), F.lit(least))


def name_entropy(name: Column) -> Column:
    """Shannon entropy, in bits, of the characters of the lower-case name; 0 for an empty one."""
    chars = F.filter(F.split(F.lower(name), ""), lambda c: c != "")
    n = F.size(chars)
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - part(c) * F.log2(part(c)))
    return F.when(n > 0, F.abs(bits)).otherwise(F.lit(0.0))


def confidence(mentions: Column, n_docs: Column, kind: Column) -> Column:
    share = F.when(n_docs <= 0, 0.3).when(n_docs == 1, 0.5).when(n_docs == 2, 0.8).otherwise(1.0)
    return F.log2(mentions + 1) * share * F.when(kind == "concept", 0.5).otherwise(1.0)


def grams(name: Column, n: int = 3) -> Column:
    """The set of character n-grams; empty for shorter names."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(n)))
    return F.when(F.length(name) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    both = F.size(F.array_intersect(grams(a, n), grams(b, n)))
    either = F.size(F.array_union(grams(a, n), grams(b, n)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector divided by its norm; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def velocity(citations: Column, year: Column, year_now: int) -> Column:
    """Citations a year; without a plausible year the citations themselves."""
    return F.when(year.isNull() | (year < 1990), citations.cast("double")).otherwise(citations / F.greatest(F.lit(1), F.lit(year_now) - year + 1))


def venue_score(venue: Column, whole_words: bool = False) -> Column:
    edge = r"\b" if whole_words else ""
    tier = F.lower(venue).rlike("|".join(f"{edge}{v}{edge}" for v in TIER_ONE))
    return F.when(F.coalesce(F.trim(venue), F.lit("")) == "", 0.0).when(tier, 1.0).otherwise(0.3)


def is_survey(title: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", title, abstract).rlike(r"(?i)\b(" + "|".join(SURVEY_WORDS) + r")\b")


def novelty(similarity: Column, path: Column, community_a: Column, community_b: Column) -> Column:
    """``path`` -1: none. Communities: null if the entity is missing, negative if it has none."""
    far = F.when(path < 0, 1.0).otherwise(F.least(path / 5.0, F.lit(1.0)))
    apart = F.when(community_a.isNull() | community_b.isNull(), 0.5).when((community_a != community_b) & (community_a >= 0), 1.0).otherwise(0.3)
    return similarity * far * apart


def title_of(content: Column) -> Column:
    """The first ``# `` line among the first 20, without its mark; null if there is none."""
    lines = F.filter(F.transform(F.slice(F.split(content, "\n"), 1, 20), stripped), lambda x: x.startswith("# "))
    return stripped(F.substring(F.get(lines, F.lit(0)), 3, 1 << 30))


def abstract_of(content: Column) -> Column:
    """Up to 1000 characters after the first abstract marker there is, to a blank line or else 500; without a marker the first 500."""
    low, out = F.lower(content), stripped(F.substring(content, 1, 500))
    # The last condition set wins: markers in order of rank, the first one outermost.
    for marker in ("abstract\n", "abstract:", "## abstract"):
        rest = stripped(F.substring(content, F.locate(marker, low) + len(marker), F.lit(1000)))
        stop = F.locate("\n\n", rest)
        out = F.when(F.locate(marker, low) > 0, stripped(F.when(stop > 1, F.substring(rest, F.lit(1), stop - 1)).otherwise(F.substring(rest, 1, 500)))).otherwise(out)
    return out


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_sections(content: Column) -> Column:
    """Array of ``(title, body)``: text before the first heading under an empty title, then each section without its heading."""
    parts = F.filter(F.split(content, HEADING), lambda x: x != "")
    headed = lambda x: x.rlike(HEAD_LINE)
    out = F.transform(parts, lambda x: F.struct(
        F.when(headed(x), F.trim(F.regexp_extract(x, HEAD_LINE, 2))).otherwise("").alias("title"),
        stripped(F.when(headed(x), F.regexp_replace(x, HEAD_LINE, "")).otherwise(x)).alias("body"),
    ))
    return F.filter(out, lambda x: (x["title"] != "") | (x["body"] != ""))


def few_blank_lines(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"\n{3,}", "\n\n")


def key_sections(content: Column, chars_per_page: int = 3000, pages: int = 5) -> Column:
    """Of a long text with headings only the preamble and the key sections; others as they are."""
    key = r"(?i)\A#{1,3}\s+(?:\d+\.?\s*)?(?:" + "|".join(KEY_HEADINGS) + r")\b"

    def of(whole: Column, text: Column) -> Column:
        kept = F.filter(whole, lambda x: (x != "") & (~x.rlike(HEAD_LINE) | x.rlike(key)))
        joined = bound(kept, lambda k: F.when(F.size(k) > 0, few_blank_lines(F.array_join(F.transform(k, lambda x: F.concat(F.regexp_replace(x, r"\n\z", ""), F.lit("\n"))), "\n"))))
        return F.when(F.exists(whole, lambda x: x.rlike(HEAD_LINE)), joined)

    long = lambda x: F.length(x) > chars_per_page * pages
    return bound(content, lambda x: F.coalesce(F.when(long(x), bound(F.split(x, HEADING), lambda whole: of(whole, x))), x))


def strip_boilerplate(content: Column, tail: int = 50) -> Column:
    """From the first title or just above the first abstract heading, to the last footer sign among the last ``tail`` lines."""
    signs = "|".join(w.replace("?", r"\?") for w in FOOTER_SIGNS)

    def of(whole: Column, lines: Column) -> Column:
        size = F.size(lines)
        first = F.transform(lines, lambda x, i: F.when(x.startswith("# ") & (F.length(x) > 4), i).when(x.contains("abstract") & (x.startswith("#") | x.startswith("**")), F.greatest(F.lit(0), i - 2)))
        start = F.coalesce(F.get(F.filter(first, lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
        found = F.transform(lines, lambda x, i: F.when((i > F.greatest(size - tail, F.lit(0))) & x.rlike(signs), i))
        end = F.coalesce(F.array_max(found), size)
        return bound(start, lambda s: few_blank_lines(F.array_join(F.slice(whole, s + 1, F.greatest(end - s, F.lit(0))), "\n")))

    # Lines are made once: named in a lambda over lines they would be made again for each of them.
    return bound(F.split(content, "\n"), lambda whole: bound(F.transform(whole, lambda x: F.lower(stripped(x))), lambda lines: of(whole, lines)))


def sentences(text: Column, least: int = 20) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/|/shorts/|/v/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def model_json(answer: Column) -> Column:
    """The JSON inside a model's answer as a variant: fenced, bare, or the outermost object or array; else null."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n(.*?)```", 1), F.lit(""))
    body = F.trim(F.coalesce(fenced, answer))
    outer = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(outer))


def with_context(prefix: Column, text: Column) -> Column:
    p = F.trim(prefix)
    return F.when(F.coalesce(p, F.lit("")) == "", text).otherwise(F.concat(p, F.when(p.endswith("."), "").otherwise("."), F.lit("\n\n"), text))


def arxiv_slug(arxiv_id: Column) -> Column:
    return F.translate(arxiv_id, "/.", "__")


def no_version(arxiv_id: Column) -> Column:
    return F.split_part(arxiv_id, F.lit("v"), F.lit(1))


def content_id(content: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, n)


def clamp_score(value: Column) -> Column:
    """0 to 10; 5 where it is no number."""
    number = value.try_cast("int")
    return F.when(number.isNull(), 5).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), number)))


def identifier_kind(x: Column) -> Column:
    return (
        F.when(x.contains("arxiv.org") | x.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), "arxiv")
        .when(x.rlike(r"^10\.\d{4,}/"), "doi").when(x.startswith("s2:"), "s2").when(x.startswith("http"), "url")
        .when(x.contains("/"), "doi").otherwise("url")
    )


def best_identifier(arxiv_id: Column, doi: Column, s2_id: Column, paper_id: Column) -> Column:
    plain = F.regexp_replace(arxiv_id, r"v[12]$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(doi, F.lit("")), F.concat(F.lit("s2:"), F.nullif(s2_id, F.lit(""))), F.regexp_replace(paper_id, "manual:", ""))


def citation_key(paper_id: Column, arxiv_id: Column) -> Column:
    return F.when(paper_id.startswith("s2:"), F.substring(paper_id, 4, 1000)).when(F.coalesce(arxiv_id, F.lit("")) != "", F.concat(F.lit("ARXIV:"), no_version(arxiv_id)))


def front_matter(**columns: Column) -> Column:
    return F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in columns.items()), F.lit("---"))


def node_size(mentions: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(10), mentions * 2))
