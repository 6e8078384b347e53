"""Documents to sections, chunks and propositions; chat history; usage of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import written

TARGET, MOST, LEAST = 600, 800, 100
HISTORY = 10


def from_text(docs: DataFrame) -> DataFrame:
    """Ids from content, abstract and token estimate of raw texts."""
    return docs.select("doc_id", X.content_id(F.substring("text", 1, 2000)).alias("content_id"), F.substring("text", 1, 500).alias("abstract"), X.token_estimate(F.col("text")).alias("token_estimate"))


def from_metadata(papers: DataFrame) -> DataFrame:
    """A small document from title, venue, year and abstract; records without title and abstract go."""
    content = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Venue: "), "venue"), F.concat(F.lit("Year: "), F.col("year").cast("string")), F.concat(F.lit("\n## Abstract\n"), "abstract"))
    kept = papers.where((F.coalesce("title", F.lit("")) != "") | (F.coalesce("abstract", F.lit("")) != ""))
    return kept.select("id", content.alias("content")).withColumn("doc_id", X.content_id(F.col("content")))


def propositions(docs: DataFrame, least: int = 20) -> DataFrame:
    """One row for each sentence of ``least`` characters or more, numbered within its document."""
    split = X.unrolled(docs.select("doc_id", F.posexplode_outer(X.sentences(F.col("text"), least)).alias("n", "text")), "text")
    return split.select("doc_id", F.concat_ws("_p", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("prop_id"), "n", "text")


def _packed(paragraphs: Column, target: int, most: int) -> Column:
    """Greedy packing of paragraphs: a full buffer is closed before a paragraph that would exceed ``most``, and at ``target``."""
    size = lambda x: F.floor(F.length(x) / 4).cast("int")
    none = F.array().cast("array<string>")
    closed = lambda done, buf: F.concat(done, F.array(F.array_join(buf, "\n\n")))

    def step(s: Column, p: Column) -> Column:
        over = (s["cur"] + size(p) > most) & (F.size(s["buf"]) > 0)
        done = F.when(over, closed(s["done"], s["buf"])).otherwise(s["done"])
        buf = F.concat(F.when(over, none).otherwise(s["buf"]), F.array(p))
        cur = F.when(over, size(p)).otherwise(s["cur"] + size(p))
        full = cur >= target
        return F.struct(F.when(full, closed(done, buf)).otherwise(done).alias("done"), F.when(full, none).otherwise(buf).alias("buf"), F.when(full, F.lit(0)).otherwise(cur).alias("cur"))

    start = F.struct(none.alias("done"), none.alias("buf"), F.lit(0).alias("cur"))
    return F.aggregate(paragraphs, start, step, lambda s: F.when(F.size(s["buf"]) > 0, closed(s["done"], s["buf"])).otherwise(s["done"]))


def chunks(docs: DataFrame, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Chunks of a document's sections: a section whole if it is small enough, else its paragraphs packed; tiny pieces go; a
    document left without a chunk keeps its first 3200 characters. Blank and null documents have none. All in-row: no shuffle."""
    size = lambda x: F.floor(F.length(x) / 4)
    paragraphs = lambda body: F.filter(F.transform(F.split(body, r"\n\n+"), X.stripped), lambda x: x != "")
    pieces = lambda s: F.when(size(s["body"]) <= most, F.array(s["body"])).otherwise(_packed(paragraphs(s["body"]), target, most))
    titled = F.flatten(F.transform(X.split_sections(F.col("text")), lambda s: F.transform(pieces(s), lambda x: F.struct(s["title"].alias("section"), x.alias("text")))))
    found = docs.where(X.stripped(F.col("text")) != "").select("doc_id", "text", F.filter(titled, lambda x: size(x["text"]) >= least).alias("parts"))
    first = F.struct(F.lit("").alias("section"), F.substring(X.stripped(F.col("text")), 1, 4 * most).alias("text"))
    out = found.select("doc_id", F.posexplode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array(first))).alias("chunk_index", "c"))
    return out.select(F.concat_ws("_c", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "c.section", "c.text", X.token_estimate(F.col("c.text")).alias("token_estimate"))


def assigned(props: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows ``(prop_id, chunk_id, shared)``: propositions to chunks of their document with enough words in common. Words are made once for
    each side; a document's propositions meet its chunks as sets of words."""
    words = lambda df, key, name: written(df.select("doc_id", key, F.array_distinct(X.tokens(F.col("text"))).alias(name)), name)
    need = F.greatest(F.lit(3.0), 0.05 * F.size("theirs"))
    both = words(props, "prop_id", "mine").where(F.size("mine") >= 3).join(words(parts, "chunk_id", "theirs"), "doc_id")
    met = both.select("prop_id", "chunk_id", F.size(F.array_intersect("mine", "theirs")).cast("long").alias("shared"), need.alias("need"))
    return met.where("shared >= need").select("prop_id", "chunk_id", "shared")


def chunk_propositions(props: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows ``(chunk_id, way, text)``: the propositions assigned to each chunk, or, where there is none, the chunk's own sentences."""
    props, parts = written(props.select("doc_id", "prop_id", "text"), "props"), written(parts.select("doc_id", "chunk_id", "text"), "parts")
    got = written(assigned(props, parts), "assigned")
    matched = got.join(props.select("prop_id", "text"), "prop_id").select("chunk_id", F.lit("assigned").alias("way"), "text")
    alone = parts.join(got.select("chunk_id"), "chunk_id", "left_anti")
    return matched.unionByName(alone.select("chunk_id", F.lit("sentence").alias("way"), F.explode(X.sentences(F.col("text"))).alias("text")))


def inverted_index(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, index)``: a map from word to positions, as bibliographic dumps carry abstracts. Texts are shuffled, not their words."""
    words = X.unrolled(docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode_outer(F.split("text", " ")).alias("pos", "word")), "word")
    return words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))


def from_inverted_index_column(index: Column) -> Column:
    """The text of an inverted index, in-row: no shuffle. Null for a null index."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")


def from_inverted_index(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", from_inverted_index_column(F.col("index")).alias("text"))


def context_queries(messages: DataFrame, last: int = 3) -> DataFrame:
    """User turns with what to search for: the message itself, or, from the third message on, the user's words among the last ``last``."""
    by = W.partitionBy("conv_id").orderBy("turn")
    said = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(by.rowsBetween(-last + 1, 0))
    asked = messages.withColumn("nth", F.row_number().over(by)).withColumn("query", F.when(F.col("nth") >= last, F.array_join(said, " ")).otherwise(F.col("text")))
    return asked.where("role = 'user'").select("conv_id", "turn", "query")


def chat_history(messages: DataFrame, turns: int = HISTORY) -> DataFrame:
    """For each turn the ``turns`` before it, cut to 200 characters, with their speaker."""
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("text", 1, 200))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-turns, -1)
    return messages.select("conv_id", "turn", F.array_join(F.collect_list(said).over(before), "\n").alias("history"))


def usage(log: DataFrame) -> DataFrame:
    """Calls and estimated tokens by model, with the total under a null model."""
    return log.rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum(X.token_estimate(F.col("text"), 1)).alias("tokens"))
