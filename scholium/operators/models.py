"""Steps that a caller's model takes: rows packed into prompts, answers parsed back to a list for each row, defaults where it fails.

``infer`` is the one surface. A step says how many rows and characters a prompt may hold, how the prompt is written, how the text that
comes back is parsed, and what stands for a row without an answer. Rows of one group are packed in their order; a group
is what one document makes, so it is as bounded as a document is. Every row comes back exactly once, with the answers it got.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inference import NO_ENTITY, STOP_NAMES

Row = dict[str, object]
Answers = list[Row]


@dataclass(frozen=True)
class Step:
    """A model step. ``prompt`` writes rows as one text, ``parse`` gives a list of answers for each of them (fewer lists than rows are
    padded, None stands for no answer), ``default`` answers for a row alone."""

    prompt: Callable[[list[Row]], str]
    parse: Callable[[str, list[Row]], list[Answers | None]]
    default: Callable[[Row], Answers]
    rows: int
    chars: int
    size: Callable[[Row], int]


def packed(rows: Iterator[Row], step: Step, group: list[str]) -> Iterator[list[Row]]:
    """Rows in their order, in batches of one group within the step's budgets; a row longer than the budget is a batch of its own."""
    batch: list[Row] = []
    chars, key = 0, None
    for row in rows:
        here, size = tuple(row[c] for c in group), step.size(row)
        if batch and (here != key or len(batch) >= step.rows or chars + size > step.chars):
            yield batch
            batch, chars = [], 0
        batch.append(row)
        chars, key = chars + size, here
    if batch:
        yield batch


def answered(model: Callable[[str], str], step: Step, batch: list[Row]) -> list[tuple[Answers, str]]:
    """A list of answers for each row of a batch and the way it came about; a failing model or parser leaves all to the default."""
    try:
        found = list(step.parse(model(step.prompt(batch)[: step.chars]), batch))[: len(batch)]
    except Exception:  # noqa: BLE001  (whatever a caller's model throws)
        found = []
    found += [None] * (len(batch) - len(found))
    return [(step.default(row), "default") if got is None else (got, "model") for row, got in zip(batch, found)]


def asked(rows: Iterator[Row], model: Callable[[str], str], step: Step, group: list[str], calls: int) -> Iterator[tuple[list[Row], list[tuple[Answers, str]]]]:
    """Batches of rows and what was answered, in their order; ``calls`` prompts are asked at once, and no more than twice as many batches are held."""
    with ThreadPoolExecutor(calls) as pool:
        held: list[list[Row]] = []
        for batch in packed(rows, step, group):
            held.append(batch)
            if len(held) == 2 * calls:
                yield from zip(held, pool.map(lambda b: answered(model, step, b), held))
                held = []
        yield from zip(held, pool.map(lambda b: answered(model, step, b), held))


def infer(df: DataFrame, model: Callable[[str], str], step: Step, answer: T.StructType, group: list[str], order: list[str], keep: list[str], calls: int = 3) -> DataFrame:
    """``df`` with ``answers`` (an array of ``answer``) and ``way`` (``model`` or ``default``), its columns ``keep``.

    Rows meet by ``group`` and are packed by ``order``; without a group they are packed as they lie, and nothing is shuffled.
    ``calls`` prompts of a task are asked at once, and no more batches than that are held.
    """
    if group:
        df = df.repartition(*group).sortWithinPartitions(*group, *order)
    out = T.StructType([*(df.schema[c] for c in keep), T.StructField("answers", T.ArrayType(answer)), T.StructField("way", T.StringType())])
    names = answer.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (row for pdf in batches for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"))
        rows: list[tuple] = []
        for batch, found in asked(each, model, step, group, calls):
            rows += [(*(row[c] for c in keep), [{n: a.get(n) for n in names} for a in got], way) for row, (got, way) in zip(batch, found)]
            if len(rows) >= 200:
                yield pd.DataFrame(rows, columns=out.names).astype("object")
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=out.names).astype("object")

    return df.mapInPandas(run, out)


def parsed_json(text: str, opening: str = "[") -> object:
    """The JSON value of an answer: in a fence, bare, or the outermost brackets in prose; None where there is none."""
    fence = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.DOTALL)
    text = (fence.group(1) if fence else text).strip()
    start, end = text.find(opening), text.rfind({"[": "]", "{": "}"}[opening])
    for part in (text, text[start : end + 1] if 0 <= start < end else ""):
        try:
            found = json.loads(part)
        except json.JSONDecodeError:
            continue
        if isinstance(found, list if opening == "[" else dict):
            return found
    return None


def sentences(text: str, least: int = 20) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if len(s) >= least]


# Propositions of chunks.

PROPOSITION = T.StructType([T.StructField("text", T.StringType())])


def _overlap(said: list[str], text: str) -> list[str]:
    """What an answer for several chunks says of this one: most words in common first."""
    words = set(text.lower().split())
    scored = sorted(((len(words & set(p.lower().split())), p) for p in said), reverse=True)
    return [p for n, p in scored if n >= max(3, 0.05 * len(words))]


def proposition_step(rows: int = 8, chars: int = 8000) -> Step:
    def prompt(batch: list[Row]) -> str:
        return "\n\n---CHUNK BOUNDARY---\n\n".join(f"[Section: {r['section'] or 'untitled'}]\n{r['text'] or ''}" for r in batch)

    def parse(text: str, batch: list[Row]) -> list[Answers | None]:
        said = [p for p in parsed_json(text) or [] if isinstance(p, str) and len(p) > 10]
        return [[{"text": p} for p in mine] if (mine := _overlap(said, str(r["text"] or ""))) else None for r in batch]

    return Step(prompt, parse, lambda r: [{"text": s} for s in sentences(str(r["text"] or ""))], rows, chars, lambda r: len(str(r["text"] or "")) + 60)


def propositions(chunks: DataFrame, model: Callable[[str], str], rows: int = 8, chars: int = 8000) -> DataFrame:
    """Rows ``(doc_id, prop_id, chunk_id, text, way)`` of ``chunks (doc_id, chunk_id, chunk_index, section, text)``: a document's chunks go
    to the model in prompts of ``rows`` chunks or ``chars`` characters; a chunk without a proposition of its own keeps its sentences."""
    got = infer(chunks.select("doc_id", "chunk_id", "chunk_index", "section", "text"), model, proposition_step(rows, chars), PROPOSITION, ["doc_id"], ["chunk_index"], ["doc_id", "chunk_id", "chunk_index"])
    each = got.select("doc_id", "chunk_id", "chunk_index", "way", F.posexplode("answers").alias("at", "a")).withColumn("text", F.trim("a.text")).where(F.length("text") >= 15)
    by_doc = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "at", "chunk_id", "way", "text"))).alias("p"))
    return by_doc.select("doc_id", F.posexplode("p").alias("n", "p")).select("doc_id", F.concat_ws("_p", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("prop_id"), "p.chunk_id", "p.text", "p.way")


# Entities and relations of propositions.

FOUND = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "name", "target", "type", "description")])


def _valid(name: str, description: str) -> bool:
    own = description.strip().lower()
    return len(name) >= 3 and name.lower() not in STOP_NAMES and own not in ("", name.lower()) and not re.match(NO_ENTITY, name)


def entity_step(rows: int = 30, chars: int = 5000, relations: bool = True) -> Step:
    """Answers of a prompt belong to its first row: entities that are valid, and ``relations`` between entities of the same answer."""

    def parse(text: str, batch: list[Row]) -> list[Answers | None]:
        said = parsed_json(text, "{")
        if not isinstance(said, dict):
            return []
        whole = lambda x, k, other="": (other if (v := x.get(k)) is None else str(v)).strip()
        of = lambda key: [x for x in said.get(key) or [] if isinstance(x, dict)]
        named = [{"kind": "entity", "name": whole(e, "name"), "type": whole(e, "type", "concept"), "description": whole(e, "description")} for e in of("entities")]
        named = [e for e in named if _valid(e["name"], e["description"])]
        if not relations:
            return [named, *([] for _ in batch[1:])]
        known = {e["name"].lower() for e in named}
        ends = [{"kind": "relation", "name": whole(r, "source"), "target": whole(r, "target"), "type": whole(r, "type", "related_to"), "description": whole(r, "description")} for r in of("relationships")]
        mine = named + [r for r in ends if r["name"].lower() in known and r["target"].lower() in known]
        return [mine, *([] for _ in batch[1:])]

    return Step(lambda batch: "\n".join(f'- "{r["text"]}"' for r in batch), parse, lambda r: [], rows, chars, lambda r: len(str(r["text"] or "")) + 5)


def _first_entities(props: DataFrame, model: Callable[[str], str], step: Step, calls: int = 3) -> DataFrame:
    """Rows ``(doc_id, name, type, description)``. A document's rows meet in one task in their order, so that names that it has had are known there."""
    names = ("doc_id", "name", "type", "description")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def each() -> Iterator[Row]:
            for batch in batches:
                kinds[:] = [batch.schema.field("doc_id").type, pa.string(), pa.string(), pa.string()]
                yield from (dict(zip(batch.schema.names, row)) for row in zip(*batch.to_pydict().values()))

        made = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
        out: list[tuple] = []
        seen: set[str] = set()
        at: tuple | None = None
        for batch, found in asked(each(), model, step, ["doc_id"], calls):
            doc = batch[0]["doc_id"]
            if at != (doc,):
                at, seen = (doc,), set()
            for got, _ in found:
                for e in got:
                    if (key := e["name"].lower()) not in seen:
                        seen.add(key)
                        out.append((doc, e["name"], e["type"], e["description"]))
            if len(out) >= 10_000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    dealt = props.select("doc_id", "n", "text").repartition("doc_id").sortWithinPartitions("doc_id", "n")
    return dealt.mapInArrow(run, T.StructType([props.schema["doc_id"], *(T.StructField(c, T.StringType()) for c in names[1:])]))


def entities(props: DataFrame, model: Callable[[str], str], rows: int = 30, chars: int = 5000) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, name, type, description)``, the first of each lower-case name of a document, and ``(doc_id, source_name, target_name, type,
    description)`` in the order of ``props (doc_id, n, text)``."""
    got = infer(props.select("doc_id", "n", "text"), model, entity_step(rows, chars), FOUND, ["doc_id"], ["n"], ["doc_id", "n"])
    each = got.select("doc_id", "n", F.posexplode("answers").alias("at", "a")).select("doc_id", "n", "at", "a.*")
    relations = each.where("kind = 'relation'").select("doc_id", F.col("name").alias("source_name"), F.col("target").alias("target_name"), "type", "description")
    return _first_entities(props, model, entity_step(rows, chars, relations=False)), relations


# Relevance of papers.

SCORE = T.StructType([T.StructField("score", T.IntegerType()), T.StructField("rationale", T.StringType())])


def relevance_step(rows: int = 30, chars: int = 30 * 900, abstract: int = 600) -> Step:
    """A JSON list of ``{id, score, rationale}``; scores are cut to 0..10, one that is no number is 5; papers left out keep 5."""

    def parse(text: str, batch: list[Row]) -> list[Answers | None]:
        def cut(x: object) -> int:
            try:
                return max(0, min(10, int(x)))
            except (TypeError, ValueError):
                return 5

        said = {str(x["id"]): x for x in parsed_json(text) or [] if isinstance(x, dict) and "id" in x}
        return [[{"score": cut(said[str(r["id"])].get("score")), "rationale": str(said[str(r["id"])].get("rationale") or "")}] if str(r["id"]) in said else None for r in batch]

    def prompt(batch: list[Row]) -> str:
        return "\n".join(json.dumps({"id": r["id"], "title": r["title"], "abstract": (r["abstract"] or "")[:abstract]}) for r in batch)

    return Step(prompt, parse, lambda r: [{"score": 5, "rationale": "not scored"}], rows, chars, lambda r: len(str(r["title"] or "")) + min(len(str(r["abstract"] or "")), abstract) + 60)


def relevance(papers: DataFrame, model: Callable[[str], str], rows: int = 30) -> DataFrame:
    """Rows ``(id, llm_relevance, llm_rationale)`` of ``papers (id, title, abstract)``; no shuffle."""
    got = infer(papers.select("id", "title", "abstract"), model, relevance_step(rows), SCORE, [], [], ["id"])
    return got.select("id", F.col("answers")[0]["score"].alias("llm_relevance"), F.col("answers")[0]["rationale"].alias("llm_rationale"))


# Models without a model, repeatable, for queries and tests.


def sentence_model(prompt: str) -> str:
    """All sentences of a prompt's chunks as a JSON list in a fence; it fails on a prompt that holds ``fail!``."""
    if "fail!" in prompt:
        raise RuntimeError("the model is out")
    parts = [p.split("\n", 1)[-1] for p in prompt.split("\n\n---CHUNK BOUNDARY---\n\n")]
    return "```json\n" + json.dumps([s for p in parts for s in sentences(p)]) + "\n```"


def keyword_model(prompt: str) -> str:
    """Words of eight letters or more as entities, neighbours of a line as relations, in prose."""
    lines = [[w.lower() for w in re.findall(r"[^\W\d_]{8,}", line)] for line in prompt.split("\n")]
    names = list(dict.fromkeys(w for line in lines for w in line))
    said = {"entities": [{"name": w, "type": "technique", "description": f"the word {w}"} for w in names], "relationships": [{"source": a, "target": b} for line in lines for a, b in zip(line, line[1:])]}
    return "Found: " + json.dumps(said)


def title_model(prompt: str) -> str:
    """A score by the title's length; of every seventh title none, and of every fifth one that is no number."""
    said = []
    for line in prompt.split("\n"):
        paper = json.loads(line)
        n = len(paper["title"] or "")
        if n % 7:
            said.append({"id": paper["id"], "score": "high" if n % 5 == 0 else n - 10, "rationale": f"{n} characters"})
    return json.dumps(said)
