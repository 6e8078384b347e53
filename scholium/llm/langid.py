"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's likelihood is the sum over all its
segmentations into pieces, by the forward algorithm; no piece spans white space, so a text's is the product of its words'.
Piece probabilities are fitted by expectation-maximisation (forward-backward) on a bounded sample of labelled rows; the
bound, ``docs_per_lang``, is a parameter. Copies of a text teach once; words longer than ``LONG`` letters teach in parts. Every
learned language can be predicted: more than ``max_langs`` of them are an error, never dropped. Scoring covers every word of
every whole text.

Null texts and texts without a letter: ``und`` with score 0. Rows with a null language are scored and never learned from.
Ties go to the alphabetically first language. With no learnable row every text is ``und``. Repeated rows and rows without an
id get a row each; very long texts are taken a megabyte at a time; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import fold

LETTERS = re.compile(r"[^\W\d_]+")
#: Longer runs of letters take the rescaled path, one position at a time.
LONG = 24


def public_pieces(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(x for x in out if x and all(c == "▁" or c.isalpha() for c in x) and "▁" not in x[1:])


class Lattice:
    """Forward and backward sums over segmentations, for many words and all languages at once. Piece 0 is any other character."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.number = {p: i + 1 for i, p in enumerate(pieces)}
        self.reach = max(map(len, pieces), default=1)
        self.p = np.exp(logp)  # (pieces + 1, languages)

    def edges(self, words: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For each (end, length): the words and the pieces that end there."""
        found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        number, reach = self.number, self.reach
        for w, word in enumerate(words):
            for end in range(1, len(word) + 1):
                for k in range(1, min(end, reach) + 1):
                    piece = number.get(word[end - k : end])
                    if piece is None:
                        if k > 1:
                            continue
                        piece = 0
                    at = found.get((end, k))
                    if at is None:
                        at = found[end, k] = ([], [])
                    at[0].append(w)
                    at[1].append(piece)
        return {key: (np.array(w), np.array(p)) for key, (w, p) in found.items()}

    def forward(self, words: list[str], edges: dict) -> np.ndarray:
        """alpha[position, word, language], for words of ``LONG`` characters at most: products then stay within doubles."""
        top = max(map(len, words), default=0)
        alpha = np.zeros((top + 1, len(words), self.p.shape[1]))
        alpha[0] = 1
        for end, k in sorted(edges):
            w, piece = edges[end, k]
            alpha[end, w] += alpha[end - k, w] * self.p[piece]
        return alpha

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """(words, languages)."""
        out = np.zeros((len(words), self.p.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        step = max(64, 65536 // max(16, self.p.shape[1]))
        for s in range(0, len(short), step):
            part = short[s : s + step]
            chosen = [words[i] for i in part]
            alpha = self.forward(chosen, self.edges(chosen))
            out[part] = np.log(alpha[[len(w) for w in chosen], range(len(chosen))])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.long(w)
        return out

    def long(self, word: str) -> np.ndarray:
        """A long word with rescaling: memory for ``reach`` positions only."""
        past, scale = [np.ones(self.p.shape[1])], np.zeros(self.p.shape[1])
        for end in range(1, len(word) + 1):
            now = np.zeros(self.p.shape[1])
            for k in range(1, min(end, self.reach) + 1):
                piece = self.number.get(word[end - k : end], 0 if k == 1 else None)
                if piece is not None:
                    now = now + past[-k] * self.p[piece]
            past = [*past[-self.reach + 1 :], now] if self.reach > 1 else [now]
            if end % 8 == 0:
                top = past[-1].copy()
                past, scale = [x / top for x in past], scale + np.log(top)
        return np.log(past[-1]) + scale

    def expected(self, words: list[str], lang: np.ndarray, n: np.ndarray) -> dict[tuple[int, int], float]:
        """Expected uses of (language, piece) in words of given languages and counts."""
        total = np.zeros(self.p.shape[::-1])
        edges = self.edges(words)
        alpha = self.forward(words, edges)
        rows, size = np.arange(len(words)), np.array([len(w) for w in words])
        beta = np.zeros(alpha.shape[:2])
        beta[size, rows] = 1
        for end, k in sorted(edges, reverse=True):
            w, piece = edges[end, k]
            beta[end - k, w] += beta[end, w] * self.p[piece, lang[w]]
        whole = alpha[size, rows, lang]
        for (end, k), (w, piece) in edges.items():
            share = alpha[end - k, w, lang[w]] * self.p[piece, lang[w]] * beta[end, w] / whole[w] * n[w]
            np.add.at(total, (lang[w], piece), share)
        return total


def learn(docs: DataFrame, pieces: list[str], docs_per_lang: int = 600, rounds: int = 3, max_langs: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (pieces + 1, languages) from at most about ``docs_per_lang`` rows of each language.

    What reaches the driver is bounded by the vocabulary and ``max_langs``: counts of languages and expected uses of pieces.
    """
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null")
    counts = sorted((r[0], r[1]) for r in known.groupBy("lang").count().limit(max_langs + 1).collect())
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs")
    langs = [c[0] for c in counts]
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    # One pass: each language has its own share of a hash's range. The hash is the text's, so that ids may be null or equal.
    part = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(1.0 if n <= docs_per_lang else docs_per_lang / n))])
    hashed = known.select("lang", "text", F.xxhash64(F.lit("lang"), "text").alias("h"))
    sample = hashed.where(F.pmod("h", F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000).dropDuplicates(["lang", "h"])
    number = F.create_map(*[x for i, c in enumerate(langs) for x in (F.lit(c), F.lit(i))])
    words = written(
        sample.select(number[F.col("lang")].alias("lang"), F.explode(F.expr(rf"regexp_extract_all(lower(text), '\\p{{L}}{{1,{LONG - 1}}}', 0)")).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")),
        "langwords",
    )
    logp = np.full((len(pieces) + 1, len(langs)), -np.log(len(pieces) + 1))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, logp))

        def run(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(*model.value), 0
            for pdf in batches:
                step = max(64, 65536 // max(16, model.value[1].shape[1]))  # the sums take a number a word, position and language
                for s in range(0, len(pdf), step):
                    part = pdf.iloc[s : s + step]
                    total = total + lattice.expected(["▁" + w for w in part["word"]], part["lang"].to_numpy(), part["n"].to_numpy(float))
            if not isinstance(total, int):
                lang, piece = np.nonzero(total)
                yield pd.DataFrame({"lang": lang, "piece": piece, "uses": total[lang, piece]})

        uses = words.repartition(2 * spark.sparkContext.defaultParallelism, "word").mapInPandas(run, "lang int, piece int, uses double")
        found = uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        fresh = np.full_like(logp, 0.05)
        fresh[found["piece"], found["lang"]] += found["uses"]
        logp = np.log(fresh / fresh.sum(0))
        model.unpersist()
    return langs, logp


class Scorer:
    """Scores of words, kept for words seen before (a table of ``cells`` numbers at most), and of whole texts."""

    def __init__(self, pieces: list[str], logp: np.ndarray, cells: int = 1_200_000):
        cap = max(1, min(300_000, cells // max(1, logp.shape[1])))
        self.lattice, self.cap = Lattice(pieces, logp), cap
        self.rows: dict[str, int] = {}
        self.table = np.zeros((cap, logp.shape[1]), np.float32)

    def words(self, unique: list[str]) -> np.ndarray:
        out = np.zeros((len(unique), self.table.shape[1]), np.float32)
        at = np.array([self.rows.get(w, -1) for w in unique], np.int64)
        out[at >= 0] = self.table[at[at >= 0]]
        if len(fresh := np.nonzero(at < 0)[0]):
            got = self.lattice.log_likelihood(["▁" + unique[i] for i in fresh])
            out[fresh] = got
            keep = [(i, g) for i, g in zip(fresh, got) if len(unique[i]) < LONG]
            if len(self.rows) + len(keep) > self.cap:
                self.rows.clear()
            keep = keep[: self.cap]
            if keep:
                start = len(self.rows)
                self.table[start : start + len(keep)] = [g for _, g in keep]
                self.rows.update((unique[i], start + k) for k, (i, _) in enumerate(keep))
        return out

    def texts(self, texts: list, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log likelihoods and numbers of words; a batch's words are taken a megabyte at a time."""
        total, n = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            if not words:
                return
            codes, unique = pd.factorize(np.array(words, object))
            scores = self.words(list(unique))
            start = 0
            for i, k in owner:
                total[i] += scores[codes[start : start + k]].sum(0, dtype=np.float64)
                n[i] += k
                start += k
            words.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            if not isinstance(text, str):
                continue
            at = 0
            while at < len(text):
                cut = min(len(text), at + chunk)
                while cut < len(text) and not text[cut].isspace():
                    cut += 1
                found = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in LETTERS.findall(text[at:cut].lower())]
                found = [w for w in found if w]
                words += found
                owner.append((i, len(found)))
                size += cut - at
                at = cut
                if size >= chunk:
                    flush()
                    size = 0
        flush()
        return total, n


def predict(docs: DataFrame, pieces: list[str], langs: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, lang_pred, score)``; the score is the share of the best language, likelihoods taken per square root of words."""
    model = docs.sparkSession.sparkContext.broadcast((pieces, logp))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*model.value)
        for pdf in batches:
            total, n = scorer.texts(list(pdf["text"]))
            if langs:
                scaled = total / np.sqrt(np.maximum(n, 1))[:, None]
                share = np.exp(scaled - scaled.max(1, keepdims=True))
                best, score = total.argmax(1), (share / share.sum(1, keepdims=True)).max(1)
            else:
                best, score, n = np.zeros(len(pdf), int), np.zeros(len(pdf)), n * 0
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [langs[b] if k else "und" for b, k in zip(best, n)], "score": np.where(n > 0, score, 0.0)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def default_pieces() -> list[str]:
    import public_tokenizers

    return public_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def query(docs: DataFrame, pieces: list[str] | None = None) -> DataFrame:
    pieces = pieces or default_pieces()
    langs, logp = learn(docs.where(fold("doc_id", 3) != 1).select("doc_id", "text", "lang"), pieces)
    out = predict(docs, pieces, langs, logp)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.5, pieces: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: a learned language with a score of ``min_score`` or more.

    The model learns from the rows' own non-null languages; where there is none, nothing can be judged and every text with a
    letter stays. Rows without an id are judged like others.
    """
    pieces = pieces or default_pieces()
    langs, logp = learn(docs.select("doc_id", "text", "lang"), pieces)
    model = docs.sparkSession.sparkContext.broadcast((pieces, logp))
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        scorer = Scorer(*model.value)
        for batch in batches:
            total, n = scorer.texts(batch.column(place).to_pylist())
            scaled = total / np.sqrt(np.maximum(n, 1))[:, None]
            share = np.exp(scaled - scaled.max(1, keepdims=True, initial=-np.inf)) if langs else np.ones((len(n), 1))
            score = 1 / share.sum(1)
            yield batch.filter(pa.array((n > 0) & (score >= min_score)))

    return docs.mapInArrow(run, schema)
