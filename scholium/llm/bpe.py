"""Byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

In the greedy encoding of a prefix the last token is unique: it is the token ending there whose predecessor is the last
token of the shorter prefix and which no merge would have crossed. So one pass from left to right keeps, for each position,
the last token only. A later token reaches back over at most ``lookahead`` symbols, the longest token of the merge list;
whatever all chains of that window have in common is stable and leaves the buffer. Memory is a window, not a word.

Null and empty texts: no token, empty decoding. Very long texts and words stream through. Ties cannot occur: merges are
ranked. Repeated rows and rows without an id get a row each, equal texts equal tokens. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: The splitting pattern and white space of the tokenizer file; \s there is Unicode white space.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
#: The same for texts within Latin-1 letters and ASCII, where the built-in engine's plain classes agree with it.
PLAIN = re.compile(r"[^\x00-\x1B\x20-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]")
SPLIT_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|[0-9]|[^\s0-9a-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """The tokens of one vocabulary file; ``spec`` is its parsed JSON."""

    def __init__(self, spec: dict, cache: int = 500_000):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made: dict[str, tuple[str, str]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for k, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), k)
            self.made.setdefault(a + b, (a, b))
        self.born = {a + b: self.rank[a, b] for a, b in self.made.values()}
        size = lambda t: len(t) - len(self.suffix) * bool(self.suffix and t.endswith(self.suffix))
        #: The merge list's sufficient lookahead: no token spans more symbols.
        self.lookahead = max([1, *(size(t) for t in self.made)])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_symbols()
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        #: Every token that merging can make, by a number of its own, and the pairs known to fit or not.
        self.names = [t for t in self.ids if t in self.made or size(t) == 1]
        self.number = {t: i for i, t in enumerate(self.names)}
        #: By the last three symbols of a token: how long such tokens are, longest first; then two symbols and one.
        ends: dict[str, set[int]] = {}
        for t in self.names:
            if (n := size(t)) > 2:
                ends.setdefault(t[n - 3 :], set()).add(n)
        self.sizes = {end: [*sorted(found, reverse=True), 2, 1] for end, found in ends.items()}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cap = cache

    def joined(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` may stand side by side: no merge across their border comes before they are complete."""
        pair = self.number[a] << 20 | self.number[b]
        if (known := self.fits.get(pair)) is not None:
            return known
        limit, good = len(self.rank), True
        while True:
            if self.rank.get((a, b), limit) < limit:
                good = False
                break
            # Undo the later of the two: the border's neighbours as they were before that merge.
            made_a, made_b = self.born.get(a, -1), self.born.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                limit, a = made_a, self.made[a][1]
            else:
                # A merge of equal rank further left would have come first, so the border's own may tie.
                limit, b = made_b + 1, self.made[b][0]
        if len(self.fits) >= 2 * self.cap:
            self.fits.clear()
        self.fits[pair] = good
        return good

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a word given as symbols, the last one with the suffix; each is emitted once it is stable."""
        window: list[str] = []
        last: list[str | None] = [None]  # last[i]: the last token of the prefix of i symbols (from the buffer's start)
        start_token: str | None = None  # the token before the buffer

        def step(i: int) -> str:
            for k in range(max(0, i - self.lookahead), i):
                token = "".join(window[k:i])
                if token in self.number:
                    before = last[k] if k else start_token
                    if (before is None and not k) or (before is not None and self.joined(before, token)):
                        return token
            raise ValueError(f"no token for {window[i - 1]!r}")

        size = lambda t: len(t) - (len(self.suffix) if self.suffix and t.endswith(self.suffix) else 0)
        for symbol in symbols:
            window.append(symbol)
            last.append(step(len(window)))
            if len(window) >= 16 * self.lookahead and not (self.suffix and symbol.endswith(self.suffix)):
                # The positions from which a later token may start; the borders common to their chains are stable.
                n, common = len(window), None
                for i in range(n - self.lookahead + 1, n + 1):
                    chain, at = set(), i
                    while at > 0:
                        chain.add(at)
                        at -= size(last[at])
                    common = chain if common is None else common & chain
                if common:
                    stable = max(common)
                    yield from self.chain(last, stable, size)
                    start_token = last[stable]
                    window, last = window[stable:], [None, *last[stable + 1 :]]
        if window:
            yield from self.chain(last, len(window), size)

    @staticmethod
    def chain(last: list, at: int, size) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= size(last[at])
        return out[::-1]

    def short(self, s: str) -> list[str]:
        """``stream`` for a word that fits in the window; ``s`` without the suffix."""
        if (whole := s + self.suffix) in self.made:
            return [whole]
        number, fits, sizes, n = self.number, self.fits, self.sizes, len(s)
        last, back = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            tail = self.suffix if i == n else ""
            for m in sizes.get(s[i - 3 : i] + tail, (2, 1)) if i > 2 else (2, 1):
                k = i - m
                token = number.get(s[k:i] + tail) if k >= 0 else None
                if token is not None:
                    if k:
                        good = fits.get(last[k] << 20 | token)
                        if not (self.joined(self.names[last[k]], self.names[token]) if good is None else good):
                            continue
                    last[i], back[i] = token, k
                    break
        out, i = [], n
        while i > 0:
            out.append(self.names[last[i]])
            i = back[i]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        if (known := self.cache.get(word)) is not None:
            return known
        names, raw = self.bytes, word.encode("utf-8", "replace")
        if (n := len(raw)) <= 64:
            tokens = self.short("".join([names[b] for b in raw]))
        else:
            tokens = self.stream(names[b] + (self.suffix if i == n - 1 else "") for i, b in enumerate(raw))
        return self.kept(word, b"".join([self.ids[t].to_bytes(4, "little") for t in tokens]))

    def kept(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.cache) >= self.cap:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of a piece of text without white space, lower case."""
        words = (SPLIT if PLAIN.search(chunk) else SPLIT_PLAIN).findall(chunk)
        if len(words) == 1:
            return self.word(words[0])
        return self.kept(chunk, b"".join([self.word(w) for w in words]))

    def segments(self, text: str, size: int = 1 << 20) -> Iterator[bytes]:
        """Ids of a text, a part of it at a time: parts end at white space, across which no token reaches."""
        for piece in self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]:
            if piece in self.special:
                yield self.special[piece].to_bytes(4, "little")
                continue
            at = 0
            while at < len(piece):
                cut = at + size
                while cut < len(piece) and piece[cut] not in " \t\n":
                    cut += 1
                part, at = piece[at:cut], cut
                if PLAIN.search(part):
                    part = SPACES.sub(" ", unicodedata.normalize("NFC", part))
                    chunks = part.replace("Σ", "σ").lower().split(" ")  # letter by letter: no final sigma
                else:
                    chunks = part.lower().split()
                known = self.cache
                yield b"".join([known[c] if c in known else self.chunk(c) for c in chunks])

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.segments(text or ""))


class Decoder:
    """Ids to text, incrementally: ``push`` returns what is complete, ``close`` the rest.

    ``spaced`` puts the vocabulary's own strings side by side with single spaces, as a tokenizer file without a decoder asks;
    otherwise bytes are put together again, a word's end is a space, and UTF-8 sequences may span tokens.
    """

    def __init__(self, encoder: Encoder, spaced: bool = True):
        self.tokens, self.spaced, self.begun = encoder.tokens, spaced, False
        self.back = {c: b for b, c in enumerate(encoder.bytes)}
        self.suffix, self.special = encoder.suffix, set(encoder.special.values())
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        if self.spaced:
            try:
                part = " ".join(map(self.tokens.__getitem__, ids))
            except KeyError:  # ids that the vocabulary lacks give nothing
                part = " ".join([self.tokens[i] for i in ids if i in self.tokens])
            if part and self.begun:
                part = " " + part
            self.begun = self.begun or bool(part)
            return part
        out = []
        for i in ids:
            token = self.tokens.get(i, "")
            if i in self.special:
                out.append(self.text.decode(b"", False) + token)
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            out.append(self.text.decode(bytes(self.back[c] for c in body)) + (" " if ends else ""))
        return "".join(out)

    def close(self) -> str:
        return "" if self.spaced else self.text.decode(b"", True)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_built: dict[str, Encoder] = {}


def encoder_of(text: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    name = hashlib.sha1(text.encode()).hexdigest()
    if name not in _built:
        _built.clear()
        _built[name] = Encoder(json.loads(text))
    return _built[name]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``. The vocabulary file, read on the driver, is broadcast: its size is fixed."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(spec.value)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(encoder)
                for part in encoder.segments(text if isinstance(text, str) else ""):
                    n += len(part) // 4
                    ids.update(part)
                    decoded.update(decoder.push(memoryview(part).cast("I")).encode())
                decoded.update(decoder.close().encode())
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **{c: [r[k] for r in rows] for k, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, ids, n_tokens, decoded)`` with the ids themselves and the text that they decode to."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(spec.value)
        for pdf in batches:
            ids = [list(memoryview(encoder.encode(t if isinstance(t, str) else "")).cast("I")) for t in pdf["text"]]
            texts = []
            for x in ids:
                d = Decoder(encoder, spaced=False)
                texts.append(d.push(x) + d.close())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids, "n_tokens": [len(x) for x in ids], "decoded": texts})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>, n_tokens long, decoded string")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return digests(docs, path)
