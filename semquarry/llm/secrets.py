"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models over characters are trained from labelled samples. A token's log-likelihood
ratio per character between them says whether it looks drawn at random. Labelled random are what follows
the fixed patterns' keywords and markers in the corpus, and ``MADE`` strings of each of ``ALPHABETS`` that
are drawn at random from a fixed seed, so that the model does not only know the forms that the patterns find
already. Labelled ordinary are the tokens, of whatever characters, of documents without any match. Of either
label the ``SAMPLE`` values of smallest hash are taken (fewer, if there are fewer), each distinct value once;
this bound is a parameter. Tokens of any length and of any characters are scored alike; a token is reported
when its mean ratio is above ``THRESHOLD`` and its whole ratio is at least what ``SHORTEST`` characters at
that mean have, so that a shorter token must look more random to be as sure.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, tidy

#: Fixed patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as runs of 32 or more: a shorter run holds no longer one
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SAMPLE = 20_000
#: Random strings are made of these characters, so many of each, from 16 to 48 characters long.
ALPHABETS = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], "0123456789abcdef")
MADE, SEED = 2000, 11
SHORTEST = 16
#: A token is reported when the ratio is above this, in nats a character.
THRESHOLD = 2.0
#: Added to each character's count, and the weight of these single counts beside those of pairs.
SMOOTHING, BACKOFF = 0.5, 5.0

_CODE = np.full(256, 0, np.uint8)
_CODE[[ord(c) for c in ALPHABET]] = range(1, len(ALPHABET) + 1)
_INSIDE = np.array([CANDIDATE.match(chr(c)) is not None for c in range(256)])
_STATES = len(ALPHABET) + 1  # 0: the start, and any other character


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in code points, by start."""
    low = text.lower()
    found = []
    if any([word in low for word in KEYWORDS]):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Models(NamedTuple):
    """Log-likelihood ratio of each step from a character to the next, random against ordinary."""

    ratio: np.ndarray

    @classmethod
    def train(cls, random: list[str], ordinary: list[str]) -> Models:
        return cls.counted(steps(random), steps(ordinary))

    @classmethod
    def counted(cls, *steps: np.ndarray) -> Models:
        """From the numbers of steps between characters, of random and of ordinary strings."""
        logs = []
        for counts in steps:
            single = (counts.sum(0) + SMOOTHING) / (counts.sum() + SMOOTHING * _STATES)
            logs.append(np.log((counts + BACKOFF * single) / (counts.sum(1, keepdims=True) + BACKOFF)))
        return cls(logs[0] - logs[1])

    def score(self, token: str) -> float:
        """Mean ratio of the token's steps, in nats; 0 for an empty token."""
        codes = _codes(token)
        return float(self.ratio[np.concatenate([[0], codes[:-1]]), codes].mean()) if len(codes) else 0.0

    def random(self, token: str) -> bool:
        """Whether a token of ``SHORTEST`` characters or more is likelier random than ordinary."""
        return len(token) >= SHORTEST and self.score(token) > 0


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)].astype(np.int64)


def steps(values: list[str]) -> np.ndarray:
    """Numbers of steps from each character to the next, in all values."""
    codes = _codes("\n".join(["", *values]))  # the line feed is the start
    return np.bincount(codes[:-1] * _STATES + codes[1:], minlength=_STATES * _STATES).reshape(_STATES, _STATES).astype(float) * (np.arange(_STATES) > 0)


def made(n: int = MADE, seed: int = SEED) -> list[str]:
    """Random strings: ``n`` of each alphabet."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(16, 49))) for letters in ALPHABETS for _ in range(n)]


def markov_spans(text: str, base: list[tuple[int, int, int]], models: Models, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end) of tokens that look random and overlap no fixed pattern's match."""
    data = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _INSIDE[data], [False]]))).reshape(-1, 2)
    if not len(edges):
        return []
    codes = _CODE[data]
    before = np.concatenate([np.zeros(1, np.uint8), codes[:-1]])
    before[edges[:, 0]] = 0
    upto = np.concatenate([[0], np.cumsum(models.ratio[before, codes])])
    size, total = edges[:, 1] - edges[:, 0], upto[edges[:, 1]] - upto[edges[:, 0]]
    likely = edges[(total > threshold * size) & (total > threshold * SHORTEST)].tolist()
    return [(a, 3, b) for a, b in likely if not any(a < end and start < b for start, _, end in base)]


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(value, random, h) labelled by the fixed patterns; for each task, the ``sample`` distinct values of smallest hash ``h`` of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, dict[str, int]] = {True: {}, False: {}}

        def trim(most: int) -> None:
            for values in kept.values():
                if len(values) > most:
                    edge = sorted(values.items(), key=lambda x: (x[1], x[0]))[:sample]
                    values.clear()
                    values.update(edge)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                for start, kind, end in spans:
                    value = text[start:end]
                    value = ASSIGN.match(value)[2] if kind == 0 else value
                    kept[True][value] = xxhash.xxh3_64_intdigest(value) >> 1
                if not spans and text:
                    known = kept[False]
                    for value in set(CANDIDATE.findall(text)).difference(known):
                        known[value] = xxhash.xxh3_64_intdigest(value) >> 1
            trim(4 * sample)
        trim(sample)
        for random, values in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(values), pa.string()), pa.array([random] * len(values), pa.bool_()), pa.array(list(values.values()), pa.int64())], ["value", "random", "h"])

    return docs.select("text").mapInArrow(tidy(run), "value string, random boolean, h long")


def train(docs: DataFrame, sample: int = SAMPLE) -> Models:
    """The two models from a bounded sample of labelled values; with no ordinary values, models that find nothing.

    Documents without a fixed pattern's match may hold secrets too. So the models are trained twice, the
    second time without the ordinary values that the first ones find random. The corpus is read once; the
    driver gets the numbers of steps, at most one row for each two characters.
    """
    values = cut(labelled(docs, sample)).distinct()
    parts = [values.where(F.col("random") == random).orderBy("h", "value").limit(sample) for random in (True, False)]
    few = cut(parts[0].unionByName(parts[1]).select("value", "random"))

    def counted(models: Models | None) -> Models:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                random = batch.column(1).to_numpy(zero_copy_only=False)
                for which in (True, False):
                    own = batch.column(0).filter(pa.array(random == which)).to_pylist()
                    if models and not which:
                        own = [value for value in own if not models.random(value)]
                    found = steps(own).ravel().astype(np.int64)
                    at = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array([which] * len(at), pa.bool_()), pa.array(at), pa.array(found[at])], ["random", "step", "n"])

        counts = {True: steps(made()), False: np.zeros((_STATES, _STATES))}
        for row in few.mapInArrow(tidy(count), "random boolean, step long, n long").groupBy("random", "step").agg(F.sum("n").alias("n")).collect():
            counts[row["random"]][divmod(row["step"], _STATES)] += row["n"]
        return Models.counted(counts[True], counts[False]) if counts[False].any() else Models(np.full((_STATES, _STATES), -1.0))

    return counted(counted(None))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, models: Models | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Null and empty texts have no spans and the digest of an empty string. Repeated rows are repeated, further
    columns are left out, and an empty table gives no rows.
    """
    models = models or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + markov_spans(text or "", base, models, threshold))
                counts.append([sum(kind == k for _, kind, _ in spans) for k in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(spans))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def masked(docs: DataFrame, models: Models | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each secret's characters replaced by ``mask`` and n_chars, where there is one, brought up to date.

    Overlapping spans are masked as one; of an assignment only the value goes. Null texts stay null.
    """
    models = models or train(docs)

    def hide(text: str | None) -> str | None:
        base = base_spans(text or "")
        spans = sorted(base + markov_spans(text or "", base, models))
        if not spans:
            return text
        out, upto = [], 0
        for start, kind, end in spans:
            start = start + ASSIGN.match(text[start:end]).start(2) if kind == 0 else start
            if end > upto:
                if start >= upto:
                    out += [text[upto:start], mask]
                upto = end
        return "".join([*out, text[upto:]])

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [hide(text) for text in batch.column(at).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else column for i, column in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")
