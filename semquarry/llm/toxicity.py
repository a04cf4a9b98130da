"""Toxicity by a linear-chain conditional random field over tokens.

Two tags: toxic and other. Labelled tokens come from labelled documents: in toxic ones, the words that
are far more frequent in toxic documents than in the rest carry the tag. The field's weights (of a
token's word, its first and last letters, and of the steps between tags) are fitted by gradient ascent
on its likelihood. Forward and backward passes over a whole text give each token's marginal; a logistic
function of the largest, of their sum and of their density is the document's score. Every window of every
labelled text takes part in the ascent, in blocks of windows drawn anew for each pass.

At most ``SAMPLE`` labelled rows of either label are learnt from, those of smallest hash. Everything
else covers all rows and whole texts.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

SAMPLE = 4000
FOLDS, HELD_OUT = 5, 0
FEATURES = 1 << 18
WINDOW = 64
#: Windows of one step of the gradient, the least number of passes over all windows, and of steps.
BLOCK, PASSES, STEPS = 1024, 4, 60
TABLE_ENTRIES = 300_000
#: Texts scored at once, and values of their padded sequences, which bound a worker's memory.
AT_ONCE, PADDED = 2000, 500_000
#: A word labels tokens toxic if its odds in toxic documents are so many times those elsewhere, and it stands between so many pairs of neighbours there.
LEAST_ODDS, LEAST_CONTEXTS = 12.0, 5
SPAN_MARGINAL = 0.5
_STRIP = ".,;:!?\"'()[]{}<>«»“”‘’*_-…¡¿"
_TOKEN = re.compile(r"\S+")


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _features(token: str) -> tuple[int, int, int]:
    word = token.strip(_STRIP) or token
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in (f"w:{word}", f"a:{word[:3]}", f"z:{word[-3:]}"))


def _forward_backward(e: np.ndarray, live: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the marginals, and the forward and backward log-odds; time-major.

    e: each token's log-odds for the toxic tag. live: sequences alive at each time, by falling length.
    steps: log weights [from, to] with tag 1 toxic; the start is tag 0.
    """
    (oo, ot), (to, tt) = steps
    n, r, s = len(e), np.zeros_like(e), np.zeros_like(e)
    for t in range(n):
        k = live[t]
        if t:
            before = r[t - 1, :k]
            r[t, :k] = e[t, :k] + np.logaddexp(ot, before + tt) - np.logaddexp(oo, before + to)
        else:
            r[0] = e[0] + ot - oo
    for t in range(n - 2, -1, -1):
        k = live[t + 1]
        after = e[t + 1, :k] + s[t + 1, :k]
        s[t, :k] = np.logaddexp(to, tt + after) - np.logaddexp(oo, ot + after)
    return r + s, r, s


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values time-major, sequences alive at each time, order by falling length)."""
    lengths = np.array([len(x) for x in rows])
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    out = np.zeros((longest, len(rows)), np.float64)
    for j, i in enumerate(order):
        out[: lengths[i], j] = rows[i]
    live = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return out, live, order


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Field:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -6.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))
    table: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.table
        try:
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            if len(known) > TABLE_ENTRIES:
                known.clear()
        w, bias = self.weights, self.bias
        for word in set(words):
            if word not in known:
                known[word] = float(w[list(_features(word))].sum() + bias)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, rows: list[np.ndarray], padded: int = PADDED) -> list[np.ndarray]:
        """Each token's probability of the toxic tag, for whole sequences of emissions.

        Sequences are taken by length, in groups of at most ``padded`` values or one sequence.
        """
        out: list[np.ndarray] = [np.zeros(0)] * len(rows)
        by_length = sorted((i for i, x in enumerate(rows) if len(x)), key=lambda i: -len(rows[i]))
        at = 0
        while at < len(by_length):
            longest = len(rows[by_length[at]])
            group = by_length[at : at + max(1, padded // longest)]
            at += len(group)
            e, live, order = _padded([rows[i] for i in group])
            p = _sigmoid(_forward_backward(e, live, self.steps)[0])
            for j, i in enumerate(order):
                out[group[i]] = p[: len(rows[group[i]]), j]
        return out

    def summary(self, p: np.ndarray) -> tuple[float, float, float]:
        """Of a document's marginals: log-odds of the largest, log of their sum, density."""
        top = float(np.clip(p.max(initial=1e-6), 1e-6, 1 - 1e-6))
        total = float(p[p > 0.05].sum())
        return np.log(top / (1 - top)), np.log1p(total), total / max(len(p), 1) * 100

    def scores(self, texts: list[str | None]) -> tuple[list[float], list[np.ndarray]]:
        p = self.marginals([self.emissions(tokens(t)) for t in texts])
        x = np.array([self.summary(m) for m in p]).reshape(-1, 3)
        return _sigmoid(self.scale[0] + x @ self.scale[1:]).tolist(), p

    def spans(self, text: str | None, p: np.ndarray) -> list[tuple[int, int]]:
        """Offsets of toxic tokens, in code points; tokens that follow each other make one span."""
        found: list[tuple[int, int]] = []
        if not (p >= SPAN_MARGINAL).any():
            return found
        last = -2
        # a letter's lower case may have more code points, but never white space, so tokens agree
        for i, m in enumerate(_TOKEN.finditer(text or "")):
            if i < len(p) and p[i] >= SPAN_MARGINAL:
                found = [*found[:-1], (found[-1][0], m.end())] if i == last + 1 else [*found, m.span()]
                last = i
        return found


class Vocabulary(dict):
    """Numbers for distinct tokens, given in order of arrival."""

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _marked(documents: list[np.ndarray], y: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """Which words carry the toxic tag in toxic documents; ``bare`` maps tokens to words without punctuation."""
    n = int(bare.max(initial=-1)) + 1
    seen = np.zeros((2, n), np.int64)
    around = np.zeros((0, 3), np.int32)  # copies of one document repeat a word's neighbours, and count once
    waiting: list[np.ndarray] = []
    for i, ids in enumerate(documents):
        words = bare[ids]
        seen[int(y[i]), np.unique(words)] += 1
        if y[i] and len(words):
            edged = np.concatenate([[-1], words, [-1]]).astype(np.int32)
            waiting.append(np.stack([edged[1:-1], edged[:-2], edged[2:]], 1))
        if waiting and (i + 1 == len(documents) or sum(map(len, waiting)) > 500_000):
            around, waiting = np.unique(np.concatenate([around, *waiting]), axis=0), []
    if waiting:
        around = np.unique(np.concatenate([around, *waiting]), axis=0)
    contexts = np.bincount(around[:, 0], minlength=n)
    odds = lambda c, of: (c + 0.3) / (of - c + 0.3)
    ratio = odds(seen[1], (y == 1).sum()) / odds(seen[0], (y == 0).sum())
    return (contexts >= LEAST_CONTEXTS) & (ratio >= LEAST_ODDS)


def fit(texts: Iterable[str | None], labels: list[int], weights: list[float] | None = None) -> Field:
    """A field from labelled documents. ``weights`` undo a sample's proportions in the document scores.

    Texts are read once and held as numbers of tokens.
    """
    vocabulary = Vocabulary()
    return _fit(vocabulary, [vocabulary.numbers(tokens(t)) for t in texts], labels, weights)


def _fit(vocabulary: Vocabulary, documents: list[np.ndarray], labels: list[int], weights: list[float] | None = None) -> Field:
    model = Field()
    y = np.array(labels, float)
    importance = np.ones(len(y)) if weights is None else np.array(weights)
    if not len(y) or y.min() == y.max():
        model.scale[0] = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return model
    stripped = Vocabulary()
    bare = stripped.numbers([w.strip(_STRIP) or w for w in vocabulary])
    marked = _marked(documents, y, bare)[bare] if len(bare) else np.zeros(0, bool)
    if not any(marked[ids].any() for ids, label in zip(documents, labels, strict=True) if label and len(ids)):  # nothing to tell the labels apart by
        rate = float((importance * y).sum() / importance.sum())
        model.scale = np.array([np.log(rate / (1 - rate)), 0.0, 0.0, 0.0])
        return model
    features = np.array([_features(w) for w in vocabulary], np.int32)
    used, place = np.unique(features, return_inverse=True)
    place = place.reshape(-1, 3).astype(np.int32)
    # windows as stretches of all tokens, one after the other
    tokens_ = np.concatenate(documents)
    toxic = marked[tokens_] & np.repeat(y > 0, [len(ids) for ids in documents])
    edges = np.concatenate([[0], np.cumsum([len(ids) for ids in documents])])
    starts = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(edges, edges[1:], strict=False)])
    lengths = np.minimum(WINDOW, edges[np.searchsorted(edges, starts, side="right")] - starts)
    w = np.zeros(len(used) + 1 + 4)  # words', the bias, the steps
    w[len(used)] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(0)
    blocks = -(-len(starts) // BLOCK)
    passes = max(PASSES, -(-STEPS // blocks))
    step = 0
    for own in (order[k::blocks] for order in (rng.permutation(len(starts)) for _ in range(passes)) for k in range(blocks)):
        step += 1
        own = own[np.argsort(-lengths[own], kind="stable")]
        on = np.arange(int(lengths[own[0]]))[:, None] < lengths[own]
        at = np.minimum(starts[own] + np.arange(len(on))[:, None], len(tokens_) - 1)
        f, tags = place[tokens_[at]], toxic[at] & on
        a = w[len(used) + 1 :].reshape(2, 2)
        e = w[f].sum(2) + w[len(used)]
        odds_, r, s = _forward_backward(e * on, on.sum(1).astype(int), a)
        error = (tags - _sigmoid(odds_)) * on
        gradient = np.zeros_like(w)
        gradient[: len(used)] = np.bincount(f.ravel(), np.repeat(error.ravel(), 3), len(used))
        gradient[len(used)] = error.sum()
        # steps as they are, less the expected ones: of the tag before, by its forward odds, and the tag after, by its backward odds
        before = np.vstack([np.zeros((1, len(own)), bool), tags[:-1]])
        f1 = np.vstack([np.full((1, e.shape[1]), -1e9), r[:-1]])
        pair = np.stack([np.stack([np.full_like(e, a[0, 0]), a[0, 1] + e + s]), np.stack([f1 + a[1, 0], f1 + a[1, 1] + e + s])])
        pair -= pair.max((0, 1))
        pair = np.exp(pair)
        pair = pair / pair.sum((0, 1)) * on
        gold = np.array([[((before == x) & (tags == z) & on).sum() for z in (0, 1)] for x in (0, 1)], float)
        gradient[len(used) + 1 :] = (gold - pair.sum((2, 3))).ravel()
        gradient -= 0.02 / blocks * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w += 0.25 * (1 - 0.9 * step / (passes * blocks)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights[used], model.bias, model.steps = w[: len(used)], float(w[len(used)]), w[len(used) + 1 :].reshape(2, 2).copy()
    emission = model.weights[features].sum(1) + model.bias
    x = np.zeros((len(documents), 3))
    for at in range(0, len(documents), 500):
        found = model.marginals([emission[ids] for ids in documents[at : at + 500]], 200_000)
        x[at : at + 500] = [model.summary(p) for p in found]
    x = np.hstack([np.ones((len(x), 1)), x])
    loss = lambda b: (importance * np.logaddexp(0, (1 - 2 * y) * (x @ b))).sum() + 0.5 * b @ b
    b = np.zeros(4)
    moved = lambda b: np.concatenate([b[:1], np.maximum(b[1:], 0)])  # noqa: E731  more marked tokens never lower a score
    for _ in range(40):  # Newton's method, each step halved until it helps
        p = _sigmoid(x @ b)
        h = (x * (importance * p * (1 - p))[:, None]).T @ x + np.eye(4)
        step = np.linalg.solve(h, x.T @ (importance * (y - p)) - b)
        size = next((k for k in 0.5 ** np.arange(20) if loss(moved(b + k * step)) < loss(b)), 0)
        if not size:
            break
        b = moved(b + size * step)
    model.scale = b
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(text, toxic, n): up to ``sample`` labelled rows of either label outside the held-out fold; n is the label's total."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out).distinct()
    parts = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    totals = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    few = parts[0].unionByName(parts[1]).join(totals, "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic", "n")  # 2 * sample rows


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` rows of either label, fitted in one task; only its weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rows = Vocabulary(), []
        for batch in batches:
            for text, label, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha256((text or "").encode("utf-8", "replace")).digest()
                rows.append((digest, label, total, vocabulary.numbers(tokens(text))))
        rows.sort(key=lambda r: r[:3])  # the same order however the rows arrive
        there = Counter(r[1] for r in rows)
        model = _fit(vocabulary, [r[3] for r in rows], [r[1] for r in rows], [r[2] / there[r[1]] for r in rows] if rows else None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = labelled_sample(docs, labels, sample).repartition(1).mapInArrow(tidy(run), "model binary").collect()  # one row
    return pickle.loads(fitted[0]["model"]) if fitted else fit([], [])


def tagged(docs: DataFrame, model: Field) -> DataFrame:
    """All columns of ``docs`` with toxicity (double) and toxic_spans (array of [start, end) offsets in code points).

    Null and empty texts get the score of a text without tokens and no spans; a column of ``docs`` by
    one of these names is replaced. Repeated rows are repeated, and an empty table gives no rows.
    """
    rest = docs.drop("toxicity", "toxic_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers, whatever the input
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(first, AT_ONCE)
                texts = batch.column(at).to_pylist()
                scores, p = shared.value.scores(texts)
                spans = [[list(span) for span in shared.value.spans(t, q)] for t, q in zip(texts, p, strict=True)]
                columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "toxicity", "toxic_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(tidy(run), f"{fields}, toxicity double, toxic_spans array<array<int>>")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """A row without doc_id is held out or not by an empty id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tagged(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
