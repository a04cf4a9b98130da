"""Language-model scoring by a small causal self-attention model over subword ids, in numpy.

Texts are lower-cased (A-Z) and split into words at white space, each word into subword ids by a public
SentencePiece model, and every text ends with an end token. Every id has an embedding and an output of its
own; outputs stand in order of their counts and are cut into classes of like shares of all tokens (a class,
then an id in it), so that frequent ids are told apart among few. Windows of ``WINDOW`` inputs move by
``SCORED``, so that each token is scored once, with at least WINDOW - SCORED tokens before it where the text
has them, in training too; a batch's windows share one masked attention. The probability of a text is that
of its ids, so it is a proper model of texts.

Counts (of words for the base score, of ids for the classes and the model's biases) cover all training
documents. The weights are trained on the executors in ``ROUNDS`` rounds, which cover all training documents
between them: a hash gives each document its round. In a round, every partition takes steps over its own
windows, and the partitions' weights are averaged, in steps, by their numbers of tokens.
"""

from __future__ import annotations

import copy
import io
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
FOLDS, HELD_OUT = 7, 2
#: Classes have about this share of all tokens each, and at most so many ids.
SHARES, LARGEST = 32, 2048
WINDOW, SCORED = 32, 16
EMBED, HIDDEN = 16, 32
ROUNDS, BATCH, STEPS, RATE = 4, 512, 240, 0.03
#: Numbers that are worked on at once, so that they stay in a core's cache.
BLOCK = 262_144
TABLE_ENTRIES = 500_000
#: Rows that a task sends on at once.
ROWS = 100_000
#: Words whose counts every task has; the others' are joined. A bound on what is broadcast.
FREQUENT = 200_000


class Words:
    """A bounded table of words: a number for each, and by that its hash and subword ids."""

    def __init__(self, model: str | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model) if model else None
        self.clear()

    def clear(self) -> None:
        self.known: pa.Array | None = None  # the words; each one's place is its number
        self.hash = np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)  # where each word's ids start

    def full(self) -> bool:
        """Whether the table is emptied before it takes more."""
        return len(self.hash) > TABLE_ENTRIES

    def add(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words' numbers, lengths in words) of the texts, one after the other.

        Words are split, told apart and found in the table by Arrow; only new ones are taken one by one.
        """
        if self.full():
            self.clear()
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = split.flatten()
        there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
        upto = np.concatenate([[0], np.cumsum(there)])
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        lengths = upto[ends[1:]] - upto[ends[:-1]]
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        known = distinct.slice(0, 0) if self.known is None else self.known.cast(distinct.type)
        of = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unseen = of < 0
        of[unseen] = len(known) + np.arange(unseen.sum())
        more = distinct.filter(pa.array(unseen))
        self.known = pa.concat_arrays([known, more])
        new = more.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if new:
            self.hash = np.append(self.hash, (np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)) ^ np.uint64(1 << 63)).view(np.int64))
            if self.model:
                ids = self.model.encode(new, num_threads=1)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                self.first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
                self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(ids), np.int32, sizes.sum()))
        return of[coded.indices.to_numpy()[there]], lengths

    def subwords(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, number of ids of each)."""
        size = np.diff(self.first)[numbers]
        where = np.arange(size.sum())
        where += np.repeat(self.first[numbers] - (np.cumsum(size) - size), size)
        return self.ids.take(where), size


_WORDS: dict[str | None, Words] = {}


def words_of(model: str | None) -> Words:
    if model not in _WORDS:
        _WORDS[model] = Words(model)
    return _WORDS[model]


def _by_id(ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids that occur, the sums of their rows of ``d``)."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # of 16 bits, which numpy sorts by counting
    first = np.flatnonzero(np.diff(ids[order].astype(np.int64), prepend=-1))
    pairs = d.take(order, 0).view(np.result_type(d.dtype, np.complex64))  # two neighbours are summed in one step
    return ids[order[first]], np.add.reduceat(pairs, first, 0).view(d.dtype)


def _step(m: np.ndarray, v: np.ndarray, d: np.ndarray, rate: float, step: int) -> np.ndarray:
    """What an Adam step takes off the weights; the moments ``m`` and ``v`` are brought up to date in place."""
    d = d * np.float32(0.1)
    m *= np.float32(0.9)
    m += d
    d *= d  # 0.01 times the gradient's square
    v *= np.float32(0.99)
    v += d
    np.sqrt(v, out=d)
    d *= np.float32((1 - 0.99**step) ** -0.5)
    d += np.float32(1e-7)
    np.divide(m, d, out=d)
    d *= np.float32(rate / (1 - 0.9**step))
    return d


class Outputs:
    """Ids' outputs, in order of their counts; the end of a text is among them. ``edges``: the classes' first outputs, and the end."""

    def __init__(self, counts: np.ndarray, texts: int):
        if len(counts) > 65_000:
            raise ValueError(f"{len(counts)} subword ids, 65000 at most")
        counts = np.append(counts, texts).astype(np.float64)
        order = np.argsort(-counts, kind="stable")
        self.of = np.empty(len(counts), np.int64)
        self.of[order] = np.arange(len(counts))
        self.end = int(self.of[-1])
        self.counts = counts[order]
        share = np.minimum(np.cumsum(self.counts) / max(self.counts.sum(), 1) * SHARES, SHARES - 1e-9).astype(int)
        edges = [0]
        for i in np.flatnonzero(np.diff(share)).tolist():  # a class ends where another share begins
            edges.append(i + 1)
        edges = [x for a, b in zip(edges, [*edges[1:], len(counts)], strict=True) for x in range(a, b, LARGEST)]
        self.edges = np.array([*edges, len(counts)])

    def sequences(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs with ends, texts' lengths in outputs)."""
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths)]
        return np.insert(self.of.astype(np.uint16).take(ids), ends, self.end), np.diff(ends, prepend=0) + 1


class Attention:
    """Weights, forward pass and gradient. The input after the last output is the start of a text."""

    def __init__(self, outputs: Outputs, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.edges, size = outputs.edges, len(outputs.counts)
        self.start, self.class_of = size, np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        counts = outputs.counts + 0.1
        per_class = np.add.reduceat(counts, self.edges[:-1])
        self.w = {
            "embed": n(size + 1, EMBED, scale=0.3), "place": n(WINDOW, EMBED), "near": n(size + 1, HIDDEN, scale=0.2), "lag": np.zeros(WINDOW, np.float32),
            "q": n(EMBED, EMBED, scale=0.25), "k": n(EMBED, EMBED, scale=0.25), "v": n(EMBED, EMBED, scale=0.25), "o": n(EMBED, HIDDEN, scale=0.25), "b": np.zeros(HIDDEN, np.float32),
            "class": n(len(per_class), HIDDEN), "class_b": np.log(per_class / per_class.sum()).astype(np.float32), "in": n(size, HIDDEN), "in_b": np.log(counts / per_class[self.class_of]).astype(np.float32),
        }

    def _hidden(self, inputs: np.ndarray, queries: int) -> tuple:
        """Scores of the last ``queries`` places over all inputs up to each, as weights ``p`` that are divided by their sums."""
        w = self.w
        x = w["embed"].take(inputs, 0)
        x += w["place"]
        xq = x[:, WINDOW - queries :]
        kind = x.dtype
        q = (xq.reshape(-1, EMBED) @ (w["q"] * kind.type(EMBED**-0.5))).reshape(xq.shape)
        kv = (x.reshape(-1, EMBED) @ np.hstack([w["k"], w["v"]])).reshape(*x.shape[:2], 2 * EMBED)
        k, v = kv[..., :EMBED], kv[..., EMBED:]
        lag = np.arange(WINDOW - queries, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        p = q @ k.transpose(0, 2, 1)
        if p.max(initial=0) > 40:
            np.minimum(p, 40, out=p)
        np.exp(p, out=p)
        p *= np.where(lag >= 0, np.exp(np.minimum(w["lag"], 40))[np.maximum(lag, 0)], kind.type(0))
        summed = (p.reshape(-1, WINDOW) @ np.ones(WINDOW, kind)).reshape(p.shape[:2])
        summed += kind.type(1e-30)
        np.divide(1, summed, out=summed)
        o = p @ v
        o *= summed[..., None]
        h = o.reshape(-1, EMBED) @ w["o"]
        h += w["near"].take(inputs[:, WINDOW - queries :].ravel(), 0)
        h += w["b"]
        np.maximum(h, 0, out=h)
        return x, xq, q, k, v, lag, p, summed, o, h

    def _log_softmax(self, h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray, scale: float = 0) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities of the targets, ``scale`` times the probabilities less one at the targets, unless it is 0).

        Places are columns: numpy then works along them, however few ids there are.
        """
        at = np.arange(len(target))
        z = w @ h.T
        z += b[:, None]
        logp = z[target, at]
        np.exp(z, out=z)
        total = z.sum(0)
        if not np.isfinite(total.max(initial=0)) or not total.min(initial=1):  # logits beyond what exp can take
            z = w @ h.T + b[:, None]
            z -= z.max(0)
            logp = z[target, at]
            np.exp(z, out=z)
            total = z.sum(0)
        logp -= np.log(total)
        if scale:
            z *= scale / total
            z[target, at] -= scale
        return logp, z

    def _within(self, c: np.ndarray) -> Iterator[tuple[int, int, slice]]:
        """(first id, id after the last, places) of the classes of more than one id among the places' sorted classes ``c``."""
        at = np.searchsorted(c, np.arange(len(self.edges)))
        for i in np.flatnonzero(np.diff(at)).tolist():
            lo, hi = int(self.edges[i]), int(self.edges[i + 1])
            if hi - lo > 1:
                most = max(128, BLOCK // (hi - lo))
                for a in range(at[i], at[i + 1], most):
                    yield lo, hi, slice(a, min(a + most, at[i + 1]))

    def logp(self, inputs: np.ndarray, targets: np.ndarray, use: np.ndarray, queries: int) -> np.ndarray:
        """Natural log-probabilities of the used targets of the windows' last ``queries`` places."""
        w, few = self.w, max(1, BLOCK // WINDOW // queries)
        h = [self._hidden(inputs[a : a + few], queries)[-1] for a in range(0, len(inputs), few)]
        h, target = np.concatenate(h) if h else np.zeros((0, HIDDEN), np.float32), targets[use]
        order = np.argsort(target.astype(np.uint16), kind="stable")
        h, target = h.take(np.flatnonzero(use)[order], 0), target[order]
        c, found = self.class_of[target], np.zeros(len(target), h.dtype)
        with np.errstate(over="ignore"):
            most = max(128, BLOCK // len(w["class_b"]))
            for a in range(0, len(target), most):
                found[a : a + most] = self._log_softmax(h[a : a + most], w["class"], w["class_b"], c[a : a + most])[0]
            for lo, hi, own in self._within(c):
                found[own] += self._log_softmax(h[own], w["in"][lo:hi], w["in_b"][lo:hi], target[own] - lo)[0]
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, use: np.ndarray, queries: int) -> tuple[float, dict]:
        """(log-probability, gradients) of the used targets of the windows' last ``queries`` places.

        Of embeddings and outputs there are only those that occur, as (numbers, gradients).
        """
        w = self.w
        x, xq, q, k, v, lag, p, summed, o, h = self._hidden(inputs, queries)
        target = targets[use]
        by_class = np.argsort(target.astype(np.uint16), kind="stable")
        places, target = np.flatnonzero(use)[by_class], target[by_class]
        hu = h.take(places, 0)
        c, scale = self.class_of[target], h.dtype.type(1 / max(len(target), 1))
        total, dh = 0.0, np.empty_like(hu)
        g = {"class": np.zeros_like(w["class"]), "class_b": np.zeros_like(w["class_b"])}
        sums: dict[int, list] = {}
        with np.errstate(over="ignore"):
            most = max(128, BLOCK // len(w["class_b"]))
            for a in range(0, len(target), most):
                own = slice(a, a + most)
                logp, e = self._log_softmax(hu[own], w["class"], w["class_b"], c[own], scale)
                total += float(logp.sum())
                g["class"] += e @ hu[own]
                g["class_b"] += e.sum(1)
                np.matmul(e.T, w["class"], out=dh[own])
            for lo, hi, own in self._within(c):
                logp, e = self._log_softmax(hu[own], w["in"][lo:hi], w["in_b"][lo:hi], target[own] - lo, scale)
                total += float(logp.sum())
                d, d_b = e @ hu[own], e.sum(1)
                if lo in sums:
                    d, d_b = d + sums[lo][1], d_b + sums[lo][2]
                sums[lo] = [np.arange(lo, hi), d, d_b]
                dh[own] += e.T @ w["in"][lo:hi]
        if sums:
            rows, d, d_b = (np.concatenate(parts) for parts in zip(*sums.values(), strict=True))
            g["in"], g["in_b"] = (rows, d), (rows, d_b)
        dh *= hu > 0
        flat = np.zeros_like(h)
        flat[places] = dh
        g["near"], g["b"], g["o"] = _by_id(inputs[:, WINDOW - queries :].ravel(), flat), flat.sum(0), o.reshape(-1, EMBED).T @ flat
        do = (flat @ w["o"].T).reshape(o.shape)  # of the weighted values' sums, once it is divided by the weights' sums
        do *= summed[..., None]
        dp = do @ v.transpose(0, 2, 1)
        o *= do
        dp -= (o.reshape(-1, EMBED) @ np.ones(EMBED, o.dtype)).reshape(*o.shape[:2], 1)
        dp *= p
        of_lag = dp.sum(0)
        g["lag"] = np.bincount(lag[lag >= 0], of_lag[lag >= 0], WINDOW).astype(h.dtype)
        dq = dp @ k
        dq *= h.dtype.type(EMBED**-0.5)
        dkv = np.concatenate([dp.transpose(0, 2, 1) @ q, p.transpose(0, 2, 1) @ do], 2).reshape(-1, 2 * EMBED)
        dx = (dkv @ np.hstack([w["k"], w["v"]]).T).reshape(x.shape)
        dx[:, WINDOW - queries :] += (dq.reshape(-1, EMBED) @ w["q"].T).reshape(dq.shape)
        g["q"] = xq.reshape(-1, EMBED).T @ dq.reshape(-1, EMBED)
        g["k"], g["v"] = np.hsplit(x.reshape(-1, EMBED).T @ dkv, 2)
        g["place"] = dx.sum(0)
        g["embed"] = _by_id(inputs.ravel(), dx.reshape(-1, EMBED))
        return total, g

    def train(self, sequence: np.ndarray, lengths: np.ndarray, seed: int, rate: float) -> float:
        """Steps over all of the texts' windows, again where they make few; the mean log-probability of the last pass.

        Only a step's own windows are laid out at once.
        """
        text, start = window_starts(lengths, SCORED)
        batch = min(BATCH, max(BATCH // 8, 4 * len(text) // STEPS))
        kinds = [(np.flatnonzero(start == 0), WINDOW, max(1, batch * SCORED // WINDOW)), (np.flatnonzero(start), SCORED, batch)]
        starts = np.cumsum(lengths) - lengths
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        step, total, seen = 0, 0.0, 0
        per_pass = sum(-(-len(own) // size) for own, _, size in kinds)
        passes = max(1, round(STEPS / per_pass))  # one, unless there are few windows
        for _ in range(passes):
            total, seen = 0.0, 0
            steps = [(own[at : at + size], queries) for own, queries, size in ((rng.permutation(own), queries, size) for own, queries, size in kinds) for at in range(0, len(own), size)]
            for at in rng.permutation(len(steps)):
                some, queries = steps[at]
                step += 1
                inputs, targets, use = windows_at(sequence, lengths, starts, text[some], start[some], self.start)
                targets, use = targets[:, WINDOW - queries :], use[:, WINDOW - queries :]
                logp, g = self.gradient(inputs, targets, use, queries)
                total, seen = total + logp, seen + int(use.sum())
                now = rate * min(1, step / 10) * (1 - 0.9 * step / (passes * per_pass))
                for name, d in g.items():
                    if isinstance(d, tuple):
                        of, d = d
                        m_, v_ = m[name][of], v[name][of]
                        self.w[name][of] -= _step(m_, v_, d, now, step)
                        m[name][of], v[name][of] = m_, v_
                    else:
                        self.w[name] -= _step(m[name], v[name], d, now, step)
        return total / max(seen, 1)

    def moved(self, start: Attention) -> dict[str, np.ndarray]:
        return {name: x - start.w[name] for name, x in self.w.items()}


def window_starts(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(window's text, place of its first input in the text) of all windows of texts of these lengths."""
    n = np.maximum(1, -(-(lengths - WINDOW) // stride) + 1)
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), n)
    return text, ((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride).astype(np.int32)


def windows_at(sequence: np.ndarray, lengths: np.ndarray, starts: np.ndarray, text: np.ndarray, start: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, whether a place has a target) of the windows that start there; ``starts`` are the texts'.

    ``sequence`` holds the texts' outputs one after the other; each text's inputs are ``first``, its start,
    and all but its last output.
    """
    at = (starts[text] + start)[:, None] + np.arange(-1, WINDOW)
    np.clip(at, 0, max(len(sequence) - 1, 0), out=at)
    found = sequence.take(at).astype(np.int32)
    inputs, targets = found[:, :-1], found[:, 1:]
    inputs[start == 0, 0] = first
    return inputs, targets, np.arange(WINDOW) < (lengths[text] - start)[:, None]


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT)


def partial_counts(training: DataFrame, model: str = MODEL) -> DataFrame:
    """(subword, key, count) of the words of the training texts, by their hashes, and of their subword ids, task by task.

    A task sends them on when its table of words is full, and at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = words_of(model), np.zeros(0, np.int64)

        def summed() -> Iterator[pa.RecordBatch]:
            seen = np.flatnonzero(total)
            ids = np.bincount(words.ids, np.repeat(np.pad(total, (0, len(words.hash) - len(total))), np.diff(words.first))).astype(np.int64)
            for subword, key, count in ((False, words.hash[seen], total[seen]), (True, np.flatnonzero(ids), ids[ids > 0])):
                for at in range(0, len(key), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[at : at + ROWS]), subword)), pa.array(key[at : at + ROWS]), pa.array(count[at : at + ROWS])], ["subword", "key", "count"])

        for batch in slices(batches, 0):
            if words.full():
                yield from summed()
                total = np.zeros(0, np.int64)
            numbers, _ = words.add(batch.column(0))
            count = np.bincount(numbers, minlength=len(words.hash))
            count[: len(total)] += total
            total = count
        yield from summed()

    return training.select("text").mapInArrow(run, "subword boolean, key long, count long")


def counted(training: DataFrame, model: str = MODEL) -> DataFrame:
    """(subword, key, count): of all words of the training texts, by their hashes, and of all their subword ids."""
    return partial_counts(training, model).groupBy("subword", "key").agg(F.sum("count").alias("count"))


def _packed(moves: dict[str, np.ndarray], n: float) -> pa.RecordBatch:
    """One row: the weights' moves, as half floats, and the number of tokens that they count for."""
    out = io.BytesIO()
    np.savez(out, **{name: x.astype(np.float16) for name, x in moves.items()})
    return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary()), pa.array([n])], ["w", "n"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the rows' moves by their tokens, one row; none of no rows."""
    total: dict[str, np.ndarray] = {}
    tokens = 0.0
    for batch in batches:
        for blob, n in zip(*batch.columns, strict=True):
            tokens += n.as_py()
            for name, x in np.load(io.BytesIO(blob.as_buffer())).items():
                total[name] = total.get(name, 0) + x.astype(np.float64) * n.as_py()
    if total:
        yield _packed({name: x / tokens for name, x in total.items()}, tokens)


def drawn(training: DataFrame, r: int, rounds: int = ROUNDS) -> DataFrame:
    """The training documents of a round: each is in one of them."""
    return training.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id", F.length("text")), F.lit(rounds)) == r)


def train(training: DataFrame, ids: np.ndarray, texts: int, model: str = MODEL, rounds: int = ROUNDS) -> tuple[Attention, Outputs]:
    """The model of the training texts, of which there are ``texts``, with subword ids so often."""
    spark = training.sparkSession
    outputs = Outputs(ids, texts)
    net = Attention(outputs)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((net, outputs))  # a fixed number of weights

        def run(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            net, outputs = shared.value
            words, parts = words_of(model), []
            for batch in slices(batches, 1):
                numbers, lengths = words.add(batch.column(1))
                sequence, size = outputs.sequences(*words.subwords(numbers), lengths)
                parts.append((sequence, size))
            if parts:
                sequence, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                own = copy.copy(net)
                own.w = {name: x.copy() for name, x in net.w.items()}
                own.train(sequence, size, r, RATE / (1 + r))
                yield _packed(own.moved(net), float(len(sequence)))

        parts = drawn(training, r, rounds).select("doc_id", "text").mapInArrow(run, "w binary, n double")
        parts = parts.repartition(8).mapInArrow(_averaged, "w binary, n double")
        found = parts.repartition(1).mapInArrow(_averaged, "w binary, n double").first()
        shared.destroy()
        if found:
            net.w = {name: net.w[name] + x for name, x in np.load(io.BytesIO(found["w"])).items()}
    return net, outputs


def score_texts(numbers: np.ndarray, lengths: np.ndarray, words: Words, net: Attention, outputs: Outputs, block: int = 4096) -> np.ndarray:
    """log10 probability of each whole text, given by its words' numbers."""
    sequence, size = outputs.sequences(*words.subwords(numbers), lengths)
    total = np.zeros(len(size))
    text, start = window_starts(size, SCORED)
    starts = np.cumsum(size) - size
    for some, queries in ((np.flatnonzero(start == 0), WINDOW), (np.flatnonzero(start), SCORED)):
        for at in range(0, len(some), block):
            own = some[at : at + block]
            inputs, targets, use = windows_at(sequence, size, starts, text[own], start[own], net.start)
            use = use[:, WINDOW - queries :]
            logp = net.logp(inputs, targets[:, WINDOW - queries :], use, queries)
            total += np.bincount(np.repeat(text[own], use.sum(1)), logp, len(size))
    return total / np.log(10)


def scored(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Null and empty texts are one end token. Rows without doc_id are held out or not by an empty id. With
    no training rows all counts are 0 and the base score is that of an empty vocabulary, log10(1) a token.
    """
    spark = docs.sparkSession
    training = _training(docs)
    both = cut(counted(training, model))
    texts = training.count()
    counts = both.where("not subword").select(F.col("key").alias("word"), "count")
    ids = np.zeros(words_of(model).model.get_piece_size(), np.int64)
    for row in both.where("subword").collect():  # as many as the subword model's vocabulary at most
        ids[row["key"]] = row["count"]
    n_words, v_words = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n_words + texts, v_words + (texts > 0)
    denominator = n + 1 * (v + 1)
    end = np.log10((texts + 1) / denominator)
    # the words of the largest counts: from the lowest power of two that leaves at most FREQUENT of them
    powers = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()  # 63 rows at most
    power, upto = 62, 0
    for row in sorted(powers, reverse=True):
        upto += row["n"]
        if upto > FREQUENT:
            break
        power = row["power"]
    few = counts.where(F.col("count") >= F.lit(2**power)).toPandas().sort_values("word")
    shared = spark.sparkContext.broadcast((few["word"].to_numpy(np.int64), few["count"].to_numpy(np.int64), *train(training, ids, texts, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, net, outputs = shared.value
        words = words_of(model)
        for part in slices(batches, 1):
            numbers, lengths = words.add(part.column(1))
            hashes = words.hash
            place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            there = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
            c = np.where(there, count[place], 0) if len(known) else np.zeros(len(hashes), np.int64)
            text = np.repeat(np.arange(len(lengths)), lengths)
            found = there[numbers]
            base = np.bincount(text, np.where(found, np.log10((c[numbers] + 1) / denominator), 0.0), len(lengths)) + end
            n_known = np.bincount(text[found], minlength=len(lengths)) + (texts > 0)
            rare = hashes[numbers[~found]]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text[~found], minlength=len(lengths)))])
            score = score_texts(numbers, lengths, words, net, outputs)
            columns = [part.column(0), pa.array(lengths + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rare))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base double, score double, rare array<long>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(denominator)))).alias("_base"), F.count("count").alias("_known"))
    out = rows.drop("rare").join(rare, "row", "left")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op5_attention(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
