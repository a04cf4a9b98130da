"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more are at a squared distance of 2 - 2c at most. After a rotation to the
principal axes of all vectors, dealt out so that blocks of ``BLOCK_AXES`` axes hold like shares of the
variance, at least one block's part of the squared distance is at most that block's share of it. So each
block is range-joined under its own budget, in two steps. Rows are dealt to strips of the block's first
axis, ``WIDE`` times as wide as the budget's root, and as guests to the next strip where they are near its
edge. Within a strip, rows are halved along the widest of the block's axes into leaves of at most ``LEAF``
rows with boxes over all its axes, and only leaves whose boxes are within the budget of each other are
compared. What is within the budget is a candidate, and is verified by its whole cosine in double precision.
A pair counts in the first block that would find it, so the union needs no pairs to be moved; tasks return
numbers of links and a spanning forest. Strips of over ``ROWS`` rows are compared block by block; equal
vectors are one class from the start.

How much is compared depends on the vectors: of clustered ones little, of ones that fill all directions
alike as much as all pairs or more, though each comparison takes a block's few axes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, in_blocks, table
from .streams import groups, labels

COSINE = 0.93
BLOCK_AXES = 8
ROWS, LEAF = 4096, 16
WIDE = 4
ROUNDING = 1e-9


def units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision of the rows of ``raw``, none of which is zero."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _usable(docs: DataFrame) -> tuple[DataFrame, np.dtype]:
    """vec_id, label, dim, key, raw (the components' bytes, as wide as given), and their type.

    dim, key and raw are null for rows that link with nothing.
    """
    kind = np.dtype(np.float32 if docs.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, raws = [], [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array([np.nan if v is None else v for v in vector], kind) if vector and label is not None else np.zeros(0, kind)
                top = np.abs(x).max(initial=0.0)
                if not top or not np.isfinite(top):
                    dims.append(None), keys.append(None), raws.append(None)
                    continue
                raws.append((x + kind.type(0)).tobytes())
                dims.append(len(x)), keys.append(xxhash.xxh3_128_digest(raws[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "label", "dim", "key", "raw"])

    kinds = [docs.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return docs.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, dim int, key binary, raw binary"), kind


class Blocks:
    """The rotation and the blocks' budgets for vectors of one length."""

    def __init__(self, moments: np.ndarray, cosine: float):
        """``moments``: sums of the outer products of the unit vectors, each with a 1 behind it."""
        dim, n = len(moments) - 1, moments[-1, -1]
        mean = moments[-1, :-1] / n
        values, axes = np.linalg.eigh(moments[:-1, :-1] / n - np.outer(mean, mean))
        order = np.argsort(-values)
        self.n = max(1, dim // BLOCK_AXES)
        dealt = [[] for _ in range(self.n)]
        for k, axis in enumerate(order):  # there and back, so that shares are alike
            turn = k // self.n
            dealt[k % self.n if turn % 2 == 0 else self.n - 1 - k % self.n].append(axis)
        self.rotation = np.concatenate([axes[:, block] for block in dealt], axis=1)
        self.starts = np.cumsum([0, *map(len, dealt)])
        energy = np.array([max(values[block].sum(), 1e-12) for block in dealt])
        self.budget = (2 - 2 * cosine) * energy / energy.sum() + ROUNDING

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distances by block; the same whichever comes first."""
        return np.add.reduceat((x - y) ** 2, self.starts[:-1], axis=1)


def moments(vectors: DataFrame, kind: np.dtype) -> dict[int, np.ndarray]:
    """Sums of the outer products of all unit vectors, each with a 1 behind it, by their length; the driver gets sixteen partial sums."""

    def add(batches: Iterator[pd.DataFrame], raw: bool) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if raw:
                    x = units(np.frombuffer(b"".join(part["m"]), kind).reshape(-1, dim))
                    x = np.concatenate([x, np.ones((len(x), 1))], 1)
                sums[dim] = sums.get(dim, 0) + (x.T @ x if raw else np.frombuffer(b"".join(part["m"]), np.float64).reshape(-1, dim + 1, dim + 1).sum(0))
        yield pd.DataFrame({"dim": np.array(list(sums), np.int32), "m": [s.tobytes() for s in sums.values()]})

    schema = "dim int, m binary"
    first = vectors.select("dim", F.col("raw").alias("m")).mapInPandas(lambda batches: add(batches, True), schema)
    again = first.repartition(16).mapInPandas(lambda batches: add(batches, False), schema)
    total: dict[int, np.ndarray] = {}
    for row in again.collect():
        total[row["dim"]] = total.get(row["dim"], 0) + np.frombuffer(row["m"], np.float64).reshape(row["dim"] + 1, -1)
    return total


def leaves(part: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Rows of ``part`` in leaves of at most ``most``, by halving along the widest axis."""
    out, waiting = [], [np.arange(len(part))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = part[rows]
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(rows) // 2)
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def near_pairs(part: np.ndarray, budget: float, most: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(p, q, compared): pairs of rows of ``part`` within a squared distance of ``budget``, each once, and how many were compared."""
    own = leaves(part, most)
    low, high = np.array([part[rows].min(0) for rows in own]), np.array([part[rows].max(0) for rows in own])
    sizes = np.array([len(rows) for rows in own])
    rows = np.full((len(own), sizes.max()), -1)
    for i, r in enumerate(own):
        rows[i, : len(r)] = r
    x, norm = part[rows], (part**2).sum(1)[rows]
    norm[rows < 0] = np.inf
    for i in range(len(own)):
        gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i]))
        partners = i + np.flatnonzero((gap**2).sum(1) <= budget)
        for at in range(0, len(partners), 128):
            j = partners[at : at + 128]
            d = norm[i][None, :, None] + norm[j][:, None, :] - 2 * (x[i][None] @ x[j].transpose(0, 2, 1))
            k, a, b = np.nonzero(d <= budget)
            keep = (j[k] != i) | (a < b)
            yield rows[i][a[keep]], rows[j[k[keep]], b[keep]], int(sizes[i] * sizes[j].sum()) - int((j == i).any()) * int(sizes[i] * (sizes[i] + 1) // 2)


def _links(group: pd.DataFrame, blocks: Blocks, cosine: float, kind: np.dtype) -> pd.DataFrame | None:
    unit = units(np.frombuffer(b"".join(group["raw"]), kind).reshape(len(group), -1))
    x = unit @ blocks.rotation
    b = int(group["block"].iloc[0])
    guest, side, copies, rid = (group[c].to_numpy() for c in ("guest", "side", "copies", "rid"))
    across = group["i"].iloc[0] != group["j"].iloc[0]
    found_p, found_q = [], []
    for p, q, _ in near_pairs(x[:, blocks.starts[b] : blocks.starts[b + 1]], blocks.budget[b] + 1e-6):
        keep = ~(guest[p] & guest[q])
        if across:
            keep &= side[p] != side[q]
        p, q = p[keep], q[keep]
        for c in range(0, len(p), 100_000):
            u, v = p[c : c + 100_000], q[c : c + 100_000]
            within = blocks.distances(x[u], x[v]) <= blocks.budget
            first = within.any(1) & (within.argmax(1) == b)
            u, v = u[first], v[first]
            close = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
            found_p.append(u[close]), found_q.append(v[close])
    p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_p, found_q))
    if not len(p):
        return None
    links = np.bincount(p, copies[q], len(x)) + np.bincount(q, copies[p], len(x))
    linked = links > 0
    return pd.DataFrame({"a": rid, "b": rid[labels(len(x), p, q)], "links": links.astype(np.int64)})[linked]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Rows link if their labels are equal and their cosine is at least ``cosine``. Null, empty or zero
    vectors, those with null or non-finite components, and rows without label link with nothing and are
    their own component. Vectors of different lengths don't link. Repeated rows count as rows. Rows
    without vec_id count as links; a component of such rows only has the id null. An empty table gives
    no rows. Further columns are left out.
    """
    found, kind = _usable(vectors)
    rows = cut(found)
    by = ["label", "dim", "key"]
    classes = rows.where("key is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.first("raw").alias("raw"))
    classes = cut(classes.withColumn("rid", F.monotonically_increasing_id()))
    blocks = {dim: Blocks(m, cosine) for dim, m in moments(classes, kind).items()}

    def strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                own = blocks[int(dim)]
                x = units(np.frombuffer(b"".join(part["raw"]), kind).reshape(len(part), -1)) @ own.rotation
                for b in range(own.n):
                    root = np.sqrt(own.budget[b]) * (1 + ROUNDING)
                    at = x[:, own.starts[b]] / (WIDE * root)
                    cell = np.floor(at).astype(np.int64)
                    for guest, which in ((False, np.ones(len(x), bool)), (True, (cell + 1 - at) * WIDE <= 1 + ROUNDING)):
                        yield pd.DataFrame({"rid": part["rid"][which], "label": part["label"][which], "dim": part["dim"][which], "block": b, "cell": (cell + guest)[which], "guest": guest})

    label = vectors.schema["label"].dataType.simpleString()
    placed = classes.select("rid", "label", "dim", "raw").mapInPandas(strips, f"rid long, label {label}, dim int, block int, cell long, guest boolean")
    strip = ["label", "dim", "block", "cell"]
    sizes = placed.groupBy(*strip).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("guest"), 1)).alias("_home")).where("n > 1 and _home > 0").drop("_home")
    dealt = in_blocks(placed.join(sizes, strip), "rid", ROWS)
    task = [*strip, "i", "j"]
    dealt = dealt.join(classes.select("rid", "copies", "raw"), "rid").select(*task, "side", "guest", "rid", "copies", "raw").repartition(*task).sortWithinPartitions(*task)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in groups(batches, task):
            for group in found:
                made = _links(group, blocks[int(group["dim"].iloc[0])], cosine, kind)
                if made is not None:
                    yield made

    links = cut(dealt.mapInPandas(compare, "a long, b long, links long"))
    joined = components(links.select("a", "b").where("a <> b"))
    totals = links.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    per_class = classes.drop("raw").join(totals, "rid", "left").join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = per_class.join(named, "component").select(*by, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.drop("raw").join(per_class, by, "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT DISTINCT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
ids AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON a = vec_id LEFT JOIN ids ON x = vec_id
"""
