"""Exact top-k search by cover trees of queries and data.

The top of one cover tree over all rows, of at most ``CELLS`` leaves, is fitted to a bounded sample: nested
levels of centres, each level's radius half of the one's above, or as near to that as a bounded number of
children comes. Every row, query or candidate, goes to the leaf of the nearest centre, and all rows' distances
give the leaves' covering radii. First each query is searched in its own leaf, which gives every leaf's
queries a worst k-th score. Then pairs of a query leaf and a data leaf are pruned, from the root down, where
no inner product below them, by the centres' product and the radii, can reach that score, and only the pairs
that are left are searched, the queries of neighbouring leaves together. A task holds at most about ``ROWS``
candidates and ``QUERIES`` queries; it has a cover tree of either side and prunes pairs of their nodes in the
same way, beginning with the k-th scores that its queries have already.

How much is pruned depends on the vectors: of clustered ones nearly all. Of ones that fill all directions
alike no bound can prune anything, since no covering radius is small beside the differences of scores; there
the children of a node don't come nearer to its rows than it is itself, the node stays a leaf, and its rows
are compared in whole blocks.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table
from .streams import groups

K = 5
EVERY = 50
ROWS, QUERIES = 4096, 1024
LEAF = 16
#: Leaves of the tree's top, and rows that it is fitted to; every row is indexed.
CELLS, SAMPLE = 256, 10_000
#: A node has at most this times the root of its rows as children, and stays a leaf if they leave more of its radius.
FANOUT, SHRINK = 4, 0.6


class CoverTree:
    """Nodes in order, the root first: centres, covering radii, children and rows (of leaves only).

    A node's children cover its rows within half of its radius, or within ``SHRINK`` of it where this would
    take too many; the first has the node's own centre.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, most: int | None = None):
        self.x = x
        centres, self.rows, self.kids, radius = [0] if len(x) else [], [np.arange(len(x))], [[]], [self._away(np.arange(len(x)), 0).max(initial=0)]
        at, leaves = 0, 1
        order = [0]
        while at < len(order):  # level by level
            node = order[at]
            at += 1
            rows = self.rows[node]
            if len(rows) <= leaf or not radius[node] or most and leaves >= most:
                continue
            picked, away = [centres[node]], self._away(rows, centres[node])
            owner = np.zeros(len(rows), np.int64)
            fanout = FANOUT * int(np.sqrt(len(rows)) + 1)
            while away.max() > radius[node] / 2 and len(picked) < fanout and (not most or leaves + len(picked) <= most):
                far = rows[away.argmax()]
                d = self._away(rows, far)
                owner[d < away] = len(picked)
                away = np.minimum(away, d)
                picked.append(far)
            if away.max() > SHRINK * radius[node]:
                continue
            self.rows[node] = rows[:0]
            for i, centre in enumerate(picked):
                own = rows[owner == i]
                self.kids[node].append(len(centres)), order.append(len(centres))
                centres.append(centre), self.rows.append(own), self.kids.append([]), radius.append(away[owner == i].max(initial=0))
            leaves += len(picked) - 1
        self.centre, self.radius = x[centres], np.array(radius if len(x) else [])
        self.norm = np.sqrt((self.centre**2).sum(1))

    def _away(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(1)) if len(rows) else np.zeros(0)

    def leaves(self) -> np.ndarray:
        """The leaves from one side of the tree to the other, so that neighbours follow each other."""
        out, waiting = [], [0] if self.kids and len(self.radius) else []
        while waiting:
            node = waiting.pop()
            waiting += self.kids[node][::-1]
            out += [] if self.kids[node] else [node]
        return np.array(out, np.int64)


def bounds(a: CoverTree, i: np.ndarray | int, b: CoverTree, j: np.ndarray) -> np.ndarray:
    """No inner product of a row below node ``i`` of ``a`` and one below ``j`` of ``b`` is larger, nor the next whole number."""
    found = b.centre[j] @ a.centre[i] + a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
    return np.floor(found + 1e-6 * (1 + np.abs(found)))


def search(q: np.ndarray, q_row: np.ndarray, d: np.ndarray, d_row: np.ndarray, k: int, known: np.ndarray | None = None, evaluated: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, positions in ``d``) of each query's k best, by falling score, then by position; -1 where there are fewer.

    ``q_row`` and ``d_row`` name rows; a row is no candidate of its own. All values are whole numbers.
    Candidates under a query's ``known`` score may be left out. ``evaluated`` is given the numbers of
    products that were taken.
    """
    nq, nd = len(q), len(d)
    most = max(float(np.abs(q).max(initial=1)), float(np.abs(d).max(initial=1))) ** 2 * q.shape[1] * (nd + 1)
    if most >= 2**52:  # beyond whole numbers in doubles: Python's own
        return _plain(q, q_row, d, d_row, k)
    least = -(2.0**60)
    best = np.full((nq, k), least)  # score * nd + (nd - 1 - position): larger is better, and no two are equal
    floor = np.full(nq, least) if known is None else np.where(np.isfinite(known), known * nd, least)
    a, b = CoverTree(q), CoverTree(d)
    below = [np.zeros(0, np.int64)] * len(a.kids)  # each node's queries
    for i in range(len(a.kids) - 1, -1, -1):
        below[i] = np.concatenate([a.rows[i], *(below[kid] for kid in a.kids[i])])

    def worst(i: int) -> float:
        return np.maximum(best[below[i], 0], floor[below[i]]).min()

    def evaluate(i: int, nodes: np.ndarray) -> None:
        data, queries = np.concatenate([b.rows[j] for j in nodes]), below[i]
        for at in range(0, len(data), 1024):
            own = data[at : at + 1024]
            keys = (q[queries] @ d[own].T) * nd + (nd - 1 - own)
            keys[q_row[queries][:, None] == d_row[own][None, :]] = least
            both = np.concatenate([best[queries], keys], axis=1)
            best[queries] = np.sort(np.partition(both, -k, axis=1)[:, -k:], axis=1)
            if evaluated is not None:
                evaluated.append(keys.size)

    def visit(i: int, nodes: np.ndarray) -> None:
        """Node ``i`` of the queries against these nodes of the data, those of the largest bounds first."""
        bound = bounds(a, i, b, nodes)
        order = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[order], bound[order]
        small = bound * nd + nd <= worst(i)
        nodes = nodes[~small]
        inner = np.array([bool(b.kids[j]) for j in nodes], bool)
        if not len(nodes):
            return
        if a.kids[i] and not inner.any():  # the data cannot be split further
            for kid in a.kids[i]:
                visit(kid, nodes)
        elif not inner.any():
            for at in range(0, len(nodes), 16):
                some = nodes[at : at + 16]
                some = some[bounds(a, i, b, some) * nd + nd > worst(i)]
                if len(some):
                    evaluate(i, some)
        elif a.kids[i] and a.radius[i] > b.radius[nodes].max():
            for kid in a.kids[i]:
                visit(kid, nodes)
        else:
            visit(i, np.concatenate([b.kids[j] if b.kids[j] else [j] for j in nodes]).astype(np.int64))

    if nq and nd:
        visit(0, np.zeros(1, np.int64))
    best = best[:, ::-1]
    score = np.floor_divide(best, nd)
    return score.astype(np.int64), np.where(best == least, -1, nd - 1 - (best - score * nd)).astype(np.int64)


def _plain(q: np.ndarray, q_row: np.ndarray, d: np.ndarray, d_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    exact = [[int(v) for v in row] for row in d]
    scores, positions = np.zeros((len(q), k), object), np.full((len(q), k), -1)
    for i, row in enumerate(q):
        row = [int(v) for v in row]
        all_ = sorted((-sum(a * b for a, b in zip(row, other, strict=True)), j) for j, other in enumerate(exact) if d_row[j] != q_row[i])[:k]
        for r, (s, j) in enumerate(all_):
            scores[i, r], positions[i, r] = -s, j
    return scores, positions


def _whole(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v (doubles that are whole numbers): rows with usable vectors only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, out = [], [], []
            for i, vector in enumerate(batch.column(1).to_pylist()):
                x = np.array([np.nan if v is None else v for v in vector], np.float64) if vector else np.full(1, np.nan)
                if np.isfinite(x).all():
                    keep.append(i), dims.append(len(x)), out.append(np.floor(256 * x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


def _top(rows: DataFrame) -> dict[int, CoverTree]:
    """The tree's top for each length of vectors, from the ``SAMPLE`` rows of smallest hash."""
    sample = rows.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    out: dict[int, CoverTree] = {}
    for dim in sorted({r["dim"] for r in sample}):
        out[dim] = CoverTree(np.array([np.frombuffer(r["v"], np.float64) for r in sample if r["dim"] == dim]), 1, CELLS)
    return out


def _nearest(tree: CoverTree, leaves: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the leaves, distance) of the nearest leaf's centre."""
    at = np.empty(len(x), np.int64)
    for i in range(0, len(x), 2048):
        at[i : i + 2048] = (tree.norm[leaves] ** 2 - 2 * x[i : i + 2048] @ tree.centre[leaves].T).argmin(1)
    return at, np.sqrt(((x - tree.centre[leaves[at]]) ** 2).sum(1))


def open_pairs(tree: CoverTree, leaves: np.ndarray, query_radius: np.ndarray, data_radius: np.ndarray, worst: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of a query leaf and a data leaf, from the root down, that the bounds don't prune; own leaves are left out.

    Radii are -1 for leaves without queries or without data.
    """
    place = {int(node): i for i, node in enumerate(leaves)}
    sides = []
    for own in (query_radius, data_radius):
        radius = np.full(len(tree.kids), -1.0)
        radius[leaves] = own
        for node in range(len(tree.kids) - 1, -1, -1):
            for kid in tree.kids[node]:
                if radius[kid] >= 0:
                    radius[node] = max(radius[node], float(np.sqrt(((tree.centre[kid] - tree.centre[node]) ** 2).sum())) + radius[kid])
        side = copy.copy(tree)
        side.radius = radius
        sides.append(side)
    least = np.full(len(tree.kids), np.inf)
    least[leaves] = worst
    for node in range(len(tree.kids) - 1, -1, -1):
        least[node] = min([least[node], *(least[kid] for kid in tree.kids[node])])
    queries, data = sides
    found, waiting = [], [(0, 0)]
    while waiting:
        i, j = waiting.pop()
        if queries.radius[i] < 0 or data.radius[j] < 0 or bounds(queries, i, data, np.array([j]))[0] < least[i]:
            continue
        if tree.kids[i] and (queries.radius[i] >= data.radius[j] or not tree.kids[j]):
            waiting += [(kid, j) for kid in tree.kids[i]]
        elif tree.kids[j]:
            waiting += [(i, kid) for kid in tree.kids[j]]
        elif i != j:
            found.append((place[i], place[j]))
    return found


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every row whose vec_id is divisible by ``every``.

    A row is never its own candidate; rows that repeat an id are. Null or empty vectors and those with
    null or non-finite components take no part; only vectors of equal length meet. Ties go to the smaller
    vec_id, null last. A repeated query row has a result of its own. An empty table gives no rows. Further
    columns are left out.
    """
    spark = vectors.sparkSession
    whole = _whole(vectors)
    tops = {dim: (tree, tree.leaves()) for dim, tree in _top(whole).items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, x = batch.column(1).to_numpy(), batch.column(2)
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                if dim not in tops:  # a length that the sample lacks has one leaf, at its first row
                    cell[own], away[own] = 0, np.inf
                    continue
                v = np.frombuffer(b"".join(x.take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), -1)
                cell[own], away[own] = _nearest(*tops[dim], v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    rows = whole.withColumn("row", F.monotonically_increasing_id()).withColumn("query", is_query)
    rows = cut(rows.mapInArrow(place, "vec_id long, dim int, v binary, row long, query boolean, cell int, away double"))
    by = ["dim", "cell"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("query"), 1)).alias("nq"), F.max("away").alias("data_radius"), F.max(F.when(F.col("query"), F.col("away"))).alias("query_radius"))
    kind, sizes = sizes.schema, sizes.collect()  # CELLS rows for each length of vectors
    sizes = spark.createDataFrame(sizes, kind)
    # parts of a leaf's rows by a hash, and groups of neighbouring leaves of about QUERIES queries
    leaf_sizes = sorted((r["dim"], r["cell"], r["nq"]) for r in sizes.collect())
    groups_of, taken = [], {}
    for dim, cell, nq in leaf_sizes:
        before = taken.get(dim, 0)
        taken[dim] = before + nq
        groups_of.append((dim, cell, before // QUERIES))
    grouped = F.broadcast(spark.createDataFrame(groups_of, "dim int, cell int, part int"))
    parted = rows.join(F.broadcast(sizes.select(*by, F.ceil(F.col("n") / ROWS).alias("_d"), F.ceil(F.col("nq") / QUERIES).alias("_q"))), by).join(grouped, by)
    parted = parted.withColumns({"d": F.pmod(F.xxhash64("row"), F.col("_d")).cast("int"), "q": F.when(F.col("query"), F.pmod(F.xxhash64("row"), F.col("_q"))).cast("int")}).drop("away", "query", "_d", "_q")
    task = ["dim", "cell", "d", "from", "q"]
    columns = [*task, "query", "row", "vec_id", "v", "known"]
    data_parts = sizes.select(*by, F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / ROWS).cast("int") - 1)).alias("d"))

    def searched(pairs: DataFrame | None, known: DataFrame | None) -> DataFrame:
        """The best of each query of the pairs (dim, from, cell) of a group and a leaf; of its own leaf, where no pairs are given."""
        none = F.lit(None).cast("long")
        asked = parted.where("q is not null").withColumn("from", F.col("cell") if pairs is None else F.col("part"))
        asked = asked.withColumn("known", none) if known is None else asked.join(known, "row", "left")
        pairs = sizes.where("nq > 0").select(*by, F.col("cell").alias("from")) if pairs is None else pairs
        parts = asked.select("dim", "from", "q").distinct()  # a hot leaf's queries have several
        pairs = pairs.join(data_parts, by).join(parts, ["dim", "from"]).select(*task)
        data = parted.drop("q").join(pairs, ["dim", "cell", "d"]).withColumns({"query": F.lit(False), "known": none})
        queries = asked.drop("cell", "d").join(pairs, ["dim", "from", "q"]).withColumn("query", F.lit(True))
        both = data.select(columns).unionByName(queries.select(columns)).repartition(*task).sortWithinPartitions(*task, F.col("vec_id").asc_nulls_last(), "row")
        return both.mapInPandas(run, "row long, query_id long, vec_id long, of long, score long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in groups(batches, task):
            for group in found:
                query = group["query"].to_numpy()
                x = np.frombuffer(b"".join(group["v"]), np.float64).reshape(len(group), -1)
                if not query.any() or query.all():
                    continue
                row, known = group["row"].to_numpy(), group["known"].to_numpy(np.float64, na_value=np.nan)
                ids = group["vec_id"].astype("Int64").array
                scores, at = search(x[query], row[query], x[~query], row[~query], k, known[query])
                i, r = np.nonzero(at >= 0)
                yield pd.DataFrame({"row": row[query][i], "query_id": ids[query][i], "vec_id": ids[~query][at[i, r]], "of": row[~query][at[i, r]], "score": scores[i, r].astype(np.int64)})

    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "of")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = cut(best(searched(None, None)))
    known = first.where(F.col("rank") == k).select("row", F.col("score").alias("known"))
    # a leaf's worst k-th score: none where one of its queries has fewer than k; CELLS rows for each length of vectors
    worst = parted.where("q is not null").select(*by, "row").join(known, "row", "left").groupBy(*by).agg(F.min("known").alias("_least"), F.count("known").alias("_n"), F.count(F.lit(1)).alias("_all"))
    found: dict[int, list] = {}
    for r in sizes.join(worst, by, "left").collect():
        found.setdefault(r["dim"], []).append((r["cell"], -1.0 if r["query_radius"] is None else r["query_radius"], r["data_radius"], r["_least"] if r["_all"] and r["_n"] == r["_all"] else -np.inf))
    pairs = []
    for dim, cells in found.items():
        if dim in tops:
            tree, leaves = tops[dim]
            query, data, least = np.full(len(leaves), -1.0), np.full(len(leaves), -1.0), np.full(len(leaves), np.inf)
            for cell, *values in cells:
                query[cell], data[cell], least[cell] = values
            part_of = {cell: part for d, cell, part in groups_of if d == dim}
            pairs += sorted({(dim, j, part_of[i]) for i, j in open_pairs(tree, leaves, query, data, least)})
    if pairs:  # a group's queries may meet their own leaf again
        first = first.drop("rank").unionByName(searched(spark.createDataFrame(pairs, "dim int, cell int, from int"), known)).dropDuplicates(["row", "of"])
    return best(first.select("row", "query_id", "vec_id", "of", "score")).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {K}
"""
