"""N-gram Jaccard join by chosen paths.

A document is its set of shingles of five words (lower case, split at white space). Equal sets are one
class from the start. A class's set is embedded in ``COORDINATES`` sampled tokens: coordinate i is the
set's least shingle under the i-th hash, so two sets share it with a probability equal to their
similarity. In each run a bucket of classes is split by coordinates that the bucket's own hash draws, each
with probability 1 / (threshold * COORDINATES) and at least one; classes that share the drawn token stay
together. A pair at the threshold so keeps one common bucket a level on average. Buckets of at most
``LIMIT`` classes are compared in full by their embeddings; larger ones are split again. After ``DEPTH``
splits what is still large is compared block by block, which loses nothing. ``RUNS`` follows from the
target recall: a pair at the threshold survives ``DEPTH`` splits of a run with probability of at least
``SURVIVAL``, so the runs miss it with probability (1 - SURVIVAL) ** RUNS.

Pairs whose embeddings agree in at least threshold - ``SLACK`` link their classes to candidate groups.
Within these every pair is verified by its whole sets, block by block, and each task returns numbers of
links and a spanning forest, never pairs. So neither a large group of copies nor one of near copies makes
rows by the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, in_blocks, table, tidy
from .streams import groups, labels, spans

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64
LIMIT = 96
DEPTH = 4
RECALL = 0.999
SURVIVAL = 0.3
RUNS = ceil(log(1 - RECALL) / log(1 - SURVIVAL))
#: Over four standard deviations of an estimate from ``COORDINATES`` at the threshold.
SLACK = 0.21
BLOCK = 512
#: Of what is still large after ``DEPTH`` splits; a class is sent once for each block of its bucket.
BUCKET_BLOCK = 1024
TABLE_ENTRIES = 150_000
#: Pairs listed, and compared, at once in a task.
PAIRS, COMPARED = 200_000, 40_000

_RNG = np.random.default_rng(7)
_ODD = _RNG.integers(1 << 62, size=(2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS, known: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. A text of fewer words has one, of all of them; one of none has none.

    ``known`` is a table of words' hashes, kept from text to text.
    """
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    try:
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    except KeyError:
        if len(known) > TABLE_ENTRIES:
            known.clear()
        for word in found:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out * _STEP[k % 5] + h[k : k + n])
    return np.unique(out)


def embed(sets: np.ndarray) -> bytes:
    """The least of a set's hashes under each of the coordinates' functions, as 32-bit numbers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(sets), 8192):
        np.minimum(least, (sets[a : a + 8192, None] * _ODD[0] + _ODD[1]).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key (null without words), size, coordinates: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            keys, sizes, coordinates = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, known=known)
                keys.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                sizes.append(len(found))
                coordinates.append(embed(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(coordinates, pa.binary())], ["doc_id", "text_key", "set_key", "size", "coordinates"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidy(run), f"doc_id {kind}, text_key long, set_key long, size int, coordinates binary")


def _children(node: np.ndarray, coordinates: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child bucket) of each class's next buckets: the coordinates that its bucket draws, with their tokens."""
    draw = _mix(node[:, None] ^ _ODD[1][None, :])
    chosen = draw < np.uint64(int(2**64 / (threshold * COORDINATES)))
    chosen[np.arange(len(node)), draw.argmin(1)] = True
    row, coordinate = np.nonzero(chosen)
    return row, _mix(draw[row, coordinate] + coordinates[row, coordinate].astype(np.uint64))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, COORDINATES)


def _split(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, set_key) of the next level, from rows (node or run's seed, set_key, coordinates)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, child = _children(batch["node"].to_numpy().astype(np.uint64), _matrix(batch["coordinates"]), threshold)
                yield pd.DataFrame({"node": child.astype(np.int64), "set_key": batch["set_key"].to_numpy()[row]})

    return classes.select("node", "set_key", "coordinates").mapInPandas(tidy(run), "node long, set_key long")


def _candidates(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Forests over the classes of buckets whose embeddings agree enough.

    A pair of different blocks gives only the edges between what either block links by itself, which the
    blocks' own tasks give. So a bucket's edges are about as many as its classes, not as its block pairs.
    """
    for frame, starts in spans(batches, ["node", "i", "j"]):
        coordinates, keys, side = _matrix(frame["coordinates"]), frame["set_key"].to_numpy(), frame["side"].to_numpy()
        across = frame["i"].to_numpy() != frame["j"].to_numpy()
        sizes = np.diff(starts)
        a, b = [], []
        for size in np.unique(sizes):
            if size < 2:
                continue
            at = starts[:-1][sizes == size]
            x, y = np.triu_indices(size, 1)
            for some in np.array_split(at, max(1, len(at) * len(x) // PAIRS)):
                p, q = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                for k in range(0, len(p), COMPARED):
                    u, v = p[k : k + COMPARED], q[k : k + COMPARED]
                    near = (coordinates[u] == coordinates[v]).sum(1) >= least * COORDINATES
                    a.append(u[near]), b.append(v[near])
        if a:
            u, v = np.concatenate(a), np.concatenate(b)
            given = across[u] & (side[u] == side[v])
            inside, label = labels(len(frame), u[given], v[given]), labels(len(frame), u, v)
            nodes = np.arange(len(frame))
            moved = np.flatnonzero((inside == nodes) & (label != nodes))
            yield pd.DataFrame({"a": keys[moved], "b": keys[label[moved]]}).drop_duplicates()


def _verify(members: list[pd.DataFrame], threshold: float) -> pd.DataFrame | None:
    """(a, b, links) of groups: b the least class that links reach in the group, links by the classes' rows."""
    out = []
    for group in members:
        if len(group) < 2:
            continue
        group = group.drop_duplicates("set_key")
        sets = [np.frombuffer(x, "<u8") for x in group["sets"]]
        size = np.array([len(x) for x in sets])
        n = len(sets)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), size)
        shared = count[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, n), np.float32)
        cuts = np.flatnonzero(np.diff(column, prepend=-1))  # where each shared shingle starts
        width = max(256, 4_000_000 // max(n, 1))
        for k in range(0, len(cuts), width):
            a, b = cuts[k], cuts[k + width] if k + width < len(cuts) else len(column)
            part = np.zeros((n, min(width, len(cuts) - k)), np.float32)
            part[row[a:b], np.cumsum(np.diff(column[a:b], prepend=column[a]) != 0)] = 1
            common += part @ part.T
        common = common.astype(np.float64)
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        i, j, side = (group[c].to_numpy() for c in ("i", "j", "side"))
        if i[0] != j[0]:
            linked &= side[:, None] != side[None, :]
        if linked.any():
            keys = group["set_key"].to_numpy()
            p, q = np.nonzero(np.triu(linked))
            out.append(pd.DataFrame({"a": keys, "b": keys[labels(n, p, q)], "links": linked @ group["copies"].to_numpy()})[linked.any(1)])
    return pd.concat(out) if out else None


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_key, class_id, n_links, n_copies, kept: one row per row of ``docs``.

    Two rows are linked if their sets' similarity is at least ``threshold``; equal sets are. class_id is
    the smallest doc_id (as the column orders them; null only if all are) that links reach, n_links the
    number of other rows linked directly, n_copies that of rows with an equal set, kept marks the rows
    with doc_id = class_id, or all of a class without ids. Texts without words (null, empty) link with
    nothing and are classes of their own. Repeated rows are linked as equal sets are. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(sketched(docs))
    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.first("coordinates").alias("coordinates"))
    classes = cut(classes)
    coordinates = classes.select("set_key", "coordinates")
    seeds = F.explode(F.array(*[F.lit(int(x)) for x in _mix(np.arange(1, runs + 1, dtype=np.uint64)).astype(np.int64)]))
    level = _split(coordinates.withColumn("node", seeds), threshold)
    buckets = []
    for k in range(depth + 1):
        level = level.join(level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node")
        level = cut(level) if k else level  # the first is light to make again, and by far the largest
        buckets.append(level.where(F.col("n") <= LIMIT))
        large = level.where(F.col("n") > LIMIT)
        if k == depth:
            buckets.append(large)
            break
        large = cut(large.join(coordinates, "set_key"))
        if large.isEmpty():
            break
        level = _split(large, threshold)
    found = buckets[0]
    for more in buckets[1:]:
        found = found.unionByName(more)
    found = in_blocks(found, "set_key", BUCKET_BLOCK).join(coordinates, "set_key")
    found = found.select("node", "i", "j", "side", "set_key", "coordinates").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    least = threshold - SLACK
    edges = found.mapInPandas(tidy(lambda batches: _candidates(batches, least)), "a long, b long")
    grouped = components(edges)  # (node, component): only classes with a candidate

    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = grouped.join(sizes, "component").join(classes.select(F.col("set_key").alias("node"), "copies", "rep"), "node")
    members = in_blocks(members.withColumnRenamed("node", "set_key"), "set_key", BLOCK)
    wanted = members.select("set_key", "rep").distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            found = [shingles(text, known=known) for text in batch.column(1).to_pylist()]
            keep = [i for i, (x, key) in enumerate(zip(found, batch.column(0).to_pylist(), strict=True)) if len(x) and xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) == key]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["set_key", "sets"])

    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))
    whole = texts.select("set_key", "text").mapInArrow(tidy(sets), "set_key long, sets binary")
    blocks = members.join(whole, "set_key").select("component", "i", "j", "side", "set_key", "copies", "sets")
    blocks = blocks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in groups(batches, ["component", "i", "j"]):
            made = _verify(found, threshold)
            if made is not None:
                yield made

    links = cut(blocks.mapInPandas(tidy(verified), "a long, b long, links long"))
    joined = components(links.select("a", "b").where("a <> b"))
    totals = links.groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("links"))
    per_class = classes.select("set_key", "copies", "rep").join(totals, "set_key", "left").join(joined.withColumnRenamed("node", "set_key"), "set_key", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "set_key"))
    named = per_class.groupBy("component").agg(F.min("rep").alias("class_id"))
    per_class = per_class.join(named, "component").select("set_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    out = rows.select("doc_id", "text_key", "set_key").join(per_class, "set_key", "left")
    alone = F.col("set_key").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "text_key", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"), alone.alias("_alone"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: of its smallest doc_id, and of rows alike in id one. Rows without words all stay."""
    decided = jaccard_classes(docs, threshold)
    alone = decided.where("_alone").select("doc_id", "text_key").distinct()
    one = decided.where("kept and not _alone").groupBy("class_id").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("n"))
    one = cut(one)
    stay = one.select(F.col("class_id").alias("doc_id"), "text_key").unionByName(alone)
    keys = docs.withColumn("_text_key", F.xxhash64("text"))
    match = keys["doc_id"].eqNullSafe(stay["doc_id"]) & (keys["_text_key"] == stay["text_key"])
    left = keys.join(stay, match, "left_semi")
    if not one.where("n > 1").isEmpty():  # rows that repeat an id: only then are rows compared once more
        worded = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
        left = left.where(worded).dropDuplicates(["doc_id", "_text_key"]).unionByName(left.where(~worded))
    return left.drop("_text_key").select(docs.columns)


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "kept")
