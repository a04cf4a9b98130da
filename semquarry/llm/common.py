"""Pieces shared by the training-data operators: checkpointing, ranking without hot tasks, components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .streams import labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared checkpoint folder and read it from there.

    The folder is the one that ``spark.checkpoint.dir`` names; only where it is unset and the master is
    local (tests, a single machine) a temporary one is taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="semquarry-"))
    return df.checkpoint(eager=True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving the memory that it has freed back to the system at its end.

    Python workers live on for the next stage, and what they keep would come on top of its needs.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``most`` bytes in the column ``text``, or one row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = upto[at - 1] if at else 0
            n = max(1, int(np.searchsorted(upto, done + most, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def hash60(*cols: Column) -> Column:
    """A hash of 60 bits that SQL engines agree on: the first 15 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *cols), 256), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """Rank from 0 within ``keys`` by (bucket, order), no task holding more than one bucket of a key.

    The rows of a key meet only bucket by bucket; the buckets' counts, a few numbers per key, give each
    bucket its first rank. ``keys`` and ``bucket`` must not hold nulls. ``total`` adds the key's row count.
    """
    by = [*keys, bucket]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    inside = df.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return inside.join(counts, by).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_before", "_row")


def in_blocks(df: DataFrame, by: str, block: int) -> DataFrame:
    """Rows dealt to pairs (i, j) of blocks of their key, i <= j, with side (their block); n is the key's count."""
    parts = F.ceil(F.col("n") / block).cast("int")
    df = df.withColumn("_parts", parts).withColumn("side", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return df.withColumns({"i": F.least("side", "_k"), "j": F.greatest("side", "_k")}).drop("_parts", "_k")


#: Edges that one task contracts at once.
CONTRACTED = 500_000


def _contract(edges: DataFrame) -> DataFrame:
    """A spanning forest for each task's edges (a, b): as many edges as nodes at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch for batch in batches if len(batch)]
        if parts:
            both = pd.concat(parts)
            nodes, at = np.unique(both[["a", "b"]].to_numpy(), return_inverse=True)
            at = at.reshape(-1, 2)
            label = labels(len(nodes), at[:, 0], at[:, 1])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            yield pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})

    return edges.mapInPandas(run, "a long, b long")


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` (a, b) with m of ``least`` (a, m, degree).

    Nodes of over a two-hundredth of the ``n`` edges, 400 at most, are joined by broadcast, so that none is a hot task.
    """
    hot = least.where(F.col("degree") > max(20, n // 200)).select("a", "m").collect()
    rest = least.select("a", "m")
    if not hot:
        return edges.join(rest, "a")
    few = F.broadcast(edges.sparkSession.createDataFrame(hot, "a long, m long"))
    return edges.join(few, "a").unionByName(edges.join(few, "a", "left_anti").join(rest, "a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that links reach.

    Alternating large-star and small-star steps, each a shuffle of at most the edges given; partial
    minima are taken before the shuffle's groups meet, and edges of nodes of large degree stay where they
    are. The driver gets a few numbers a round, and the minima of at most 400 nodes.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before, n = None, now.count()
    while n and (before is None or 2 * n < before):  # forests of a bounded number of edges a task, while that helps
        now = cut(_contract(now.repartition(-(-n // CONTRACTED))).distinct())
        before, n = n, now.count()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("degree")))
        # large star: every larger neighbour of a node goes to the node's minimum
        large = _with_least(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a > b").distinct())
        # small star: every node's smaller neighbours, and itself, go to the smallest of them
        small = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")))
        after = _with_least(large, small, n).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = cut(after.where("a > b").distinct())
        # done when the edges are stars whose centre has no smaller neighbour, which the pair of sums shows
        sums = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now = after
        if sums == seen:
            break
        seen = sums
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
