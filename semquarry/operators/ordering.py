"""Ranked, windowed and recursive operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .partitioning import stored


def freshness(age_days: Column, half_life_days: float = 7.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half_life_days)


def composite(signals: Mapping[str, tuple[Column, float, float]]) -> Column:
    """Weighted mean of (signal, weight, default); 0 where the weights sum to 0."""
    total = sum(w for _, w, _ in signals.values())
    return sum((F.coalesce(c, F.lit(d)) * w for c, w, d in signals.values()), F.lit(0.0)) / total if total else F.lit(0.0)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Spark keeps k rows of a group per task before the shuffle (WindowGroupLimit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, key, order, 1, "_last").drop("_last")


def gaps(df: DataFrame, by: Sequence[str], step: str) -> DataFrame:
    """Missing steps as stretches [from, to], by each row's neighbour: nothing is gathered by key."""
    w = Window.partitionBy(*by).orderBy(step)
    after = F.lead(step).over(w)
    return df.select(*by, step).distinct().withColumn("_after", after).where(F.col("_after") > F.col(step) + 1).select(*by, (F.col(step) + 1).alias("gap_from"), (F.col("_after") - 1).alias("gap_to"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, time: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the latest right row of its key not after it: one union and one window, no range join.

    ``bucket`` names a stretch of time, such as a day, that grows with it. With it no task holds more than a
    key's rows of one stretch: what a stretch begins with is carried over from the stretches' last values.
    """
    row = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType
    both = left.select(by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    both = both.unionByName(right.select(by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(row).alias("_row"), F.col(value).alias("_v")))
    keys = [by] if bucket is None else [by, "_bucket"]
    both = both if bucket is None else both.withColumn("_bucket", bucket(F.col("_t")))
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)))
    if bucket is not None:
        lasts = both.groupBy(*keys).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_last"))
        before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
        carried = lasts.select(*keys, F.last("_last", ignorenulls=True).over(before)["_v"].alias("_carried"))
        seen = seen.where("_side = 1").join(carried, keys).withColumn("_seen", F.coalesce("_seen", "_carried"))
    return seen.where("_side = 1").select("_row.*", F.col("_seen").alias(f"{value}_as_of"))


def previous(df: DataFrame, by: str, order: Sequence[str], value: str, bucket: Column, name: str) -> DataFrame:
    """``df`` with the value of the row before in the order of its key, of which no task holds more than one stretch.

    ``bucket`` grows with the order. The first row of a stretch gets the last value of the stretch before.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(by, "_bucket").orderBy(*order)
    lasts = rows.groupBy(by, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = lasts.select(by, "_bucket", F.lag("_last").over(Window.partitionBy(by).orderBy("_bucket")).alias("_carried"))
    rows = rows.withColumns({"_first": F.row_number().over(inside) == 1, "_before": F.lag(value).over(inside)}).join(carried, [by, "_bucket"])
    return rows.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))).drop("_bucket", "_first", "_before", "_carried")


def chain_breaks(df: DataFrame, by: Sequence[str], index: str, own: str, previous: str) -> DataFrame:
    """Rows whose previous hash or number does not follow from the row before."""
    w = Window.partitionBy(*by).orderBy(index)
    return df.withColumn("_prev", F.lag(own).over(w)).withColumn("_n", F.row_number().over(w) - 1).where(~F.col("_prev").eqNullSafe(F.col(previous)) | (F.col("_n") != F.col(index))).drop("_prev", "_n")


def lineage(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor, node, depth): shortest walks along edges, of any length, but none back to its start.

    Each round joins the walks end to end, so that it has all of twice the length, until one finds no new pair.
    """
    walks = stored(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("node"), F.lit(1).alias("depth")).where("ancestor <> node").distinct())
    n = walks.count()
    while True:
        onward = walks.select(F.col("ancestor").alias("_mid"), F.col("node").alias("_to"), F.col("depth").alias("_more"))
        longer = walks.join(onward, F.col("node") == F.col("_mid")).where(F.col("ancestor") != F.col("_to")).select("ancestor", F.col("_to").alias("node"), (F.col("depth") + F.col("_more")).alias("depth"))
        after = stored(walks.unionByName(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
        before, n = n, after.count()
        if n == before:
            return walks
        walks = after
