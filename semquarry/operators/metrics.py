"""Grouped measures: confusion, ranking, percentiles, histograms, descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def confusion(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = (), empty_precision: float = 1.0) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, fpr by group; ``empty_precision`` is given where nothing is predicted."""
    count = lambda c: F.count(F.when(c, 1))
    out = df.groupBy(*by).agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"), count(~predicted & ~actual).alias("tn"))
    ratio = lambda a, b, empty: F.when(b == 0, F.lit(empty)).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty_precision), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return out.withColumns({"precision": rounded(p), "recall": rounded(r), "f1": rounded(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))), "fpr": rounded(ratio(F.col("fp"), F.col("fp") + F.col("tn"), 0.0))})


def threshold_sweep(df: DataFrame, score: str, actual: Column, thresholds: Sequence[float]) -> DataFrame:
    """The confusion at each threshold: one row is dealt to the fixed list of thresholds, and summed before the shuffle."""
    swept = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return confusion(swept, F.col(score) >= F.col("threshold"), actual, ["threshold"])


def ranking(df: DataFrame, query: str, order: Sequence[Column], relevant: Column, k: int = 10) -> DataFrame:
    """ndcg, mrr (reciprocal rank), ap and precision at k by query, from each query's ranked list."""
    w = Window.partitionBy(query).orderBy(*order)
    rel = relevant.cast("int")
    df = df.withColumn("_rel", rel).withColumn("_rank", F.row_number().over(w)).withColumn("_hits", F.sum("_rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.col("_rel") / F.log2(F.col("_rank") + 1)
    out = df.groupBy(query).agg(
        F.sum(F.when(F.col("_rank") <= k, gain).otherwise(0.0)).alias("_dcg"),
        F.sum("_rel").alias("relevant"),
        F.min(F.when(F.col("_rel") == 1, F.col("_rank"))).alias("_first"),
        F.sum(F.when(F.col("_rel") == 1, F.col("_hits") / F.col("_rank")).otherwise(0.0)).alias("_ap"),
        F.sum(F.when(F.col("_rank") <= k, F.col("_rel")).otherwise(0)).alias("_at_k"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return out.select(query, "relevant", rounded(F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("_dcg") / ideal)).alias("ndcg"), rounded(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"), rounded(F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("_ap") / F.col("relevant"))).alias("ap"), rounded(F.col("_at_k") / k).alias("precision_at_k"))


def nearest_rank(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def latency_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """count, min, max, mean, linear p50/p95/p99 and nearest-rank p95."""
    linear = lambda p: rounded(F.expr(f"percentile({value}, {p})"))
    return df.groupBy(*by).agg(F.count(value).alias("n"), rounded(F.min(value)).alias("lowest"), rounded(F.max(value)).alias("highest"), rounded(F.avg(value)).alias("mean"), linear(0.5).alias("p50"), linear(0.95).alias("p95"), linear(0.99).alias("p99"), rounded(nearest_rank(value, 0.95)).alias("p95_nearest"))


def descriptive(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """n, mean, lower median, sample and population deviation, nearest-rank quartiles and their range."""
    q = lambda p: nearest_rank(value, p)
    return df.groupBy(*by).agg(F.count(value).alias("n"), rounded(F.avg(value), 3).alias("mean"), rounded(q(0.5), 3).alias("median_low"), rounded(F.median(value), 3).alias("median_mid"), rounded(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 3).alias("sd"), rounded(F.stddev_pop(value), 3).alias("sd_pop"), rounded(q(0.75) - q(0.25), 3).alias("iqr"))


def histogram(df: DataFrame, value: Column, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Counts in (previous, bound] and beyond the last, by a chain of comparisons rather than a join."""
    bucket = F.when(F.lit(False), F.lit(0.0))
    for b in bounds:
        bucket = bucket.when(value <= b, F.lit(float(b)))
    return df.withColumn("upto", bucket.otherwise(F.lit(float("inf")))).groupBy(*by, "upto").agg(F.count(F.lit(1)).alias("n"))
