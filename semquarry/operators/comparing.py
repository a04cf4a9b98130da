"""Joins that compare two states: baselines, contracts, expectations, coverage, first matching policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, issue): keys that are expected and missing, or there and unexpected; one full join of distinct keys."""
    a, b = (side.select(key).distinct().withColumn(name, F.lit(True)) for side, name in ((expected, "_want"), (found, "_have")))
    issue = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected")
    return a.join(b, key, "full").withColumn("issue", issue).where("issue is not null").select(key, "issue")


def drops(before: DataFrame, after: DataFrame, by: Sequence[str], least: float, inverted: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Rows of both sides, joined on ``by``, with delta and change: regression, improvement or none beyond ``least``.

    Column value on both sides. Where column ``name`` is one of ``inverted``, less is better. Keys that one side lacks are left out.
    """
    both = after.select(*by, F.col("value").alias("current")).join(before.select(*by, F.col("value").alias("previous")), list(by))
    delta = F.round(F.col("current") - F.col("previous"), 6)
    better = F.when(F.col(name).isin(*inverted), -delta).otherwise(delta) if name and inverted else delta
    return both.withColumn("delta", delta).withColumn("change", F.when(better < -least, "regression").when(better > least, "improvement").otherwise("none"))


def severities(baseline: DataFrame, current: DataFrame, by: Sequence[str], levels: Mapping[str, float]) -> DataFrame:
    """Drops of at least one of the levels, which are given worst first."""
    both = current.select(*by, F.col("value").alias("current")).join(baseline.select(*by, F.col("value").alias("baseline")), list(by)).withColumn("drop", F.round(F.col("baseline") - F.col("current"), 6))
    severity = F.when(F.lit(False), "")
    for level, least in levels.items():
        severity = severity.when(F.col("drop") >= least, level)
    return both.withColumn("severity", severity).where("severity is not null")


def against_baseline(current: DataFrame, baseline: DataFrame, key: str, least_delta: float = 0.05, least: float = 0.5, default: float = 1.0) -> DataFrame:
    """Rates by key against a baseline's, which is ``default`` where it has none: delta, whether under the threshold, whether passed."""
    joined = current.select(key, F.col("rate").alias("current")).join(baseline.select(key, F.col("rate").alias("_base")), key, "left").withColumn("baseline", F.coalesce("_base", F.lit(default)))
    delta, below = F.round(F.col("current") - F.col("baseline"), 6), F.col("current") < least
    return joined.select(key, "baseline", "current", delta.alias("delta"), below.alias("below"), (~((delta < -least_delta) | below)).alias("passed"))


def contract_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(method, path, change, breaking) of endpoints (method, path, auth, bytes): one row for each change."""
    key = ["method", "path"]
    both = old.select(*key, F.col("auth").alias("_a"), F.col("bytes").alias("_m"), F.lit(True).alias("_old")).join(new.select(*key, F.col("auth").alias("_b"), F.col("bytes").alias("_n"), F.lit(True).alias("_new")), key, "full")
    changes = F.array_compact(F.array(F.when(F.col("_new").isNull(), "removed"), F.when(F.col("_old").isNull(), "added"), F.when(~F.col("_a") & F.col("_b"), "auth_added"), F.when(F.col("_n") < F.col("_m"), "size_reduced")))
    return both.select(*key, F.explode(changes).alias("change")).withColumn("breaking", F.col("change") != "added")


def first_match(rows: DataFrame, value: Column, policies: Sequence[tuple[str, int]], name: str = "policy") -> DataFrame:
    """``rows`` with the first policy whose name the value holds and its days; few policies, so a chain of comparisons and no join."""
    policy, days = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for key, limit in policies:
        policy, days = policy.when(F.contains(value, F.lit(key)), key), days.when(F.contains(value, F.lit(key)), limit)
    return rows.withColumns({name: policy, f"{name}_days": days})


def out_of_tolerance(expected: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """(key, divergence) of expectations (key, value, tolerance): missing, or off by more than the tolerance."""
    both = expected.join(measured.select(key, F.col("value").alias("_found")), key, "left")
    divergence = F.when(F.col("_found").isNull(), "missing").when(F.abs(F.col("_found") - F.col("value")) > F.col("tolerance"), "out of tolerance")
    return both.withColumn("divergence", divergence).where("divergence is not null").select(key, "divergence")


def language_queries(records: DataFrame, group: str, language: str, order: str, languages: Sequence[str], most: int = 5) -> DataFrame:
    """(group, source, target, query, expected): pairs of a group's languages, of each the first record, at most ``most`` of a group.

    Sources come in order of their records, targets in the order of ``languages``. A group's records are
    reduced to one a language before they meet, so no group makes more pairs than languages do.
    """
    from pyspark.sql.window import Window

    rank = F.when(F.lit(False), 0)
    for i, name in enumerate(languages):
        rank = rank.when(F.col(language) == name, i)
    firsts = records.groupBy(group, language).agg(F.min(order).alias("id")).withColumn("rank", rank)
    a = firsts.select(group, F.col(language).alias("source"), F.col("id").alias("query"))
    b = firsts.where("rank is not null").select(group, F.col(language).alias("target"), F.col("id").alias("expected"), "rank")
    pairs = a.join(b, group).where("source <> target")
    n = F.row_number().over(Window.partitionBy(group).orderBy("query", "rank"))
    return pairs.withColumn("_n", n).where(F.col("_n") <= most).select(group, "source", "target", "query", "expected")
