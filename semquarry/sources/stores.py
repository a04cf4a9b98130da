"""Manifests, datasets, baselines, backups and reports: JSON documents that drivers read whole, and the files they name.

Documents here are small by their nature (one manifest, one baseline of each language); what they name is
read by Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, sem
from .jsonl import file_hashes, read_lines

#: Schemas of manifests and of model profiles.
EXPERIMENT, MODEL_PROFILE, BASELINE = "openlunum-experiment/0.1", "openlunum-model-profile/0.1", "1.0"
_DIGEST = re.compile(r"[a-f0-9]{64}")


def read_json(spark: SparkSession, path: str):
    """The value of one JSON document, from any store that Spark reads."""
    found = spark.read.text(path, wholetext=True).first()
    return json.loads(found["value"])


def write_json(spark: SparkSession, value, path: str) -> None:
    """One JSON document, indented, as a text file below ``path``."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest_errors(value: Mapping) -> list[str]:
    """What an experiment's manifest lacks, in order; none where it can be run."""
    filled = lambda key: str(value.get(key) or "").strip()
    errors = [] if value.get("schema") == EXPERIMENT else ["Unsupported experiment schema"]
    errors += [f"{key} is required" for key in ("id", "area", "task", "hypothesis", "baselineCommit", "outputDirectory") if not filled(key)]
    limits, free = value.get("limits") or {}, value.get("deterministic") is True
    if not free:
        errors += [] if filled("modelProfile") else ["modelProfile is required"]
        dataset = value.get("dataset") or {}
        errors += [] if dataset.get("path") and _DIGEST.fullmatch(str(dataset.get("sha256"))) else ["dataset path and SHA-256 are required"]
    least = ("maxItems", "maxAttemptsPerItem", *(() if free else ("maxModelCalls",)))
    return errors + (["experiment limits must be positive"] if any(limits.get(k, 0) < 1 for k in least) else [])


def profile_errors(value: Mapping) -> list[str]:
    """What a model's profile lacks."""
    errors = [] if value.get("schema") == MODEL_PROFILE else ["Unsupported model profile schema"]
    errors += [] if value.get("provider") == "openai-compatible" else ["Only openai-compatible profiles are currently supported"]
    return errors + ([] if value.get("baseUrl") and value.get("model") else ["baseUrl and model are required"])


def dataset(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """Items of a JSON-lines dataset, whose digest must be ``sha256`` where one is given."""
    if sha256 is not None:
        found = {r["sha256"] for r in file_hashes(spark, path).select("sha256").limit(2).collect()}
        if found != {sha256}:
            raise ValueError(f"{path}: digest is not {sha256}")
    return read_lines(spark, path)


def retrieval_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row per retrieval query document, with what breaks its invariants."""
    rows = spark.read.schema("queryId string, query string, candidates array<string>, expectedRelevant array<string>, rankedResults array<string>, mode string, falseEquivalenceIds array<string>").option("multiLine", True).json(path)
    unique = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    within = lambda c: F.size(F.array_except(c, "candidates")) == 0
    return rows.withColumn("errors", policy.reasons((F.coalesce("queryId", F.lit("")) == "", "queryId is empty"), (~unique("candidates"), "candidates repeat"), (~within("rankedResults"), "ranked beyond candidates"), (~within("expectedRelevant"), "expected beyond candidates"), (F.coalesce(F.size("expectedRelevant"), F.lit(0)) <= 0, "nothing expected")))


def language_records(spark: SparkSession, path: str) -> DataFrame:
    """id, language, text, group, fingerprint of multilingual records in JSON lines; null fingerprints where no valid object is given."""
    get = lambda name: F.expr(f"try_variant_get(record, '$.{name}', 'string')")
    form = F.expr("coalesce(to_json(try_variant_get(record, '$.goldSem', 'variant')), to_json(try_variant_get(record, '$.sem', 'variant')))")
    return read_lines(spark, path).where("record is not null").select(get("id").alias("id"), get("sourceLanguage").alias("language"), get("sourceText").alias("text"), get("semanticGroup").alias("group"), sem.sem_fingerprint(form).alias("fingerprint"))


def labelled_pairs(mutations: DataFrame, sources: DataFrame, held_out: DataFrame) -> DataFrame:
    """id, label, sem_a, sem_b: mutated items against their sources, all negative, and held-out pairs; orphans have no sem_a."""
    a = mutations.join(sources.select(F.col("id").alias("sourceItemId"), F.col("sem").alias("sem_a")), "sourceItemId", "left")
    negative = a.select("id", F.lit("negative").alias("label"), "sem_a", F.col("sem").alias("sem_b"))
    return negative.unionByName(held_out.select("id", "label", "sem_a", "sem_b"))


def gate_inputs(documents: DataFrame, column: str) -> DataFrame:
    """gate, actual from JSON objects of gates' names and numbers; null where a value is no number."""
    parsed = documents.select(F.from_json(column, "map<string,string>").alias("m")).where("m is not null")
    return parsed.select(F.explode("m").alias("gate", "_v")).select("gate", F.expr("try_cast(_v as double)").alias("actual"))


def save_baseline(spark: SparkSession, metrics: DataFrame, path: str, **about: str) -> None:
    """A baseline (language and its rates) with what it was taken from: datasetSha256, modelId, schemaVersion."""
    missing = {"datasetSha256", "modelId", "schemaVersion"} - about.keys()
    if missing:
        raise ValueError(f"missing {', '.join(sorted(missing))}")
    rows = {r["language"]: r.asDict() for r in metrics.collect()}  # one row a language
    write_json(spark, {"version": BASELINE, **about, "languages": rows}, path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """language and rates of a stored baseline; None where there is none or it has another form."""
    try:
        found = read_json(spark, path)
        rows = list(found["languages"].values())
        names = [k for k in rows[0] if k != "language"]
        if found["version"] != BASELINE or not all(isinstance(found[k], str) for k in ("datasetSha256", "modelId", "schemaVersion")):
            return None
        return spark.createDataFrame([(str(r["language"]), *(float(r[k]) for k in names)) for r in rows], "language string, " + ", ".join(f"`{k}` double" for k in names))
    except Exception:  # noqa: BLE001  a store that cannot be read is no baseline
        return None


def save_edges(edges: DataFrame, path: str) -> None:
    """Lineage edges as JSON lines."""
    edges.write.mode("overwrite").json(path)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("predecessor long, successor long, relation string, reason string, timestamp string, retainedPaths array<string>").json(path)


def backup(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies the files below ``source`` as rows (path, content, sha256) to ``target``; returns their manifest (path, sha256, length)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    files.select("path", "content", "length", F.sha2("content", 256).alias("sha256")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).select("path", "sha256", "length")


def redacted_report(results: DataFrame, experiment: str) -> DataFrame:
    """One row: counts and rates of results (status, exact, recall) and a digest over them, but no item."""
    count = lambda c: F.count(F.when(c, 1))
    row = results.agg(F.count(F.lit(1)).alias("items"), count(F.col("status") == "passed").alias("passed"), count(~F.col("status").eqNullSafe("passed")).alias("failed"), F.coalesce(F.avg(F.coalesce("exact", F.lit(False)).cast("int")), F.lit(0.0)).alias("exact_rate"), F.coalesce(F.avg(F.coalesce("recall", F.lit(0.0))), F.lit(0.0)).alias("recall"))
    row = row.withColumn("experiment", F.lit(experiment))
    return row.withColumn("integrity", F.sha2(F.to_json(F.struct("experiment", "items", "passed", "failed", "exact_rate", "recall")), 256))


def line_results(lines: DataFrame, operation: str) -> DataFrame:
    """id, ok, output, error of each JSON line for ``validate``, ``fingerprint`` or ``classify``; works on streams too."""
    get = lambda name: F.expr(f"try_variant_get(record, '$.{name}', 'string')")
    form = F.expr("coalesce(to_json(try_variant_get(record, '$.goldSem', 'variant')), to_json(try_variant_get(record, '$.sem', 'variant')))")
    if operation not in ("validate", "fingerprint", "classify"):
        raise ValueError(f"unknown operation {operation}")
    errors = F.array_join(sem.validation_errors(form), "; ")
    why = F.array_join(policy.classified_reasons(F.coalesce(get("sourceText"), F.lit("")), F.coalesce(get("category"), F.lit("simple_fact")), F.lit("low"), F.lit(0.8), F.lit(None).cast("boolean")), ",")
    output = {"validate": F.lit("valid"), "fingerprint": sem.sem_fingerprint(form), "classify": why}[operation]
    kind = F.when(F.col("record").isNull(), "PARSE_ERROR").when(form.isNull(), "MISSING_SEM")
    error = kind if operation == "classify" else kind.when(errors != "", F.concat(F.lit("VALIDATION_FAILED: "), errors))
    rows = lines.select(get("id").alias("id"), error.alias("error"), output.alias("_output"))
    return rows.select("id", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), F.col("_output")).alias("output"), "error")


def read_stream(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """A stream of JSON lines; lines of over ``most`` bytes have a null record."""
    lines = spark.readStream.text(path).where(F.trim("value") != "")
    return lines.select("value", F.expr(f"if(octet_length(value) > {most}, null, try_parse_json(value))").alias("record"))
