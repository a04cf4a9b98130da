"""JSON-lines and JSON-document sources and sinks, with errors kept beside the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sem import sem_fingerprint, validation_errors


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value, record (variant; null if not JSON): blank lines are left out. Splits files, so any size is read in parallel."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("_metadata.file_path").alias("file"), "value", F.expr("try_parse_json(value)").alias("record"))


def good_and_bad(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    return lines.where("record is not null"), lines.where("record is null").select("file", "value")


def extract_records(documents: DataFrame, text: str) -> DataFrame:
    """One row per record of a JSON object, array, or wrapper {records | items | data: [...]}."""
    parsed = documents.withColumn("_v", F.expr(f"try_parse_json({text})"))
    parsed = parsed.withColumn("_list", F.expr("coalesce(try_variant_get(_v, '$.records', 'array<variant>'), try_variant_get(_v, '$.items', 'array<variant>'), try_variant_get(_v, '$.data', 'array<variant>'), try_variant_get(_v, '$', 'array<variant>'), array(_v))"))
    return parsed.where("_v is not null").select(F.explode("_list").alias("record"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def process(lines: DataFrame, operation: str) -> DataFrame:
    """value, result or error of each line for ``validate`` or ``fingerprint``."""
    sem = F.expr("coalesce(to_json(variant_get(record, '$.goldSem', 'variant')), to_json(variant_get(record, '$.sem', 'variant')), value)")
    lines = lines.withColumn("_sem", sem)
    result = F.array_join(validation_errors("_sem"), "; ") if operation == "validate" else sem_fingerprint("_sem")
    return lines.select("value", F.when(F.col("record").isNotNull(), result).alias("result"), F.when(F.col("record").isNull(), "not JSON").alias("error"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, state (ok, missing, corrupt, unexpected) of a manifest (path, sha256) against found files."""
    both = manifest.select("path", F.col("sha256").alias("_want")).join(found.select("path", F.col("sha256").alias("_have")), "path", "full_outer")
    return both.select("path", F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_want") != F.col("_have"), "corrupt").otherwise("ok").alias("state"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
