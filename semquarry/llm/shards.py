"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows get a seeded hash and a rank by it within their source (stratum); sorted by fractional rank
(rank + 1/2) / rows of the source, every stretch of the order holds the sources in their global
proportion, so cutting it into equal stretches gives shards that match the mixture, with row counts at
most one apart (law ``rows``). Neither ranking puts a source or the whole order into one task: ranks are
taken bucket by bucket, and the buckets' counts are summed. The text is read once and only its size and
checksum are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash60, ranked, table

SHARDS = 8
SEED = "interleave-1"
HASH_BUCKETS = 1024
STRETCHES = 4096


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, stratum: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    A null source is a stratum of its own; a null text has size 1 and the checksum of an empty text;
    rows that tie in hash, id, size and checksum are alike in all that is returned. An empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col(stratum).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("_stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hash60(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_h"),
    ).withColumn("_bucket", F.expr(f"shiftright(_h, {60 - (HASH_BUCKETS - 1).bit_length()})"))
    order = [F.col(c) for c in ("_h", "doc_id", "size", "text_crc32")]
    rows = ranked(rows, ["_stratum"], "_bucket", order, "_r", total="_n_stratum")
    rows = rows.withColumns({
        "_fraction": (2 * F.col("_r") + 1) / (2 * F.col("_n_stratum")),
        "_stretch": F.expr(f"(2 * _r + 1) * {STRETCHES} div (2 * _n_stratum)"),
    })
    sizes = rows.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))  # at most STRETCHES rows
    upto = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_stretch", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_stretch").orderBy("_fraction", "_h", "_stratum", "doc_id", "size", "text_crc32")
    rows = rows.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(starts), "_stretch")
    rows = rows.withColumn("_p", F.col("_start") + F.col("_i") - 1).withColumns({
        "_q": F.expr(f"_all div {shards}"),
        "_more": F.expr(f"_all % {shards}"),
    })
    large = F.expr("_more * (_q + 1)")
    return rows.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(F.col("_p") < large, F.expr("_p div (_q + 1)")).otherwise(F.expr("_more + (_p - _more * (_q + 1)) div greatest(_q, 1)")).cast("int").alias("shard"),
        F.when(F.col("_p") < large, F.expr("_p % (_q + 1)")).otherwise(F.expr("(_p - _more * (_q + 1)) % greatest(_q, 1)")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_shards(spark, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents")).drop("source")


#: CRC-32 has no function there: a table of 256 remainders, then one step a byte.
_CRC = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS t),
"""

OP10_SQL = f"""
WITH {_CRC}
strata AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce('=' || source, 'null') AS stratum,
         ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
digits AS (SELECT doc_id, source, stratum, h, strlen(text) + 1 AS size, hex(encode(text)) AS x FROM strata),
sums AS (
  SELECT doc_id, stratum, h, size, CASE WHEN size = 1 THEN 0 ELSE xor(4294967295::BIGINT,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) END AS text_crc32
  FROM digits, crc_table),
fractions AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum)) AS f
  FROM sums),
placed AS (SELECT *, row_number() OVER (ORDER BY f, h, stratum, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM fractions),
cuts AS (SELECT *, n // {SHARDS} AS q, n % {SHARDS} AS m FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
  (CASE WHEN p < m * (q + 1) THEN p // (q + 1) ELSE m + (p - m * (q + 1)) // greatest(q, 1) END)::INTEGER AS shard,
  (CASE WHEN p < m * (q + 1) THEN p % (q + 1) ELSE (p - m * (q + 1)) % greatest(q, 1) END)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM cuts
"""
