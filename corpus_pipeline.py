"""From raw documents to packed training sequences, in four stages.

Each stage takes all rows that the one before kept. All but the last return the columns of documents.
Nulls, empty and very long texts, repeated rows, empty tables and further columns pass as each
operator's docstring says: a null or empty text is scored as one without tokens, has no near copies and
no secrets, and is packed as one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semquarry.llm import jaccard, packing, secrets, toxicity
from semquarry.llm.common import cut, table

#: A document is rejected from this toxicity on.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under ``TOXIC``, by a field trained on labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    plain = docs.toDF(*[f"c{i}" if name != "text" else name for i, name in enumerate(docs.columns)])
    return toxicity.tagged(plain, model).where(F.col("toxicity") < TOXIC).drop("toxicity", "toxic_spans").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group that similar sets of five-word shingles link."""
    return jaccard.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets' characters replaced by a mask."""
    return secrets.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("secrets", mask_secrets), ("packing", pack_sequences)]

#: Trained models, regular expressions and tokenizers have no SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on what the one before returned, stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
