"""Text normalization, surface identity and token counts as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a telegraph leaves out.
STOP_WORDS = "the a an is are was were be been being to of and or for in on at with from by this that these those it its as do does did have has had".split()


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function; text that has that form already is passed on."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def normalization_form(text: pd.Series) -> pd.Series:
    """NFC or NFD where the text is in one of them only, else the first compatible form that it is in, or unknown."""

    def form(t):
        if t is None:
            return None
        composed, decomposed = unicodedata.is_normalized("NFC", t), unicodedata.is_normalized("NFD", t)
        if composed != decomposed:
            return "NFC" if composed else "NFD"
        return next((f for f in ("NFKC", "NFKD") if unicodedata.is_normalized(f, t)), "unknown")

    return text.map(form)


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(text), r"(?U)[\s\x{FEFF}]+", " "))


def normalize_identifier(text: Column) -> Column:
    return F.lower(F.replace(normalize_text(text), F.lit(" "), F.lit("_")))


def surface_fingerprint(text: Column, length: int = 24, tag: str = "0.1") -> Column:
    digest = F.sha2(F.lower(normalize_text(F.coalesce(text, F.lit("")))), 256)
    return F.concat(F.lit(f"lsf:{tag}:sha256:"), F.substring(digest, 1, min(64, max(16, length))))


def telegraph(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(nfkc(text)), F.lit(r"([\p{L}\p{N}_-]+)"), 1)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(stop, w)), " ")


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def rough_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(utf16_length(text) / 4)).cast("long")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("long")


def word_punct_tokens(text: Column) -> Column:
    """Words and single marks, and the two ends."""
    return (F.size(F.regexp_extract_all(text, F.lit(r"""([.,!?;:()"']|[^\s.,!?;:()"']+)"""), 1)) + 2).cast("long")


def symbol_tokens(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, and every other mark by itself."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+|[^\sA-Za-z0-9_])"), 1)).cast("long")


def byte_tokens(text: Column, bytes_per_token: float = 3.5) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / bytes_per_token)).cast("long")


def savings_ratio(before: Column, after: Column) -> Column:
    return F.when(before <= 0, F.lit(float("nan"))).otherwise((before - after) / before)


def parse_fingerprint(fp: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(fp, r"^(lfp|lsf):(\d+\.\d+):(sha256):([a-f0-9]+)$", k), F.lit(""))
    return F.struct(part(1).alias("prefix"), part(2).alias("version"), part(3).alias("algorithm"), part(4).alias("digest"))
