"""Packing documents into sequences by large-item matching.

Only an item's length matters to a packing, so the plan is made from the histogram of lengths: at most
``CAPACITY`` counts, whatever the size of the input. Items above a third of the capacity, of which no
three fit together, are matched: the largest with the largest that still fits beside it, which makes as
many pairs as can be made. The smaller ones, from the longest, go where they leave the smallest gap.
The plan says which ranks of a length go to which sequences; an item's rank within its length is taken
without putting a length into one task. The driver sees the histogram and nothing else.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash60, ranked, table, tidy

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY = 1024
END_ID = 2
#: Bounds of a worker's table of words.
TABLE_ENTRIES, LONGEST_ENTRY = 200_000, 100
#: Buckets of a length's rows for their ranks: so many at least, and so many rows in each at most, nearly.
RANK_BUCKETS, BUCKET_ROWS = 256, 50_000


class ByteIds:
    """Ids of the ``tokenizers`` file, as bytes of 32-bit numbers.

    The file's pattern takes a single space with the word behind it, so where no two white spaces meet
    around a space, the text falls apart there and each word's ids can be kept in a bounded table. Words
    new to it are encoded by a faster library from the same vocabulary, as ranks. Other texts, and those
    that hold the special token's string, are encoded whole.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        pairs = map(bytes.split, open(ranks, "rb"))
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.table: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any([token in text for token in self.special]):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        known = self.table
        try:  # the table has no word with white space at an end, and no empty one
            return self._ids(first) + b"".join([known[word] for word in words])
        except KeyError:
            distinct = set(words)
        if (first and first[-1].isspace()) or not all([word and not word[0].isspace() and not word[-1].isspace() for word in distinct]):
            return self._ids(text)
        if len(known) > TABLE_ENTRIES:
            known.clear()
        new = {word: self._ids(" " + word) for word in distinct if word not in known}
        known.update(new)
        ids = self._ids(first) + b"".join([known[word] for word in words])
        for word in new:
            if len(word) > LONGEST_ENTRY:
                del known[word]
        return ids


_IDS: dict[tuple[str, str], ByteIds] = {}


def byte_ids(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> ByteIds:
    if (tokenizer, ranks) not in _IDS:
        _IDS[tokenizer, ranks] = ByteIds(tokenizer, ranks)
    return _IDS[tokenizer, ranks]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and ``END_ID``, cut at the capacity.

    Only the first piece of a document may be shorter than the capacity. A null or empty text is one
    piece that holds the end only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(tokenizer, ranks)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                all_ids = encoder.encode(text or "") + end
                n = len(all_ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = all_ids[4 * a : 4 * b]
                    at.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4"))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, number, first sequence, offset): ranks go to sequences one by one; and the number of sequences."""
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: stretches (first sequence, number)
    rows, sequences = [], 0

    def put(n: int, number: int, first: int, offset: int) -> None:
        rows.append((n, taken[n], number, first, offset))
        taken[n] += number
        left[n] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= n and m <= capacity - n and (left[m] if m < n else left[m] > 1)), 0)
            number = left[n] if not partner else left[n] // 2 if partner == n else min(left[n], left[partner])
            put(n, number, sequences, 0)
            if partner:
                put(partner, number, sequences, n)
            leave(capacity - n - partner, sequences, number)
            sequences += number
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=0)
            if gap:
                first, there = gaps[gap].pop()
                number = min(there, left[n])
                if number < there:
                    gaps[gap].append((first + number, there - number))
                if not gaps[gap]:
                    del gaps[gap]
                put(n, number, first, capacity - gap)
                leave(gap - n, first, number)
            else:
                full, each = divmod(left[n], capacity // n)
                if full:
                    for k in range(capacity // n):
                        put(n, full, sequences, k * n)
                    leave(capacity % n, sequences, full)
                    sequences += full
                else:
                    for k in range(each):
                        put(n, 1, sequences, k * n)
                    leave(capacity - each * n, sequences, 1)
                    sequences += 1
    return rows, sequences


def pack(docs: DataFrame, capacity: int = CAPACITY, **kinds) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset.

    Every row is packed, repeated ones too; ties within a length are broken by a hash of the id. An
    empty table gives no rows. Further columns are left out.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, capacity, **kinds))
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(counts, capacity)
    # a few rows for each two lengths at most, whatever the size of the input
    where = F.broadcast(spark.createDataFrame(rows, "length long, _from long, _number long, _first long, offset long"))
    cuts = cuts.withColumn("_h", hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string"))).withColumn("_b", F.col("_h") % max(RANK_BUCKETS, -(-max(counts.values(), default=0) // BUCKET_ROWS)))
    placed = ranked(cuts, ["length"], "_b", [F.col(c) for c in ("_h", "doc_id", "piece", "ids_crc32")], "_r").drop("_h", "_b")
    placed = placed.join(where, (placed["length"] == where["length"]) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_from") + F.col("_number"))).drop(where["length"])
    return placed.withColumn("sequence_id", F.col("_first") + F.col("_r") - F.col("_from")).drop("_r", "_from", "_number", "_first")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
