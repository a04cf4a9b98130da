"""SentencePiece encoding and decoding by a table of distinct marked words.

Where no piece of a model holds a word mark after another character, merges cannot cross the gap before
a mark, so each distinct marked word is segmented once and its ids are put back by position. A slice of
texts becomes a table of distinct words and, for every text, the words' places in it; only the table is
segmented, and each text's ids and decoded text are gathered from it by these places. Segmented words are
also kept from slice to slice, at most ``TABLE_ENTRIES`` of at most ``LONGEST_ENTRY`` characters in each
worker, whatever the size of the input. No row is shuffled: ``joined_ids`` makes one table of the whole
corpus and joins it to every position, which moves several times the input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, table, tidy

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TABLE_ENTRIES = 400_000
LONGEST_ENTRY = 200
MARK = "▁"
_MARKED = re.compile("[ ▁]+[^ ▁]*")


class Pieces:
    """Encodes and decodes whole texts through the table of distinct marked words."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.local = not any(MARK in piece.lstrip(MARK) for piece in pieces)
        self.table: dict[str, tuple[list[int], str, str]] = {}

    def _segment(self, words: list[str]) -> list[tuple[list[int], str, str]]:
        """Ids, ids as text and decoded text of marked words, each given without its first mark."""
        found = self.model.encode(words, num_threads=1) if words else []
        mark = self.model.piece_to_id(MARK)
        found = [ids or [mark] for ids in found]
        return [(ids, ",".join(map(str, ids)), text) for ids, text in zip(found, self.model.decode(found), strict=True)]

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        if not text:
            return []
        words = text.split(" ")
        if "" not in words and MARK not in text:
            return words
        return [word[1:] for word in _MARKED.findall(MARK + text)]

    def _table(self, words: list[str]) -> list[tuple[list[int], str, str]]:
        """What ``_segment`` gives for distinct words, from the kept ones where they are known."""
        known = self.table
        missing = [word for word in words if word not in known]
        if missing:
            if len(known) + len(missing) > TABLE_ENTRIES:
                known.clear()
                missing = words
            known.update(zip(missing, self._segment(missing), strict=True))
        found = [known[word] for word in words]
        for word in missing:
            if len(word) > LONGEST_ENTRY:
                del known[word]
        return found

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Per text: number of ids, ids joined by commas, decoded text. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.local:
            ids = [self.model.encode(text) for text in texts.to_pylist()]
            return pa.array(map(len, ids), pa.int64()), pa.array([",".join(map(str, x)) for x in ids], pa.string()), pa.array([self.model.decode(x) for x in ids], pa.string())
        # words are what single spaces divide, but for runs of spaces, spaces at an end, and marks in the text itself
        odd = pc.or_(pc.match_substring_regex(texts, f"^ | $|  |{MARK}"), pc.equal(texts, ""))
        words = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            lists = words.to_pylist() if len(rows) == len(texts) else None
            own = [self.words(text) for text in texts.take(pa.array(rows)).to_pylist()]
            if lists is None:
                order = np.arange(len(texts))
                order[rows] = len(texts) + np.arange(len(rows))
                words = pa.concat_arrays([words, pa.array(own, words.type)]).take(pa.array(order))
            else:
                words = pa.array(own, words.type)
        flat = words.flatten()
        coded = flat.dictionary_encode()
        table = self._table(coded.dictionary.to_pylist())
        offsets = pa.array(words.offsets.to_numpy() - words.offsets[0].as_py(), pa.int32())
        places = coded.indices
        counts = np.fromiter((len(row[0]) for row in table), np.int64, len(table))[places.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(counts)])[offsets.to_numpy()]
        gathered = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([row[k] for row in table], pa.string()).take(places)), by) for k, by in ((1, ","), (2, " "))]
        return pa.array(np.diff(upto)), *gathered


_PIECES: dict[str, Pieces] = {}


def pieces_of(model: str) -> Pieces:
    if model not in _PIECES:
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


def piece_ids(docs: DataFrame, model: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ids (array<int>), decoded (string). Null text counts as empty; further columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in slices(batches, 1):
            _, joined, decoded = pieces.encode(batch.column(1))
            ids = [[int(x) for x in row.split(",")] if row else [] for row in joined.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), decoded], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string")


def joined_ids(docs: DataFrame, model: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What ``piece_ids`` returns, by one table of the whole corpus: each distinct word is segmented once in all.

    Every position of every text is shuffled twice, for the join and to put the ids back in order; a word
    of any frequency is joined in as many tasks as Spark deals its rows to. For models whose pieces cannot
    cross marks only.
    """
    if not pieces_of(model).local:
        raise ValueError("pieces cross word marks")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in slices(batches, 1):
            words = [pieces.words(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.string()))], [key, "_row", "_words"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            ids, _, decoded = zip(*pieces._segment(batch.column(0).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["_word", "_ids", "_decoded"])

    kind = docs.schema[key].dataType.simpleString()
    rows = cut(docs.select(key, text, F.monotonically_increasing_id().alias("_row")).mapInArrow(tidy(split), f"{key} {kind}, _row long, _words array<string>"))
    places = rows.select("_row", F.posexplode("_words").alias("_at", "_word"))
    table = places.select("_word").distinct().mapInArrow(tidy(segment), "_word string, _ids array<int>, _decoded string")
    found = places.join(table, "_word").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_ids", "_decoded"))).alias("_found"))
    ids = F.coalesce(F.flatten("_found._ids"), F.array().cast("array<int>"))
    return rows.drop("_words").join(found, "_row", "left").select(key, ids.alias("ids"), F.coalesce(F.array_join("_found._decoded", " "), F.lit("")).alias("decoded"))


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids and the digests of an empty string; repeated rows are repeated, further
    columns are left out, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())
        for batch in slices(batches, 1):
            n, ids, decoded = pieces.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, sha(ids), sha(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))
