"""Packing by power-of-two decomposition.

A document's token ids, then one end id, are cut from the front into pieces whose lengths
are powers of two, the largest that fits first (``MAX_LEN`` at most). A piece is a
sequence of its own, so none crosses documents and none is padded, and sequences are
numbered bucket by bucket of equal length: a training batch takes a range of numbers.

Numbers need no global sort: pieces fall into (length, slice) cells by a hash of their
document, cells are counted (12 x ``SLICES`` counts at most), and a piece's number is its
cell's first plus its rank in the cell.

Cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

MAX_LEN, END_ID, SLICES = 2048, 1, 1024
VOCABULARY = "word_bpe_49k.json"
_END = np.array([END_ID], dtype="<u4").tobytes()
#: Texts of these characters alone are tokenized word by word: white space always separates tokens there and no character composes with another.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*").fullmatch
#: Of these a word's pieces are runs of letters, single digits and runs of other marks.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_SIMPLE = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+").findall
#: How the model writes the bytes that Latin-1 has no visible character for: from U+0100 on, in order.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}
#: Words that a worker remembers.
REMEMBERED = 400_000


@functools.cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordMemo(dict):
    """Token ids of words, as the tokenizer gives them, each computed once; as bytes of 32-bit numbers."""

    def __init__(self, path: str):
        self.tok = _tokenizer(path)

    def _piece(self, p: str) -> bytes:
        """The ids of one piece of the pre-tokenizer's: letters go to the model as they are, others through the tokenizer."""
        got = self.get(p)
        if got is None:
            if _LETTERS(p):
                got = array("I", [t.id for t in self.tok.model.tokenize(p.lower().encode().decode("latin-1").translate(_BYTES))]).tobytes()
            else:
                got = array("I", self.tok.encode(p, add_special_tokens=False).ids).tobytes()
            self[p] = got
        return got

    def __missing__(self, word: str) -> bytes:
        """A word of letters, digits and marks is cut as the pre-tokenizer cuts it; only contractions and other scripts need its own eyes."""
        if _LETTERS(word) or not _SIMPLE(word):
            return self._piece(word)
        self[word] = ids = b"".join(map(self._piece, _PIECES(word)))
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as one call of the tokenizer would give them."""
        plain = [bool(_PLAIN(t)) and "<|" not in t for t in texts]
        words = [(t.lower() if t.isascii() else t).split() if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self) > REMEMBERED:
            self.clear()
        get = self.__getitem__
        whole = lambda t: np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [b"".join(map(get, w)) if p else whole(t) for t, w, p in zip(texts, words, plain, strict=True)]


@functools.cache
def memo(path: str) -> WordMemo:
    return WordMemo(path)


def lengths(n: int) -> list[int]:
    """Powers of two, none over MAX_LEN, that sum to n, largest first."""
    out = [MAX_LEN] * (n // MAX_LEN)
    return out + [1 << b for b in range(MAX_LEN.bit_length() - 2, -1, -1) if n >> b & 1]


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = memo(path)
        for b in batches:
            docs, start, length, crc, total = [], [], [], [], []
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i in range(0, len(ids), 500):
                for d, raw in zip(ids[i : i + 500], tok.encode([t or "" for t in texts[i : i + 500]]), strict=True):
                    raw, at = raw + _END, 0
                    for k in lengths(len(raw) // 4):
                        docs.append(d)
                        start.append(at)
                        length.append(k)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + k)]))
                        at += k
                    total += [at] * (len(docs) - len(total))
            yield pa.record_batch([pa.array(docs, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece; vocabulary: a tokenizer file."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces with sequence_id (gapless from 0, shorter lengths last) and offset."""
    cells = cut(pieces(documents, vocabulary).withColumn("slice", F.expr(f"pmod(xxhash64(doc_id, start), {SLICES})")))
    counts = cells.groupBy("length", "slice").agg(F.count("*").alias("n")).orderBy(F.desc("length"), "slice")
    # 12 x SLICES rows at most, so one task suffices and the result may be broadcast
    first = counts.coalesce(1).select("length", "slice", (F.sum("n").over(Window.orderBy(F.desc("length"), "slice")) - F.col("n")).alias("first"))
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")) - 1)
    out = ranked.join(F.broadcast(first), ["length", "slice"])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
