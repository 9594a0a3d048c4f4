"""Packing by concatenate and cut.

All documents form one stream of tokens: pass one tokenizes each input partition and notes where each
document starts inside it; prefix sums over the partitions' token totals turn that into global
offsets; pass two cuts the stream into fixed windows, so a document that crosses a window boundary
becomes several pieces (the boundary records). Every window but the last is full.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import map_arrow, table, written
from .vocab import merger

CACHE_CHARS = 8_000_000
BLOCK = 1024
MOST_BROADCAST = 500_000
#: A run of letters that no normalizer but lower case changes, then ASCII punctuation: two pre-tokens at most.
_SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-/:-@\[-`{-~]*)")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class WordEncoder:
    """Whole-text ids of a tokenizer whose pre-tokens never span white space, word by word.

    Each different word is encoded once by the tokenizers library and kept; ``CACHE_CHARS`` bounds
    what is kept (memory only: a forgotten word is encoded again).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = merger(self.tokenizer)
        self.width = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        return [w for w in _SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``width``."""
        split = [self.words(t) for t in texts]
        if self.held > CACHE_CHARS:
            self.known.clear()
            self.held = 0
        known = self.known
        odd, match, merge, width = [], _SIMPLE.fullmatch, self.merge, self.width
        for word in set().union(*split).difference(known):
            if m := match(word):
                known[word] = array(width, [i for part in m.groups() if part for i in merge(part.lower() + "\0")]).tobytes()
                self.held += len(word) + 16
            else:
                odd.append(word)
        for at in range(0, len(odd), 2048):
            some = odd[at : at + 2048]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[word] = array(width, e.ids).tobytes()
                self.held += len(word) + 16
        return [b"".join(map(known.__getitem__, words)) for words in split]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Pass one: (part, at, doc_id, n, ids) with ``at`` the tokens before the document in its partition.

    Null texts are empty: only ``end_id``. ids: little-endian unsigned 16 bits (32 where the vocabulary needs it).
    """

    def make():
        encoder, part, seen = WordEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = array(encoder.width, [end_id]).tobytes()

        def work(cols: dict) -> dict:
            nonlocal seen
            ids = [x + end for x in encoder.encode([t or "" for t in cols["text"]])]
            n = [len(x) // len(end) for x in ids]
            starts = seen + np.cumsum([0, *n])
            seen = int(starts[-1])
            return {"part": [part] * len(n), "at": starts[:-1].tolist(), "doc_id": cols["doc_id"], "n": n, "ids": ids}

        return work

    return map_arrow(docs.select("doc_id", "text"), make, "part int, at long, doc_id long, n long, ids binary")


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """(part, base): tokens in all partitions before, by prefix sums inside blocks of partitions and over the blocks."""
    total = tokens.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = total.groupBy("block").agg(F.sum("n").alias("block_n"))
    blocks = blocks.select("block", F.coalesce(F.sum("block_n").over(before.orderBy("block")), F.lit(0)).alias("block_base"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("block").orderBy("part")), F.lit(0))
    return total.withColumn("inside", inside).join(blocks, "block").select("part", (F.col("inside") + F.col("block_base")).alias("base"))


def cut(tokens: DataFrame, length: int = 4096, end_width: int = 2) -> DataFrame:
    """Pass two: the pieces of every document, one row for each window it reaches into."""

    def make():
        kind = "<u2" if end_width == 2 else "<u4"

        def work(cols: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, at, base, raw in zip(cols["doc_id"], cols["at"], cols["base"], cols["ids"], strict=True):
                ids, first, start = np.frombuffer(raw, kind).astype("<u4"), base + at, 0
                while start < len(ids):
                    sequence, offset = divmod(first + start, length)
                    size = min(length - offset, len(ids) - start)
                    row = (doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), sequence, offset)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                    start += size
            return out

        return work

    offsets = partition_offsets(tokens)
    if tokens.select("part").distinct().count() <= MOST_BROADCAST:
        offsets = F.broadcast(offsets)  # two numbers for each input partition, and their count is checked
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(tokens.join(offsets, "part").select("doc_id", "at", "base", "ids"), make, schema)


def pack(docs: DataFrame, length: int = 4096, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Order of documents: that of the input's partitions. Repeated rows are packed each; a null doc_id is kept;
    an empty table gives no rows. Other columns are ignored. Each run of 4096 tokens is one sequence; only the
    last may be shorter, and its padding is implied.
    """
    tokens = written(tokenized(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), end_id), "tokens")
    return cut(tokens, length)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
