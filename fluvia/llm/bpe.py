"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the characters cuts each text into chunks at places that depend only on the text
nearby, so passages that documents share give the same chunks. A chunk is encoded once per worker
and its ids are reused. Ids next to a cut may be wrong, because a cut can split a pre-token: the ends
of a chunk up to its outermost safe places are left open, and each join of open ends is encoded
again as one string, which grows over further chunks until it ends at safe places on both sides.
There its ids agree with those of the whole text.

Safe place: a single space between two characters that are not white space. The pre-tokenizer always
starts a new piece there, and merges never cross pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .base import map_arrow, table
from .vocab import merger, token_bytes

WINDOW = 8
MASK = 127
LEAST = 48
MOST = 2048
CACHE_CHARS = 8_000_000
LONG_PIECE = 64
#: Letters with the space before them, then ASCII punctuation: two pre-tokens at most.
_SIMPLE = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)?([!-/:-@\[-`{-~]*)")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s\s")
_POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(WINDOW, dtype=np.uint64)).astype(np.uint64)


def cuts(text: str) -> list[int]:
    """Cut places of the rolling hash, from 0 to len(text), chunks of ``LEAST`` to ``MOST`` characters."""
    n = len(text)
    if n <= LEAST + WINDOW:
        return [0, n]
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    h = codes[: n - WINDOW + 1] * _POWERS[0]
    for i in range(1, WINDOW):
        h += codes[i : n - WINDOW + 1 + i] * _POWERS[i]
    found, last = [0], 0
    for p in (np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK)) == 0) + WINDOW).tolist():
        if p - last >= LEAST and n - p >= LEAST:
            found.append(p)
            last = p
    found.append(n)
    if max(b - a for a, b in zip(found, found[1:], strict=False)) > MOST:
        found = [*chain.from_iterable(range(a, b, MOST) for a, b in zip(found, found[1:], strict=False)), n]
    return found


class ChunkEncoder:
    """Encodes and decodes as the tokenizers library does, with chunk and piece caches of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, tuple[str, bytes, str] | None] = {}
        self.held = 0
        self.bytes_of = token_bytes(self.tokenizer)
        self.merge = merger(self.tokenizer)

    def _learn(self, pieces) -> None:
        odd = []
        for piece in set(pieces).difference(self.pieces):
            if (ids := self._simple(piece)) is None:
                odd.append(piece)
            else:
                self.pieces[piece] = ids
                self.held += len(piece) + 16
        for at in range(0, len(odd), 2048):
            some = odd[at : at + 2048]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.pieces[piece] = array("I", e.ids).tobytes()
                self.held += len(piece) + 16

    def _simple(self, piece: str) -> bytes | None:
        """Ids of words and punctuation with single line breaks between them; None for anything else."""
        ids: list[int] = []
        for i, line in enumerate(piece.split("\n")):
            if not line or not (m := _SIMPLE.fullmatch(line)) or i and line[0] == " ":
                return None
            if i:
                ids += self.merge("\n")
            for part in m.groups():
                if part:
                    ids += self.merge(part)
        return array("I", ids).tobytes()

    @staticmethod
    def _split(text: str) -> list[str]:
        """Pieces from one safe place to the next; all but the first begin with their space."""
        words = text.split(" ") if _UNSAFE.search(text) is None and text[:1] != " " and text[-1:] != " " else _SAFE.split(text)
        return [words[0], *(" " + w for w in words[1:])]

    def _open(self, chunk: str) -> tuple[str, list[str], str] | None:
        """Open head, closed pieces, open tail; None without a safe place."""
        pieces = self._split(chunk)
        return None if len(pieces) == 1 else (pieces[0], pieces[1:-1], pieces[-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32 bits."""
        if self.held > CACHE_CHARS:
            self.pieces.clear()
            self.chunks.clear()
            self.held = 0
        cut = []
        for t in texts:
            c = cuts(t)
            cut.append([t[a:b] for a, b in zip(c, c[1:], strict=False)])
        opened = {c: self._open(c) for c in set(chain.from_iterable(cut)) if c not in self.chunks}
        self._learn(chain.from_iterable(x[1] for x in opened.values() if x))
        self.held += sum(map(len, opened))
        for c, x in opened.items():
            self.chunks[c] = x and (x[0], b"".join(map(self.pieces.__getitem__, x[1])), x[2])
        plans, joins = [], []
        for chunks in cut:
            plan, pending = [], ""
            for c in chunks:
                if (x := self.chunks[c]) is None:
                    pending += c  # no safe place here: the join grows over this chunk
                else:
                    plan += (pending + x[0], x[1])
                    pending = x[2]
            plan.append(pending)
            plans.append(plan)
            joins += plan[::2]
        # the space that opens a tail may be followed by white space from the next chunk only at its end, so joins split again safely
        split = {j: self._split(j) for j in set(joins)}
        self._learn(p for ps in split.values() for p in ps if len(p) <= LONG_PIECE)
        long = {p: array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for ps in split.values() for p in ps if len(p) > LONG_PIECE}
        get = lambda p: long[p] if len(p) > LONG_PIECE else self.pieces[p]
        repaired = {j: b"".join(map(get, ps)) for j, ps in split.items()}
        return [b"".join(repaired[x] if i % 2 == 0 else x for i, x in enumerate(plan)) for plan in plans]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, keep: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep``, ids and the decoded text.

    Null and empty texts have no tokens. Repeated rows give repeated results, null ids stay, other columns are ignored, an
    empty table gives no rows.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")

    def make():
        encoder = ChunkEncoder(path)

        def work(cols: dict) -> dict:
            ids = encoder.encode([t or "" for t in cols["text"]])
            decoded = [encoder.decode(x) for x in ids]
            out = {
                "doc_id": cols["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
            }
            return out | ({"ids": [array("I", x).tolist() for x in ids], "decoded": decoded} if keep else {})

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep
    return map_arrow(docs.select("doc_id", "text"), make, schema, rows=128)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), keep=False)
