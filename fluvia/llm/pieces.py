"""Byte-level BPE by a sentencepiece model that is written down from the vocabulary.

Each vocabulary entry becomes a piece: its bytes as printable characters (one a byte), scored by its negative rank, at the
place of its id. The library then merges the adjacent pair whose joint piece has the least rank, leftmost first, which is
what the ranks mean. Nothing is normalised and no space is added, so a pre-token goes in as it is. An unknown piece is
required by the format and follows the last id; every byte is a piece, so it is never given.

The pattern's matches are found once for each different stretch from one safe space to the next (a single space between
characters that aren't white space always begins a match), and ids of short stretches are kept while a worker lasts.
Characters that the pattern library's tables call letters or digits and the tiktoken library's older ones don't are
matched as neither.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .base import map_arrow, table
from .vocab import BYTE_OF

CACHE_CHARS = 8_000_000
LONG = 64
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s\s")
_RARE = re.compile("[\u0530-\U0010ffff]")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]").match
#: A character for private use: no letter, digit or white space.
_OTHER = "\ue000"
#: One character for each byte.
_SHOWN = {b: c for c, b in BYTE_OF.items()}


def ranks(path: str) -> list[bytes]:
    """Bytes of each id; a line of the file is an entry in base64 and its rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, lines)}
    if sorted(found) != list(range(len(found))) or {bytes([b]) for b in range(256)} - {*found.values()}:
        raise ValueError(f"{path}: ranks must run from 0 without gaps and hold every byte")
    return [found[i] for i in range(len(found))]


def model(entries: list[bytes]) -> bytes:
    """The serialised sentencepiece model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    out = pb.ModelProto()
    out.trainer_spec.model_type = pb.TrainerSpec.BPE
    out.trainer_spec.vocab_size = len(entries) + 1
    out.trainer_spec.unk_id = len(entries)
    out.trainer_spec.bos_id = out.trainer_spec.eos_id = out.trainer_spec.pad_id = -1
    spec = out.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    for rank, entry in enumerate(entries):
        out.pieces.add(piece="".join(map(_SHOWN.__getitem__, entry)), score=-rank, type=pb.ModelProto.SentencePiece.NORMAL)
    out.pieces.add(piece="<unk>", score=0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    return out.SerializeToString()


@lru_cache(maxsize=1)
def _probe():
    """Merges the quote and the s after a letter or digit, and only there."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"'s": 256}
    return tiktoken.Encoding("probe", pat_str=r"[\p{L}\p{N}]'s|(?s:.)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=1 << 16)
def _unknown(c: str) -> bool:
    """Whether only the pattern library takes the character for a letter or digit."""
    return unicodedata.category(c) == "Cn" and bool(_WORDLIKE(c)) and _probe()(c + "'s")[-1] != 256


class PieceEncoder:
    """Encodes and decodes as the tiktoken library does with the same ranks and pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.entries = ranks(path)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model(self.entries))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _stretches(self, text: str) -> list[str]:
        words = text.split(" ") if text[:1] != " " and text[-1:] != " " and _UNSAFE.search(text) is None else _SAFE.split(text)
        return [words[0], *(" " + w for w in words[1:])]

    def matches(self, stretch: str) -> list[str]:
        if _RARE.search(stretch) and (odd := {c for c in stretch if c > "\u052f" and _unknown(c)}):
            shown = stretch.translate({ord(c): _OTHER for c in odd})
            return [stretch[m.start() : m.end()] for m in self.pattern.finditer(shown)]
        return self.pattern.findall(stretch)

    def _encode(self, stretches: list[str]) -> list[bytes]:
        """Each stretch's matches, encoded apart."""
        split = [self.matches(s) for s in stretches]
        shown = [m.encode("utf-8", "replace").decode("latin-1").translate(_SHOWN) for m in chain.from_iterable(split)]
        ids = iter(self.library.encode(shown, out_type=int, num_threads=1))
        return [array("I", chain.from_iterable(next(ids) for _ in matches)).tobytes() for matches in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32 bits."""
        if self.held > CACHE_CHARS:
            self.known.clear()
            self.held = 0
        known, split = self.known, [self._stretches(t) for t in texts]
        fresh = list(set(chain.from_iterable(split)).difference(known))
        passing = {}
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            for stretch, ids in zip(some, self._encode(some), strict=True):
                if len(stretch) > LONG:
                    passing[stretch] = ids
                else:
                    known[stretch] = ids
                    self.held += len(stretch) + 16
        if passing:
            return [b"".join(passing[s] if len(s) > LONG else known[s] for s in stretches) for stretches in split]
        return [b"".join(map(known.__getitem__, stretches)) for stretches in split]

    def decode(self, ids: bytes) -> bytes:
        """The inverse mapping: each id's bytes."""
        return b"".join(map(self.entries.__getitem__, array("I", ids)))


def encode_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep``, ids and the decoded bytes.

    Null and empty texts have no tokens. Repeated rows give repeated results, null ids stay, other columns are ignored, an
    empty table gives no rows.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        encoder = PieceEncoder(path, pattern)

        def work(cols: dict) -> dict:
            ids = encoder.encode([t or "" for t in cols["text"]])
            decoded = [encoder.decode(x) for x in ids]
            out = {
                "doc_id": cols["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
            }
            return out | ({"ids": [array("I", x).tolist() for x in ids], "decoded": decoded} if keep else {})

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * keep
    return map_arrow(docs.select("doc_id", "text"), make, schema, rows=128)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), keep=False)
