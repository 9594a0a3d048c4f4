"""Telephony audio columns: mu-law, A-law and ADPCM samples, resampled PCM, and the containers around them.

A stored clip is a RIFF/WAVE file whose data chunk holds 8-bit companded samples or 4-bit ADPCM blocks.
Companded samples expand by 256-entry tables made from the coding rule; ADPCM blocks are decoded for
all clips of a batch at once, one step of all blocks at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import map_arrow, table

RATE = 8000
UNIT = 64
#: WAVE format tags (fixed values).
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law code: sign, 3-bit segment and 4-bit step of the inverted byte, bias 132."""
    code = ~np.arange(256, dtype=np.uint8)
    size = ((code.astype(np.int32) & 15) * 8 + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law code: even bits inverted, segment 0 linear."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    segment, step = (code >> 4 & 7).astype(np.int32), (code.astype(np.int32) & 15) * 16 + 8
    size = np.where(segment == 0, step, step + 256 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
#: Step sizes of IMA ADPCM and the changes of their index by code (fixed values of the format).
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
        337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
        5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _difference(code: np.ndarray, index: np.ndarray) -> np.ndarray:
    step = STEPS[index]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) int16 of mono IMA blocks (blocks, bytes): a 4-byte head, then two codes a byte, low one first."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1).T.astype(np.int32)
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for t, code in enumerate(codes):
        value = np.clip(value + _difference(code, index), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[t + 1] = value
    return out.T


def encode_adpcm(samples: np.ndarray) -> np.ndarray:
    """Blocks (blocks, bytes) for int16 samples (blocks, samples); an odd number of samples."""
    value, index = samples[:, 0].astype(np.int32), np.zeros(len(samples), np.int32)
    codes = np.empty((samples.shape[1] - 1, len(samples)), np.uint8)
    for t in range(1, samples.shape[1]):
        step, d = STEPS[index], samples[:, t].astype(np.int32) - value
        rest, code = np.abs(d), np.where(d < 0, 8, 0)
        for bit in (4, 2, 1):
            hit = rest >= step
            code, rest, step = code + bit * hit, rest - step * hit, step >> 1
        value = np.clip(value + _difference(code, index), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        codes[t - 1] = code
    head = np.zeros((len(samples), 4), np.uint8)
    head[:, :2] = samples[:, :1].astype("<i2").view(np.uint8)
    return np.concatenate([head, (codes[::2] | codes[1::2] << 4).T], 1)


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """int16 samples at ``up / down`` times the rate, linear between neighbours, in whole-number arithmetic."""
    if not len(pcm):
        return pcm.astype(np.int16)
    place = np.arange(-(-len(pcm) * up // down), dtype=np.int64) * down
    at, rest = np.minimum(place // up, len(pcm) - 1), place % up
    x = pcm.astype(np.int64)
    return ((x[at] * (up - rest) + x[np.minimum(at + 1, len(pcm) - 1)] * rest + up // 2) // up).astype(np.int16)


def to_wave(data: bytes, codec: str, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A RIFF/WAVE file of one channel around ``data``."""
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if codec == "adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * bits // 8, block, bits) + extra
    parts = b"fmt " + struct.pack("<I", len(head)) + head
    if codec != "pcm":
        # samples in the clip: a byte each, but for ADPCM the block's head and two codes a byte after it
        samples = len(data) // block * ((block - 4) * 2 + 1) if codec == "adpcm" else len(data)
        parts += b"fact" + struct.pack("<II", 4, samples)
    parts += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def from_wave(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and data of a WAVE file; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if head is None or head[1] != 1:
                raise ValueError("not one channel with a format chunk")
            codec = {v: k for k, v in TAGS.items()}.get(head[0])
            if codec is None:
                raise ValueError(f"unknown format tag {head[0]}")
            return codec, head[2], head[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def to_pcm(media: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """(rate, int16 samples) of each WAVE file; None for null or unreadable ones. ADPCM blocks of equal size are decoded together."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(media)
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, m in enumerate(media):
        try:
            codec, rate, block, data = from_wave(m or b"")
        except (ValueError, struct.error):
            continue
        x = np.frombuffer(data, np.uint8)
        if codec == "adpcm" and block >= 5:
            waiting.setdefault(block, []).append((i, rate, x[: len(x) // block * block].reshape(-1, block)))
        elif codec == "pcm":
            out[i] = (rate, x[: len(x) // 2 * 2].view("<i2"))
        elif codec in ("mulaw", "alaw"):
            out[i] = (rate, (MULAW if codec == "mulaw" else ALAW)[x])
    for clips in waiting.values():
        pcm, at = decode_adpcm(np.concatenate([b for _, _, b in clips])), 0
        for i, rate, b in clips:
            out[i] = (rate, pcm[at : at + len(b)].reshape(-1))
            at += len(b)
    return out


def store_pcm(clips: DataFrame, rate: int = 16000) -> DataFrame:
    """(clip_id, media, n_samples): each clip (clip_id, media) as a WAVE file of 16-bit PCM at ``rate``; nulls where media isn't readable."""

    def make():
        def work(cols: dict) -> dict:
            pcm = [x and resample(x[1], rate // (g := np.gcd(rate, x[0])), x[0] // g) for x in to_pcm(cols["media"])]
            media = [None if x is None else to_wave(x.astype("<i2").tobytes(), "pcm", rate, 2, 16) for x in pcm]
            return {"clip_id": cols["clip_id"], "media": media, "n_samples": [None if x is None else len(x) for x in pcm]}

        return work

    return map_arrow(clips.select("clip_id", "media"), make, "clip_id long, media binary, n_samples long", rows=64)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes followed by zeros up to a positive multiple of 64, and their number without the zeros."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _stats(pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    return f"{len(x)},{int(np.abs(x).max())},{int((x * x).sum() // len(x))},{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text stored as a mu-law clip, read back and described.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of the data read back, media_bytes and
    media_sha256 of the clip. feature: samples, peak, mean square and zero crossings of the clip expanded
    and resampled to 16 kHz, of the same bytes as A-law, and of the same bytes as 64-byte ADPCM blocks.
    Null texts are empty, so 64 zero bytes; equal texts give equal values; repeated rows come back each; null ids stay;
    other columns are ignored; an empty table gives no rows.
    """

    def make():
        def work(cols: dict) -> dict:
            raw = [payload(t) for t in cols["text"]]
            media = [to_wave(p, "mulaw") for p, _ in raw]
            back = [from_wave(m)[3] for m in media]
            mulaw, alaw, adpcm = to_pcm(media), to_pcm([to_wave(b, "alaw") for b in back]), to_pcm([to_wave(b, "adpcm", RATE, UNIT, 4) for b in back])
            return {
                "doc_id": cols["doc_id"],
                "n_bytes": [n for _, n in raw],
                "payload_bytes": [len(b) for b in back],
                "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                "tail_crc32": [zlib.crc32(b[-UNIT:]) for b in back],
                "media_bytes": [len(m) for m in media],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                "feature": ["mulaw:" + _stats(resample(u[1], 2, 1)) + ";alaw:" + _stats(a[1]) + ";adpcm:" + _stats(d[1]) for u, a, d in zip(mulaw, alaw, adpcm, strict=True)],
            }

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(docs.select("doc_id", "text"), make, schema, rows=64)


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
