"""Language identification with error-correcting output codes.

Each language has a codeword; each bit has a binary linear classifier over hashed character n-grams
(1 to 3 characters of lower-cased letters). Decoding adds up, for each language, the logistic losses
of the bits against its codeword, weighted by the bit's accuracy when learnt, and takes the least. The
softmax of the negative losses, sharpened by the text's length as fits documents that weren't learned from, times the
share of the text's letters that learning saw at all, is the score. A text is ambiguous where its best two languages are
close or under half of its letters are known.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fold, map_arrow, table

#: Learning uses at most so many documents a language, whole. Of each language every sixth isn't learned from but sharpens the scores.
SAMPLE_DOCS = 500
CALIBRATION = 6
BUCKETS = 1 << 14
AMBIGUOUS = 0.2
KNOWN_LETTERS = 0.5
#: Lengths of the pieces that sharpen the scores of short texts.
PIECES = (8, 32, 128)
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """(n, bits) of -1 and 1: the exhaustive code up to 6 languages, else the best spread of random codes of 4 log2(n) + 8 bits."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if (i == 0 or not (c >> (i - 1)) & 1) else -1 for c in range(1, bits + 1)] for i in range(n)])
    rng, best, spread = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, int(4 * np.log2(n)) + 8))
        apart = (code[:, None] != code[None]).sum(2) + 999 * np.eye(n, dtype=int)
        usable = (np.abs(code.sum(0)) < n).all()
        if usable and apart.min() > spread:
            best, spread = code, apart.min()
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after the other, and the place where each text's begin (its last is one for the end)."""
    plain = [" " + _NOT_LETTERS.sub(" ", t).lower() + " " for t in texts]
    sizes = np.array([len(p) for p in plain])
    x = np.frombuffer("".join(plain).encode("utf-32-le"), "<u4")
    bi = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    tri = bi[:-1] * np.uint32(31) + x[2:] * np.uint32(0xC2B2AE3D)
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int32)
    # the n-grams that start at each character; those that would cross into the next text are only its separators
    both = np.stack([mix(x), np.append(mix(bi), 0), np.append(mix(tri), [0, 0])], 1)
    return both, np.append(0, np.cumsum(sizes))


@dataclass
class Example:
    """What learning reads of a document, of bounded size: its different n-grams with their counts, its letters, and the same of some short pieces."""

    lang: str
    letters: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]  # of the whole text, then of pieces; each character counts three n-grams


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    col, count = np.unique(grams([text])[0], return_counts=True)
    return col.astype(np.uint16), count.astype(np.uint32)


def example(text: str, lang: str) -> Example:
    """The whole text, and a piece of each length at a place given by the text's checksum."""
    at, few = zlib.crc32(text.encode()), []
    for size in PIECES:
        start = at % max(1, len(text) - size)
        piece = text[start : start + size]
        few += [_counts(piece)] if len(text) > size and _LETTER.search(piece) else []
    return Example(lang, np.unique(_code_points(_NOT_LETTERS.sub("", text).lower())), [_counts(text), *few])


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS, bits)
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss
    letters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    sharpness: tuple[float, float] = (0.0, 0.0)

    def bits(self, texts: list[str], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(texts, bits) classifier outputs, bias plus mean weight of the n-grams of the whole text, and the texts' lengths."""
        ids, starts = grams(texts)
        per_char = np.concatenate([self.weights[ids[a : a + chunk]].sum(1) for a in range(0, len(ids), chunk)]) if len(ids) else np.zeros((0, len(self.bias)))
        sums = np.add.reduceat(per_char, starts[:-1], axis=0, dtype=np.float64)
        return self.bias + sums / np.diff(starts)[:, None], np.diff(starts)

    def losses(self, f: np.ndarray) -> np.ndarray:
        """(texts, languages) weighted losses, less the least."""
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) @ self.trust
        return loss - loss.min(1, keepdims=True)

    def known(self, text: str) -> float:
        """Share of the text's letters that learning saw."""
        x = _code_points(_NOT_LETTERS.sub("", text).lower())
        return float(np.isin(x, self.letters).mean()) if len(x) else 0.0

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is ambiguous; ``und`` with score 0 for null texts and those without a letter."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        live = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not live or not self.languages:
            return out
        p = _softmax(self.losses((found := self.bits([texts[i] for i in live]))[0]), found[1], *self.sharpness)
        top = np.sort(p, 1)
        best, second = top[:, -1], top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        for i, k, a, b in zip(live, p.argmax(1), best, second, strict=True):
            share = self.known(texts[i])
            out[i] = (self.languages[k], float(a) * share, bool(a - b < AMBIGUOUS or share < KNOWN_LETTERS))
        return out


def _softmax(loss: np.ndarray, sizes: np.ndarray, a: float, b: float) -> np.ndarray:
    p = np.exp(-loss * np.exp(a + b * np.log(sizes))[:, None])
    return p / p.sum(1, keepdims=True)


def _sharpness(loss: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[float, float]:
    """The factor exp(a) * length ** b of the losses under which the right languages are likeliest, by a grid; (0, 0) without examples."""
    if not len(loss):
        return 0.0, 0.0
    cost = lambda a, b: -np.log(np.maximum(_softmax(loss, sizes, a, b)[np.arange(len(loss)), which], 1e-6)).mean()
    return min(((float(a), float(b)) for a in np.arange(-12, 4.1, 0.5) for b in np.arange(0, 3.01, 0.25)), key=lambda x: cost(*x))


def fit(rows: list[tuple[str, str]], rounds: int = 40, rate: float = 60.0, decay: float = 1e-6) -> Model:
    """The model learned from (text, language) rows by gradient steps on the logistic loss of all bits at once."""
    return fit_examples([example(t, y) for t, y in rows if t and _LETTER.search(t)], rounds, rate, decay)


def fit_examples(rows: Iterable[Example], rounds: int = 40, rate: float = 60.0, decay: float = 1e-6) -> Model:
    """As ``fit``; of each language every sixth example only sharpens the scores."""
    learned, kept, seen = [], [], {}
    for x in rows:
        seen[x.lang] = seen.get(x.lang, 0) + 1
        (kept if seen[x.lang] % CALIBRATION == 0 else learned).append(x)
    languages = sorted(seen)
    code = codewords(max(1, len(languages)))
    n_bits = code.shape[1]
    letters = np.unique(np.concatenate([np.zeros(0, np.uint32), *(x.letters for x in learned)]))
    model = Model(languages, code, np.zeros((BUCKETS, n_bits), np.float32), np.zeros(n_bits), np.ones(n_bits) / n_bits, letters)
    if len(languages) < 2:
        return model
    parts = []
    for i, x in enumerate(learned):
        col, count = x.grams[0]
        parts.append((np.full(len(col), i, np.int32), col.astype(np.int32), (count / count.sum() * 3).astype(np.float32)))
    row, col, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
    scale = 1 / np.maximum(1e-3, np.sqrt(np.bincount(col, value, BUCKETS) / len(learned)))  # rarer n-grams count more
    value = value * scale[col]
    which = np.array([languages.index(x.lang) for x in learned])
    weigh = len(learned) / len(languages) / np.bincount(which, minlength=len(languages))[which]
    w, b = np.zeros((BUCKETS, n_bits)), np.zeros(n_bits)
    y, f = code[which], np.zeros((len(learned), n_bits))
    for k in range(n_bits):
        for _ in range(rounds):
            g = weigh * y[:, k] / (1 + np.exp(np.clip(y[:, k] * f[:, k], -50, 50))) / len(learned)
            w[:, k] += rate * (np.bincount(col, g[row] * value, BUCKETS) - decay * w[:, k])
            b[k] += g.sum()
            f[:, k] = b[k] + np.bincount(row, w[col, k] * value, len(learned))
    right = np.clip((np.sign(f) == y).mean(0), 0.5, 0.999)
    trust = np.log(right / (1 - right)) + 1e-3
    model.weights, model.bias, model.trust = (w * scale[:, None]).astype(np.float32), b, trust / trust.sum() * n_bits
    tests = [(languages.index(x.lang), col, count) for x in kept for col, count in x.grams]
    held = np.array([b + count @ model.weights[col] / count.sum() * 3 for _, col, count in tests]).reshape(-1, n_bits)
    sizes = np.array([count.sum() / 3 for *_, count in tests])
    model.sharpness = _sharpness(model.losses(held) if len(held) else held, sizes, np.array([k for k, *_ in tests], int))
    return model


def _sample(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, lang, text) of at most ``SAMPLE_DOCS`` ids a language, in order of a hash of the id, of rows that aren't held out.

    Every (id, language) counts once, with its least text; null ids, texts and languages give none. A language's rows are
    first thinned by that hash to about 1.5 times what is wanted, so that neither a task nor the driver sees more of a
    common one, however many rows it has.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    few = named.select("doc_id", "lang", place.alias("h")).join(F.broadcast(sizes), "lang").where(F.col("h") * F.col("n") < 1.5 * SAMPLE_DOCS)
    taken: dict[str, int] = {}
    ids = []
    for r in sorted(few.select("doc_id", "lang", "h").distinct().collect(), key=lambda r: (r.lang, r.h, r.doc_id)):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= SAMPLE_DOCS:
            ids.append((r.doc_id, r.lang))
    spark = docs.sparkSession
    wanted = spark.createDataFrame(ids, "doc_id long, lang string")  # at most SAMPLE_DOCS ids a language
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(wanted), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return texts.where("text IS NOT NULL")


def labelled_sample(docs: DataFrame, held_out) -> list[tuple[str, str]]:
    """(text, language) of the documents that ``learn`` reads, for inspection of small tables: the texts come to the driver."""
    return [(r.text, r.lang) for r in sorted(_sample(docs, held_out).collect(), key=lambda r: (r.doc_id, r.lang))]


def learn(docs: DataFrame, held_out) -> Model:
    """The model of the rows of ``docs`` that aren't held out; see ``_sample`` for which.

    Tasks count n-grams of whole texts, so that the driver gets some 100 KB of a document at most, however long it is.
    """

    def make():
        def work(cols: dict) -> dict:
            some = [(i, example(t, y)) for i, y, t in zip(cols["doc_id"], cols["lang"], cols["text"], strict=True) if _LETTER.search(t)]
            packed = lambda k, x: [part[k].tobytes() for part in x.grams]
            return {"doc_id": [i for i, _ in some], "lang": [x.lang for _, x in some], "letters": [x.letters.tobytes() for _, x in some], "cols": [packed(0, x) for _, x in some], "counts": [packed(1, x) for _, x in some]}

        return work

    found = map_arrow(_sample(docs, held_out), make, "doc_id long, lang string, letters binary, cols array<binary>, counts array<binary>", rows=16).collect()
    pairs = lambda r: [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32)) for a, b in zip(r.cols, r.counts, strict=True)]
    return fit_examples(Example(r.lang, np.frombuffer(r.letters, "<u4"), pairs(r)) for r in sorted(found, key=lambda r: (r.doc_id, r.lang)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row.

    Null texts and texts without a letter are ``und`` with score 0 and ambiguous, as all are without a learned language. Of
    languages with equal losses the first by name wins, and the text is ambiguous. A text in a script that learning never saw
    gets a learned language with a score near 0, and is ambiguous. Repeated rows come back each with equal
    results, null ids stay, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(cols: dict) -> dict:
            found = shared.value.predict(cols["text"])
            return {"doc_id": cols["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "ambiguous": [x[2] for x in found]}

        return work

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, ambiguous boolean", rows=64)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    found = identify(docs, learn(docs, out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")
