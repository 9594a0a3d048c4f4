"""Toxic spans by a linear-chain conditional random field.

Only documents are labelled, so token labels come first: words, and word beginnings of 4 to 7
letters, that tell toxic documents from clean ones by a likelihood ratio test; tokens of toxic
documents that carry one are positive. The field learns from word, beginning, ending and length
features of a token and its neighbours. Forward-backward marginals of a text's tokens, but for faint ones,
are summed and set against its length; a logistic function of both, fitted to the labelled documents, is the
score, and tokens with a marginal of 0.5 or more are the offending offsets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fold, map_arrow, table
from .crf import Crf, Types, train

#: Learning uses at most so many labelled documents, whole, and so many sentences of each kind.
SAMPLE_DOCS = 4000
SAMPLE_SENTENCES = 3000
FAINT = 0.1
BUCKETS = 1 << 16
SENTENCE = 256
_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_BREAKS = ".!?\n"


def _units(word: str) -> list[str]:
    return [f"w{word}", *(f"{n}{word[:n]}" for n in range(4, 8) if len(word) >= n)]


def _features(word: str) -> list[int]:
    w = word.lower()
    names = (f"w{w}", *(f"{n}{w[:n]}" for n in range(4, 8)), f"s{w[-3:]}", f"n{min(len(w), 12)}", "b")
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def toxic_units(texts: Iterable[set[str]], labels: list[int]) -> set[str]:
    """Words and beginnings in at least three toxic documents, five times as often as in clean ones, with a likelihood ratio statistic of 25 or more.

    A unit counts once for each document that holds it. None without both toxic and clean documents. texts is gone through twice.
    """
    n1, n0 = sum(labels), len(labels) - sum(labels)
    if not n1 or not n0:
        return set()
    counts: list[Counter[str]] = [Counter(), Counter()]
    for wanted in (1, 0):  # toxic documents first, so that of clean ones only units seen there are counted
        for words, y in zip(texts, labels, strict=True):
            if y == wanted:
                units = {u for w in words for u in _units(w)}
                counts[y].update(units if y else units & counts[1].keys())
        if wanted:
            counts[1] = Counter({u: n for u, n in counts[1].items() if n >= 3})
    found = set()
    for unit, a in counts[1].items():
        b = counts[0][unit]
        if a / n1 >= 5 * b / n0:
            p = (a + b) / (n1 + n0)
            part = lambda k, n: sum(x * np.log(x / e) for x, e in ((k, n * p), (n - k, n * (1 - p))) if x)
            if 2 * (part(a, n1) + part(b, n0)) >= 25:
                found.add(unit)
    return found


class _Words:
    """The lower-cased words of each text, as a set made anew at each pass."""

    def __init__(self, split: list[list[str]]):
        self.split = split

    def __iter__(self) -> Iterator[set[str]]:
        return ({t.lower() for t in s if t not in _BREAKS} for s in self.split)


def _sentences(tokens: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens:
        if t in _BREAKS or len(out[-1]) == SENTENCE:
            out.append([])
        if t not in _BREAKS:
            out[-1].append(t)
    return [s for s in out if s]


@dataclass
class Model:
    crf: Crf
    weights: np.ndarray


def _evidence(marginal_sums: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Inputs of a text's score: how much is toxic, and how densely."""
    return np.stack([np.ones(len(tokens)), np.log(marginal_sums + 0.05), np.log(marginal_sums / (tokens + 20) + 1e-3)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """The model learned from (text, toxic) rows; None where no word tells them apart."""
    same: dict[str, str] = {}  # one string object for each different token
    split = [[same.setdefault(t, t) for t in _TOKEN.findall(x)] for x, _ in rows]
    units = toxic_units(_Words(split), [y for _, y in rows])
    if not units:
        return None
    positive, near, negative = [], [], []
    for tokens, (_, y) in zip(split, rows, strict=True):
        for s in _sentences(tokens):
            carries = [not units.isdisjoint(_units(t.lower())) for t in s]
            labels = [int(c and y == 1) for c in carries]
            (positive if any(labels) else near if any(carries) else negative).append((s, labels))
    rng = np.random.default_rng(5)
    pick = lambda xs: [xs[i] for i in rng.permutation(len(xs))[:SAMPLE_SENTENCES]]
    crf = train(Crf.zeros(BUCKETS, 2), Types(_features, most=1 << 40), pick(positive) + pick(near) + pick(negative), epochs=8)
    scorer = Scorer(Model(crf, np.zeros(3)))
    seen = [scorer.evidence([x for x, _ in rows[at : at + 256]]) for at in range(0, len(rows), 256)]
    inputs = _evidence(*(np.concatenate([e[i] for e in seen]) for i in range(2)))
    return Model(crf, _logistic(inputs, np.array([y for _, y in rows])))


class Scorer:
    """Scores texts with a ``Model``; what it knows of word types is kept between calls, up to a bound."""

    def __init__(self, model: Model):
        self.crf, self.weights, self.types = model.crf, model.weights, Types(_features, _BREAKS)
        self.emit = np.zeros((0, 3, 2))

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sum of the marginals of ``FAINT`` or more and number of tokens of each text, and the marginals of all its tokens and breaks."""
        if len(self.types.rows) > self.types.most:
            self.types.clear()
            self.emit = self.emit[:0]
        numbered = [np.array(self.types.ids(_TOKEN.findall(t)), np.int64) for t in texts]
        if new := self.types.rows[len(self.emit) :]:
            self.emit = np.concatenate([self.emit, self.crf.of_types(np.array(new))])
        sizes = [len(x) for x in numbered]
        flat = np.concatenate([*numbered, np.zeros(0, np.int64)])
        doc = np.repeat(np.arange(len(texts)), sizes)
        real = flat != 0
        group = np.cumsum(~real) + doc  # a break or a new text starts another sentence
        ids, group = flat[real], group[real]
        p = np.zeros(len(flat))
        if len(ids):
            firsts = np.flatnonzero(np.diff(group, prepend=-1))
            place = np.arange(len(ids)) - np.repeat(firsts, np.diff(firsts, append=len(ids)))
            firsts = np.flatnonzero(place % SENTENCE == 0)
            lengths = np.diff(firsts, append=len(ids))
            p[real] = self.crf.marginals(self.crf.emissions(self.emit, ids, lengths), lengths)[0][:, 1]
        sums = np.bincount(doc, np.where(p >= FAINT, p, 0), len(texts))
        return sums, np.bincount(doc[real], minlength=len(texts)), np.split(p, np.cumsum(sizes)[:-1])

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Score and offending (start, end) offsets of each text."""
        if not texts:
            return []
        *inputs, marginals = self.evidence(texts)
        score = 1 / (1 + np.exp(-np.clip(_evidence(*inputs) @ self.weights, -30, 30)))
        spans = [[m.span() for m, y in zip(_TOKEN.finditer(t), p, strict=True) if y >= 0.5] if (p >= 0.5).any() else [] for t, p in zip(texts, marginals, strict=True)]
        return list(zip(score.tolist(), spans, strict=True))


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out) -> list[tuple[str, int]]:
    """(text, toxic) of at most ``SAMPLE_DOCS`` ids, in order of a hash of the id, with a label of 0 or 1 that are not held out.

    Every id counts once: repeated labels give the greatest, repeated documents the least text. Ids without a document, null ids and null texts give none.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    # the ids are at most SAMPLE_DOCS; partial aggregation keeps one text an id in each task
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return [(r.text, r.y) for r in sorted(texts.where("text IS NOT NULL").collect(), key=lambda r: r.doc_id)]


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, spans) for every row; spans are the offending (start, end) offsets in code points.

    Null and empty texts score as texts without a toxic token do; all score 0 without a model. Repeated rows come back
    each with equal scores, null ids stay, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value) if shared.value is not None else None

        def work(cols: dict) -> dict:
            found = scorer.scores([t or "" for t in cols["text"]]) if scorer else [(0.0, [])] * len(cols["text"])
            return {"doc_id": cols["doc_id"], "score": [s for s, _ in found], "spans": [[{"start": a, "end": b} for a, b in x] for _, x in found]}

        return work

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, score double, spans array<struct<start: int, end: int>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = score_documents(docs, fit(labelled_sample(docs, labels, out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
