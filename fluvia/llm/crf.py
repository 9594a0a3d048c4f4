"""Linear-chain conditional random fields in numpy: training, marginals and best paths over many sequences at once.

A token's emission is the sum of weights of its type's features, plus those of the types before and
after it. Sequences lie one after the other in flat arrays; each step of a recursion handles the
tokens at one position of all sequences that are long enough, so nothing is padded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


class Types:
    """Numbers token types and holds their hashed features; whoever keeps one clears it when it holds over ``most`` (memory only: types are numbered afresh)."""

    def __init__(self, features: Callable[[str], list[int]], breaks: str = "", most: int = 200_000):
        self.features, self.most, self.breaks = features, most, breaks
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {b: 0 for b in self.breaks}
        self.rows: list[list[int]] = [self.features("")]

    def ids(self, tokens: list[str]) -> list[int]:
        number = self.number
        for t in dict.fromkeys(tokens):  # in order of appearance, so that numbers don't depend on string hashes
            if t not in number:
                number[t] = len(self.rows)
                self.rows.append(self.features(t))
        return list(map(number.__getitem__, tokens))


def steps(lengths: np.ndarray) -> list[np.ndarray]:
    """Flat indices of the tokens at position 0, 1, ... of all sequences, longest sequences first."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], -lengths[order]
    return [starts[: np.searchsorted(sizes, -t, "left")] + t for t in range(int(lengths.max(initial=0)))]


@dataclass
class Crf:
    own: np.ndarray  # (buckets, labels)
    left: np.ndarray  # weights of the features of the token before
    right: np.ndarray
    trans: np.ndarray  # (labels, labels)
    start: np.ndarray

    @classmethod
    def zeros(cls, buckets: int, labels: int) -> Crf:
        z = lambda *s: np.zeros(s)
        return cls(z(buckets, labels), z(buckets, labels), z(buckets, labels), z(labels, labels), z(labels))

    def of_types(self, rows: np.ndarray) -> np.ndarray:
        """(types, 3, labels): what each type adds to its own, the next and the previous token's emission."""
        return np.stack([self.own[rows].sum(1), self.left[rows].sum(1), self.right[rows].sum(1)], 1)

    @staticmethod
    def emissions(table: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        e = table[ids, 0]
        ends = np.cumsum(lengths)
        inner = np.ones(len(ids), bool)
        inner[ends[:-1]] = False  # first tokens have none before them
        inner[:1] = False
        at = np.flatnonzero(inner)
        e[at] += table[ids[at - 1], 1]
        e[at - 1] += table[ids[at], 2]
        return e

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(tokens, labels) posterior probabilities by forward-backward, with what training needs."""
        psi = np.exp(e - e.max(1, keepdims=True))
        move = np.exp(self.trans)
        at, alphas, scales = steps(lengths), [], []
        for t, rows in enumerate(at):
            a = psi[rows] * (np.exp(self.start) if t == 0 else alphas[-1][: len(rows)] @ move)
            s = a.sum(1, keepdims=True)
            alphas.append(a / s)
            scales.append(s)
        out = np.empty_like(psi)
        betas: list[np.ndarray] = [np.empty(0)] * len(at)
        for t in range(len(at) - 1, -1, -1):
            b = np.ones_like(alphas[t])
            if t + 1 < len(at):
                b[: len(at[t + 1])] = (psi[at[t + 1]] * betas[t + 1] / scales[t + 1]) @ move.T
            betas[t] = b
            m = alphas[t] * b
            out[at[t]] = m / m.sum(1, keepdims=True)
        return out, at, alphas, betas, psi

    def best(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label of each token on the best path (Viterbi)."""
        at = steps(lengths)
        score, back = None, []
        finals = np.zeros(len(lengths), int)
        for t, rows in enumerate(at):
            if t == 0:
                score = e[rows] + self.start
                back.append(None)
            else:
                finals[len(rows) : len(score)] = score[len(rows) :].argmax(1)
                through = score[: len(rows), :, None] + self.trans
                back.append(through.argmax(1))
                score = through.max(1) + e[rows]
        if score is not None:
            finals[: len(score)] = score.argmax(1)
        out = np.zeros(len(e), int)
        for t in range(len(at) - 1, -1, -1):
            n = len(at[t])
            out[at[t]] = finals[:n]
            if t:
                finals[:n] = back[t][np.arange(n), finals[:n]]
        return out

    def gradient_step(self, rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, gold: np.ndarray, state: dict, rate: float, decay: float) -> None:
        """One AdaGrad step up the log-likelihood of the gold labels of these sequences."""
        labels = self.trans.shape[0]
        table = self.of_types(rows)
        m, at, alphas, betas, psi = self.marginals(self.emissions(table, ids, lengths), lengths)
        g = np.eye(labels)[gold] - m
        n_types, firsts = len(rows), np.cumsum(lengths) - lengths
        inner = np.ones(len(ids), bool)
        inner[firsts] = False
        pos = np.flatnonzero(inner)
        trans = np.zeros_like(self.trans)
        move = np.exp(self.trans)
        np.add.at(trans, (gold[pos - 1], gold[pos]), 1.0)
        for t in range(1, len(at)):
            n = len(at[t])
            joint = alphas[t - 1][:n, :, None] * move * (psi[at[t]] * betas[t])[:, None, :]
            trans -= (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        by_type = np.zeros((3, n_types, labels))
        np.add.at(by_type[0], ids, g)
        np.add.at(by_type[1], ids[pos - 1], g[pos])
        np.add.at(by_type[2], ids[pos], g[pos - 1])
        for name, grad in (("own", by_type[0]), ("left", by_type[1]), ("right", by_type[2]), ("trans", trans), ("start", g[firsts].sum(0))):
            w = getattr(self, name)
            if name in ("own", "left", "right"):
                full = np.zeros_like(w)
                for f in range(rows.shape[1]):
                    np.add.at(full, rows[:, f], grad)
                grad = full
            grad = grad / len(lengths) - decay * w
            state[name] = state.get(name, 1e-8) + grad**2
            w += rate * grad / np.sqrt(state[name])


def train(crf: Crf, types: Types, sequences: list[tuple[list[str], list[int]]], epochs: int = 12, batch: int = 256, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Crf:
    """Fit to (tokens, labels) sequences."""
    numbered = [(np.array(types.ids(tokens)), np.array(labels)) for tokens, labels in sequences if tokens]
    rng, state, rows = np.random.default_rng(seed), {}, np.array(types.rows)
    for _ in range(epochs):
        order = rng.permutation(len(numbered))
        for at in range(0, len(order), batch):
            some = [numbered[i] for i in order[at : at + batch]]
            ids = np.concatenate([x[0] for x in some])
            used, ids = np.unique(ids, return_inverse=True)
            crf.gradient_step(rows[used], ids, np.array([len(x[0]) for x in some]), np.concatenate([x[1] for x in some]), state, rate, decay)
    return crf
