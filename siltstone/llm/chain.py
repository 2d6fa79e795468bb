"""A linear-chain conditional random field: training by gradient ascent, decoding by Viterbi. Shared by two operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Sequences:
    """Labelled sequences, stepped through together, longest first."""

    def __init__(self, rows: Sequence[np.ndarray], labels: Sequence[np.ndarray], n_labels: int):
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        self.lengths = np.array([len(rows[i]) for i in order])
        alive = [int(np.searchsorted(-self.lengths, -t, side="left")) for t in range(int(self.lengths[0]))]  # sequences longer than t
        self.flat = np.concatenate([rows[i] for i in order])
        self.gold = np.concatenate([labels[i] for i in order])
        self.base = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.at = [self.base[: alive[t]] + t for t in range(len(alive))]
        self.seen = np.stack([self.flat[self.gold == k].sum(0) for k in range(n_labels)], 1)
        self.pairs = np.zeros((n_labels, n_labels))
        for on in self.at[1:]:
            np.add.at(self.pairs, (self.gold[on - 1], self.gold[on]), 1)

    def slopes(self, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The labels' log likelihood, and its derivatives by weights and by moves: what's seen less what's expected."""
        score = self.flat @ weights
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[self.at[0]] = score[self.at[0]]
        for on in self.at[1:]:
            forward[on] = score[on] + _log_sum(forward[on - 1][:, :, None] + moves[None], 1)
        for on in reversed(self.at[1:]):
            backward[on - 1] = _log_sum(moves[None] + (score[on] + backward[on])[:, None, :], 2)
        norm = _log_sum(forward[self.base + self.lengths - 1], 1)
        of = np.repeat(norm, self.lengths)
        single = np.exp(forward + backward - of[:, None])
        expected = np.zeros_like(moves)
        for on in self.at[1:]:
            both = forward[on - 1][:, :, None] + moves[None] + (score[on] + backward[on])[:, None, :] - of[on][:, None, None]
            expected += np.exp(both).sum(0)
        value = score[np.arange(len(score)), self.gold].sum() + (self.pairs * moves).sum() - norm.sum()
        return float(value), self.seen - self.flat.T @ single, self.pairs - expected


def train(
    rows: Sequence[np.ndarray], labels: Sequence[np.ndarray], n_labels: int = 2, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions (labels x labels) of greatest regularised likelihood.

    rows: for each sequence its features (positions x features); labels: its labels. Adam, full batch, no randomness.
    """
    held = Sequences(rows, labels, n_labels)
    total = len(held.flat)
    values = [np.zeros((rows[0].shape[1], n_labels)), np.zeros((n_labels, n_labels))]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in values]
    for step in range(1, steps + 1):
        for value, slope, (m, v) in zip(values, held.slopes(*values)[1:], state):
            slope = slope / total - ridge * value
            m *= 0.9
            m += 0.1 * slope
            v *= 0.999
            v += 0.001 * slope**2
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return values[0], values[1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def viterbi(scores: Sequence[Sequence[float]], moves: Sequence[Sequence[float]]) -> list[int]:
    """The best labels of one sequence with two labels; scores: (label 0, label 1) by position. Ties go to label 1."""
    (m00, m01), (m10, m11) = moves
    back: list[int] = []
    a = b = 0.0
    for i, (s, u) in enumerate(scores):
        if i:
            x, y, p, q = a + m00, b + m10, a + m01, b + m11
            back.append((y >= x) | (q >= p) << 1)
            a, b = (y if y >= x else x) + s, (q if q >= p else p) + u
        else:
            a, b = s, u
    if not scores:
        return []
    label = int(b >= a)
    out = [label]
    for step in reversed(back):
        label = step >> label & 1
        out.append(label)
    out.reverse()
    return out
