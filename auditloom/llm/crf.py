"""Binary linear-chain conditional random field: fitting by full-batch gradient, decoding by Viterbi.

With two labels everything reduces to one score per position (how much label 1 is preferred), a 2 x 2 transition table
and a start and an end score, which keeps the model a plain dictionary that travels inside a task's closure.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

Features = Sequence[str]


@dataclass
class Chain:
    """A fitted model. `weights` maps a feature to its preference for label 1."""

    weights: dict[str, float] = field(default_factory=dict)
    transition: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    start: float = 0.0
    end: float = 0.0

    def score(self, row: Features) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in row])

    def decode(self, scores: Sequence[float]) -> list[int]:
        """Most probable labels (Viterbi) for the positions' scores; of equal paths the one with more zeros."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.transition
        back: list[tuple[int, int]] = []
        zero, one = 0.0, scores[0] + self.start
        for score in scores[1:]:
            a, b, c, d = zero + t00, one + t10, zero + t01, one + t11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), score + max(c, d)
        label = int(one + self.end > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit(
    sequences: Sequence[Sequence[Features]],
    labels: Sequence[Sequence[int]],
    *,
    least_count: int = 3,
    steps: int = 100,
    rate: float = 0.15,
    l2: float = 0.003,
) -> Chain:
    """Maximum penalised likelihood by Adam over the exact forward-backward gradient of all sequences at once.

    The result depends only on the sequences and their order. Without any sequence the empty model comes back, which
    labels everything 0.
    """
    kept = [(s, y) for s, y in zip(sequences, labels) if len(s)]
    if not kept:
        return Chain()
    counts = Counter(f for s, _ in kept for row in s for f in row)
    index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= least_count))}
    n, longest = len(kept), max(len(s) for s, _ in kept)
    position: list[int] = []
    feature: list[int] = []
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest))
    for i, (s, y) in enumerate(kept):
        mask[i, : len(s)], gold[i, : len(s)] = True, y
        for t, row in enumerate(s):
            for f in row:
                if (k := index.get(f)) is not None:
                    position.append(i * longest + t)
                    feature.append(k)
    at, of = np.array(position, np.int64), np.array(feature, np.int64)
    last = mask.sum(1) - 1
    rows = np.arange(n)
    pair = mask[:, 1:]
    observed = np.array([[(pair * (gold[:, :-1] == a) * (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    size = len(index)
    theta = np.zeros(size + 6)  # weights, transitions row by row, start, end
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit = np.bincount(at, weights=theta[of], minlength=n * longest).reshape(n, longest)
        move, begin, finish = theta[size : size + 4].reshape(2, 2), theta[size + 4], theta[size + 5]
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = emit
        score[:, 0, 1] += begin
        score[rows, last, 1] += finish
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step_in = np.logaddexp(forward[:, t - 1, 0, None] + move[0], forward[:, t - 1, 1, None] + move[1]) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], step_in, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            step_back = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None], step_back, 0.0)
        whole = np.logaddexp(forward[rows, last, 0], forward[rows, last, 1])
        one = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]) * mask
        gradient = np.zeros_like(theta)
        gradient[:size] = np.bincount(of, weights=((gold - one) * mask).ravel()[at], minlength=size)
        if longest > 1:
            joint = forward[:, :-1, :, None] + move + (score[:, 1:] + backward[:, 1:])[:, :, None, :]
            expected = (np.exp(joint - whole[:, None, None, None]) * pair[:, :, None, None]).sum((0, 1))
            gradient[size : size + 4] = (observed - expected).ravel()
        gradient[size + 4] = (gold[:, 0] - one[:, 0]).sum()
        gradient[size + 5] = (gold[rows, last] - one[rows, last]).sum()
        gradient -= l2 * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Chain(
        {f: float(theta[k]) for f, k in index.items()},
        [[float(x) for x in row] for row in theta[size : size + 4].reshape(2, 2)],
        float(theta[size + 4]),
        float(theta[size + 5]),
    )
