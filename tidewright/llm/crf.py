"""A linear-chain conditional random field: fitted on the driver from a bounded sample, decoded in the tasks."""

from __future__ import annotations

import numpy as np

#: Training sequences are cut into pieces of this many steps (decoding is not).
PIECE = 32


class LinearChainCRF:
    """Log-linear scores of labels by features (emission) and of neighbouring labels (transition)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.emission, self.transition, self.mean, self.scale = emission, transition, mean, scale

    @classmethod
    def fit(cls, sequences: list[np.ndarray], labels: list[np.ndarray], n_labels: int = 2, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-4) -> LinearChainCRF:
        """Greatest penalised conditional likelihood, by Adam steps on the exact gradient (forward-backward)."""
        pieces = [(x[i : i + PIECE], y[i : i + PIECE]) for x, y in zip(sequences, labels) for i in range(0, len(x), PIECE)]
        pieces.sort(key=lambda p: -len(p[0]))
        steps, d = np.concatenate([x for x, _ in pieces]).astype(float), pieces[0][0].shape[1]
        mean, scale = steps.mean(axis=0), steps.std(axis=0) + 1e-6
        n, longest = len(pieces), len(pieces[0][0])
        x = np.zeros((n, longest, d + 1))
        y = np.zeros((n, longest), dtype=int)
        lengths = np.array([len(p[0]) for p in pieces])
        for k, (a, b) in enumerate(pieces):
            x[k, : len(a), :d], x[k, : len(a), d], y[k, : len(b)] = (a - mean) / scale, 1, b
        live = np.arange(longest)[None, :] < lengths[:, None]
        both = live[:, 1:] & live[:, :-1]
        gold = np.eye(n_labels)[y] * live[..., None]
        gold_pairs = np.einsum("nta,ntb->ab", gold[:, :-1] * both[..., None], gold[:, 1:])
        w, t = np.zeros((d + 1, n_labels)), np.zeros((n_labels, n_labels))
        moments = [np.zeros_like(v) for v in (w, t, w, t)]
        count = live.sum()
        for step in range(1, rounds + 1):
            marginals, pairs = _expected(x @ w, t, lengths, both)
            grads = (np.einsum("ntd,nta->da", x, gold - marginals) / count - ridge * w, (gold_pairs - pairs) / count - ridge * t)
            for k, (value, g) in enumerate(zip((w, t), grads)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * g * g
                value += rate * moments[k] / (1 - 0.9**step) / (np.sqrt(moments[k + 2] / (1 - 0.999**step)) + 1e-8)
        return cls(w, t, mean, scale)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.emission[:-1] + self.emission[-1]

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best label sequence for the given scores (steps x labels); equal scores: the lower label."""
        n = len(scores)
        if not n:
            return []
        labels, trans = range(self.transition.shape[0]), self.transition.T.tolist()
        rows = scores.tolist()
        best, back = rows[0], []
        for row in rows[1:]:
            came, now = [], []
            for k in labels:
                options = [b + t for b, t in zip(best, trans[k])]
                top = max(options)
                came.append(options.index(top))
                now.append(top + row[k])
            best = now
            back.append(came)
        at = best.index(max(best))
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        return path[::-1]


def _expected(scores: np.ndarray, t: np.ndarray, lengths: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels (0 beyond a sequence's end) and expected counts of label pairs."""
    n, longest, k = scores.shape
    e, m = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(t)
    forward, backward = np.empty((n, longest, k)), np.ones((n, longest, k))
    forward[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, longest):
        a = forward[:, i - 1] @ m * e[:, i]
        forward[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        b = (e[:, i + 1] * backward[:, i + 1]) @ m.T
        backward[:, i] = np.where((i + 1 < lengths)[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
    marginals = forward * backward
    marginals /= marginals.sum(axis=2, keepdims=True)
    joint = forward[:, :-1, :, None] * m * (e * backward)[:, 1:, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    marginals *= (np.arange(longest)[None, :] < lengths[:, None])[..., None]
    return marginals, (joint * both[..., None, None]).sum(axis=(0, 1))
