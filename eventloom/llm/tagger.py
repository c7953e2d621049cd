"""A character-level bidirectional LSTM with CRF transitions, forwards and backwards in numpy.

Inputs are ``(time, batch)`` arrays of character classes; all steps are vectorised over the
batch.  ``fit`` is Adam on the CRF's negative log-likelihood; ``decode`` is Viterbi.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _logsum(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class CharTagger:
    """Embedding, one LSTM each way, emission layer, transitions."""

    def __init__(self, classes: int, tags: int, embed: int = 12, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"e": n(classes, embed) * np.float32(classes**0.5 * 0.3), "o": n(2 * hidden, tags), "ob": np.zeros(tags, np.float32), "t": np.zeros((tags, tags), np.float32), "s": np.zeros(tags, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"x{d}": n(embed, 4 * hidden), f"h{d}": n(hidden, 4 * hidden), f"b{d}": bias}

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, batch, n = x.shape[0], x.shape[1], self.hidden
        h, c, out, kept = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32), np.empty((steps, batch, n), np.float32), []
        z_in = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, prev = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept.append((t, i, f, o, g, before, prev, tc))
        return out, kept

    def _lstm_back(self, x: np.ndarray, d_out: np.ndarray, kept: list, d: str, grads: dict) -> np.ndarray:
        n = self.hidden
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
        dwh = np.zeros_like(self.p[f"h{d}"])
        for t, i, f, o, g, before, prev, tc in reversed(kept):
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dwh += prev.T @ dz
            dc, dh = dc * f, dz @ self.p[f"h{d}"].T
        flat = dz_all.reshape(-1, 4 * n)
        grads[f"x{d}"], grads[f"h{d}"], grads[f"b{d}"] = x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)
        return dz_all @ self.p[f"x{d}"].T

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        x = self.p["e"][classes]
        h = np.concatenate([self._lstm(x, "f", False)[0], self._lstm(x, "b", False)[0]], axis=2)
        return h @ self.p["o"] + self.p["ob"]

    def _passes(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log scores of the CRF, and the log of the partition sum."""
        p, steps = self.p, len(e)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + p["s"]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + p["t"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(p["t"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        return alpha, beta, z

    def gradients(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of ``tags`` and its gradients."""
        p, grads = self.p, {}
        x = p["e"][classes]
        (hf, kf), (hb, kb) = self._lstm(x, "f", True), self._lstm(x, "b", True)
        h = np.concatenate([hf, hb], axis=2)
        e = h @ p["o"] + p["ob"]
        steps, batch, k = e.shape
        alpha, beta, z = self._passes(e)
        marginal = np.exp(alpha + beta - z[None, :, None])
        pair = np.exp(alpha[:-1][..., None] + p["t"] + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
        rows = np.arange(batch)
        gold = p["s"][tags[0]] + e[0][rows, tags[0]]
        for t in range(1, steps):
            gold = gold + p["t"][tags[t - 1], tags[t]] + e[t][rows, tags[t]]
        np.subtract.at(pair, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        one = np.eye(k, dtype=np.float32)[tags]
        de = ((marginal - one) / batch).astype(np.float32)
        grads["t"], grads["s"] = pair / batch, (marginal[0] - one[0]).sum(axis=0) / batch
        grads["o"], grads["ob"] = h.reshape(-1, h.shape[2]).T @ de.reshape(-1, k), de.sum(axis=(0, 1))
        dh = de @ p["o"].T
        n = self.hidden
        dx = self._lstm_back(x, dh[..., :n], kf, "f", grads) + self._lstm_back(x, dh[..., n:], kb, "b", grads)
        grads["e"] = np.zeros_like(p["e"])
        np.add.at(grads["e"], classes.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z - gold).mean()), grads

    def fit(self, classes: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 8e-3, seed: int = 5) -> CharTagger:
        """Train on ``(windows, time)`` arrays."""
        rng, t = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs) + 1e-3
            order = rng.permutation(len(classes))
            for i in range(0, len(order), batch):
                mine, t = order[i : i + batch], t + 1
                _, grads = self.gradients(classes[mine].T, tags[mine].T)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags ``(time, batch)`` and the CRF's probability of each."""
        e = self.emissions(classes)
        steps, batch, k = e.shape
        score, back = e[0] + self.p["s"], np.empty((steps, batch, k), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + self.p["t"]
            back[t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[t]
        tags = np.empty((steps, batch), np.int64)
        tags[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(batch), tags[t]]
        alpha, beta, z = self._passes(e)
        share = np.take_along_axis(alpha + beta, tags[..., None], 2)[..., 0]
        return tags, np.exp(share - z)
