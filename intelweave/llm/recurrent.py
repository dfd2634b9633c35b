"""A bidirectional LSTM labeller of sequences in numpy, trained by Adam.

Sequences of a batch stand one behind the other in flat arrays, sorted by falling length; step t works on
the first rows that are still that long. So nothing is padded, and sequences of any length go through whole.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def steps_of(lengths: np.ndarray, backward: bool) -> list[np.ndarray]:
    """Flat places of each step, for sequences in order of falling length."""
    start = np.cumsum(lengths) - lengths
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    return [(start[:b] + lengths[:b] - 1 - t) if backward else (start[:b] + t) for t, b in enumerate(alive)]


def run_direction(z: np.ndarray, u: np.ndarray, steps: list[np.ndarray], keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of all places from their inputs ``z`` (places x 4 units); with ``keep`` what the gradient needs."""
    units = u.shape[0]
    out, kept = np.empty((len(z), units), z.dtype), []
    rows = len(steps[0]) if steps else 0
    h, c = np.zeros((rows, units), z.dtype), np.zeros((rows, units), z.dtype)
    for at in steps:
        b = len(at)
        gates = z[at] + h[:b] @ u
        sig = _sigmoid(gates[:, :3 * units])
        i, f, o = sig[:, :units], sig[:, units:2 * units], sig[:, 2 * units:]
        g = np.tanh(gates[:, 3 * units:])
        before, was = c[:b], h[:b]
        c = f * before + i * g
        th = np.tanh(c)
        h = o * th
        out[at] = h
        if keep:
            kept.append((i, f, o, g, before, was, th))
    return out, kept


def direction_gradient(dout: np.ndarray, u: np.ndarray, steps: list[np.ndarray], kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs ``z`` and of ``u``."""
    units = u.shape[0]
    dz, du = np.zeros((len(dout), 4 * units), dout.dtype), np.zeros_like(u)
    rows = len(steps[0]) if steps else 0
    dh, dc = np.zeros((rows, units), dout.dtype), np.zeros((rows, units), dout.dtype)
    for at, (i, f, o, g, before, was, th) in zip(reversed(steps), reversed(kept)):
        b = len(at)
        h = dh[:b] + dout[at]
        c = dc[:b] + h * o * (1 - th * th)
        d = np.hstack([c * g * i * (1 - i), c * before * f * (1 - f), h * th * o * (1 - o), c * i * (1 - g * g)])
        dz[at] = d
        du += was.T @ d
        dh[:b], dc[:b] = d @ u.T, c * f
    return dz, du


class Labeller:
    """Features of places to the log-odds of each one's label."""

    def __init__(self, inputs: int, units: int, seed: int) -> None:
        rng = np.random.default_rng(seed)

        def init(rows: int, cols: int) -> np.ndarray:
            return (rng.standard_normal((rows, cols)) / np.sqrt(rows)).astype(np.float32)

        self.p = {"v": np.concatenate([init(2 * units, 1), init(inputs, 1)]), "a": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(inputs, 4 * units), f"u{d}": init(units, 4 * units), f"c{d}": np.zeros(4 * units, np.float32)}
            self.p[f"c{d}"][units:2 * units] = 1  # forget little at first

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Log-odds of all places; ``lengths`` fall."""
        hidden, held = [], []
        for d in "fb":
            steps = steps_of(lengths, d == "b")
            h, kept = run_direction(x @ self.p[f"w{d}"] + self.p[f"c{d}"], self.p[f"u{d}"], steps, keep)
            hidden.append(h)
            held.append((steps, kept))
        both = np.hstack([*hidden, x])
        return (both @ self.p["v"])[:, 0] + self.p["a"], (both, held)

    def gradients(self, x: np.ndarray, dlogit: np.ndarray, state: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of ``x`` from those of the log-odds."""
        both, held = state
        units = self.p["uf"].shape[0]
        grads = {"v": both.T @ dlogit[:, None], "a": dlogit.sum(keepdims=True)}
        dboth = dlogit[:, None] * self.p["v"].T
        dx = dboth[:, 2 * units:].copy()
        for k, d in enumerate("fb"):
            dz, grads[f"u{d}"] = direction_gradient(dboth[:, k * units:(k + 1) * units], self.p[f"u{d}"], *held[k])
            grads[f"w{d}"], grads[f"c{d}"] = x.T @ dz, dz.sum(0)
            dx += dz @ self.p[f"w{d}"].T
        return grads, dx


class Adam:
    """Steps with running means of gradients and of their squares."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float(np.square(g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-12))  # one odd batch must not undo the others
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
