"""Small recurrent networks in numpy: gated units in two directions, attention pooling, a linear-chain CRF, Adam."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def normal(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[-2]))).astype(np.float32)


class Adam:
    def __init__(self, params: Params, rate: float, clip: float = 5.0):
        self.params, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: Params) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            rise = self.m[k] / (1 - 0.9**self.t)
            self.params[k] -= (self.rate * rise / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def turned(lengths: np.ndarray, steps: int) -> np.ndarray:
    """(steps, batch): the position that the backward direction reads at each step; its own beyond the length."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


# Arrays of states are (steps, 2, batch, size); direction 1 runs from the end of each sequence to its start.


# Sequences of a batch come longest first, so those that a step still reaches are a slice.


def gru(gates: np.ndarray, lengths: np.ndarray, u: np.ndarray, c: np.ndarray, keep: bool = False):
    """States of all steps (beyond its length a sequence keeps its last state), and what gru_back needs."""
    steps, _, batch, size = gates.shape
    size //= 3
    h = np.zeros((2, batch, size), gates.dtype)
    out, kept = np.empty((steps, 2, batch, size), gates.dtype), []
    for t in range(steps):
        m = int((lengths > t).sum())
        now, x = h[:, :m], gates[t, :, :m]
        g = now @ u
        zr = sigmoid(x[..., : 2 * size] + g[..., : 2 * size])
        inner = g[..., 2 * size :] + c
        n = np.tanh(x[..., 2 * size :] + zr[..., size:] * inner)
        if keep:
            kept.append((now.copy(), zr, inner, n))
        h[:, :m] = n + zr[..., :size] * (now - n)
        out[t] = h
    return out, kept


def gru_back(d_out: np.ndarray, kept: list, lengths: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of gates, u and c from that of all states."""
    steps, _, batch, size = d_out.shape
    d_gates = np.zeros((steps, 2, batch, 3 * size), d_out.dtype)
    d_u, d_c, d_h = np.zeros_like(u), np.zeros((2, 1, size), d_out.dtype), np.zeros((2, batch, size), d_out.dtype)
    for t in reversed(range(steps)):
        h, zr, inner, n = kept[t]
        m = h.shape[1]
        d_h += d_out[t]
        d = d_h[:, :m]
        z, r = zr[..., :size], zr[..., size:]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * inner * r * (1 - r)
        d_inner = d_n * r
        d_gates[t, :, :m] = np.concatenate([d_z, d_r, d_n], axis=-1)
        d_g = np.concatenate([d_z, d_r, d_inner], axis=-1)
        d_u += h.transpose(0, 2, 1) @ d_g
        d_c += d_inner.sum(axis=1, keepdims=True)
        d_h[:, :m] = d * z + d_g @ u.transpose(0, 2, 1)
    return d_gates, d_u, d_c


def lstm(gates: np.ndarray, lengths: np.ndarray, u: np.ndarray, keep: bool = False):
    steps, _, batch, size = gates.shape
    size //= 4
    h, c = (np.zeros((2, batch, size), gates.dtype) for _ in range(2))
    out, kept = np.empty((steps, 2, batch, size), gates.dtype), []
    for t in range(steps):
        g = gates[t] + h @ u
        s = sigmoid(g[..., : 3 * size])
        a = np.tanh(g[..., 3 * size :])
        new_c = s[..., size : 2 * size] * c + s[..., :size] * a
        th = np.tanh(new_c)
        live = (t < lengths)[:, None]
        if keep:
            kept.append((h, c, s, a, th))
        h, c = np.where(live, s[..., 2 * size :] * th, h), np.where(live, new_c, c)
        out[t] = h
    return out, kept


def lstm_back(d_out: np.ndarray, kept: list, lengths: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, _, batch, size = d_out.shape
    d_gates = np.zeros((steps, 2, batch, 4 * size), d_out.dtype)
    d_u, d_h, d_c = np.zeros_like(u), np.zeros((2, batch, size), d_out.dtype), np.zeros((2, batch, size), d_out.dtype)
    for t in reversed(range(steps)):
        h, c, s, a, th = kept[t]
        i, f, o = s[..., :size], s[..., size : 2 * size], s[..., 2 * size :]
        d, live = d_h + d_out[t], (t < lengths)[:, None]
        go = np.where(live, d, 0)
        new_c = np.where(live, d_c + go * o * (1 - th * th), 0)
        g = np.concatenate([new_c * a * i * (1 - i), new_c * c * f * (1 - f), go * th * o * (1 - o), new_c * i * (1 - a * a)], axis=-1)
        d_gates[t] = g
        d_u += h.transpose(0, 2, 1) @ g
        d_h = np.where(live, 0, d) + g @ u.transpose(0, 2, 1)
        d_c = np.where(live, new_c * f, d_c)
    return d_gates, d_u


def lsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """log Z (batch), tag marginals (steps, batch, tags) and summed pair marginals (tags, tags)."""
    steps, batch, tags = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0] + start
    for t in range(1, steps):
        new = lsum(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
        alpha[t] = np.where((t < lengths)[:, None], new, alpha[t - 1])
    for t in reversed(range(steps - 1)):
        new = lsum(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where((t + 1 < lengths)[:, None], new, 0)
    z = lsum(alpha[-1], 1)
    live = np.arange(steps)[:, None] < lengths
    mass = np.where(live[..., None], np.exp(alpha + beta - z[:, None]), 0)
    pairs = np.zeros_like(trans)
    for t in range(1, steps):
        p = np.exp(alpha[t - 1][:, :, None] + trans + (emit[t] + beta[t])[:, None, :] - z[:, None, None])
        pairs += p[t < lengths].sum(axis=0)
    return z, mass, pairs


def viterbi(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags (steps, batch); beyond a length the last tag goes on."""
    steps, batch, tags = emit.shape
    best, back = emit[0] + start, np.empty((steps, batch, tags), np.int8)
    for t in range(1, steps):
        way = best[:, :, None] + trans
        back[t] = way.argmax(axis=1)
        live = (t < lengths)[:, None]
        best = np.where(live, way.max(axis=1) + emit[t], best)
        back[t] = np.where(live, back[t], np.arange(tags))
    out = np.empty((steps, batch), np.int64)
    out[-1] = best.argmax(axis=1)
    for t in reversed(range(1, steps)):
        out[t - 1] = back[t][np.arange(batch), out[t]]
    return out
