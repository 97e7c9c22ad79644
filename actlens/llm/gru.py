"""A bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

A step reads SPAN bytes: each gives a row of the table of its place in the step (input weights and bias in one), which
add up; both directions run over a window, and a linear layer gives class logits at every step, which are those of its
bytes. Windows have a multiple of SPAN positions.
"""

from __future__ import annotations

import numpy as np

#: The symbol for "no byte": before, after and between texts. Bytes of a step.
PAD, SPAN = 256, 4
#: What no byte adds to the reset and update gates: it shuts them, so that a step without bytes leaves the state 0, however many there are. These rows are not learned.
SHUT = -50.0


def init(classes: int, hidden: int, seed: int, span: int = SPAN) -> dict[str, np.ndarray]:
    """Gates come first (reset, update, new), so that each is one stretch of memory. in: rows for the symbols at each place of a step read forwards, then for those read backwards; rec: recurrent weights of both directions."""
    r = np.random.default_rng(seed)
    turn = lambda: np.linalg.qr(r.normal(size=(hidden, hidden)))[0]
    p = {"in": r.normal(0, 0.3, (3, 2 * span * (PAD + 1), hidden)), "rec": np.stack([[turn(), turn()] for _ in range(3)]), "out": r.normal(0, 0.1, (2, hidden, classes)), "bias": np.zeros(classes)}
    p["in"][:2, PAD :: PAD + 1], p["in"][2, PAD :: PAD + 1] = SHUT, 0
    return {k: v.astype(np.float32) for k, v in p.items()}


def span(p: dict) -> int:
    return p["in"].shape[1] // (2 * (PAD + 1))


def _gate(x: np.ndarray) -> None:
    """The piecewise linear sigmoid, in place: several times faster than the smooth one."""
    np.multiply(x, 0.2, out=x)
    np.add(x, 0.5, out=x)
    np.maximum(x, 0, out=x)
    np.minimum(x, 1, out=x)


def _slope(gate: np.ndarray) -> np.ndarray:
    return np.where((gate > 0) & (gate < 1), gate.dtype.type(0.2), gate.dtype.type(0))


def _both(p: dict, x: np.ndarray) -> np.ndarray:
    """(steps, span, 2, B): the symbols of each step in either direction, as rows of the table."""
    k = span(p)
    own = x.astype(np.int64).reshape(len(x) // k, k, -1) + (np.arange(k) * (PAD + 1))[:, None]
    return np.stack([own, own[::-1] + k * (PAD + 1)], axis=2)


def _run(p: dict, xs: np.ndarray, keep: bool):
    """States (T + 1, 2, B, H) of both directions, each in its own order; with keep also what the backward pass needs: gates (3, T, 2, B, H) and the linear part of the new state."""
    table, rec = p["in"], p["rec"]
    steps, places, _, width = xs.shape
    h_size, kind = rec.shape[-1], rec.dtype
    states = np.zeros((steps + 1, 2, width, h_size), kind)
    gates = np.empty((3, steps, 2, width, h_size), kind) if keep else None
    lin = np.empty((steps, 2, width, h_size), kind) if keep else None
    a, g = np.empty((3, 2, width, h_size), kind), np.empty((3, 2, width, h_size), kind)
    rz, (r, z, n), an = g[:2], g, a[2]
    more = np.empty_like(g)
    for t in range(steps):
        h, new = states[t], states[t + 1]
        np.matmul(h, rec, out=a)
        np.take(table, xs[t, 0], axis=1, out=g, mode="clip")
        for i in range(1, places):
            g += np.take(table, xs[t, i], axis=1, out=more, mode="clip")
        rz += a[:2]
        _gate(rz)
        if keep:
            lin[t] = an
        an *= r
        n += an
        np.tanh(n, out=n)
        if keep:
            gates[:, t] = g
        np.subtract(h, n, out=new)
        new *= z
        new += n
    return states, gates, lin


def _top(p: dict, states: np.ndarray) -> np.ndarray:
    return states[1:, 0] @ p["out"][0] + states[:0:-1, 1] @ p["out"][1] + p["bias"]


def log_probs(p: dict, x: np.ndarray) -> np.ndarray:
    """(steps, B, classes) for windows x (T, B) of byte symbols."""
    y = _top(p, _run(p, _both(p, x), False)[0])
    y -= y.max(-1, keepdims=True)
    return y - np.log(np.exp(y).sum(-1, keepdims=True))


def _back(p: dict, xs: np.ndarray, kept, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights; d_out (T, 2, B, H): those of the states, each direction in its own order."""
    states, (r, z, n), lin = kept
    turned = p["rec"].swapaxes(-1, -2).copy()
    h = states[:-1]
    # what doesn't depend on later steps, for all steps at once: dn = dh * on_n, dz = dh * on_z, dr = dn * on_r
    on_n, on_z, on_r = (1 - z) * (1 - n * n), (h - n) * _slope(z), lin * _slope(r)
    d_in = np.empty((3, *r.shape), r.dtype)
    e = np.empty((3, *r.shape[1:]), r.dtype)
    d_lin = np.empty_like(lin)
    dh = np.zeros_like(states[0])
    for t in range(len(xs) - 1, -1, -1):
        dh += d_out[t]
        dr, dz, dn = d_in[:, t]
        np.multiply(dh, on_n[t], out=dn)
        np.multiply(dh, on_z[t], out=dz)
        np.multiply(dn, on_r[t], out=dr)
        e[0], e[1] = dr, dz
        np.multiply(dn, r[t], out=e[2])
        d_lin[t] = e[2]
        dh *= z[t]
        dh += np.matmul(e, turned).sum(0)
    d_table = np.zeros_like(p["in"])
    size = h.shape[-1]
    for place in range(xs.shape[1]):
        flat = xs[:, place].reshape(-1)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        for i in range(3):
            d_table[i][flat[order][first]] = np.add.reduceat(d_in[i].reshape(-1, size)[order], first, axis=0)
    d_table[:, PAD :: PAD + 1] = 0
    each = [d_in[0], d_in[1], d_lin]
    return d_table, np.stack([[h[:, i].reshape(-1, size).T @ d[:, i].reshape(-1, size) for i in (0, 1)] for d in each])


def gradients(p: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, dict]:
    """Weighted mean cross entropy over positions, and its gradients. x, y, w: (T, B)."""
    k, xs = span(p), _both(p, x)
    kept = _run(p, xs, True)
    s = _top(p, kept[0])
    s -= s.max(-1, keepdims=True)
    q = np.exp(s)
    total = q.sum(-1, keepdims=True)
    q /= total
    s -= np.log(total)
    w = (w / max(w.sum(), 1e-6)).astype(q.dtype).reshape(-1, k, x.shape[1])
    y = y.reshape(w.shape)
    q *= w.sum(1)[..., None]
    at, of, loss = np.arange(len(q))[:, None], np.arange(x.shape[1])[None], 0.0
    for i in range(k):
        loss -= float((w[:, i] * s[at, of, y[:, i]]).sum())
        q[at, of, y[:, i]] -= w[:, i]
    qs = np.stack([q, q[::-1]], axis=1)
    g = {"out": np.stack([kept[0][1:, i].reshape(-1, p["out"].shape[1]).T @ qs[:, i].reshape(-1, q.shape[-1]) for i in (0, 1)]), "bias": q.sum((0, 1))}
    g["in"], g["rec"] = _back(p, xs, kept, np.matmul(qs, p["out"].transpose(0, 2, 1).copy()))
    return loss, g


class Adam:
    def __init__(self, p: dict):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict, g: dict, rate: float, clip: float = 1.0) -> None:
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        scale = min(1.0, clip / (norm + 1e-6))
        self.t += 1
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)
