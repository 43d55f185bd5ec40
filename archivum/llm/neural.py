"""Small recurrent networks in numpy: a bidirectional LSTM layer with its gradients, and Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Lstm:
    """One direction. Sequences are time x batch x features; where the mask is 0 the state stays
    as it was, so padding on either side has no effect."""

    def __init__(self, d: int, h: int, rng: np.random.Generator) -> None:
        self.h = h
        self.p = {"wx": rng.normal(0, d**-0.5, (d, 4 * h)).astype(np.float32), "wh": rng.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32), "b": np.zeros(4 * h, np.float32)}
        self.p["b"][h : 2 * h] = 1  # remember at first

    def forward(self, gates_in: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """``gates_in``: x @ wx + b, time x batch x 4h."""
        n, (wh, k) = len(gates_in), (self.p["wh"], self.h)
        hid = np.zeros((gates_in.shape[1], k), np.float32)
        cell = np.zeros_like(hid)
        out = np.empty((n, *hid.shape), np.float32)
        past = []
        for t in range(n):
            g = gates_in[t] + hid @ wh
            s = sigmoid(g[:, : 3 * k])
            i, f, o, u = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(g[:, 3 * k :])
            c = f * cell + i * u
            tc = np.tanh(c)
            m = mask[t][:, None]
            if keep:
                past.append((hid, cell, i, f, o, u, tc, m))
            hid = m * (o * tc) + (1 - m) * hid
            cell = m * c + (1 - m) * cell
            out[t] = hid
        return out, past

    def backward(self, d_out: np.ndarray, past: list) -> tuple[np.ndarray, dict]:
        """Gradients of the gates' input (time x batch x 4h) and of wh."""
        k, wh = self.h, self.p["wh"]
        dh = np.zeros_like(past[0][0])
        dc = np.zeros_like(dh)
        d_gates = np.empty((len(past), dh.shape[0], 4 * k), np.float32)
        d_wh = np.zeros_like(wh)
        for t in range(len(past) - 1, -1, -1):
            hid, cell, i, f, o, u, tc, m = past[t]
            dh = dh + d_out[t]
            own, rest = dh * m, dh * (1 - m)
            dcell = dc * m + own * o * (1 - tc**2)
            g = d_gates[t]
            g[:, :k] = dcell * u * i * (1 - i)
            g[:, k : 2 * k] = dcell * cell * f * (1 - f)
            g[:, 2 * k : 3 * k] = own * tc * o * (1 - o)
            g[:, 3 * k :] = dcell * i * (1 - u**2)
            d_wh += hid.T @ g
            dh = rest + g @ wh.T
            dc = dcell * f + dc * (1 - m)
        return d_gates, {"wh": d_wh}


class BiLstm:
    """Both directions over the same input; the output is 2h wide."""

    def __init__(self, d: int, h: int, rng: np.random.Generator) -> None:
        self.ways = (Lstm(d, h, rng), Lstm(d, h, rng))
        self.h = h

    def params(self) -> dict:
        return {f"{i}{k}": v for i, w in enumerate(self.ways) for k, v in w.p.items()}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        outs, pasts = [], []
        for w, turn in zip(self.ways, (1, -1), strict=True):
            h, past = w.forward((x @ w.p["wx"] + w.p["b"])[::turn], mask[::turn], keep)
            outs.append(h[::turn])
            pasts.append(past)
        return np.concatenate(outs, 2), (x, pasts)

    def backward(self, d_out: np.ndarray, kept: tuple) -> tuple[np.ndarray, dict]:
        x, pasts = kept
        dx, grads = np.zeros_like(x), {}
        for n, (w, turn, past) in enumerate(zip(self.ways, (1, -1), pasts, strict=True)):
            g, own = w.backward(d_out[:, :, n * self.h : (n + 1) * self.h][::turn], past)
            g = g[::turn]
            flat = g.reshape(-1, g.shape[2])
            grads |= {f"{n}wh": own["wh"], f"{n}wx": x.reshape(-1, x.shape[2]).T @ flat, f"{n}b": flat.sum(0)}
            dx += g @ w.p["wx"].T
        return dx, grads


class Adam:
    """In-place steps on named arrays, with the gradient's norm held to 5."""

    def __init__(self, params: dict, rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        cut = min(1.0, 5 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * cut
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.params[k].dtype)
