"""A small character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Character classes in this order; others are 3 (letters and signs beyond ASCII) or 15.
CLASSES = 16
WINDOW = 64
_table = np.full(128, 15, dtype=np.uint8)
for _c in range(128):
    _ch = chr(_c)
    if "a" <= _ch <= "z":
        _table[_c] = 1
    elif "A" <= _ch <= "Z":
        _table[_c] = 2
    elif _ch.isdigit():
        _table[_c] = 4
    elif _ch == " ":
        _table[_c] = 5
    elif _ch.isspace():
        _table[_c] = 6
    elif _ch in "@.-+()_%":
        _table[_c] = 7 + "@.-+()_%".index(_ch)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, _table[np.minimum(codes, 127)], 3).astype(np.uint8)


@dataclass
class Tagger:
    """Parameters: x (2, classes, 4H) inputs, h (2, H, 4H), b (2, 4H) for both directions,
    w (2H, tags), c (tags), trans (tags, tags) from row to column, first (tags)."""

    p: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.p["h"].shape[1]

    @classmethod
    def new(cls, tags: int, hidden: int = 12, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.2: rng.normal(0, s, shape)
        p = {
            "x": draw(2, CLASSES, 4 * hidden),
            "h": draw(2, hidden, 4 * hidden),
            "b": np.zeros((2, 4 * hidden)),
            "w": draw(2 * hidden, tags),
            "c": np.zeros(tags),
            "trans": draw(tags, tags, s=0.05),
            "first": np.zeros(tags),
        }
        p["b"][:, hidden : 2 * hidden] = 1  # the forget gate starts open
        return cls(p)

    def emissions(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Tag scores (windows, length, tags) of class windows; keep gathers the states."""
        p, hid = self.p, self.hidden
        n, length = windows.shape
        kind = p["x"].dtype
        h = np.zeros((2, n, hid), dtype=kind)
        c = np.zeros_like(h)
        out = np.empty((n, length, 2 * hid), dtype=kind)
        for t in range(length):
            u = length - 1 - t
            z = np.stack([p["x"][0][windows[:, t]], p["x"][1][windows[:, u]]]) + p["b"][:, None] + h @ p["h"]
            gates = 1 / (1 + np.exp(-z[..., : 3 * hid]))
            i, f, o = gates[..., :hid], gates[..., hid : 2 * hid], gates[..., 2 * hid :]
            g = np.tanh(z[..., 3 * hid :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[:, t, :hid] = h[0]
            out[:, u, hid:] = h[1]
        if keep is not None:
            keep.append(out)
        return out @ p["w"] + p["c"]

    def loss_and_gradient(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths and its gradient."""
        p, hid = self.p, self.hidden
        n, length = windows.shape
        kept: list = []
        scores = self.emissions(windows, kept)
        out = kept.pop()
        alpha = np.empty_like(scores)
        alpha[:, 0] = scores[:, 0] + p["first"]
        for t in range(1, length):
            alpha[:, t] = _lse(alpha[:, t - 1][:, :, None] + p["trans"], 1) + scores[:, t]
        beta = np.zeros_like(scores)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _lse(p["trans"] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _lse(alpha[:, -1], 1)
        rows, steps = np.arange(n)[:, None], np.arange(length)
        gold = scores[rows, steps, tags].sum(1) + p["first"][tags[:, 0]] + p["trans"][tags[:, :-1], tags[:, 1:]].sum(1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        d = np.exp(alpha + beta - total[:, None, None])
        d[rows, steps, tags] -= 1
        grad["first"] = d[:, 0].sum(0) / n
        for t in range(1, length):
            both = alpha[:, t - 1][:, :, None] + p["trans"] + (scores[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
            grad["trans"] += np.exp(both).sum(0) / n
        np.add.at(grad["trans"], (tags[:, :-1], tags[:, 1:]), -1.0 / n)
        d /= n
        grad["c"] = d.sum((0, 1))
        grad["w"] = np.einsum("ntk,ntj->kj", out, d)
        dout = d @ p["w"].T
        dh, dc = np.zeros((2, n, hid)), np.zeros((2, n, hid))
        for t in range(length - 1, -1, -1):
            u = length - 1 - t
            h, before, i, f, o, g, tc = kept[t]
            dh = dh + np.stack([dout[:, t, :hid], dout[:, u, hid:]])
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            grad["b"] += dz.sum(1)
            grad["h"] += np.swapaxes(h, 1, 2) @ dz
            for k, at in ((0, t), (1, u)):
                np.add.at(grad["x"][k], windows[:, at], dz[k])
            dh = dz @ np.swapaxes(p["h"], 1, 2)
            dc = dc * f
        return float((total - gold).mean()), grad

    def train(self, windows: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 6) -> float:
        """Adam over seeded batches; returns the last loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = float("nan")
        for step in range(1, steps + 1):
            own = rng.integers(0, len(windows), min(batch, len(windows)))
            loss, grad = self.loss_and_gradient(windows[own], tags[own])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            shrink = min(1.0, 5.0 / max(size, 1e-9))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g * shrink
                s[k] = 0.99 * s[k] + 0.01 * (g * shrink) ** 2
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return loss

    def small(self) -> Tagger:
        """The same in single precision, for decoding."""
        return Tagger({k: v.astype(np.float32) for k, v in self.p.items()})

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi over the scores (length, tags) of one stretch of text."""
        p = self.p
        length, tags = scores.shape
        back = np.zeros((length, tags), dtype=np.int8)
        best = scores[0] + p["first"]
        for t in range(1, length):
            steps = best[:, None] + p["trans"]
            back[t] = steps.argmax(0)
            best = steps[back[t], np.arange(tags)] + scores[t]
        path = np.empty(length, dtype=np.int8)
        path[-1] = best.argmax()
        for t in range(length - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
