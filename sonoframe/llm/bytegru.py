"""A bidirectional gated recurrent network over bytes that labels every position; numpy only."""

from __future__ import annotations

import numpy as np

PAD = 256


def encode(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of at most ``width`` bytes, padded; their lengths; the text that each row belongs to. A text's rows
    cover all of its bytes."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        n = -(-len(raw) // width)
        step = -(-len(raw) // n) if n else 1  # rows of a text are about as long
        rows += [raw[a : a + step] for a in range(0, len(raw), step)]
        owner += [i] * (len(rows) - len(owner))
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    codes = np.full((len(rows), int(lengths.max(initial=1))), PAD, dtype=np.int64)
    if len(rows):
        inside = np.arange(codes.shape[1]) < lengths[:, None]
        codes[inside] = np.frombuffer(b"".join(rows), dtype=np.uint8)
    return codes, lengths, np.array(owner, dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Parameters: per direction a table from bytes to gate inputs, recurrent weights and biases; output weights."""

    def __init__(self, classes: int, hidden: int = 32, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h = hidden
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "table": f(2, PAD + 1, 3 * h, scale=0.3),
            "u": f(2, h, 3 * h, scale=h**-0.5),
            "b": np.zeros((2, 1, 3 * h), dtype=np.float32),
            "v": f(2, h, classes, scale=h**-0.5),
            "c": np.zeros(classes, dtype=np.float32),
        }

    def _inputs(self, codes: np.ndarray, lengths: np.ndarray):
        """Codes of both directions, time first, and for each row where the backward state of a position lies."""
        steps = codes.shape[1]
        mirror = lengths[:, None] - 1 - np.arange(steps)
        mirror = np.where(mirror >= 0, mirror, np.arange(steps))
        back = np.take_along_axis(codes, mirror, axis=1)
        return np.stack([codes.T, back.T], axis=1), mirror

    def _run(self, both: np.ndarray, keep: bool):
        steps, _, rows = both.shape
        u, b, table = self.p["u"], self.p["b"], self.p["table"]
        h = u.shape[1]
        states = np.zeros((steps + 1, 2, rows, h), dtype=np.float32)
        saved = []
        for t in range(steps):
            x = np.stack([table[0][both[t, 0]], table[1][both[t, 1]]])
            s = states[t]
            g = s @ u + b
            zr = _sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * g[..., 2 * h :])
            states[t + 1] = n + z * (s - n)
            if keep:
                saved.append((z, r, n, g[..., 2 * h :]))
        return states, saved

    def log_probabilities(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(rows, positions, classes)."""
        both, mirror = self._inputs(codes, lengths)
        return self._output(self._run(both, keep=False)[0], mirror)

    def _output(self, states: np.ndarray, mirror: np.ndarray) -> np.ndarray:
        v = self.p["v"]
        ahead = states[1:, 0].transpose(1, 0, 2) @ v[0]
        behind = np.take_along_axis(states[1:, 1].transpose(1, 0, 2) @ v[1], mirror[:, :, None], axis=1)
        logits = ahead + behind + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        both, mirror = self._inputs(codes, lengths)
        states, saved = self._run(both, keep=True)
        steps, _, rows = both.shape
        u, v = self.p["u"], self.p["v"]
        h = u.shape[1]
        logs = self._output(states, mirror)
        inside = (np.arange(steps) < lengths[:, None]).astype(np.float32)
        weight = inside / inside.sum()
        loss = float(-(logs[np.arange(rows), :, labels] * weight).sum())
        d = np.exp(logs)
        d[np.arange(rows), :, labels] -= 1
        d *= weight[:, :, None]
        d_back = np.take_along_axis(d, mirror[:, :, None], axis=1)  # mirror is its own inverse within a row
        out = np.stack([d.transpose(1, 0, 2), d_back.transpose(1, 0, 2)], axis=1)  # steps, 2, rows, classes
        grads = {k: np.zeros_like(x) for k, x in self.p.items()}
        grads["c"] = d.sum(axis=(0, 1))
        through = np.empty_like(states[1:])
        for k in (0, 1):
            own = out[:, k].reshape(-1, out.shape[-1])
            grads["v"][k] = states[1:, k].reshape(-1, h).T @ own
            through[:, k] = (own @ v[k].T).reshape(steps, rows, h)
        d_state = np.zeros((2, rows, h), dtype=np.float32)
        d_x = np.empty((steps, 2, rows, 3 * h), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, n, gn = saved[t]
            s = states[t]
            d_state += through[t]
            d_n = d_state * (1 - z) * (1 - n * n)
            d_z = d_state * (s - n) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=2)
            d_x[t] = np.concatenate([d_z, d_r, d_n], axis=2)
            grads["u"] += s.transpose(0, 2, 1) @ d_g
            grads["b"] += d_g.sum(axis=1, keepdims=True)
            d_state = d_state * z + d_g @ u.transpose(0, 2, 1)
        for k in (0, 1):
            flat, codes_k = d_x[:, k].reshape(-1, 3 * h), both[:, k].reshape(-1)
            order = np.argsort(codes_k, kind="stable")
            sorted_codes = codes_k[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
            grads["table"][k][sorted_codes[first]] = np.add.reduceat(flat[order], first, axis=0)
        return loss, grads

    def train(self, batches, rate: float = 0.01, steps: int = 300) -> list[float]:
        """Adam over ``batches`` of (codes, lengths, labels), the rate falling to a tenth."""
        first = {k: np.zeros_like(x) for k, x in self.p.items()}
        second = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for i, (codes, lengths, labels) in enumerate(batches, 1):
            loss, grads = self.gradients(codes, lengths, labels)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - 0.9 * min(i / steps, 1))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
        return losses
