"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters look up their share of the gates, two recurrences read a window from either
end, and their states score the tags of each place. A linear-chain CRF adds scores of
neighbouring tags; training raises the likelihood of the labelled sequence, decoding
takes the best one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Printable ASCII keeps its identity; other blanks, letters and characters share one each.
SYMBOLS = 98
#: Score of tag sequences that cannot occur.
NEVER = -1e4


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of the code points of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 32, 97).astype(np.uint8)
    out[(points >= 0xC0) & (points < 0x3000)] = 96
    out[(points >= 9) & (points <= 13)] = 95
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Weights; ``inputs`` and ``recur`` hold one matrix per direction."""

    inputs: list[np.ndarray]
    recur: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    allowed: np.ndarray  # 0 or NEVER by (tag, next tag)
    first: np.ndarray  # 0 or NEVER by first tag

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recur, self.out, self.bias, self.moves]

    def states(self, ids: np.ndarray, keep: bool = False):
        """Hidden states of both directions, and what the backward pass needs."""
        n, length = ids.shape
        size = self.recur[0].shape[0]
        states = np.zeros((2, n, length, size), self.out.dtype)
        kept = []
        for way in range(2):
            h = np.zeros((n, size), self.out.dtype)
            c = np.zeros_like(h)
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                z = self.inputs[way][ids[:, t]] + h @ self.recur[way]
                gates = sigmoid(z[:, : 3 * size])
                g = np.tanh(z[:, 3 * size :])
                i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
                before = (h, c)
                c = f * c + i * g
                tc = np.tanh(c)
                h = o * tc
                states[way, :, t] = h
                if keep:
                    kept.append((way, t, i, f, o, g, tc, *before))
        return states, kept

    def scores(self, states: np.ndarray) -> np.ndarray:
        size = states.shape[-1]
        return states[0] @ self.out[:size] + states[1] @ self.out[size:] + self.bias

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        scores = self.scores(self.states(ids)[0])
        n, length, tags = scores.shape
        moves = (self.moves + self.allowed).astype(scores.dtype)
        best = scores[:, 0] + self.first.astype(scores.dtype)
        back = np.zeros((n, length, tags), np.int8)
        for t in range(1, length):
            both = best[:, :, None] + moves
            back[:, t] = both.argmax(axis=1)
            best = both.max(axis=1) + scores[:, t]
        out = np.zeros((n, length), np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[rows, t, out[:, t]]
        return out

    def light(self) -> Tagger:
        """The same tagger with half the precision, to decode with."""
        small = [[w.astype(np.float32) for w in ws] for ws in (self.inputs, self.recur)]
        rest = (self.out, self.bias, self.moves, self.allowed, self.first)
        return Tagger(*small, *(w.astype(np.float32) for w in rest))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def gradients(model: Tagger, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags, and its slope by each weight."""
    states, kept = model.states(ids, keep=True)
    scores = model.scores(states)
    n, length, k = scores.shape
    moves = model.moves + model.allowed
    ahead = np.zeros_like(scores)
    behind = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + model.first
    for t in range(1, length):
        ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
    for t in range(length - 2, -1, -1):
        behind[:, t] = log_sum(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    total = log_sum(ahead[:, -1], 1)
    d_scores = np.exp(ahead + behind - total[:, None, None])
    pair = ahead[:, :-1, :, None] + moves + (scores[:, 1:] + behind[:, 1:])[:, :, None, :]
    d_moves = np.exp(pair - total[:, None, None, None]).sum(axis=(0, 1))
    rows, places = np.arange(n)[:, None], np.arange(length)[None, :]
    path = scores[rows, places, tags].sum(axis=1) + moves[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    d_scores[rows, places, tags] -= 1
    np.add.at(d_moves, (tags[:, :-1], tags[:, 1:]), -1.0)
    d_scores /= n
    size = states.shape[-1]
    flat = d_scores.reshape(-1, k)
    d_out = np.concatenate([states[way].reshape(-1, size).T @ flat for way in range(2)])
    d_inputs, d_recur = [], []
    one_hot = np.zeros((n * length, SYMBOLS))
    one_hot[np.arange(n * length), ids.reshape(-1)] = 1
    for way in range(2):
        from_scores = d_scores @ model.out[way * size : (way + 1) * size].T
        d_z = np.zeros((n, length, 4 * size))
        d_h, d_c = np.zeros((n, size)), np.zeros((n, size))
        grown = np.zeros_like(model.recur[way])
        for w, t, i, f, o, g, tc, h, c in reversed(kept):
            if w != way:
                continue
            d_h = d_h + from_scores[:, t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            z = np.concatenate(
                (d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)), 1
            )
            d_z[:, t] = z
            grown += h.T @ z
            d_h, d_c = z @ model.recur[way].T, d_c * f
        d_inputs.append(one_hot.T @ d_z.reshape(n * length, -1))
        d_recur.append(grown)
    loss = float((total - path).mean())
    return loss, [*d_inputs, *d_recur, d_out, flat.sum(axis=0), d_moves / n]


def train(ids, tags, kinds: int, size: int = 12, steps: int = 360, batch: int = 64, seed: int = 11) -> Tagger:
    """A tagger of windows; tag 0 is outside, 2k - 1 begins and 2k continues kind k."""
    rng = np.random.default_rng(seed)
    k = 2 * kinds + 1
    allowed = np.zeros((k, k))
    first = np.zeros(k)
    for kind in range(1, kinds + 1):
        inside = 2 * kind
        first[inside] = NEVER
        allowed[:, inside] = NEVER
        allowed[[inside - 1, inside], inside] = 0
    inputs = [rng.normal(0, 0.3, (SYMBOLS, 4 * size)) for _ in range(2)]
    for table in inputs:
        table[:, size : 2 * size] += 1.0  # remember at first
    recur = [rng.normal(0, 0.3, (size, 4 * size)) for _ in range(2)]
    model = Tagger(inputs, recur, rng.normal(0, 0.3, (2 * size, k)), np.zeros(k), np.zeros((k, k)), allowed, first)
    weights = model.weights()
    mean = [np.zeros_like(w) for w in weights]
    square = [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        chosen = rng.choice(len(ids), batch)
        _, slopes = gradients(model, ids[chosen], tags[chosen])
        norm = np.sqrt(sum(float((s * s).sum()) for s in slopes))
        rate = 0.03 * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        for w, s, m, v in zip(weights, slopes, mean, square, strict=True):
            s = s * min(1.0, 5.0 / max(norm, 1e-9))
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model
