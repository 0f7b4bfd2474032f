"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word's input is its own embedding, if the training sample has it in two documents or more, next to the mean embedding of
its character 3-grams and 5-grams (with marks for its start and end). Equal words of a block share one input row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from beamfold.llm import words as W

WINDOW, STRIDE = 16, 8
EMBED, HIDDEN, ATTEND = 8, 8, 8
GRAMS = 1 << 15
GRAM_SIZES = (3, 5)
_START, _END = W.series(4, 2)


@dataclass
class Inputs:
    """Distinct words of a block (vocabulary row, grams as a flat list with counts) and windows as rows of distinct words."""
    word: np.ndarray
    grams: np.ndarray
    gram_counts: np.ndarray
    windows: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def inputs(block: W.Block, vocabulary: np.ndarray) -> Inputs:
    w = W.words(block, W.ALNUM)
    hashes, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        word = np.where(vocabulary[at] == hashes, at + 1, 0)
    else:
        word = np.zeros(len(hashes), np.int64)
    total = W.prefix(block, lower=True)
    start, end = w.start[first], w.end[first]
    flat, owner = [], []
    for n in GRAM_SIZES:
        count = np.maximum(end - start - n + 1, 1)
        who = np.repeat(np.arange(len(start)), count)
        a = start[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        b = np.minimum(a + n, end[who])
        h = W.ranges_hash(block, a, b, True, total) + (a == start[who]) * _START + (b == end[who]) * _END
        flat.append((W.mix(h) % np.uint64(GRAMS)).astype(np.int64))
        owner.append(who)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    # Windows of each text: a last one starts where the text ends within it.
    many = np.where(w.counts > WINDOW, 1 + -(-(w.counts - WINDOW) // STRIDE), np.minimum(w.counts, 1))
    text = np.repeat(np.arange(block.rows), many)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < w.counts[text][:, None]
    windows = np.where(inside, inverse[np.minimum(w.firsts[text][:, None] + place, max(len(inverse) - 1, 0))] if len(inverse) else 0, len(hashes))
    return Inputs(word, np.concatenate(flat)[order], np.bincount(owner, minlength=len(start)), windows, text, hashes)


def part(x: Inputs, rows: np.ndarray) -> Inputs:
    """Some windows, with only the distinct words that they hold."""
    windows = x.windows[rows]
    used, inverse = np.unique(windows, return_inverse=True)
    inverse = inverse.reshape(windows.shape)
    if len(used) and used[-1] == len(x.word):
        used = used[:-1]  # the padding stays the number after the last word
    many = x.gram_counts[used]
    begin = (np.cumsum(x.gram_counts) - x.gram_counts)[used]
    at = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return Inputs(x.word[used], x.grams[at], many, inverse, x.text[rows], x.hash[used])


def _sums(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of values added up by their place."""
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order[first]]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=None: (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": draw(len(vocabulary) + 1, EMBED, scale=0.1), "gram": draw(GRAMS, EMBED, scale=0.1), "attend": draw(2 * HIDDEN, ATTEND), "attend_b": np.zeros(ATTEND, np.float32),
                  "attend_v": draw(ATTEND), "out": draw(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(2 * EMBED, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def rows(self, x: Inputs) -> np.ndarray:
        """Input of each distinct word, and of the padding in the last row."""
        total = np.zeros((len(x.grams) + 1, EMBED), np.float64)
        np.cumsum(self.p["gram"][x.grams], axis=0, out=total[1:])
        end = np.cumsum(x.gram_counts)
        chars = (total[end] - total[end - x.gram_counts]) / x.gram_counts[:, None]
        return np.concatenate([np.concatenate([self.p["word"][x.word], chars], axis=1), np.zeros((1, 2 * EMBED), np.float32)]).astype(np.float32)

    def _run(self, proj: np.ndarray, windows: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; proj: projected input of each distinct word."""
        H, u = HIDDEN, self.p[f"h{d}"]
        n, steps = windows.shape
        h = np.zeros((n, H), np.float32)
        out, saved = np.empty((n, steps, H), np.float32), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, g = proj[windows[:, t]], h @ u
            zr = _sigmoid(x[:, :2 * H] + g[:, :2 * H])
            new = np.tanh(x[:, 2 * H:] + zr[:, H:] * g[:, 2 * H:])
            step = mask[:, t, None] * (1 - zr[:, :H])
            if keep:
                saved[t] = (h, zr, new, g[:, 2 * H:])
            h = h + step * (new - h)
            out[:, t] = h
        return out, saved

    def logits(self, rows: np.ndarray, windows: np.ndarray, keep: bool = False):
        mask = (windows < len(rows) - 1).astype(np.float32)
        parts = {d: self._run(rows @ self.p[f"x{d}"] + self.p[f"b{d}"], windows, mask, d, keep) for d in "fb"}
        states = np.concatenate([parts["f"][0], parts["b"][0]], axis=2)
        a = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        e = np.exp(a @ self.p["attend_v"]) * mask
        weight = e / e.sum(1, keepdims=True)
        pooled = (weight[:, :, None] * states).sum(1)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logit, (mask, parts, states, a, weight, pooled)) if keep else logit

    def score(self, x: Inputs, size: int = 8192) -> np.ndarray:
        """Probability of each window."""
        rows = self.rows(x)
        return np.concatenate([_sigmoid(self.logits(rows, x.windows[i:i + size])) for i in range(0, len(x.windows), size)] or [np.zeros(0, np.float32)])

    def gradients(self, x: Inputs, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the windows."""
        p, H, windows = self.p, HIDDEN, x.windows
        rows = self.rows(x)
        logit, (mask, parts, states, a, weight, pooled) = self.logits(rows, windows, True)
        d = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled[:, None]
        d_weight = (states * d_pooled[:, None]).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["attend_v"] = (a * d_energy[:, :, None]).sum((0, 1))
        d_a = d_energy[:, :, None] * p["attend_v"] * (1 - a * a)
        flat = d_a.reshape(-1, ATTEND)
        g["attend"], g["attend_b"] = states.reshape(-1, 2 * H).T @ flat, flat.sum(0)
        d_states = d_states + d_a @ p["attend"].T
        d_rows = np.zeros_like(rows)
        for k, way in enumerate("fb"):
            u, saved, out = p[f"h{way}"], parts[way][1], d_states[:, :, k * H:(k + 1) * H]
            g[f"h{way}"], d_in = np.zeros_like(u), np.empty((*windows.shape, 3 * H), np.float32)
            dh = np.zeros((len(windows), H), np.float32)
            steps = range(windows.shape[1])
            for t in reversed(steps) if way == "f" else steps:
                h, zr, new, hn = saved[t]
                dh = dh + out[:, t]
                m = mask[:, t, None]
                z, r = zr[:, :H], zr[:, H:]
                d_new = dh * m * (1 - z) * (1 - new * new)
                d_z = dh * m * (h - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_in[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
                g[f"h{way}"] += h.T @ d_gate
                dh = dh * (1 - m * (1 - z)) + d_gate @ u.T
            d_proj = _sums(len(rows), windows.ravel(), d_in.reshape(-1, 3 * H))
            d_proj[-1] = 0
            g[f"x{way}"], g[f"b{way}"] = rows.T @ d_proj, d_proj.sum(0)
            d_rows += d_proj @ p[f"x{way}"].T
        g["word"] = _sums(len(p["word"]), x.word, d_rows[:-1, :EMBED])
        g["gram"] = _sums(GRAMS, x.grams, np.repeat(d_rows[:-1, EMBED:] / x.gram_counts[:, None], x.gram_counts, axis=0))
        g["word"][0] = 0
        return g

    def fit(self, x: Inputs, labels: np.ndarray, rounds: int = 5, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 11) -> None:
        """labels: of each text. A text stands for its most suspicious window, chosen anew each round, at first by the word of
        the largest log-odds; texts of label 0 add a second one and random windows. Half of the words hide their own embedding in
        each step, so that the characters learn, too."""
        rng = np.random.default_rng(seed)
        odds = self._odds(x, labels)
        suspicion = np.append(odds, -np.inf)[x.windows].max(1)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for round_ in range(rounds):
            order = np.lexsort((rng.random(len(x.text)), -suspicion, x.text))
            first = np.flatnonzero(np.diff(x.text[order], prepend=-1))
            second = np.minimum(first + 1, len(order) - 1)
            hard = order[second][labels[x.text[order[second]]] == 0]
            clean = np.flatnonzero(labels[x.text] == 0)
            pick = np.concatenate([order[first], hard, rng.choice(clean, min(len(clean), 2 * len(first)), replace=False)])
            for _ in range(epochs):
                rng.shuffle(pick)
                for i in range(0, len(pick), batch):
                    rows = pick[i:i + batch]
                    some = part(x, rows)
                    some.word = np.where(rng.random(len(some.word)) < 0.5, 0, some.word)
                    g = self.gradients(some, labels[some.text].astype(np.float32))
                    step += 1
                    for k, a in self.p.items():
                        m[k] += 0.1 * (g[k] - m[k])
                        v[k] += 0.01 * (g[k] * g[k] - v[k])
                        a -= (rate * (1 - round_ / (rounds + 1)) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            if round_ < rounds - 1:
                suspicion = self.score(x)

    @staticmethod
    def _odds(x: Inputs, labels: np.ndarray) -> np.ndarray:
        """Smoothed log-odds of label 1 of each distinct word, by the texts it is in, or of its grams if it is rare."""
        pair = np.unique(np.repeat(x.text, WINDOW) * np.int64(len(x.word) + 1) + x.windows.ravel())
        text, word = pair // (len(x.word) + 1), pair % (len(x.word) + 1)
        keep = word < len(x.word)
        text, word = text[keep], word[keep]
        share = (labels == 1).mean()
        gram_owner = np.repeat(np.arange(len(x.word)), x.gram_counts)
        ones = np.bincount(word, weights=labels[text] == 1, minlength=len(x.word))
        all_ = np.bincount(word, minlength=len(x.word))
        gram_ones, gram_all = (np.bincount(x.grams, weights=c[gram_owner], minlength=GRAMS) for c in (ones, all_))
        odds = lambda one, n: np.log((one + 2 * share) / (n - one + 2 * (1 - share)))
        by_gram = np.maximum.reduceat(odds(gram_ones, gram_all)[x.grams], np.cumsum(x.gram_counts) - x.gram_counts)
        return np.maximum(odds(ones, all_), 0.8 * by_gram)
