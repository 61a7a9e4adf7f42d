"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs.

Every word is a learned word vector (a bounded vocabulary; other words share
one vector) next to the sum of learned vectors of its hashed byte n-grams.  The
network reads windows of ``WINDOW`` words that overlap by ``WINDOW - STRIDE``;
attention pools the states of both directions into one logit per window, and a
small logistic layer turns the windows of a text into its score.  That layer,
and how far its log odds are moved so that the best cut is a score of 0.7, come
from the quarter of the rows that a first network doesn't see; the network that
scores learns from all.  All of it is trained in numpy in one task, on a bounded, hash-ordered sample of labelled
rows (``max_positive``, ``max_negative``); labels of held-out rows are never
read.  Scoring covers all windows of whole texts and is one Arrow pass without
a shuffle.

Defined results: a null, empty or wordless text is one empty window and gets
the score of that; equal texts get equal scores; one very long text is walked
in bounded blocks of windows; labels with a null id or value are left out;
without both classes in the training rows every score is the share of
positives (0 without rows); the input row travels in the struct ``doc`` so
that column names cannot clash; rows that repeat an id are rows like others;
an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.staging import small_arrow_batches
from quarry.llm.textkit import slices, string_buffers, word_hashes

WINDOW, STRIDE = 32, 24
WORD_DIM = CHAR_DIM = 12
HIDDEN = 10
VOCABULARY, GRAMS = 4096, 8192
GRAM_SIZES = (3, 5)
#: The score from which on a text counts as toxic, and how far calibration may move the text layer's log odds to it.
CUT, MOST_OFFSET = 0.7, 2.0
_F = np.float32

_TOKEN = np.zeros(256, bool)
_TOKEN[0x30:0x3A] = _TOKEN[0x41:0x5B] = _TOKEN[0x61:0x7B] = _TOKEN[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def _tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (ASCII and Latin-1 letters) and the spans of letter and digit runs."""
    data = _FOLD[raw]
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][accented] += 0x20
    ink = _TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[bounds <= len(data)]] = True
    before, after = np.zeros_like(ink), np.zeros_like(ink)
    before[1:] = ink[:-1]
    after[:-1] = ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, bounds)


def _gram_lists(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 20000) -> tuple[np.ndarray, np.ndarray]:
    """CSR lists of hashed byte n-grams of the words, made in blocks and kept in two bytes each."""
    first, grams = [np.zeros(1, np.int64)], [np.zeros(0, np.uint16)]
    for at in range(0, len(starts), block):
        own, some = _gram_block(data, starts[at : at + block], ends[at : at + block])
        first.append(own[1:] + first[-1][-1])
        grams.append(some)
    return np.concatenate(first), np.concatenate(grams)


def _gram_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of one block of words, with marks at both word ends."""
    lengths = ends - starts
    framed = lengths + 2
    base = np.cumsum(framed) - framed
    total = int(framed.sum())
    text = np.full(total, 1, np.uint32)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[place + np.repeat(base + 1, lengths)] = data[place + np.repeat(starts, lengths)]
    text[base + framed - 1] = 2
    word = np.repeat(np.arange(len(starts)), framed)
    left = np.repeat(base + framed, framed) - np.arange(total)
    owners, grams = [], []
    for size in GRAM_SIZES:
        at = np.flatnonzero(left >= size)
        code = np.full(len(at), np.uint32(size * 40503), np.uint32)
        with np.errstate(over="ignore"):
            for k in range(size):
                code = (code ^ text[at + k]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
        owners.append(word[at])
        grams.append((code % np.uint32(GRAMS)).astype(np.uint16))
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(len(starts) + 1)), gram[order]


def _segment_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive row segments; empty segments are 0."""
    out = np.zeros((len(first) - 1, rows.shape[1]), _F)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(rows, first[full], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * (np.tanh(_F(0.5) * x) + _F(1.0))


def _window_index(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, first window of each text) of all windows; one at least per text."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    firsts = np.concatenate(([0], np.cumsum(count)))
    local = np.arange(firsts[-1]) - np.repeat(firsts[:-1], count)
    begin = np.repeat(first[:-1], count) + local * STRIDE
    return begin, np.minimum(begin + WINDOW, np.repeat(first[1:], count)), firsts


@dataclass
class Network:
    """Parameters by name, the vocabulary (sorted word hashes) and the text-level weights."""

    params: dict[str, np.ndarray]
    vocabulary: np.ndarray
    constant: float | None = None
    text_weights: np.ndarray | None = None
    offset: float = 0.0

    @staticmethod
    def fresh(vocabulary: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(_F)
        p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "gram": draw(GRAMS, CHAR_DIM, scale=0.1)}
        for way in "fb":
            p[f"x{way}"] = draw(3 * HIDDEN, WORD_DIM + CHAR_DIM, scale=0.3)
            p[f"b{way}"] = np.zeros(3 * HIDDEN, _F)
            p[f"u{way}"] = draw(3 * HIDDEN, HIDDEN, scale=0.3)
        p |= {"attend": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, _F)}
        return Network(p, vocabulary)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, ids: np.ndarray, first: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = (1 / np.sqrt(np.maximum(np.diff(first), 1))).astype(_F)[:, None]
        return np.concatenate([self.params["word"][ids], _segment_sums(self.params["gram"][grams], first) * scale], axis=1), scale

    def chunked_logits(self, ids: np.ndarray, gram_first: np.ndarray, grams: np.ndarray, words: np.ndarray, first: np.ndarray, chosen: np.ndarray, chunk: int = 200) -> np.ndarray:
        """The window logits of the chosen texts, ``chunk`` texts at a time."""
        out = [np.zeros(0, _F)]
        for at in range(0, len(chosen), chunk):
            spans = [words[first[t] : first[t + 1]] for t in chosen[at : at + chunk]]
            begin, end, _ = _window_index(np.cumsum([0, *map(len, spans)]))
            own, local = np.unique(np.concatenate(spans), return_inverse=True)
            counts = np.diff(gram_first)[own]
            heads = np.concatenate(([0], np.cumsum(counts)))
            some = grams[np.arange(heads[-1]) - np.repeat(heads[:-1], counts) + np.repeat(gram_first[own], counts)]
            out.append(self.window_logits(self.gates(ids[own], heads, some), local, begin, end))
        return np.concatenate(out)

    def gates(self, ids: np.ndarray, first: np.ndarray, grams: np.ndarray, block: int = 20000) -> dict[str, np.ndarray]:
        """``project`` of the inputs of all words, in blocks that bound what their n-grams take."""
        parts = []
        for at in range(0, max(1, len(ids)), block):
            own = first[at : at + block + 1]
            x, _ = self.inputs(ids[at : at + block], own - own[0], grams[own[0] : own[-1]])
            parts.append(self.project(x))
        return {w: np.concatenate([p[w][:, :-1] for p in parts] + [np.zeros((3 * HIDDEN, 1), _F)], axis=1) for w in "fb"}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of all gates of all words (gates x words), with a zero column for padding."""
        return {w: np.concatenate([self.params[f"x{w}"] @ x.T + self.params[f"b{w}"][:, None], np.zeros((3 * HIDDEN, 1), _F)], axis=1) for w in "fb"}

    def states(self, gates: dict[str, np.ndarray], words: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """(steps, 2 * HIDDEN, windows) of both directions."""
        steps, n = words.shape
        out = np.empty((steps, 2 * HIDDEN, n), _F)
        H = HIDDEN
        for k, way in enumerate("fb"):
            h = np.zeros((H, n), _F)
            u, table = self.params[f"u{way}"], gates[way]
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                x = np.take(table, words[t], axis=1)
                g = u @ h
                x[: 2 * H] += g[: 2 * H]
                zr = _sigmoid(x[: 2 * H])
                new = np.tanh(x[2 * H :] + zr[H:] * g[2 * H :])
                if trace is not None:
                    trace[way, t] = (h, zr, new, g[2 * H :])
                h = (new + zr[:H] * (h - new)) * mask[t]
                out[t, k * H : (k + 1) * H] = h
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(attention, pooled states, logits) of windows; a window without words pools to 0."""
        e = np.einsum("thn,h->tn", states, self.params["attend"], optimize=True)
        e = np.where(mask > 0, e, _F(-1e9))
        e = np.exp(e - e.max(axis=0)) * mask
        alpha = e / np.maximum(e.sum(axis=0), _F(1e-9))
        c = np.einsum("thn,tn->hn", states, alpha, optimize=True)
        return alpha, c, self.params["out"] @ c + self.params["bias"][0]

    def window_logits(self, gates: dict[str, np.ndarray], words: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = 2048) -> np.ndarray:
        out = np.empty(len(begin), _F)
        pad = gates["f"].shape[1] - 1
        padded = np.append(words, pad)
        for at in range(0, len(begin), block):
            place = begin[at : at + block] + np.arange(WINDOW)[:, None]
            inside = place < end[at : at + block]
            chosen = padded[np.where(inside, np.minimum(place, len(words)), len(words))]
            mask = inside.astype(_F)
            out[at : at + block] = self.pooled(self.states(gates, chosen, mask), mask)[2]
        return out

    def gradients(self, x: np.ndarray, words: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss, with that of the word inputs ``x``."""
        gates = self.project(x)
        trace: dict = {}
        states = self.states(gates, words, mask, trace)
        alpha, c, logit = self.pooled(states, mask)
        d = ((_sigmoid(logit) - label) / len(label)).astype(_F)
        p, H, out = self.params, HIDDEN, {}
        out["bias"], out["out"] = np.array([d.sum()], _F), c @ d
        dc = p["out"][:, None] * d
        da = np.einsum("thn,hn->tn", states, dc, optimize=True)
        de = alpha * (da - (alpha * da).sum(axis=0))
        out["attend"] = np.einsum("thn,tn->h", states, de, optimize=True)
        ds = alpha[:, None, :] * dc + p["attend"][None, :, None] * de[:, None, :]
        dx = np.zeros_like(x)
        steps, n = words.shape
        flat = words.reshape(-1)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        for k, way in enumerate("fb"):
            u, du = p[f"u{way}"], np.zeros_like(p[f"u{way}"])
            dg = np.empty((steps, 3 * H, n), _F)
            dh = np.zeros((H, n), _F)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                h, zr, new, gn = trace[way, t]
                dh = (dh + ds[t, k * H : (k + 1) * H]) * mask[t]
                z, r = zr[:H], zr[H:]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dn])
                back = np.concatenate([dz, dr, dn * r])
                du += back @ h.T
                dh = dh * z + u.T @ back
            rows = dg.transpose(0, 2, 1).reshape(-1, 3 * H)
            summed = np.add.reduceat(rows[order], heads, axis=0)
            own = ranked[heads] < len(x)
            at, summed = ranked[heads][own], summed[own]
            out[f"u{way}"], out[f"b{way}"] = du, summed.sum(axis=0)
            out[f"x{way}"] = summed.T @ x[at]
            dx[at] += summed @ p[f"x{way}"]
        return out, dx

    def text_scores(self, logits: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return _sigmoid((_text_features(logits, firsts) @ self.text_weights + self.offset).astype(_F)).astype(np.float64)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        raw_all, bounds_all = string_buffers(column)
        out = np.empty(len(column))
        for at, to in slices(bounds_all, 2 << 20):
            raw, bounds = raw_all[bounds_all[at] : bounds_all[to]], bounds_all[at : to + 1] - bounds_all[at]
            data, starts, ends, first = _tokens(raw, bounds)
            hashes, which, words = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
            gates = self.gates(self.word_ids(hashes), *_gram_lists(data, starts[which], ends[which]))
            begin, end, firsts = _window_index(first)
            out[at:to] = self.text_scores(self.window_logits(gates, words, begin, end), firsts)
        return out


def _text_features(logits: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    n = np.diff(firsts).astype(np.float64)
    prob = _sigmoid(logits).astype(np.float64)
    total = np.add.reduceat(prob, firsts[:-1]) if len(n) else n
    sure = np.add.reduceat((prob > 0.5).astype(np.float64), firsts[:-1]) if len(n) else n
    top = np.maximum.reduceat(logits, firsts[:-1]).astype(np.float64) if len(n) else n
    return np.stack([np.ones(len(n)), top, np.log1p(total), total / np.maximum(n, 1), sure / np.maximum(n, 1), np.log(np.maximum(n, 1))], axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1]) * max(1.0, len(y) / 1000)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - y) + penalty @ w
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _draw_odds(firsts: np.ndarray, window_text: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Running odds of a pool's windows: a window weighs one over the root of its text's windows."""
    odds = np.cumsum(1 / np.sqrt(np.diff(firsts)[window_text[pool]]))
    return odds / odds[-1]


def _log_odds(feature: np.ndarray, text_of: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of a feature's texts being toxic against the share of toxic texts."""
    seen = np.unique(feature * np.int64(len(labels)) + text_of)
    toxic = labels[seen % len(labels)]
    p, n = (np.bincount(seen[toxic == k] // len(labels), minlength=size) for k in (1, 0))
    return (np.log((p + 0.5) / (labels.sum() + 1)) - np.log((n + 0.5) / ((1 - labels).sum() + 1))).astype(_F)


def train(texts: list[str], labels: np.ndarray, steps: int = 700, batch: int = 256, rate: float = 0.01, decay: float = 0.2, seed: int = 11) -> Network:
    """Fit the network on all texts, with the text layer that a network of three quarters of them gets from the rest."""
    first = _train(texts, labels, True, steps, batch, rate, decay, seed)
    if first.constant is not None:
        return first
    net = _train(texts, labels, False, steps, batch, rate, decay, seed + 1)
    net.text_weights, net.offset = first.text_weights, first.offset
    return net


def _train(texts: list[str], labels: np.ndarray, validate: bool, steps: int, batch: int, rate: float, decay: float, seed: int) -> Network:
    """Fit a network; with ``validate`` on three quarters of the texts, and its text layer on the rest (on all, if that is small)."""
    labels = np.asarray(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        return Network({}, np.zeros(0, np.uint64), constant=float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    raw, bounds = string_buffers(pa.array(texts, pa.large_string()))
    data, starts, ends, first = _tokens(raw, bounds)
    hashes, which, words = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
    gram_first, grams = _gram_lists(data, starts[which], ends[which])
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = np.unique(words * np.int64(len(texts)) + text_of)
    del text_of
    spread = np.bincount(pairs // len(texts), minlength=len(hashes))
    common = np.argsort(-spread, kind="stable")[:VOCABULARY]
    net = Network.fresh(np.sort(hashes[common[spread[common] >= 5]]), seed)
    ids = net.word_ids(hashes)
    net.params["word"][:, 0] = _F(0.2) * _log_odds(ids[pairs // len(texts)], pairs % len(texts), labels, len(net.vocabulary) + 1)
    net.params["word"][0, 0] = 0
    begin, end, firsts = _window_index(first)
    window_text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    held = rng.random(len(texts)) < (0.25 if validate else 0.0)
    pools = [np.flatnonzero((labels[window_text] == k) & ~held[window_text]) for k in (0, 1)]
    if not len(pools[0]) or not len(pools[1]):
        pools = [np.flatnonzero(labels[window_text] == k) for k in (0, 1)]
    sums = [_draw_odds(firsts, window_text, p) for p in pools]
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.params.items()}
    for step in range(1, steps + 1):
        if step in (steps // 3, 2 * steps // 3):
            # Of a toxic text only some windows are; from here on those count that the network finds most so.
            toxic = np.flatnonzero(labels == 1)
            found = np.full(len(begin), -np.inf, _F)
            found[labels[window_text] == 1] = net.chunked_logits(ids, gram_first, grams, words, first, toxic)
            top = np.maximum.reduceat(found, firsts[:-1])[window_text]
            sure = pools[1][found[pools[1]] >= top[pools[1]] - 1.5]
            sums[1], pools[1] = _draw_odds(firsts, window_text, sure), sure
        picks = np.concatenate([pools[k][np.minimum(np.searchsorted(sums[k], rng.random(m)), len(pools[k]) - 1)] for k, m in ((0, batch - batch // 3), (1, batch // 3))])
        place = begin[picks] + np.arange(WINDOW)[:, None]
        inside = place < end[picks]
        chosen = words[np.where(inside, np.minimum(place, len(words) - 1), 0)]
        own = np.unique(chosen[inside])
        local = np.where(inside, np.searchsorted(own, chosen), len(own))
        counts = np.diff(gram_first)[own]
        own_first = np.concatenate(([0], np.cumsum(counts)))
        own_grams = grams[np.arange(own_first[-1]) - np.repeat(own_first[:-1], counts) + np.repeat(gram_first[own], counts)]
        # Some known words are shown as unknown, so that characters have to carry them too.
        shown = np.where(rng.random(len(own)) < 0.15, 0, ids[own])
        x, scale = net.inputs(shown, own_first, own_grams)
        grad, dx = net.gradients(x, local, inside.astype(_F), labels[window_text[picks]].astype(_F))
        for name, at, rows in (("word", shown, dx[:, :WORD_DIM]), ("gram", own_grams, np.repeat(dx[:, WORD_DIM:] * scale, counts, axis=0))):
            order = np.argsort(at, kind="stable")
            ranked = at[order]
            heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
            grad[name] = np.zeros_like(net.params[name])
            if len(heads):
                grad[name][ranked[heads]] = np.add.reduceat(rows[order], heads, axis=0)
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for name, g in grad.items():
            if name in ("word", "gram"):
                net.params[name] *= _F(1 - now * decay)
            m, v = moments[name]
            m *= _F(0.9)
            m += _F(0.1) * g
            v *= _F(0.999)
            v += _F(0.001) * g * g
            net.params[name] -= _F(now) * (m / _F(1 - 0.9**step)) / (np.sqrt(v / _F(1 - 0.999**step)) + _F(1e-7))
    if not validate:
        return net
    features = _text_features(net.chunked_logits(ids, gram_first, grams, words, first, np.arange(len(texts))), firsts)
    weigh = held if 4 <= labels[held].sum() <= held.sum() - 4 else np.ones(len(texts), bool)
    net.text_weights = _fit_logistic(features[weigh], labels[weigh])
    net.offset = _offset(features[weigh] @ net.text_weights, labels[weigh])
    return net


def _offset(z: np.ndarray, y: np.ndarray) -> float:
    """What moves the cut with the best F1 of validation texts to a score of ``CUT``; by at most ``MOST_OFFSET`` either way."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    cut = (z[order][best] + z[order][min(best + 1, len(y) - 1)]) / 2
    return float(np.clip(np.log(CUT / (1 - CUT)) - cut, -MOST_OFFSET, MOST_OFFSET))


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", max_positive: int = 1500, max_negative: int = 3000, steps: int = 700) -> Network:
    """Train on at most ``max_positive`` + ``max_negative`` rows that are not held out, by hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = lambda value, n: usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = ranked(1, max_positive).unionByName(ranked(0, max_negative))
    # The two limits bound the broadcast side.
    rows = docs.select("doc_id", docs[text].alias("_text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        net = train([r["_text"] or "" for r in own], np.array([r["toxic"] for r in own], np.int64), steps=steps)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # One task: its rows are bounded by the two limits, and a worker's numpy uses one thread.
    found = rows.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(found[0].net) if found else train([], np.zeros(0, np.int64))


def score_toxicity(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc struct of ``keep`` or all columns, score) for every row of ``docs``."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a few hundred kB, whatever the corpus
    packed = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("doc"), docs[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], names=["doc", "score"])

    schema = T.StructType([T.StructField("doc", packed.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, schema)
