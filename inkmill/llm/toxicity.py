"""Toxicity by a small bidirectional gated recurrent network, trained here in numpy.

A text is its runs of letters and digits, A-Z lower-cased. A word's input has a word part
and a character part: hashed embeddings of the word and of its character trigrams, both
trained, and how much more often the word, and its most and its average telling trigram,
are in toxic texts than in others, counted on the training texts. Two gated recurrent
layers read a window of words forwards and backwards, attention pools their states, and a
logistic unit scores the window. Windows overlap and cover the whole text; the text's
score is a calibrated sum of its worst window, the mean of its worst few and the number
of its windows.

Training texts are labelled as wholes. A toxic text is trained on the window that the
present weights find worst, a clean one on that, on a window at random, or on a word of
such a window over and over, so that faint evidence doesn't add up where words repeat. A
text sees counts that leave itself out, and most embeddings are left out at each step, so
that the network doesn't learn to trust words that it has seen in one text. A fifth of the
labelled texts is kept back from counts and steps: the checkpoint and the calibration with
the least loss there are taken, both labels weighing about the same.

Null texts and texts without a word score 0. Null labels aren't learned from; without
labels of both kinds every score is 0. Repeated rows score alike; where one id has several
texts, each is learned from with the id's label (1 if any of its labels is). Very long
texts are scored whole, by one task. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import documents
from inkmill.llm.words import mix, span_hashes, text_blocks

#: Bound of the training sample: texts of each label, whole ones of any length.
SAMPLE = {1: 600, 0: 2400}
WINDOW, STRIDE = 64, 48
STATES, EMBEDDED = 8, 5
#: Hashed words with a count, and hashed words and trigrams with an embedding (trigrams are counted in the same).
ODDS_BUCKETS, WORD_BUCKETS, CHAR_BUCKETS = 1 << 18, 1 << 14, 1 << 14
#: Share of the clean random windows that are trained on as one of their words over and over.
REPEATED = 0.4
STEPS, BATCH, RATE = 360, 96, 0.01
#: Share of the labelled texts kept back for calibration and for choosing among the checkpoints, steps between these, weight of the smoothing of
#: counts, chance that a word's or character's trained embedding is left out in training, and share of the embeddings that decays a step.
KEPT_BACK, CHECK_EVERY, SMOOTH, DROPPED, DECAY = 0.2, 60, 2.0, 0.85, 0.002
THRESHOLD = 0.7
#: Worst windows whose mean the calibration sees, and how much more the clean texts weigh there than the toxic ones.
TOP, TILT = 5, 1.5
PRIOR = (0.4, 0.4, -0.3, 0.0)
#: Windows scored and words described at once, and words whose inputs a task keeps.
WINDOWS_AT_ONCE, WORDS_AT_ONCE = 2048, 20_000
CACHE_WORDS = 150_000
#: Text is worked on in blocks of about so many bytes.
BLOCK_BYTES = 512 << 10

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def letter_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the first word of each row and the end."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _INSIDE[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[starts] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)


def _trigrams(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of each word, one around each byte, and where each word's begin."""
    size = end - begin
    at = np.concatenate(([0], np.cumsum(size)))
    place = np.repeat(begin - at[:-1], size) + np.arange(at[-1])
    before, here, after = (_LOWER[raw[np.clip(place + k, 0, len(raw) - 1)]].astype(np.uint64) for k in (-1, 0, 1))
    before[at[:-1]] = 0
    after[at[1:] - 1] = 0
    return (mix(before << np.uint64(16) | here << np.uint64(8) | after) % np.uint64(CHAR_BUCKETS)).astype(np.int64), at


@dataclass
class Network:
    """The trained weights; input channels are the three counted ones, then the embedded ones."""

    word_odds: np.ndarray
    char_odds: np.ndarray
    words: np.ndarray
    chars: np.ndarray
    inputs: np.ndarray  # direction x gate (update, reset, candidate) x channel x state
    states: np.ndarray  # direction x gate x state x state
    bias: np.ndarray  # direction x gate x state
    attention: np.ndarray
    output: np.ndarray
    scale: tuple  # output bias, and the calibration: weights of what _summary gives, and their bias

    def channels(self, keys: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        odds = self.char_odds[grams]
        n = np.diff(at)[:, None]
        word = (keys % np.uint64(WORD_BUCKETS)).astype(np.int64)
        counted = np.stack([self.word_odds[(keys % np.uint64(ODDS_BUCKETS)).astype(np.int64)], np.maximum.reduceat(odds, at[:-1]), np.add.reduceat(odds, at[:-1]) / n[:, 0]], axis=1)
        return np.concatenate([counted, self.words[word] + np.add.reduceat(self.chars[grams], at[:-1], axis=0) / n], axis=1).astype(np.float32)


    def inputs_of(self, raw: np.ndarray, keys: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The channels of the words, some at a time."""
        parts = [words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate([self.channels(keys[w], *_trigrams(raw, begin[w], end[w])) for w in parts])


def _gates(x: np.ndarray, h: np.ndarray, net: Network, d: int) -> tuple[np.ndarray, ...]:
    z = 0.5 * np.tanh(0.5 * (x[:, 0] + h @ net.states[d, 0])) + 0.5
    r = 0.5 * np.tanh(0.5 * (x[:, 1] + h @ net.states[d, 1])) + 0.5
    u = h @ net.states[d, 2]
    return z, r, u, np.tanh(x[:, 2] + r * u)


def _read(projected: list[list[np.ndarray]], ids: np.ndarray, net: Network) -> np.ndarray:
    """States of both directions for windows of word numbers, (time, window, 2 x state). projected: by direction and gate, a row a word."""
    time, n = ids.shape
    out = np.zeros((time, n, 2 * STATES), np.float32)
    half = np.float32(0.5)
    for d in (0, 1):
        (pz, pr, pc), (uz, ur, uc) = projected[d], [np.ascontiguousarray(w, np.float32) for w in net.states[d]]
        uz, ur = uz * half, ur * half
        h = np.zeros((n, STATES), np.float32)
        for t in range(time) if d == 0 else range(time - 1, -1, -1):
            now = ids[t]
            z, r = h @ uz, h @ ur
            z += pz[now]
            r += pr[now]
            np.tanh(z, out=z)
            np.tanh(r, out=r)
            z *= half
            z += half
            r *= half
            r += half
            c = h @ uc
            c *= r
            c += pc[now]
            np.tanh(c, out=c)
            h = h - c
            h *= z
            h += c
            out[t, :, d * STATES : (d + 1) * STATES] = h
    return out


def _pool(states: np.ndarray, live: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, pooled state, attention) of each window; live says which places hold a word."""
    a = states @ net.attention
    a = np.where(live, a, -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tns->ns", a, states)
    return pooled @ net.output + net.scale[0], pooled, a


class Scorer:
    """Scores texts with a network; keeps the projected inputs of words it has seen."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        # word 0 fills windows that are shorter; nothing attends to it
        self.projected = [[np.zeros((1, STATES), np.float32) for _ in range(3)] for _ in range(2)]

    def enter(self, x: np.ndarray) -> None:
        """Takes in words with these channels; they get the next numbers."""
        for d in (0, 1):
            for g in (0, 1, 2):
                own = (x @ self.net.inputs[d, g] + self.net.bias[d, g]) * (0.5 if g < 2 else 1.0)
                self.projected[d][g] = np.concatenate([self.projected[d][g], own.astype(np.float32)])

    def numbers(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        keys = span_hashes(raw, begin, end)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        listed = distinct.tolist()
        new = [k for k, x in enumerate(listed) if x not in self.known]
        if new:
            x = self.net.inputs_of(raw, keys, begin, end, first[new])
            self.known.update(zip((listed[k] for k in new), range(len(self.projected[0][0]), len(self.projected[0][0]) + len(new)), strict=True))
            self.enter(x)
        return np.array([self.known[x] for x in listed], np.int64)[back] if listed else np.zeros(0, np.int64)

    def windows(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logit, row) of all windows: each STRIDE words, the last one up to the end of the row."""
        first, row, size = _window_starts(np.diff(at))
        logits = np.zeros(len(first), np.float32)
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(order), WINDOWS_AT_ONCE):
            own = order[k : k + WINDOWS_AT_ONCE]
            steps = np.arange(size[own].max())[:, None]
            live = steps < size[own]
            ids = np.where(live, numbers[np.minimum(at[row[own]] + first[own] + steps, len(numbers) - 1)], 0)
            logits[own] = _pool(_read(self.projected, ids, self.net), live, self.net)[0]
        return logits, row

    def texts(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, raw, starts in text_blocks(column, BLOCK_BYTES):
            begin, end, at = letter_spans(raw, starts)
            score = np.zeros(len(starts) - 1)
            if len(begin):
                some = np.diff(at) > 0
                score[some] = _logistic(_summary(*self.windows(self.numbers(raw, begin, end), at), len(some))[some] @ self.net.scale[1])
            out.append(score)
        return np.concatenate(out) if out else np.zeros(0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _summary(logits: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """What the calibration sees of each of n rows: the logit of the worst window, the mean of the worst TOP (or all, if fewer), the logarithm of their number, and 1."""
    order = np.lexsort((-logits, row))
    at = np.searchsorted(row[order], np.arange(n + 1))
    count = np.diff(at)
    place = at[:-1, None] + np.arange(TOP)
    held = np.arange(TOP) < count[:, None]
    top = np.where(held, np.clip(logits[order], -30, 30)[np.minimum(place, max(0, len(order) - 1))] if len(order) else 0.0, 0.0)
    return np.stack([top[:, 0], top.sum(axis=1) / np.maximum(1, held.sum(axis=1)), np.log(np.maximum(1, count)), np.ones(n)], axis=1)


def _window_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, row, words) of each window of rows of n words."""
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * STRIDE, np.maximum(0, n[row] - WINDOW))
    return first, row, np.minimum(WINDOW, n[row])


def _odds(parts: Iterator[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, counted: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of how much more often each bucket is in toxic rows, near 0 where it is rare; and the same as a row of each label sees it, which doesn't count itself.

    parts: (bucket, row) of whole rows; counted: which rows count.
    """
    seen = np.zeros((2, size))
    for buckets, row in parts:
        pairs = np.unique(row * size + buckets.astype(np.int64))
        pairs = pairs[counted[pairs // size]]
        for k in (0, 1):
            seen[k] += np.bincount(pairs[toxic[pairs // size] == k] % size, minlength=size)
    ratio = max(1, (counted & (toxic == 1)).sum()) / max(1, (counted & (toxic == 0)).sum())
    of = lambda good, bad: np.log((bad + SMOOTH * ratio) / (good + SMOOTH) / ratio).astype(np.float32)
    return of(*seen), np.stack([of(np.maximum(seen[0] - 1, 0), seen[1]), of(seen[0], np.maximum(seen[1] - 1, 0))])


def _words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Bytes of all texts, where their words begin and end, the first word of each text and the end, and the words' hashes; block by block."""
    raws, begins, ends, ats, keys, done, words = [], [], [], [np.zeros(1, np.int64)], [], 0, 0
    for _, _, raw, starts in text_blocks(pa.array(texts, pa.string())):
        begin, end, at = letter_spans(raw, starts)
        raws.append(raw), begins.append((begin + done).astype(np.int32)), ends.append((end + done).astype(np.int32)), ats.append(at[1:] + words), keys.append(span_hashes(raw, begin, end))
        done, words = done + len(raw), words + len(begin)
    return tuple(np.concatenate(x) for x in (raws, begins, ends, ats, keys))


def train(texts: list[str], toxic: list[int], seed: int = 5) -> Network | None:
    """A network from whole texts with labels 1 and 0; None without both kinds."""
    label = np.array(toxic, np.int64)
    if not (label == 1).any() or not (label == 0).any():
        return None
    rng = np.random.default_rng(seed)
    raw, begin, end, at, keys = _words_of(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    back = np.zeros(len(texts), bool)
    for k in (0, 1):
        own = rng.permutation(np.flatnonzero((label == k) & (np.diff(at) > 0)))
        back[own[: int(KEPT_BACK * len(own))]] = True
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    number = number.astype(np.int32)
    size = end[first] - begin[first]
    gram_at = np.concatenate(([0], np.cumsum(size)))
    grams = np.concatenate([_trigrams(raw, begin[w], end[w])[0].astype(np.uint16) for k in range(0, len(first), WORDS_AT_ONCE) for w in [first[k : k + WORDS_AT_ONCE]]])
    bucket = (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64)

    counter = (distinct % np.uint64(ODDS_BUCKETS)).astype(np.int64)

    def word_parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield counter[number], row

    def gram_parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(texts), 100):  # texts at a time, as a word has many trigrams
            span = slice(at[k], at[min(k + 100, len(texts))])
            pairs = np.unique(row[span] * len(distinct) + number[span])
            used = pairs % len(distinct)
            yield grams[np.repeat(gram_at[used] - np.cumsum(size[used]) + size[used], size[used]) + np.arange(size[used].sum())], np.repeat(pairs // len(distinct), size[used])

    channels, small = 3 + EMBEDDED, lambda *s: rng.normal(0, 0.3, s)
    (word_odds, seen_words), (char_odds, seen_chars) = _odds(word_parts(), label, ~back, ODDS_BUCKETS), _odds(gram_parts(), label, ~back, CHAR_BUCKETS)
    net = Network(
        word_odds, char_odds, rng.normal(0, 0.05, (WORD_BUCKETS, EMBEDDED)), rng.normal(0, 0.05, (CHAR_BUCKETS, EMBEDDED)),
        small(2, 3, channels, STATES), small(2, 3, STATES, STATES), np.zeros((2, 3, STATES)), small(2 * STATES), small(2 * STATES), (0.0, None),
    )
    starts_of, window_row, window_size = _window_starts(np.diff(at))
    by_row = np.searchsorted(window_row, np.arange(len(texts) + 1))
    has = np.flatnonzero(np.diff(by_row))
    # at first the worst window is that with the most telling word
    x = net.inputs_of(raw, keys, begin, end, first)
    told = np.concatenate((x[number, :2].sum(axis=1), np.zeros(WINDOW)))
    logits = np.full(len(starts_of), -9.0)
    for k in range(WINDOW):
        logits = np.maximum(logits, np.where(k < window_size, told[np.minimum(at[window_row] + starts_of + k, len(told) - 1)], -9))
    params = {"words": net.words, "chars": net.chars, "inputs": net.inputs, "states": net.states, "bias": net.bias, "attention": net.attention, "output": net.output, "b0": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    fit = has[~back[has]]
    judged = has[back[has]] if back.any() else has
    best = (np.inf, None, None)
    for step in range(STEPS):
        if step and step % CHECK_EVERY == 0:
            logits, best = _checked(net, params, raw, begin, end, keys, first, number, at, label, judged, best)
        half = BATCH // 2
        rows = np.concatenate([rng.choice(fit[label[fit] == k], half) for k in (1, 0) if (label[fit] == k).any()])
        worst = np.array([by_row[r] + int(np.argmax(logits[by_row[r] : by_row[r + 1]])) for r in rows])
        chance = np.array([rng.integers(by_row[r], by_row[r + 1]) for r in rows])
        chosen = np.where((label[rows] == 1) | (rng.random(len(rows)) < 0.5), worst, chance)
        same = (label[rows] == 0) & (chosen == chance) & (rng.random(len(rows)) < REPEATED)
        grads = _gradients(net, params, number, at, starts_of[chosen], window_row[chosen], window_size[chosen], label[rows], same, bucket, counter, grams, gram_at, size, (seen_words, seen_chars, rng))
        rate = RATE * (1.0 if step < STEPS // 2 else 0.4)
        for k, g in grads.items():
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            params[k] -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-7)
        for k in ("words", "chars"):
            params[k] *= 1 - DECAY
    _, (_, kept, net.scale) = _checked(net, params, raw, begin, end, keys, first, number, at, label, judged, best)
    for k, v in kept.items():
        if k != "b0":
            setattr(net, k, v)
    return net


def _checked(net, params, raw, begin, end, keys, first, number, at, label, judged, best):
    """The logits of all windows under the present weights, and these weights with their calibration if they have the least loss on the judged texts so far."""
    net.scale = (float(params["b0"][0]), None)
    scorer = Scorer(net)
    scorer.enter(net.inputs_of(raw, keys, begin, end, first))
    logits, window_of = scorer.windows(number + 1, at)
    loss, weights = _calibrated(_summary(logits, window_of, len(label))[judged], label[judged])
    if loss < best[0]:
        best = (loss, {k: v.copy() for k, v in params.items()}, (net.scale[0], weights))
    return logits, best


def _calibrated(x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """The least cross entropy of a logistic fit to x in which both labels weigh the same (TILT times as much for 0), and its weights.

    A ridge, the stronger the fewer toxic texts there are, draws all weights but the bias to PRIOR; those of logits aren't below 0.
    """
    n = np.array([(label == 0).sum() / TILT, (label == 1).sum()])
    share, w = (1 / np.maximum(n, 1))[label], np.array(PRIOR)
    y, ridge = np.where(label == 1, 0.99, 0.01), np.diag([1.0, 1.0, 1.0, 0.0]) * 2 / (n[1] + 1)
    for _ in range(60):
        p = _logistic(x @ w)
        slope = x.T @ (share * (y - p)) - ridge @ (w - PRIOR)
        w = w + np.linalg.solve((x * (share * np.maximum(p * (1 - p), 0.01))[:, None]).T @ x + ridge + 1e-6 * np.eye(4), slope).clip(-0.5, 0.5)
        w[:2] = np.maximum(w[:2], 0)
    p = np.clip(_logistic(x @ w), 1e-9, 1 - 1e-9)
    return float(-(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), w


def _gradients(net, params, number, at, first, row, size, label, same, bucket, counter, grams, gram_at, gram_n, seen=None) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over windows, by back-propagation through time. seen: counts as a row of each label sees them, and a source of chance for dropping embeddings."""
    n, time = len(first), int(size.max())
    live = np.arange(time)[:, None] < size
    ids = np.where(live, number[np.minimum(at[row] + first + np.arange(time)[:, None], len(number) - 1)], 0)
    ids[:, same] = ids[size[same] // 2, np.flatnonzero(same)]
    # a word is looked up once for each label of the windows that hold it
    flat, back = np.unique(ids * 2 + label, return_inverse=True)
    back, of = back.reshape(ids.shape), flat & 1
    flat = flat >> 1
    spread = np.repeat(np.arange(len(flat)), gram_n[flat])
    own = grams[np.repeat(gram_at[flat] - np.cumsum(gram_n[flat]) + gram_n[flat], gram_n[flat]) + np.arange(gram_n[flat].sum())]
    own_at = np.concatenate(([0], np.cumsum(gram_n[flat])))[:-1]
    odds, told = (net.char_odds[own], net.word_odds[counter[flat]]) if seen is None else (seen[1][of[spread], own], seen[0][of, counter[flat]])
    kept_in = np.ones(len(flat)) if seen is None else (seen[2].random(len(flat)) >= DROPPED) / (1 - DROPPED)
    mean = np.add.reduceat(net.chars[own], own_at, axis=0) / gram_n[flat][:, None]
    table = np.concatenate([np.stack([told, np.maximum.reduceat(odds, own_at), np.add.reduceat(odds, own_at) / gram_n[flat]], axis=1), (net.words[bucket[flat]] + mean) * kept_in[:, None]], axis=1)
    x = table[back] * live[:, :, None]
    grads = {k: np.zeros_like(v) for k, v in params.items()}
    states, kept = np.zeros((time, n, 2 * STATES)), [[None] * time for _ in range(2)]
    for d in (0, 1):
        h = np.zeros((n, STATES))
        projected = np.einsum("tnc,gcs->tngs", x, net.inputs[d]) + net.bias[d]
        projected *= live[:, :, None, None]  # as word 0 in scoring
        for t in range(time) if d == 0 else range(time - 1, -1, -1):
            z, r, u, c = _gates(projected[t], h, net, d)
            kept[d][t] = (h, z, r, u, c)
            h = c + z * (h - c)
            states[t, :, d * STATES : (d + 1) * STATES] = h
    net.scale = (float(params["b0"][0]), None)
    logit, pooled, a = _pool(states, live, net)
    dlogit = (1 / (1 + np.exp(-logit)) - label) / n
    grads["output"] += pooled.T @ dlogit
    grads["b0"] += dlogit.sum()
    dpooled = dlogit[:, None] * net.output
    da = np.einsum("tns,ns->tn", states, dpooled)
    da = a * (da - (a * da).sum(axis=0))
    grads["attention"] += np.einsum("tn,tns->s", da, states)
    dstates = a[:, :, None] * dpooled + da[:, :, None] * net.attention
    dx = np.zeros_like(x)
    for d in (0, 1):
        dh = np.zeros((n, STATES))
        for t in range(time - 1, -1, -1) if d == 0 else range(time):
            h, z, r, u, c = kept[d][t]
            dh = dh + dstates[t, :, d * STATES : (d + 1) * STATES]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            gates = np.stack([dz, dr, dc], axis=1)
            grads["states"][d, 0] += h.T @ dz
            grads["states"][d, 1] += h.T @ dr
            grads["states"][d, 2] += h.T @ (dc * r)
            dh = dh * z + dz @ net.states[d, 0].T + dr @ net.states[d, 1].T + (dc * r) @ net.states[d, 2].T
            gates *= live[t][:, None, None]
            grads["inputs"][d] += np.einsum("nc,ngs->gcs", x[t], gates)
            grads["bias"][d] += gates.sum(axis=0)
            dx[t] += np.einsum("ngs,gcs->nc", gates, net.inputs[d])
    by_word = np.zeros((len(flat), EMBEDDED))
    np.add.at(by_word, back.ravel(), (dx * live[:, :, None])[:, :, 3:].reshape(-1, EMBEDDED))
    by_word *= kept_in[:, None]
    np.add.at(grads["words"], bucket[flat], by_word)
    np.add.at(grads["chars"], own, (by_word / gram_n[flat][:, None])[spread])
    return grads


def fold(folds: int = 3) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Network | None:
    """A network from a bounded sample of the labelled rows; which are taken depends on a hash of the id only."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = {}
    for kind, n in (sample or SAMPLE).items():
        ids |= {r["doc_id"]: kind for r in marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()}
    if not ids:
        return None
    sample = docs.where(F.col("doc_id").isin(list(ids)) & F.col("text").isNotNull()).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        net = train([t for _, t in rows], [ids[i] for i, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # the sample is bounded, and one task trains, so that the driver holds neither texts nor the training's arrays
    return pickle.loads(sample.repartition(1).mapInArrow(run, "net binary").first()["net"])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value is not None else None
        for batch in batches:
            values = scorer.texts(batch.column(1)) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def learned(docs: DataFrame, labels: DataFrame) -> Network | None:
    return learn(docs.where(fold() != 1), labels.where(fold() != 1))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with all columns. Rows of one id go together, and so do those without id."""
    gone = score(docs, learned(docs, labels)).where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias("gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each row of documents, learned from the labels outside fold 1 of 3."""
    docs = documents(spark, sf_dir)
    scored = score(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
