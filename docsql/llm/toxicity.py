"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is a sequence of words (runs of ASCII letters and digits and of bytes from 0x80, A-Z lower-cased). A word's
input is its word embedding, the sum of its hashed character n-grams' embeddings, and two fixed numbers from the
fitting sample: the log odds of the word and the largest log odds of its n-grams. Two gated recurrent layers read each window forwards and backwards, attention pools their states, and a linear layer gives the window's logit.
All overlapping windows of a text are scored; a logistic layer turns their logits' maximum, mean and spread into
the text's score. Labels, language, source and ids are inputs of no score.

The network is fitted on a bounded sample of labelled rows (POSITIVE, NEGATIVE rows, WINDOWS windows of each), and the
logistic layer on whole texts of a part of these rows that the network has not seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.common import LOWER, drop, field_ddl, groups_of, materialize, slices, text_buffer, tidied, word_spans
from docsql.llm.common import span_hashes as _hashes

#: The fitting sample: labelled rows of either class and windows of each at most.
POSITIVE, NEGATIVE, WINDOWS = 2000, 3000, 8
LENGTH, STRIDE = 64, 48
WORDS, BUCKET_BITS, FINE_BITS, GRAMS = 20_000, 15, 20, (3, 4, 6, 8)
EMBED, HIDDEN, ATTEND = 8, 8, 8
_INPUTS = 2 * EMBED + 2
#: For log odds: times that a word counts in one row at most, times that it must be seen, smoothing, what is chance, and scale.
REPEATS, SEEN, SMOOTH, LEAST, SCALE = 4, 3, 4.0, 1.5, 0.4
EPOCHS, MOST_EPOCHS, STEPS, BATCH, RATE, SEED = 3, 24, 500, 128, 0.01, 7
#: Rate of the embeddings beside the other weights', and by how much they shrink with each use.
SLOW, SHRINK = 1.0, 0.01
#: One in so many sampled rows is kept from the network for the logistic layer.
KEPT_BACK = 4
#: Rows with this remainder of crc32(id as text) mod FOLDS are never learned from.
FOLDS, HELD_OUT = 5, 0
IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.frombuffer(LOWER, np.uint8)
_GROUP, _SOME_WORDS = 2 << 20, 8192


# ---------------------------------------------------------------- inputs


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct hash, and each hash's number."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return first, inverse


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the words, with marks at both ends, and how many each word has."""
    n = ends - starts + 2
    first = np.cumsum(n) - n
    text = np.full(int(n.sum()), ord("^"), np.uint8)
    at = np.repeat(starts - first - 1, n) + np.arange(len(text))
    inner = np.ones(len(text), bool)
    inner[first] = inner[first + n - 1] = False
    text[inner] = _LOWER[data[at[inner]]]
    text[first + n - 1] = ord("$")
    left = np.repeat(first + n, n) - np.arange(len(text))  # bytes to the word's end
    word = np.repeat(np.arange(len(n)), n)
    buckets, words = [], []
    wide = np.concatenate([text, np.zeros(max(GRAMS), np.uint8)]).astype(np.uint64)
    code = np.zeros(len(text), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        code = (code << np.uint64(8)) | wide[k - 1 : k - 1 + len(text)]
        if k in GRAMS:
            some = left >= k
            h = (code[some] ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - FINE_BITS))
            words.append(word[some])
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int32), np.bincount(word, minlength=len(n))


def windows_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with n words: the text of each window and its first word, counted from the text's own."""
    more = np.maximum(0, -(-(n - LENGTH) // STRIDE))
    count = 1 + more
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, np.minimum(k * STRIDE, np.maximum(n[text] - LENGTH, 0))


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Weights, forward and backward pass."""

    def __init__(self, vocabulary: np.ndarray, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        draw = lambda *shape: rnd.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.vocabulary = vocabulary  # sorted word hashes; number 0 is any other word
        h = HIDDEN
        self.w = {
            "word": rnd.normal(0, 0.05, (len(vocabulary) + 1, EMBED)).astype(np.float32), "char": rnd.normal(0, 0.05, (1 << BUCKET_BITS, EMBED)).astype(np.float32),
            **{f"{k}{d}": v for d in "fb" for k, v in (("in", draw(_INPUTS, 3 * h)), ("re", draw(h, 3 * h)), ("bias", np.zeros(3 * h, np.float32)))},
            "attend": draw(2 * h, ATTEND), "query": draw(ATTEND), "out": draw(2 * h), "off": np.zeros(1, np.float32),
        }
        self.odds = (np.zeros(len(vocabulary) + 1, np.float32), np.zeros(1 << FINE_BITS, np.float32))  # of words, of n-grams
        self.last = np.zeros(5)  # of the logistic layer over a text's windows

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, numbers: np.ndarray, buckets: np.ndarray, counts: np.ndarray, odds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        words, fine = odds or self.odds
        out = np.zeros((len(numbers), _INPUTS), np.float32)
        out[:, :EMBED] = self.w["word"][numbers]
        out[:, 2 * EMBED] = words[numbers]
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            out[some, EMBED : 2 * EMBED] = np.add.reduceat(self.w["char"][buckets >> (FINE_BITS - BUCKET_BITS)], first, axis=0) / np.sqrt(counts[some, None]).astype(np.float32)
            out[some, 2 * EMBED + 1] = np.maximum.reduceat(fine[buckets], first)
        return out

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.w[f"in{d}"] + self.w[f"bias{d}"] for d in "fb"]

    def _layer(self, d: str, table: np.ndarray, words: np.ndarray, mask: np.ndarray | None, tape: list | None) -> np.ndarray:
        """States (window, word, HIDDEN) of one direction."""
        n, length = words.shape
        h, re, k = np.zeros((n, HIDDEN), np.float32), self.w[f"re{d}"], HIDDEN
        out = np.empty((length, n, HIDDEN), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            x, g = table[words[:, t]], h @ re
            zr = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            new = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
            after = new + z * (h - new)
            if mask is not None:
                after = np.where(mask[:, t, None], after, h)
            if tape is not None:
                tape.append((t, h, z, r, new, g[:, 2 * k :]))
            h = after
            out[t] = h
        return out

    def forward(self, tables: list[np.ndarray], words: np.ndarray, mask: np.ndarray | None, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; words are rows of the tables, mask tells real words from padding."""
        tapes = {d: [] for d in "fb"} if tape is not None else {"f": None, "b": None}
        states = np.concatenate([self._layer(d, t, words, mask, tapes[d]) for d, t in zip("fb", tables, strict=True)], axis=2)
        hidden = np.tanh(states @ self.w["attend"])
        score = hidden @ self.w["query"]
        if mask is not None:
            score = np.where(mask.T, score, np.float32(-30))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if tape is not None:
            tape |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled, "tapes": tapes}
        return pooled @ self.w["out"] + self.w["off"]

    def backward(self, slope: np.ndarray, tables: list[np.ndarray], words: np.ndarray, mask: np.ndarray, tape: dict) -> tuple[dict, list[np.ndarray]]:
        """Gradients of the dense weights, and of the tables."""
        grad = {"out": slope @ tape["pooled"], "off": slope.sum(keepdims=True)}
        pooled = slope[:, None] * self.w["out"]
        states, weight, hidden = tape["states"], tape["weight"], tape["hidden"]
        d_states = weight[:, :, None] * pooled
        d_weight = np.einsum("tnk,nk->tn", states, pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["query"] = np.einsum("tna,tn->a", hidden, d_score)
        d_hidden = d_score[:, :, None] * self.w["query"] * (1 - hidden**2)
        grad["attend"] = np.einsum("tnk,tna->ka", states, d_hidden)
        d_states = d_states + d_hidden @ self.w["attend"].T
        d_tables = []
        k = HIDDEN
        for i, d in enumerate("fb"):
            re, part = self.w[f"re{d}"], d_states[:, :, i * k : (i + 1) * k]
            d_re, d_x = np.zeros_like(re), np.zeros((*words.shape, 3 * k), np.float32)
            carry = np.zeros((len(words), k), np.float32)
            for t, before, z, r, new, g in reversed(tape["tapes"][d]):
                d_h = np.where(mask[:, t, None], carry + part[t], 0)
                d_new = d_h * (1 - z) * (1 - new**2)
                d_g = np.concatenate([d_h * (before - new) * z * (1 - z), d_new * g * r * (1 - r), d_new * r], axis=1)
                d_x[:, t, : 2 * k], d_x[:, t, 2 * k :] = d_g[:, : 2 * k], d_new
                d_re += before.T @ d_g
                carry = np.where(mask[:, t, None], d_h * z + d_g @ re.T, carry + part[t] * 0)
            grad[f"re{d}"] = d_re
            flat, at = d_x.reshape(-1, 3 * k), words.ravel()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
            table = np.zeros_like(tables[i])
            table[at[order][first]] = np.add.reduceat(flat[order], first, axis=0)
            d_tables.append(table)
        return grad, d_tables

    # ---------------------------------------------------------------- whole texts

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of each window and the window's logit, for all windows of all texts."""
        starts, ends = word_spans(data, off, IS_WORD)
        first = np.searchsorted(starts, off)
        hashes = _hashes(data, starts, ends)
        once, number = _distinct(hashes)
        tables = [np.zeros((len(once) + 1, 3 * HIDDEN), np.float32) for _ in "fb"]
        for i in range(0, len(once), _SOME_WORDS):
            some = once[i : i + _SOME_WORDS]
            x = self.inputs(self.word_numbers(hashes[some]), *grams(data, starts[some], ends[some]))
            for table, part in zip(tables, self.project(x), strict=True):
                table[i : i + len(some)] = part
        n = np.diff(first)
        text, begin = windows_of(n)
        begin = begin + first[:-1][text]
        size = np.minimum(n[text], LENGTH)
        out = np.empty(len(text), np.float32)
        number = np.r_[number, np.full(LENGTH, len(once))].astype(np.int64)
        whole = size == LENGTH
        for some in (np.flatnonzero(whole), np.flatnonzero(~whole)[np.argsort(size[~whole], kind="stable")]):
            for i in range(0, len(some), 1024):
                w = some[i : i + 1024]
                longest = max(1, int(size[w].max()))
                step = np.arange(longest)
                mask = None if whole[w[0]] else step < size[w, None]
                words = number[begin[w, None] + step]
                out[w] = self.forward(tables, words if mask is None else np.where(mask, words, len(once)), mask)
        return text, out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.last, -30, 30)))

    def features(self, texts: pa.Array) -> np.ndarray:
        data, off = text_buffer(texts)
        out = np.empty((len(texts), 5))
        for i, j in groups_of(off, _GROUP):
            text, z = self.logits(data[off[i] : off[j]], off[i : j + 1] - off[i])
            out[i:j] = text_features(text, z, j - i)
        return out


def text_features(text: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """Of each text: 1, the largest logit, the mean logit, the mean probability, the logarithm of the windows' number."""
    count = np.maximum(np.bincount(text, minlength=n), 1)
    largest = np.full(n, -30.0)
    np.maximum.at(largest, text, z)
    mean = lambda x: np.bincount(text, x, n) / count
    return np.stack([np.ones(n), np.clip(largest, -12, 12), np.clip(mean(z), -12, 12), 4 * mean(_sigmoid(z)), np.log(count)], axis=1)


# ---------------------------------------------------------------- fitting


def _log_odds(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """By how much the smoothed log odds of things seen so often in rows of label 1 and 0 are beyond chance, else 0."""
    p, q = positive.sum() + 1, negative.sum() + 1
    rate = p / (p + q)
    odds = np.log((positive + SMOOTH * rate) / p) - np.log((negative + SMOOTH * (1 - rate)) / q)
    return np.where(positive + negative >= SEEN, SCALE * np.maximum(odds - LEAST, 0), 0).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Network:
    """A network from texts (some windows of a row, joined) and their labels; its logistic layer is not fitted yet."""
    if len(set(np.asarray(labels).tolist())) < 2:  # one class only: nothing can be told apart
        net = Network(np.zeros(0, np.uint64), seed)
        net.last = np.array([-6.0, 0, 0, 0, 0])
        return net
    rnd = np.random.default_rng(seed)
    order = rnd.permutation(len(texts))
    texts, labels = [texts[i] for i in order], labels[order].astype(np.float32)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    off = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    off[-1] = len(data)
    starts, ends = word_spans(data, off, IS_WORD)
    first = np.searchsorted(starts, off)
    hashes = _hashes(data, starts, ends)
    once, number = _distinct(hashes)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    pair, times = np.unique(row * np.int64(len(once) + 1) + number, return_counts=True)
    in_row, in_word = pair // (len(once) + 1), pair % (len(once) + 1)
    often = np.bincount(in_word, minlength=len(once))
    known = np.flatnonzero(often >= 2)
    known = known[np.argsort(-often[known], kind="stable")[:WORDS]]
    net = Network(np.sort(hashes[once[known]]), seed)
    numbers = net.word_numbers(hashes[once])
    del hashes
    some = [grams(data, starts[once[i : i + _SOME_WORDS]], ends[once[i : i + _SOME_WORDS]]) for i in range(0, len(once), _SOME_WORDS)] or [grams(data, starts, ends)]
    buckets, counts = (np.concatenate(x) for x in zip(*some, strict=True))
    del some
    first_gram = np.cumsum(counts) - counts
    times = np.minimum(times, REPEATS)

    def odds_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of words and n-grams from some rows."""
        mine = rows[in_row]
        by_word = [np.bincount(in_word[mine & (labels[in_row] == y)], times[mine & (labels[in_row] == y)], len(once)) for y in (1, 0)]
        words = _log_odds(*(np.bincount(numbers, x, len(net.vocabulary) + 1) for x in by_word))
        words[0] = 0
        return words, _log_odds(*(np.bincount(buckets, np.repeat(x.astype(np.float32), counts), 1 << FINE_BITS) for x in by_word))

    # What a row is learned with comes from the other half of the rows, as later rows have no part in the odds either.
    half = np.arange(len(texts)) % 2 == 0
    odds = [odds_of(~half), odds_of(half)]
    net.odds = odds_of(np.ones(len(texts), bool))
    del pair, in_row, in_word, times

    text, begin = windows_of(np.diff(first))
    size = np.minimum(np.diff(first)[text], LENGTH)
    begin = begin + first[:-1][text]
    padded = np.r_[number, np.full(LENGTH, len(once))].astype(np.int64)
    train = np.flatnonzero(size > 0)
    share = labels[text[train]].mean() if len(train) else 0.5
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    each_epoch = max(1, sum(-(-int((half[text[train]] == k).sum()) // BATCH) for k in (0, 1)))
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS // each_epoch)))
    step, total = 0, epochs * each_epoch
    for _ in range(epochs):
        batches = [(part, odds[1 - k]) for k in (0, 1) if len(mine := train[half[text[train]] == k]) for part in np.array_split(rnd.permutation(mine), -(-len(mine) // BATCH))]
        for at, seen in [batches[i] for i in rnd.permutation(len(batches))]:
            mask = np.arange(LENGTH) < size[at, None]
            words = np.where(mask, padded[begin[at, None] + np.arange(LENGTH)], len(once))
            used, words = np.unique(words, return_inverse=True)
            words = words.reshape(mask.shape)
            real = used[used < len(once)]
            k = counts[real]
            mine = buckets[np.repeat(first_gram[real] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            x = net.inputs(numbers[real], mine, k, seen)
            if len(real) < len(used):
                x = np.r_[x, np.zeros((1, _INPUTS), np.float32)]
            tables, tape = net.project(x), {}
            z = net.forward(tables, words, mask, tape)
            y = labels[text[at]]
            slope = (_sigmoid(z) - y) * np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / len(at)
            grad, d_tables = net.backward(slope.astype(np.float32), tables, words, mask, tape)
            d_x = np.zeros_like(x)
            for d, table in zip("fb", d_tables, strict=True):
                grad[f"in{d}"], grad[f"bias{d}"] = x.T @ table, table.sum(axis=0)
                d_x += table @ net.w[f"in{d}"].T
            d_x = d_x[: len(real)]
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for name, g in grad.items():
                a, b = m[name]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                net.w[name] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
            each = np.repeat(d_x[:, EMBED : 2 * EMBED] / np.sqrt(np.maximum(k, 1))[:, None], k, axis=0)
            for name, rows, g in (("word", numbers[real], d_x[:, :EMBED]), ("char", mine >> (FINE_BITS - BUCKET_BITS), each)):
                touched, where = np.unique(rows, return_inverse=True)
                sums = np.stack([np.bincount(where, g[:, c], len(touched)) for c in range(EMBED)], axis=1)
                b = m[name][1]
                b[touched] += sums * sums
                net.w[name][touched] *= 1 - SHRINK
                net.w[name][touched] -= (SLOW * rate * sums / (np.sqrt(b[touched]) + 1e-6)).astype(np.float32)
            net.w["word"][0] = 0
    return net


def fit_last(x: np.ndarray, y: np.ndarray, base_rate: float) -> np.ndarray:
    """The logistic layer from texts' features and labels, by Newton's method, with the classes weighted as among all labels."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base_rate = min(max(base_rate, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, base_rate / rate, (1 - base_rate) / (1 - rate))
    centre = np.array([np.log(base_rate / (1 - base_rate)), 0, 0, 0, 0])
    keep = np.array([0.01, 0.5, 0.5, 0.5, 2.0])
    b = centre.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep * (b - centre)
        b = b - np.clip(np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), g), -2, 2)
    return b


# ---------------------------------------------------------------- the operator


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fits on POSITIVE and NEGATIVE labelled rows at most, those with the least hashed ids, and WINDOWS windows of each.

    Of rows that share an id the one with the least text counts. The logistic layer has the whole texts of one in
    KEPT_BACK of these rows (of all, where these lack a class), whose windows are scored in tasks of their own.
    """
    marks = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(f"`{label_col}`").alias("__y"))
    marks = marks.filter(~held_out(F.col("__id")))
    rate = marks.agg(F.avg("__y")).first()[0]
    base_rate = rate if rate is not None else 0.0
    some = [marks.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in ((1, POSITIVE), (0, NEGATIVE))]
    chosen = some[0].union(some[1])
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text")).filter(F.col("__id").isNotNull())
    rows = rows.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.max("__y").cast("int").alias("y"), F.min("__text").alias("text"))
    sample = materialize(rows.select("y", "text", (F.pmod(F.xxhash64("__id", F.lit(SEED)), F.lit(KEPT_BACK)) == 0).alias("back")), "labelled")
    counts = {(r.back, r.y): r.n for r in sample.groupBy("back", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {y for _, y in counts} != {0, 1}:
        drop(sample)
        return fit([], np.zeros(0))
    split = all((back, y) in counts for back in (True, False) for y in (0, 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, off = text_buffer(batch.column(1))
            starts, ends = word_spans(data, off, IS_WORD)
            first = np.searchsorted(starts, off)
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                begin = windows_of(np.array([b - a]))[1]
                rnd = np.random.default_rng(b - a)
                begin = np.sort(rnd.choice(begin, min(WINDOWS, len(begin)), replace=False)) + a
                out.append(b" ".join(data[starts[s] : ends[min(s + LENGTH, b) - 1]].tobytes() for s in begin.tolist() if b > a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "windows"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([w for w, _ in got], np.array([y for _, y in got])))], pa.binary())], ["net"])

    # One task fits the network; the driver gets its weights only, and five numbers of each row for the logistic layer.
    windows = (sample.filter("NOT back") if split else sample).select("y", "text").mapInArrow(tidied(cut), "y int, windows binary").repartition(1)
    net = pickle.loads(bytes(windows.mapInArrow(tidied(learn), "net binary").first().net))
    shared = df.sparkSession.sparkContext.broadcast(net)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.features(batch.column(1)).tolist(), pa.list_(pa.float64()))], ["y", "x"])

    got = sorted((list(r.x), r.y) for r in (sample.filter("back") if split else sample).select("y", "text").mapInArrow(tidied(measure), "y int, x array<double>").collect())
    net.last = fit_last(np.array([x for x, _ in got]), np.array([y for _, y in got], float), base_rate)
    shared.destroy()
    drop(sample)
    return net


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", remove: bool = False) -> DataFrame:
    """One row for each row of df: id, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    With remove, the rows of df that are not predicted 1 instead, with df's columns. Null, empty and wordless texts
    are one window without words. Null ids are never learned from and not held out; an id with several labels
    counts as 1 if any is; other labels than 0 and 1 are void. Without labels of both classes all scores are the same and low.
    Repeated rows are scored one by one; other columns may have any names.
    """
    sc = df.sparkSession.sparkContext
    net = sc.broadcast(train(df, labels, id_col, text_col, label_col))

    if remove:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                yield batch.filter(pa.array(net.value.scores(batch.column(text_col)) < 0.5))

        return df.mapInArrow(tidied(keep), df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            s = net.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    slim = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"), held_out(F.col(f"`{id_col}`")).alias("held_out"))
    return slim.mapInArrow(tidied(run), f"{field_ddl(df, id_col)}, held_out boolean, score double, predicted int")
