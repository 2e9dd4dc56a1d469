import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from docsql.llm import toxicity
from docsql.llm.common import text_buffer, word_spans

from .data import COLUMNS, documents, table


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(6)
    bad = ["zorgal", "zorgalet", "murk", "murkist"]
    rows, labels = [], []
    for i in range(2000):
        words = [rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice("lmnrst") * rnd.randint(1, 3) for _ in range(rnd.randint(5, 220))]
        y = int(i % 4 == 0)
        for _ in range(1 + len(words) // 40 if y else 0):
            words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", "s", "en"])
        rows.append((i, " ".join(words), "en", "s", 0, 0, "", ""))
        labels.append((i, y))
    return rows, labels


def test_gradients():
    rnd = np.random.default_rng(1)
    net = toxicity.Network(np.zeros(0, np.uint64))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    tables = [rnd.normal(size=(9, 3 * toxicity.HIDDEN)) for _ in "fb"]
    words = rnd.integers(0, 9, (5, 7))
    mask = np.arange(7) < np.array([7, 3, 1, 5, 7])[:, None]
    tape = {}
    net.forward(tables, words, mask, tape)
    pull = rnd.normal(size=5)
    grad, d_tables = net.backward(pull, tables, words, mask, tape)
    loss = lambda: float((net.forward(tables, words, mask) * pull).sum())
    for array, g in [(net.w[k], grad[k]) for k in grad] + list(zip(tables, d_tables, strict=True)):
        for at in [tuple(rnd.integers(0, n) for n in array.shape) for _ in range(6)]:
            old = array[at]
            array[at] = old + 1e-4
            up = loss()
            array[at] = old - 1e-4
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-4 - g[at]) < 2e-3 * max(1, abs(g[at]))


def plain_logit(net, words):
    """A window's logit, word by word and number by number: inputs, both gated layers, attention, output."""
    hashes = lambda w: toxicity._hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    w, k = net.w, toxicity.HIDDEN
    xs = []
    for word in words:
        number = next((i + 1 for i, h in enumerate(net.vocabulary) if h == hashes(word)[0]), 0)
        buckets = toxicity.grams(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0].tolist()
        x = np.zeros(toxicity._INPUTS)
        x[: toxicity.EMBED] = w["word"][number]
        x[2 * toxicity.EMBED] = net.odds[0][number]
        if buckets:
            x[toxicity.EMBED : 2 * toxicity.EMBED] = sum(w["char"][b >> (toxicity.FINE_BITS - toxicity.BUCKET_BITS)].astype(float) for b in buckets) / len(buckets) ** 0.5
            x[2 * toxicity.EMBED + 1] = max(net.odds[1][b] for b in buckets)
        xs.append(x)
    states = [[None, None] for _ in words]
    for side, d in enumerate("fb"):
        h = np.zeros(k)
        for t in range(len(words)) if d == "f" else reversed(range(len(words))):
            x, g = xs[t] @ w[f"in{d}"] + w[f"bias{d}"], h @ w[f"re{d}"]
            z, r = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
            h = (1 - z) * np.tanh(x[2 * k :] + r * g[2 * k :]) + z * h
            states[t][side] = h
    rows = [np.concatenate(s) for s in states]
    score = [float(np.tanh(s @ w["attend"]) @ w["query"]) for s in rows]
    weight = np.exp(np.array(score) - max(score))
    return float(sum(a * s for a, s in zip(weight / weight.sum(), rows, strict=True)) @ w["out"] + w["off"][0])


def test_all_windows_equal_plain_version():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["Ab", "cd", "é", "fghij", "k1", "unseen" + str(rnd.randrange(9))]) for _ in range(n)) for n in (1, 5, 63, 64, 65, 130, 300)]
    vocabulary = np.sort(toxicity._hashes(np.frombuffer(b"abcdk1", np.uint8), np.array([0, 2, 4]), np.array([2, 4, 6])))
    net = toxicity.Network(vocabulary, seed=5)
    draw = np.random.default_rng(6)
    net.odds = tuple(draw.random(len(o)).astype(np.float32) for o in net.odds)
    net.w["off"] += 0.3
    data, off = text_buffer(pa.array(texts))
    text, z = net.logits(data, off)
    for i, t in enumerate(texts):
        words = [w.lower().encode() for w in t.split()]
        begins = sorted({min(s, max(len(words) - toxicity.LENGTH, 0)) for s in range(0, max(len(words) - toxicity.LENGTH, 0) + toxicity.STRIDE, toxicity.STRIDE)})
        want = [plain_logit(net, words[b : b + toxicity.LENGTH]) for b in begins]
        assert z[text == i].tolist() == pytest.approx(want, abs=1e-4)
    net.last = np.array([0.1, 0.7, -0.4, 0.2, 0.05])
    for i, s in enumerate(net.scores(pa.array(texts)).tolist()):
        mine = z[text == i].astype(float)
        x = [1, max(mine), np.mean(mine), 4 * np.mean(1 / (1 + np.exp(-mine))), np.log(len(mine))]
        assert s == pytest.approx(1 / (1 + np.exp(-np.dot(x, net.last))), abs=1e-5)


def test_grams_and_windows():
    data, off = text_buffer(pa.array(["Ab é abcdefghij ab"]))
    starts, ends = word_spans(data, off, toxicity.IS_WORD)
    buckets, counts = toxicity.grams(data, starts, ends)
    marked = ["^ab$".encode(), "^é$".encode(), b"^abcdefghij$", b"^ab$"]
    assert counts.tolist() == [sum(max(0, len(m) - k + 1) for k in toxicity.GRAMS) for m in marked]
    assert sorted(buckets[: counts[0]]) == sorted(buckets[-counts[3] :])
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        text, begin = toxicity.windows_of(np.array([n, 3]))
        mine = begin[text == 0]
        assert mine[0] == 0 and (np.diff(mine) <= toxicity.STRIDE).all() and mine[-1] + toxicity.LENGTH >= n and (mine[-1] + toxicity.LENGTH == n or n < toxicity.LENGTH)


def test_whole_table(spark, corpus):
    rows, labels = corpus
    docs, marks = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, marks).collect()
    y = dict(labels)
    assert {r.doc_id for r in got} == set(y) and len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.9 * len(held)
    bad = [r.predicted for r in held if y[r.doc_id]]
    assert len(bad) >= 100 and sum(bad) >= 0.9 * len(bad)
    # Labels of held-out rows change nothing.
    turned = spark.createDataFrame([(i, 1 - v if zlib.crc32(str(i).encode()) % 5 == 0 else v) for i, v in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-6) for r in got)
    kept = toxicity.score(docs, marks, remove=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_odd_rows_and_labels(spark):
    docs = table(spark, documents())
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (4, 0), (5, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks).collect()
    assert len(got) == docs.count() and not any(r.held_out for r in got if r.doc_id is None)
    same = toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len({r.score for r in same}) == 1 and same[0].predicted == 0
    assert toxicity.score(spark.createDataFrame([], COLUMNS), marks).collect() == []
