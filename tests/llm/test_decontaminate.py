import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from docsql.llm import decontaminate

from .data import COLUMNS, documents, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, note string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for item, text in [x[:2] for x in items]:
            v = words(text)
            k = min(8, len(v))
            windows = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if k else set()
            places = [p for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in windows] if k else []
            if places and item is not None:
                found.add(str(item))
                hit |= {q for p in places for q in range(p, p + k)}
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def items_for(rows):
    long = [r[1].split(" ") for r in rows if r[1] and len(r[1].split(" ")) > 60][:6]
    items = [(i, " ".join(w[5 : 5 + 8 + 7 * i]).upper(), "x") for i, w in enumerate(long)]
    return [*items, (20, "W3 w4", None), (21, "w3! w4", ""), (21, "w7", ""), (22, None, ""), (23, "...", ""), (None, "w1", ""), (24, items[0][1], "")]


def run(df, benchmark, **kw):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(df, benchmark, **kw).collect()]


def test_equals_brute_force(spark):
    rows = documents()
    items = items_for(rows)
    bench = spark.createDataFrame(items, ITEMS)
    want = sorted(brute(rows, items), key=str)
    assert sorted(run(table(spark, rows), bench), key=str) == want
    kept = decontaminate.decontaminate(table(spark, rows), bench, remove=True)
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rows = documents()
    items = items_for(rows)
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    assert len(list(decontaminate.blocks_of(spark.createDataFrame(items, ITEMS), "item_id", "text", 8, 40))) > 3
    assert sorted(run(table(spark, rows), spark.createDataFrame(items, ITEMS)), key=str) == sorted(brute(rows, items), key=str)


def test_more_blocks_than_are_broadcast_at_a_time(spark, monkeypatch):
    rows = documents()
    items = items_for(rows)
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    monkeypatch.setattr(decontaminate, "BLOCKS", 2)
    bench = spark.createDataFrame(items, ITEMS)
    want = sorted(brute(rows, items), key=str)
    assert sorted(run(table(spark, rows), bench), key=str) == want
    kept = decontaminate.decontaminate(table(spark, rows), bench, remove=True, min_items=1)
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[3]), key=str)


def test_words_that_share_a_hash(monkeypatch):
    """Words with one hash are one number to the search; the words themselves decide."""
    real = decontaminate.span_hashes
    monkeypatch.setattr(decontaminate, "span_hashes", lambda *a: real(*a) % np.uint64(3))
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(40)), None) for i in range(40)]
    items = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 9))), None) for i in range(12)]
    block = type("B", (), {"value": decontaminate.TestBlock([(str(i), decontaminate.words_of(t)) for i, t, _ in items], 4)})
    found = decontaminate._verdict(*decontaminate._scan(pa.array([r[1] for r in rows]), pa.nulls(len(rows), pa.binary()), [block]), 2)
    monkeypatch.undo()
    for r, hit, n in zip(rows, found["n_hit"], found["n_items"], strict=True):
        w = words(r[1])
        mine, place = set(), set()
        for i, t, _ in items:
            v = words(t)
            k = min(4, len(v))
            for p in range(len(w) - k + 1):
                if any(w[p : p + k] == v[q : q + k] for q in range(len(v) - k + 1)):
                    mine.add(i)
                    place |= set(range(p, p + k))
        assert (hit, n) == (len(place), len(mine))


def test_longest_of_many_places():
    rnd = random.Random(4)
    items = [(str(i), ("a b c d " + " ".join(rnd.choice("xyz") for _ in range(6))).encode().split()) for i in range(30)]
    block = decontaminate.TestBlock(items, 4)
    text = "q a b c d " + " ".join(rnd.choice("xyz") for _ in range(9))
    seen = decontaminate._scan(pa.array([text]), pa.nulls(1, pa.binary()), [type("B", (), {"value": block})])[1][0]
    tail = text.encode().split()[1:]
    best = max(next((n for n, (x, y) in enumerate(zip(tail, ws, strict=False)) if x != y), min(len(tail), len(ws))) for _, ws in items)
    assert seen.longest[0] == best and seen.longest[1] == 1


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e f g h i j z", "", "", 0, 0, "", "")], COLUMNS)
    bench = spark.createDataFrame([(5, "q a b c d e f g h i j w", ""), (6, "c d e f g h i j", "")], ITEMS)
    (r,) = decontaminate.decontaminate(docs, bench).collect()
    assert (r.longest_match, r.longest_at, r.longest_item, r.n_hit, r.n_items) == (10, 2, "5", 10, 2)


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert not any(r[5] or r[2] for r in run(table(spark, documents()), none))
    assert run(spark.createDataFrame([], COLUMNS), none) == []
