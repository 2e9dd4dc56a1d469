import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from docsql.llm import simhash
from docsql.llm.common import LOWER
from docsql.llm.components import connected_components

from .data import COLUMNS, documents, table


def fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    texts = [r[1] for r in documents()] + ["One two", "A b c", "x\x1cy z\x0bq \x85 r"]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [fingerprint(t) for t in texts]


def test_table(spark):
    rows = documents()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash(table(spark, rows)).collect()}
    prints = {}
    for r in rows:
        prints.setdefault(fingerprint(r[1]), []).append(r[0])
    root = smallest(list(prints), [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    for p, ids in prints.items():
        members = [i for q in prints if root[q] == root[p] for i in prints[q] if i is not None]
        for i in ids:
            assert got[i, f"{p:016x}"] == (min(members) if members else None)
    assert simhash.simhash(table(spark, rows)).count() == len(rows)
    kept = simhash.deduplicate(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(set(got.values()), key=str)


def test_links_are_whole_in_long_runs(spark, monkeypatch):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(700)}
    fps |= {rnd.getrandbits(64) for _ in range(300)} | {centre ^ 1 << b for b in range(64)}
    want = smallest(sorted(fps), [(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 2])
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(classes).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert smallest(sorted(fps), links) == want
    # The same with runs far over the limit, which are dealt anew level by level.
    monkeypatch.setattr(simhash, "RUN", 20)

    def level(rows, first):
        cols = [pa.array([r[i] for r in sorted(rows)], pa.int32() if i == 3 else pa.int64()) for i in range(2 if first else 4)]
        return [r for b in simhash._link(iter([pa.RecordBatch.from_arrays(cols, list("abcd")[: len(cols)])]), first) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    key, of = simhash._index(np.array(sorted(fps), np.uint64))
    out, first, links = list(zip(key.view(np.int64).tolist(), of.view(np.int64).tolist(), strict=True)), True, []
    for _ in range(8):
        got = level(out, first)
        links += [(a % 2**64, b % 2**64) for a, b, m, _ in got if m is None]
        out, first = [r for r in got if r[2] is not None], False
        if not out:
            break
    assert smallest(sorted(fps), links) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {5000 + i: 5000 for i in range(1, 60)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty(spark):
    assert simhash.simhash(spark.createDataFrame([], COLUMNS)).collect() == []


def test_one_row_of_each_component(spark):
    rnd = random.Random(8)
    line = lambda: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rnd.randrange(99)) for _ in range(60))
    a, b, c, d, e, f = (line() for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (4, c), (7, d), (7, d), (7, e), (9, d), (9, f), (None, None), (None, ""), (3, a.upper()), (None, "  ")]
    root = smallest(prints := list({fingerprint(t) for _, t in rows}), [(x, y) for x, y in combinations(prints, 2) if (x ^ y).bit_count() <= 2])
    assert len(set(root.values())) == 7
    wide = spark.createDataFrame([(i, t, "", "", 0, 0, "", "") for i, t in rows], COLUMNS).repartition(3)
    kept = sorted(((r.doc_id, (r.text or "").strip().lower()) for r in simhash.deduplicate(wide).collect()), key=str)
    assert kept == sorted([(3, a), (None, b), (4, c), (7, d), (7, e), (9, f), (None, "")], key=str)
