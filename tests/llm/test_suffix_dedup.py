import hashlib
import random
from collections import Counter

import pytest
from docsql.llm import suffix_dedup

from .data import COLUMNS, documents, table


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        reach = 0
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                for i in range(max(s, reach), s + length):
                    gone[i] = True
                reach = s + length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def run(spark, rows, **kw):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, rows), **kw).filter("doc_id is not null").collect())


def compare(spark, rows, length, **kw):
    want = sorted((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], length), strict=True) if r[0] is not None)
    assert run(spark, rows, length=length, **kw) == want


def test_table(spark):
    compare(spark, documents(), 200)


@pytest.mark.parametrize(("length", "gram"), [(20, 7), (33, 8), (12, 12), (9, 1)])
def test_small_windows(spark, length, gram, monkeypatch):
    rnd = random.Random(length)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 600)
    pieces = ["".join(rnd.choice("ab") for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(pieces) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgé") for _ in range(25)) for _ in range(rnd.randint(0, 9))), None, None, 0, 0, "", "") for i in range(60)]
    compare(spark, [*rows, (99, "a" * 500, None, None, 0, 0, "", "")], length, gram=gram)


def test_classes_by_pairs_and_ranks(monkeypatch):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    core, length = word(30), 36
    texts = sorted({((core + word(rnd.randint(0, 9))).encode(), word(rnd.randint(0, 9)).encode()) for _ in range(70)})
    members = []
    for i, (right, left) in enumerate(texts):
        shared = suffix_dedup.extend(members[-1][1], right, 0) if members else 0
        members.append((shared, right, left, i, -1 if i % 9 == 0 else 100))

    def all_windows(pairs):
        found = set()
        monkeypatch.setattr(suffix_dedup, "PAIRS", pairs)
        suffix_dedup.resolve(members, length, lambda b, lo, hi: found.update((b, s) for s in range(lo, hi + 1)))
        return found

    by_pairs = all_windows(1000)
    assert by_pairs == all_windows(3) and by_pairs


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_one_passage_in_all_documents_over_many_ranges(spark, parts):
    """Suffixes at one frequent k-gram stand in several ranges, by suffix and by the text before it."""
    rnd = random.Random(parts)
    word = lambda n, letters="ab": "".join(rnd.choice(letters) for _ in range(n))
    core, tails, heads = word(45, "abcdefgh"), [word(30) for _ in range(5)], [word(30) for _ in range(5)]
    text = lambda: word(12, "xyz") + rnd.choice(heads)[rnd.randint(0, 25) :] + core + rnd.choice(tails)[: rnd.randint(0, 30)] + word(12, "xyz")
    rows = [(i, "".join(text() for _ in range(rnd.randint(1, 3))), None, None, 0, 0, "", "") for i in range(150)]
    for length, gram in ((40, 8), (52, 10), (60, 30)):
        compare(spark, rows, length, gram=gram, parts=parts)


def test_merge_keeps_shared_prefixes():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    runs = [sorted(strings[i::7]) for i in range(7)] + [[]]
    coded = [iter([(s, x, b"", 0, 0) for s, x in zip(suffix_dedup._shared(r), r, strict=True)] if r else []) for r in runs]
    out = list(suffix_dedup.merge_runs(coded))
    assert [r[1] for r in out] == sorted(strings)
    assert [r[0] for r in out][1:] == [suffix_dedup.extend(a[1], b[1], 0) for a, b in zip(out, out[1:], strict=False)]


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], COLUMNS)).collect() == []
