import random
from collections import defaultdict

import corpus_pipeline
import pytest
from docsql.llm import packing
from docsql.llm.queries import op5_packing, tokenizer_path
from tokenizers import Tokenizer

from .data import COLUMNS, documents, table


def brute(items, capacity):
    bins, out = [], []
    for length, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= length and source not in b["s"] and (cluster < 0 or cluster not in b["c"])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= length
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return out


def test_shard_equals_plain_search():
    rnd = random.Random(2)
    for _ in range(60):
        k = rnd.randint(1, 60)
        items = [(rnd.randint(1, 99), min(rnd.randrange(k), rnd.randrange(k)), rnd.choice([-1, -1, *range(rnd.randint(1, 5))])) for _ in range(rnd.randint(1, 150))]
        items.sort(key=lambda x: (-x[0], x[2], x[1]))
        assert packing.pack_shard(items, 100) == brute(items, 100)


def test_table(spark):
    rows = documents()
    got = packing.pack(table(spark, rows), capacity=128).collect()
    length = defaultdict(list)
    for r in rows:
        length[r[0]].append(len([w for w in (r[1] or "").split(" ") if w]) + 1)
    placed, bins = defaultdict(int), defaultdict(list)
    for r in got:
        placed[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    assert placed == {i: sum(n) for i, n in length.items()}
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(members, members[1:], strict=False))
        assert members[0].bin_offset == 0 and sum(r.n_tokens for r in members) <= 128
        assert len({r.source for r in members}) == len(members) == len({r.cluster for r in members})


@pytest.mark.parametrize("capacity", [64, 128])
def test_table_is_packed_as_tightly_as_plain_search(spark, capacity):
    """Every rest of the whole table stands where the plain search puts it; rows that are equal in length, source and cluster may change places."""
    rows = documents(n=160)
    got = packing.pack(table(spark, rows), capacity=capacity).collect()
    rests = [(r.n_tokens, r.source, r.cluster) for r in got if r.n_tokens < capacity]
    key = lambda r: (-r[0], r[2] is None, r[2] or "", r[1] is None, r[1] or "")
    clusters = {c: i for i, c in enumerate(sorted({r[2] for r in rests}, key=str))}
    ordered = sorted(rests, key=key)
    bins, want = defaultdict(list), defaultdict(list)
    for r in got:
        if r.n_tokens < capacity:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.source, r.cluster))
    for item, (b, offset) in zip(ordered, brute([(n, s, clusters[c]) for n, s, c in ordered], capacity), strict=True):
        want[b].append((offset, *item))
    as_rows = lambda found: sorted((sorted(x, key=str) for x in found.values()), key=str)
    assert as_rows(bins) == as_rows(want) and len(rests) > 100


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], COLUMNS)).collect() == []


def test_lengths_are_ids(spark):
    lines, solid, script = "a line\n" * 900, "xyz0" * 50000, "日本語の文章" * 3000
    rows = [(i, t, "en", f"s{i}", 0, 0, "", "") for i, t in enumerate([lines, "\t".join(["tab"] * 700), solid, script, "", None, "two words"])]
    path = tokenizer_path()
    got = packing.pack(table(spark, rows), capacity=512, tokenizer=path).collect()
    plain, placed, filled, pieces = Tokenizer.from_file(path), defaultdict(int), defaultdict(int), defaultdict(set)
    for r in got:
        placed[r.doc_id] += r.n_tokens
        filled[r.bin_id] += r.n_tokens
        pieces[r.doc_id].add(r.piece)
    assert placed == {r[0]: len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    assert max(filled.values()) <= 512
    assert all(len(p) == -(-placed[i] // 512) for i, p in pieces.items()) and all(len(pieces[i]) > 1 for i in range(4))


def test_query_counts_ids(spark, tmp_path):
    table(spark, [(1, "a line\n" * 4000, "en", "s", 0, 0, "", "")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_packing(spark, str(tmp_path)).count() > 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() > 1
