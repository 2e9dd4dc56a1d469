import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import pytest
from docsql.llm import decontaminate, packing, toxicity
from docsql.llm.common import LOWER

from .test_simhash import fingerprint, smallest


def lower(text):
    return (text or "").encode().translate(LOWER)


def contaminated(text, items):
    words = decontaminate.words_of(text)
    seen = {k: {tuple(words[p : p + k]) for p in range(len(words) - k + 1)} for k in range(1, 9)}
    n = 0
    for item in items:
        k = min(8, len(item))
        n += k > 0 and any(tuple(item[p : p + k]) in seen[k] for p in range(len(item) - k + 1))
    return n >= 1


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append((docs, (path := str(tmp_path_factory.mktemp("stages") / str(i)))))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return sf_dir, [(a.collect(), spark.read.parquet(p).collect(), a.columns, spark.read.parquet(p).columns) for a, p in out]


def test_each_stage_equals_plain_version(spark, stages):
    sf_dir, steps = stages
    assert all(before == after for _, _, before, after in steps[:-1])
    (docs, clean, *_), (_, single, *_), (_, apart, *_), (_, kept, *_), (_, packed, *_) = steps
    scores = toxicity.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in scores if not r.predicted}
    of = defaultdict(list)
    for r in clean:
        of[lower(r.text)].append(r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(max(ids) for ids in of.values())
    prints = defaultdict(list)
    for r in single:
        prints[fingerprint(r.text)].append(r.doc_id)
    root = smallest(list(prints), [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    groups = defaultdict(list)
    for p, ids in prints.items():
        groups[root[p]] += ids
    assert sorted(r.doc_id for r in apart) == sorted(min(g) for g in groups.values())
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in apart if not contaminated(r.text, items))
    bins = defaultdict(list)
    for r in packed:
        bins[r.bin_id].append(r)
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept}
    for members in bins.values():
        assert sum(r.n_tokens for r in members) <= packing.CAPACITY and len({r.source for r in members}) == len(members)


def test_run(spark, stages):
    sf_dir, steps = stages
    key = lambda r: (r.doc_id, r.piece, r.n_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, steps[-1][1]))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_tables(spark, tmp_path, empty):
    from .data import documents, table

    docs = table(spark, documents()).limit(0) if empty else table(spark, documents())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    some = [] if empty else [(1, 0), (2, 0), (3, 0), (None, 1), (4, None)]
    spark.createDataFrame(some, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [] if empty else [(1, None), (None, "w1 w2"), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert got == []
        return
    # No label of class 1 and no item with an id and words: what is left after exact and near dedup is packed.
    last = {}
    for r in documents():
        if lower(r[1]) not in last or (r[0] is not None and (last[lower(r[1])] or -1) < r[0]):
            last[lower(r[1])] = r[0]
    prints = defaultdict(list)
    for text, i in last.items():
        prints[fingerprint(text.decode())].append(i)
    root = smallest(list(prints), [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    groups = defaultdict(list)
    for p, ids in prints.items():
        groups[root[p]] += ids
    kept = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert sorted((r.doc_id for r in got if r.piece == 0), key=str) == sorted(kept, key=str)


def test_documents_with_one_passage_go(spark, tmp_path):
    rnd = random.Random(2)
    line = lambda k: " ".join(f"w{rnd.randrange(5000)}" for _ in range(k))
    item, other = line(40), line(40)
    docs = [(i, line(60), "en", "s", 0) for i in range(20)]
    docs += [(50, f"{line(30)} {' '.join(item.split()[5:20]).upper()} {line(30)}", "en", "s", 0), (51, " ".join(item.split()[:7]), "en", "s", 0), (None, f"{item} {other}", "en", "s", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 51]
