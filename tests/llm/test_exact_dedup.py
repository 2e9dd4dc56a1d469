import hashlib
from collections import defaultdict

import pytest
from docsql.llm import exact_dedup
from docsql.llm.common import LOWER
from pyspark.sql import functions as F

from .data import COLUMNS, documents, table


def norm(t):
    return (t or "").encode().translate(LOWER)


def check(spark, rows, df=None):
    got = exact_dedup.exact_dedup(df if df is not None else table(spark, rows)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    keep = {hashlib.sha256(t).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    of = {r[0]: hashlib.sha256(norm(r[1])).hexdigest() for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.text_sha256 == of[r.doc_id] and (r.keep_id, r.group_size) == keep[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(keep)


def test_table(spark):
    check(spark, documents())


def test_large_group_over_many_buckets(spark):
    texts = ["Same text again", "same TEXT again", "zz", None, "É", "é"]
    rows = [(i, texts[0] if i % 3 else texts[i % 5] if i % 2 else f"own {i % 40}", "en", "s", 0, 0, "", "") for i in range(3000)]
    check(spark, rows)


@pytest.mark.parametrize("kind", ["int", "smallint", "string"])
def test_null_ids_of_any_type(spark, kind):
    rows = [(i if i % 4 else None, ["same", "SAME", "other", None][i % 4 // (1 + i % 2)] or f"own {i % 7}", "en", "s", 0, 0, "", "") for i in range(400)]
    got = exact_dedup.exact_dedup(table(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(norm(r[1])).hexdigest()].append(r[0])
    order = (lambda i: str(i)) if kind == "string" else (lambda i: i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None, key=order)
        assert (r.keep_id, r.group_size) == (keep if kind != "string" or keep is None else str(keep), len(ids))
    assert sorted((r.text_sha256, r.doc_id) for r in got if r.kept) == sorted((r.text_sha256, r.keep_id) for r in {r.text_sha256: r for r in got}.values())


def test_keeps_whole_rows(spark):
    df = table(spark, documents())
    kept = exact_dedup.deduplicate(df)
    assert kept.schema == df.schema
    assert kept.count() == len({norm(r[1]) for r in documents()})


def test_empty(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert exact_dedup.exact_dedup(empty).collect() == [] and exact_dedup.deduplicate(empty).collect() == []
