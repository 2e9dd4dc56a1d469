"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from docsql.queries import QUERIES, TABLES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, db, name):
    q = QUERIES[name]
    df = q.run(spark, sf_dir)
    got = df.collect()
    result = db.execute(q.oracle())
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    order = sorted(columns)
    assert sorted([shown(r[c]) for c in order] for r in got) == sorted([shown(r[c]) for c in order] for r in want)


def test_queries_of_whole_tables(spark, sf_dir, db):
    run = lambda name: [tuple(r) for r in QUERIES[name].run(spark, sf_dir).collect()]
    one = lambda sql: db.execute(sql).fetchone()[0]
    orders = one("SELECT count(*) FROM orders")
    assert len(run("scalar_cast")) == one("SELECT count(*) FROM lineitem")
    assert len(run("projection_include")) == orders
    assert {a for a, _ in run("join_nullsafe")} == {k for (k,) in db.execute("SELECT o_orderkey FROM orders").fetchall()}
    assert len(run("pred_script")) == one("SELECT count(*) FROM orders WHERE o_totalprice > 250000 AND o_totalprice < 400000")
    assert 0 in {r.n for r in QUERIES["date_histogram_gaps"].run(spark, sf_dir).collect()}
    assert sum(r.n for r in QUERIES["date_histogram_gaps"].run(spark, sf_dir).collect()) == one("SELECT count(*) FROM events WHERE event_type = 'error' AND value > 150")
    # In order: the third of the rows without a price stands last.
    ordered = [k for (k,) in run("order_nulls_last")]
    assert ordered == [k for (k,) in db.execute(QUERIES["order_nulls_last"].oracle()).fetchall()]
    assert len(ordered) == orders and all(k % 3 == 0 for k in ordered[-(orders // 3) :])
