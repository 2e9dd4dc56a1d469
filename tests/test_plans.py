"""Plans that the engine must get: filters and columns reach the scan, equal keys are hash-partitioned, nothing leaves the JVM."""

import re

import pytest
from docsql.queries import QUERIES, engine


@pytest.fixture(scope="module")
def e(spark, sf_dir):
    return engine(spark, sf_dir)


def scan(plan, table):
    at = plan.index(f"/{table}.parquet")
    return plan[plan.rindex("Scan parquet", 0, at) : at + 1500]


def test_filters_and_columns_reach_the_scan(e):
    part = scan(e.explain("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'F' AND o_custkey NOT IN (1, 2) AND o_orderdate < '1996-01-01'"), "orders")
    assert "GreaterThan(o_totalprice,1000.0)" in part and "Or(IsNull(o_orderstatus)" in part and "LessThan(o_orderdate" in part and "o_custkey" in part.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "o_orderpriority" not in part.split("ReadSchema")[1].split("\n")[0]


def test_aggregate_reads_its_columns_and_sums_before_the_shuffle(e):
    plan = e.explain("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey LIMIT 10")
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double>", plan)
    assert "partial_sum" in plan and "TakeOrderedAndProject" in plan


def test_equal_keys_are_no_nested_loop(e):
    for text in ("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT a.o_orderkey, b.o_orderkey FROM sparse a JOIN sparse b ON a.prio = b.prio"):
        plan = e.explain(text)
        assert re.search("SortMergeJoin|HashJoin", plan) and not re.search("NestedLoop|Cartesian", plan)


def test_side_filters_go_below_the_join(e):
    plan = e.explain("SELECT c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 400000 AND c.c_mktsegment = 'BUILDING'")
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan


def test_subqueries_and_children_are_semi_and_anti_joins_by_their_own_type(e):
    for name in ("pred_subquery_in", "children_match", "pred_subquery_not_in_nulls"):
        plan = e.explain(QUERIES[name].text)
        assert "LeftSemi" in plan and "LeftAnti" in plan and "NestedLoop" not in plan
        assert not re.search(r"cast\(\w+#\d+L? as string\)", plan)


def test_or_joins_are_equality_joins(e):
    plan = e.explain(QUERIES["join_or_large"].text)
    assert len(re.findall(r"\) (?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", plan)) >= 2 and not re.search("NestedLoop|Cartesian", plan)


def test_several_lists_are_one_scan(e):
    plan = e.explain(QUERIES["grouping_lists"].text)
    assert len(re.findall(r"\) Scan parquet", plan)) == 1 and "Expand" in plan


def test_top_hits_read_what_they_show(e):
    read = re.findall(r"ReadSchema: struct<(.*?)>", e.explain(QUERIES["tophits"].text))
    assert {c.split(":")[0] for r in read for c in r.split(",")} == {"o_orderkey", "o_totalprice", "o_orderpriority"}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.text.upper().startswith("SELECT") and "GEO_INTERSECTS" not in q.text])
def test_no_python(e, name):
    assert not re.search("Python|Pandas|Arrow", e.explain(QUERIES[name].text))


@pytest.mark.parametrize("name", ["nested_other_path", "reverse_nested"])
def test_buckets_left_for_the_row_move_no_rows(e, name):
    # Each row once in a bucket is told from its own array: whole rows are neither sorted nor sent away for that.
    plan = e.explain(QUERIES[name].text)
    assert "array_distinct" in plan and "SortAggregate" not in plan and "first(" not in plan


def test_geo_joins_compare_no_rows_in_a_nested_loop(e):
    plan = e.explain(QUERIES["join_geo"].text)
    # The only loops are those over the few levels of cells; rows meet by equal cells and equal shapes.
    loops = re.findall(r"\) BroadcastNestedLoopJoin[^\n]*\n(?:[^\n]+\n)*?Join condition: ([^\n]*)", plan)
    assert "CartesianProduct" not in plan and re.search("SortMergeJoin|HashJoin", plan)
    assert loops and all("_level" in condition for condition in loops)
    # A shape is read after equal ones have been put together.
    lines = plan.split("\n\n")[0].split("\n")
    below = [next(x for x in lines[i + 1 :] if re.search("Exchange|Scan|Join", x)) for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert below and not any("Scan" in x for x in below)
