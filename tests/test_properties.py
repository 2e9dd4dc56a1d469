"""Random statements: hints and equivalent forms do not change results."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docsql.functions.text import needed, tokens_of, wildcard_regex
from docsql.plans.parser import bind, parse
from tests.fixtures import fixture_engine


@pytest.fixture(scope="module")
def engine(spark):
    return fixture_engine(spark)


atoms = st.one_of(
    st.tuples(st.sampled_from(["years", "pay", "number"]), st.sampled_from([">", ">=", "<", "<=", "=", "<>"]), st.integers(0, 45)).map(lambda t: f"{t[0]} {t[1]} {t[2]}"),
    st.tuples(st.sampled_from(["deck", "engine", "bridge"]), st.booleans()).map(lambda t: f"post {'NOT ' if t[1] else ''}IN ('{t[0]}')"),
    st.tuples(st.integers(0, 40), st.integers(0, 40), st.booleans()).map(lambda t: f"years {'NOT ' if t[2] else ''}BETWEEN {t[0]} AND {t[1]}"),
    st.sampled_from(["first LIKE 'M%'", "first NOT LIKE '%a%'", "post IS NULL", "post IS NOT NULL"]),
)
conditions = st.recursive(atoms, lambda x: st.one_of(st.tuples(x, x).map(lambda t: f"({t[0]} AND {t[1]})"), st.tuples(x, x).map(lambda t: f"({t[0]} OR {t[1]})"), x.map(lambda c: f"NOT ({c})")), max_leaves=5)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(c=conditions)
def test_not_not_and_split_rows(engine, c):
    """No field is null here: a condition and its negation split the rows, and a double negation changes nothing."""
    n = lambda w: engine.sql(f"SELECT _id FROM crew WHERE {w}").count()
    assert n(c) + n(f"NOT ({c})") == 6 and n(f"NOT (NOT ({c}))") == n(c)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(c=conditions, op=st.sampled_from(["=", "<", "<>"]))
def test_join_hints_change_nothing(engine, c, op):
    text = f"SELECT /*! {{}} */ a._id, b._id FROM crew a JOIN boat b ON a.years {op} b.berths WHERE " + re.sub(r"\b(years|pay|number|post|first)\b", r"a.\1", c)
    results = [sorted(map(tuple, engine.sql(text.replace("{}", h)).collect())) for h in ("USE_NL", "HASH_WITH_TERMS_FILTER", "NL_MULTISEARCH_SIZE(2)")]
    assert results[0] == results[1] == results[2]


@given(values=st.lists(st.one_of(st.none(), st.booleans(), st.integers(-(2**60), 2**60), st.text(max_size=12)), min_size=1, max_size=4))
def test_bound_values_come_back(values):
    tree = parse(bind("SELECT " + ", ".join("coalesce(?)" for _ in values) + " FROM t WHERE a = '?'", values))
    assert [i.node.args[0].value for i in tree.items] == values


@given(text=st.text(max_size=40), n=st.integers(1, 9), k=st.integers(-12, 12))
def test_text_helpers(text, n, k):
    assert all(t == t.lower() and t for t in tokens_of(text))
    assert re.match(wildcard_regex(text.replace("*", "").replace("?", "")), text.replace("*", "").replace("?", ""))
    assert 1 <= needed(n, k, None) <= n
