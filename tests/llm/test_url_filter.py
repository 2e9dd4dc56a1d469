from datetime import date

import pytest
from docsql.llm import url_filter

ENTRIES = [
    ("host", "a.example.com", "adult", "add", date(2024, 1, 5)), ("host", "a.example.com", "adult", "remove", date(2024, 3, 1)), ("host", "a.example.com", "adult", "add", date(2025, 1, 1)),
    ("domain", "example.com", "spam", "add", date(2023, 6, 1)), ("prefix", "a.example.com/x/y", "trap", "add", date(2024, 2, 1)), ("prefix", "B.example.org/", "trap", "add", date(2024, 2, 1)),
    ("host", "b.example.org", "adult", "add", date(2024, 2, 2)), ("host", "b.example.org", "adult", "remove", date(2024, 2, 2)), ("host", None, "adult", "add", date(2024, 2, 2)), ("domain", "net", "tld", "add", date(2026, 1, 1)),
]
CAPTURES = [
    (1, "https://A.example.com/x/y/z?q=1", date(2024, 2, 1)), (2, "http://user@a.example.com:8080/x/yy", date(2024, 2, 29)), (3, "http://a.example.com/", date(2024, 3, 1)), (4, "http://a.example.com.", date(2025, 5, 5)),
    (5, "http://notexample.com/", date(2024, 5, 5)), (6, None, date(2024, 5, 5)), (7, "mailto:x", date(2024, 5, 5)), (8, "http://a.example.com/x", None), (9, "http://b.example.org/q", date(2024, 2, 2)),
    (10, "http://deep.er.example.com", date(2023, 5, 31)), (11, "http://deep.er.example.com", date(2023, 6, 1)), (12, "http://" + "a." * 200 + "net/", date(2026, 2, 2)), (13, "http://x.net/" + "y/" * 5000, date(2026, 2, 2)),
    (1, "https://A.example.com/x/y/z?q=1", date(2024, 2, 1)), (None, "http://x.net", date(2026, 2, 2)),
]
WANT = {
    1: ("prefix", "a.example.com/x/y", 3), 2: ("host", "a.example.com", 2), 3: ("domain", "example.com", 1), 4: ("host", "a.example.com", 2), 5: None, 6: None, 7: None, 8: None,
    9: ("prefix", "b.example.org/", 1), 10: None, 11: ("domain", "example.com", 1), 12: ("domain", "net", 1), 13: ("domain", "net", 1), None: ("domain", "net", 1),
}


@pytest.mark.parametrize("most", [1000, 0])
def test_intervals_in_either_join(spark, most):
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at date").selectExpr("*", "'x' AS kind", "1 AS year", "'y' AS name")
    entries = spark.createDataFrame(ENTRIES, "kind string, name string, category string, action string, entry_date date")
    got = url_filter.url_filter(captures, entries, broadcast_rows=most).collect()
    assert len(got) == len(CAPTURES)
    for r in got:
        assert (r.blocked and (r.list_kind, r.list_name, r.n_active) or None) == WANT[r.page_id]
        assert r.blocked == (r.n_active > 0)


def test_empty(spark):
    captures = spark.createDataFrame([], "page_id long, url string, fetched_at date")
    entries = spark.createDataFrame(ENTRIES, "kind string, name string, category string, action string, entry_date date")
    assert url_filter.url_filter(captures, entries).collect() == []
    some = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at date")
    assert not any(r.blocked for r in url_filter.url_filter(some, entries.limit(0)).collect())


@pytest.mark.parametrize("most", [1000, 0])
def test_deep_prefixes_and_long_hosts(spark, most):
    deep, labels = "/".join(f"s{i}" for i in range(12)), ".".join(f"l{i}" for i in range(150))
    entries = [("prefix", f"x.org/{deep}", "deep", "add", date(2024, 1, 1)), ("domain", "net", "tld", "add", date(2024, 1, 1)), ("domain", f"{labels}.org", "long", "add", date(2024, 1, 1))]
    urls = {1: f"http://x.org/{deep}", 2: f"http://x.org//{deep}/more?q", 3: f"http://x.org/{deep}x", 4: "http://" + "a." * 200 + "net/", 5: f"http://a.b.{labels}.org/", 6: f"http://{labels[3:]}.org/"}
    captures = spark.createDataFrame([(i, u, date(2024, 2, 2)) for i, u in urls.items()], "page_id long, url string, fetched_at date")
    entries = spark.createDataFrame(entries, "kind string, name string, category string, action string, entry_date date")
    got = {r.page_id: r.category for r in url_filter.url_filter(captures, entries, broadcast_rows=most).collect()}
    assert got == {1: "deep", 2: "deep", 3: None, 4: "tld", 5: "long", 6: None}


@pytest.mark.parametrize("most", [1000, 0])
def test_letter_case_addresses_and_actions(spark, most):
    entries = [
        ("host", "A.com", "adult", "add", date(2024, 1, 1)), ("host", "a.com", "adult", "remove", date(2024, 2, 1)), ("host", "a.com", "adult", "suspend", date(2024, 3, 1)),
        ("host", "b.com", "adult", "add", date(2024, 1, 1)), ("host", "B.COM", "adult", "add", date(2024, 1, 1)), ("host", "b.com", "adult", "review", date(2024, 1, 5)),
        ("host", "[::1]", "local", "add", date(2024, 1, 1)), ("prefix", "[2001:DB8::2]/x", "trap", "add", date(2024, 1, 1)),
    ]
    urls = {1: "http://a.com/", 2: "http://A.COM:80/x", 3: "http://b.com", 4: "http://u@[::1]:8080/q", 5: "https://[2001:db8::2]/X/y", 6: "http://[::2]/"}
    when = {1: date(2024, 1, 31), 2: date(2024, 2, 1)}
    captures = spark.createDataFrame([(i, u, when.get(i, date(2024, 3, 3))) for i, u in urls.items()], "page_id long, url string, fetched_at date")
    entries = spark.createDataFrame(entries, "kind string, name string, category string, action string, entry_date date")
    got = {r.page_id: (r.host, r.category, r.n_active) for r in url_filter.url_filter(captures, entries, broadcast_rows=most).collect()}
    assert got == {1: ("a.com", "adult", 1), 2: ("a.com", None, 0), 3: ("b.com", "adult", 1), 4: ("[::1]", "local", 1), 5: ("[2001:db8::2]", "trap", 1), 6: ("[::2]", None, 0)}


def test_query_keeps_long_hosts(spark, tmp_path):
    from docsql.llm.queries import op2_url_filter

    spark.createDataFrame([(40, "http://" + "a." * 200 + "example.org/")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    [row] = op2_url_filter(spark, str(tmp_path)).collect()
    assert len(row.host) > 400 and row.blocked and row.list_name == "example.org"
