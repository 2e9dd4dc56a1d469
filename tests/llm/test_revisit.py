import random
from datetime import datetime, timedelta

from docsql.llm import revisit

SCHEMA = "record_id long, url string, ts timestamp, kind string, headers map<string,string>, u string, id string"
START = datetime(2024, 1, 1)


def brute(rows):
    order = sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1].lower(), r[2], r[0]))
    out = {}
    for i, r in enumerate(order):
        if r[3] == "revisit":
            before = [q for q in order[:i] if q[1].lower() == r[1].lower() and q[3] == "response"]
            out[id(r)] = before[-1] if before else None
    return out


def test_one_hot_url_over_many_tasks(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(1500):
        url = "http://hot.example.com" if rnd.random() < 0.6 else f"http://u{rnd.randrange(60)}.example.com"
        kind = rnd.choices(["response", "revisit", "request"], [1, 12, 1])[0]
        tag = rnd.choice(['"a"', '"b"', None])
        headers = {"etag": tag, "vary": str(i), "server": kind} if tag else {"vary": str(i), "server": kind}
        rows.append((i, url, START + timedelta(minutes=rnd.randrange(4000)), kind, headers, "x", "y"))
    rows += [(5000, None, START, "revisit", None, "", ""), (5001, "http://hot.example.com", None, "revisit", None, "", ""), (5002, "nohost:", START, "response", {}, "", ""), (5003, "http://Hot.example.com/", START + timedelta(days=9), "revisit", {}, "", "")]
    want = brute(rows)
    by_id = {r[0]: r for r in rows}
    got = revisit.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    seen = set()
    for r in got:
        mine = by_id[r.record_id]
        seen.add(r.status)
        if mine[3] != "revisit":
            assert r.status == ("full" if mine[3] == "response" else "other") and r.headers == (mine[4] or {})
            continue
        base = want.get(id(mine))
        if r.record_id == 5003:
            base = max((q for q in rows if q[3] == "response" and q[1] == "http://hot.example.com"), key=lambda q: (q[2], q[0]))
        if base is None:
            assert r.status == "orphan" and r.refers_to is None
            continue
        a, b = (mine[4] or {}).get("etag"), base[4].get("etag")
        status = "unverified" if not (a and b) else "resolved" if a == b else "mismatch"
        assert r.status == status
        if status == "mismatch":
            assert r.refers_to is None and r.headers == mine[4]
        else:
            assert r.refers_to == base[0]
            assert r.headers == base[4] | {k: v for k, v in (mine[4] or {}).items() if k in revisit.PERMITTED}
    assert seen == {"full", "other", "orphan", "resolved", "unverified", "mismatch"}


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/index.html", "https://u@example.com:443/a/?utm_source=x#top", "http://example.com/a?gclid=q"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://example.com/a?b=2&a=1", "http://example.com/a?a=1&b=2", "", None, "http://example.com/a.html", "http://example.com/a?ref=q", "http://example.com/index.php", "http://example.com/myindex.html"]], "u string")
    got = [r[0] for r in rows.select(revisit.canonical_url(rows.u)).collect()]
    assert got == ["example.com/a"] * 3 + ["example.com/a?a=1&b=2"] * 2 + [None, None, "example.com/a.html", "example.com/a?ref=q", "example.com", "example.com/myindex.html"]


def test_empty(spark):
    assert revisit.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
