"""The dialect over the invented harbour tables of tests/fixtures.py."""

import pytest
from docsql.operators.expressions import LoweringError
from docsql.plans.parser import ParseError, bind, parse
from docsql.sources.catalog import TableNotFound
from docsql.sources.results import csv_lines

from tests.fixtures import CREW, fixture_engine


@pytest.fixture(scope="module")
def engine(spark):
    return fixture_engine(spark)


def rows(engine, text, *params):
    return [tuple(r) for r in engine.sql(text, list(params)).collect()]


def count(engine, table, where):
    return len(rows(engine, f"SELECT * FROM {table} WHERE {where}"))


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("nested(crate.goods) = 'salt'", 1), ("nested(crate.goods) = 'tea'", 2), ("nested('crate', crate.goods = 'tea' AND crate.owner = 'rin')", 2),
        ("nested('crate', crate.goods = 'salt' AND crate.owner = 'rin')", 0), ("nested(crate.goods) = IN_TERMS(tea, wool)", 3), ("nested(crate.goods) IN ('salt', 'wool')", 2),
        ("NOT nested('crate', crate.goods = 'tea')", 1), ("nested(crate.weight) > 4", 1), ("nested(crate.goods) <> 'tea'", 1),
    ],
)
def test_nested_conditions(engine, where, n):
    assert count(engine, "cargo", where) == n


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("children(stage, town) = 'Oslo'", 1), ("children(stage, town) IN ('Riga', 'Cork')", 3), ("children(stage, town = 'Riga' AND weather = 'fog')", 1), ("children(stage, town = 'Riga' AND weather = 'gale')", 0),
        ("children(stage, town) = IN_TERMS(Oslo, Riga)", 2), ("NOT children(stage, weather = 'fog')", 2), ("children(stage, town) <> 'Riga'", 1), ("children(stage, days > 5) OR season = 'summer'", 3),
        ("_id = IN_TERMS(SELECT voyage FROM leg WHERE days = 6)", 2), ("_id <> IN_TERMS(SELECT voyage FROM leg WHERE days = 6)", 1),
    ],
)
def test_child_conditions(engine, where, n):
    assert count(engine, "voyage", where) == n


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("SELECT s.post, p.port, p.side FROM harbour s JOIN harbour p ON p.port = s.home", 9),  # null keys meet null keys
        ("SELECT s.name.first, f.name.last FROM harbour s LEFT JOIN harbour f ON f.name.first = s.kin.father", 7),
        ("SELECT a.place, b.title FROM berth a JOIN boat b", 18),
        ("SELECT /*! JOIN_TABLES_LIMIT(3, null) */ a.place, b.title FROM berth a JOIN boat b", 6),
        ("SELECT /*! JOIN_TABLES_LIMIT(null, 1) */ a.place, b.title FROM berth a JOIN boat b", 9),
        ("SELECT b.title, c.first FROM boat b JOIN crew c ON b.skipper = c.first OR b.berths = c.years", 2),
        ("SELECT b.title, c.first FROM boat b JOIN crew c ON b.skipper = c.first OR (b.berths = 3 AND b.title = c.post)", 2),
        ("SELECT c.first, b.title FROM crew c JOIN boat b ON b.skipper = c.first WHERE (c.years > 30 OR c.pay > 800) AND b.berths > 2", 2),
        ("SELECT s.post FROM harbour s JOIN harbour p ON p.port = s.home WHERE s.name.first IN (SELECT skipper FROM boat) AND p.side = 'north'", 2),
        ("SELECT r.label, l.label FROM reef r JOIN lane l ON GEO_INTERSECTS(r.area, l.area)", 1),
    ],
)
def test_joins(engine, text, n):
    found = rows(engine, text)
    assert len(found) == n
    if "JOIN_TABLES_LIMIT" not in text:
        assert sorted(map(str, rows(engine, text.replace("SELECT ", "SELECT /*! USE_NL */ ", 1)))) == sorted(map(str, found))


def test_left_join_filters_the_padded_side_first(engine):
    found = rows(engine, "SELECT s._id a, f._id b FROM harbour s LEFT JOIN harbour f ON f.name.first = s.kin.father WHERE f.home = 'nowhere' AND s.post = 'engine'")
    assert found == [("h3", None)]


def test_join_columns(engine):
    assert engine.sql("SELECT c.first who, b.* FROM crew c JOIN boat b ON b.skipper = c.first").columns == ["who", "b._id", "b.title", "b.skipper", "b.berths"]
    with pytest.raises(ParseError):
        engine.sql("SELECT * FROM boat a RIGHT JOIN crew b ON a.berths = b.years")


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("body = 'grey seal ashore'", 1), ("body = 'grey seal'", 2), ("body IN ('grey seal ashore', 'seal brown')", 2), ("seen IS missing", 4), ("seen IS NOT missing", 2), ("`wave height` IS NOT NULL", 2),
        ("['wave height'] > 5", 1), ("body <> 'seal'", 2), ("body LIKE 'gr%'", 2), ("body = matchQuery('grey brown')", 4), ("body = matchQuery('grey brown', operator='and')", 0),
        ("body = matchPhrase('seal ashore')", 1), ("body = match_phrase_prefix(query='low ti')", 2), ("x = query('body:(grey AND ashore) OR tide')", 3), ("body = matchPhrase('grey ashore', slop=1)", 1),
        ("seen < '2021-03-05' AND seen > '2021-03-05||-1d'", 1), ("body = matchQuery('low grey tide', minimum_should_match=2)", 2), ("body = wildcardQuery('b*n')", 2), ("body = term('seal')", 4),
        ("NOT (body = 'seal' OR body = 'tide')", 0),
    ],
)
def test_text(engine, where, n):
    assert count(engine, "note", where) == n


def test_negation_of_missing(engine):
    assert count(engine, "harbour", "home <> 'Kelp Bay'") == 3
    assert count(engine, "harbour", "NOT (name.rank > 2)") == 1
    assert count(engine, "harbour", "home NOT IN ('Kelp Bay')") == 3
    assert count(engine, "harbour", "skills = 'mate'") == 2
    assert count(engine, "harbour", "@flag = 'blue' AND name.first = IN_TERMS(tomas, ruth)") == 1
    assert count(engine, "harbour", "nick = 'Ilse \"Anchor\"'") == 1


def test_subqueries(engine):
    assert count(engine, "boat", "skipper IN (SELECT first FROM crew WHERE first = 'Tomas')") == 1
    assert count(engine, "boat", "skipper NOT IN (SELECT first FROM crew WHERE first = 'Tomas')") == 1
    assert count(engine, "harbour", "home NOT IN (SELECT port FROM harbour WHERE side = 'north')") == 3
    assert count(engine, "boat", "berths = IN_TERMS(SELECT name.rank FROM harbour WHERE name.first <> 'Ilse' AND name.rank IS NOT NULL)") == 1
    assert count(engine, "boat", "_id = IDS_QUERY(b2, b9)") == 1
    assert count(engine, "crew", "number IN (SELECT place + 10 FROM berth WHERE row = 'east') OR pay < 400") == 4
    with pytest.raises(LoweringError):
        engine.sql("SELECT * FROM boat WHERE skipper IN (SELECT first, post FROM crew)")


def test_sets(engine):
    of = lambda a, op, b, cols="place": rows(engine, f"SELECT {cols} FROM berth WHERE row = '{a}' {op} SELECT {cols} FROM berth WHERE row = '{b}'")
    assert of("east", "MINUS", "east") == [] and of("east", "MINUS", "west") == [(2,)]
    assert sorted(of("dock", "MINUS", "pier", "place, mark")) == [(1, "z"), (3, "y")]
    assert sorted(of("east", "INTERSECT", "west")) == [(1,), (4,)]
    assert len(rows(engine, "SELECT mark FROM berth UNION SELECT mark FROM berth")) == 18
    with pytest.raises(LoweringError):
        engine.sql("SELECT place FROM berth UNION SELECT title FROM boat")


def test_geo(engine):
    assert count(engine, "reef", "GEO_INTERSECTS(area, 'POLYGON ((31 41, 33 41, 33 44, 31 44, 31 41))')") == 1
    assert count(engine, "reef", "GEO_BOUNDING_BOX(middle, 20.0, 51.0, 22.0, 50.0)") == 1
    assert count(engine, "reef", "GEO_DISTANCE(middle, '2km', 21.01, 50.5)") == 1
    assert count(engine, "reef", "GEO_POLYGON(middle, 30, 40, 40, 40, 35, 50)") == 1
    assert count(engine, "reef", "GEO_CELL(middle, 21.001, 50.5001, 5)") == 1
    assert count(engine, "reef", "GEO_DISTANCE_RANGE(middle, '100m', '3km', 21.01, 50.5)") == 1
    assert [n for _, n in rows(engine, "SELECT COUNT(*) FROM reef GROUP BY geohash_grid(field='middle',precision=3)")] == [1, 1]
    assert rows(engine, "SELECT * FROM reef GROUP BY geo_bounds(field='middle',alias='all')") == [(21.0, 50.5, 34.0, 43.0)]


def test_nested_buckets(engine):
    assert sorted(rows(engine, "SELECT COUNT(*) FROM cargo GROUP BY nested(crate.goods)")) == [("salt", 1), ("tea", 2), ("wool", 1)]
    assert rows(engine, "SELECT SUM(nested(crate.weight)) AS s, MIN(nested(crate.weight)) AS m FROM cargo") == [(11.0, 1.0)]
    inner = "nested(crate.owner), filter('heavy', crate.weight > 1)"
    assert sorted(rows(engine, f"SELECT COUNT(*) FROM cargo GROUP BY {inner}, reverse_nested(class)")) == [("rin", "m", 2), ("rin", "n", 1)]
    assert rows(engine, f"SELECT SUM(reverse_nested(total)) t FROM cargo GROUP BY {inner}") == [("rin", 60.0)]
    assert sorted(rows(engine, f"SELECT COUNT(*) FROM cargo GROUP BY {inner}, reverse_nested(remark.state, '~remark')")) == [("rin", "dry", 2), ("rin", "wet", 2)]
    assert rows(engine, "SELECT COUNT(*) FROM cargo GROUP BY histogram('field'='crate.weight','nested'='crate','interval'='2','alias'='w')") == [(0.0, 1), (2.0, 2), (4.0, 1)]


def test_buckets(engine):
    assert rows(engine, "SELECT COUNT(*) FROM harbour GROUP BY terms('alias'='flag','field'='@flag','missing'='none')")[0] == ("none", 4)
    assert rows(engine, "SELECT SUM(pay + years) AS s FROM crew") == [(float(sum(r[2] + r[4] for r in CREW)),)]
    assert [r[0] for r in rows(engine, "SELECT COUNT(*) FROM boat GROUP BY terms('field'='title','alias'='t',order='desc')")] == ["Plover", "Heron"]
    assert engine.sql("SELECT COUNT(*) FROM crew GROUP BY post").columns == ["post", "COUNT(*)"]
    assert rows(engine, "SELECT COUNT(years) FROM crew GROUP BY range(years, 20, 30, 40)") == [("20.0-30.0", 2), ("30.0-40.0", 2)]
    assert rows(engine, "SELECT COUNT(*) AS n FROM crew GROUP BY filters(kind, rest, filter(deck, post = 'deck'), filter(rich, pay > 1900))") == [("deck", 4), ("rest", 0), ("rich", 2)]


def test_bucket_orders_and_least_rows(engine):
    asc = rows(engine, "SELECT MAX(pay) AS p FROM crew GROUP BY terms(field='post',alias='x',order='{\"p\":\"asc\"}')")
    assert asc == [("deck", 1250.0), ("engine", 2100.0)]
    assert rows(engine, "SELECT MAX(pay) AS p FROM crew GROUP BY terms(field='post',alias='x',size=1,order='[{\"p\":\"desc\"},{\"_key\":\"asc\"}]')") == [("engine", 2100.0)]
    assert rows(engine, "SELECT COUNT(*) AS n FROM crew GROUP BY terms(field='first',alias='f',order='{\"_key\":\"desc\"}')")[0] == ("Tomas", 1)
    assert {r[0] for r in rows(engine, "SELECT COUNT(*) AS n FROM crew GROUP BY terms(field='post',alias='x',min_doc_count=3), first")} == {"deck"}
    for bad in ("terms(field='post',alias='x',order='{\"q\":\"asc\"}')", "terms(field='post',alias='x',order='{\"p\":\"asc\"}'), first", "terms(field='post',alias='x',order='[{\"p\":\"asc\"},{\"q\":\"asc\"}]')"):
        with pytest.raises(LoweringError):
            engine.sql(f"SELECT MAX(pay) AS p FROM crew GROUP BY {bad}")


def test_gaps_below_a_parent(engine):
    found = rows(engine, "SELECT COUNT(*) AS n FROM crew GROUP BY post, histogram(field='years',interval=10,alias='h',min_doc_count=0)")
    assert [r for r in found if r[0] == "deck"] == [("deck", 20.0, 2), ("deck", 30.0, 0), ("deck", 40.0, 1), ("deck", 50.0, 1)]
    wide = rows(engine, "SELECT COUNT(*) AS n FROM crew WHERE post = 'engine' GROUP BY post, histogram(field='years',interval=10,alias='h',extended_bounds='20:45')")
    assert wide == [("engine", 20.0, 0), ("engine", 30.0, 2), ("engine", 40.0, 0)]


def test_time_zones(engine):
    by = lambda zone: rows(engine, f"SELECT COUNT(*) AS n FROM note GROUP BY date_histogram(field='seen',interval='1d',format='MM-dd HH:mm',alias='d',time_zone='{zone}')")
    assert by("Asia/Shanghai") == by("+08:00") == [("03-04 00:00", 1), ("03-05 00:00", 1)]
    assert by("Pacific/Auckland") == [("03-04 00:00", 1), ("03-06 00:00", 1)]
    ranges = "SELECT COUNT(*) AS n FROM note GROUP BY date_range(field='seen',format='yyyy-MM-dd HH:mm',alias='d',time_zone='+06:00','2021-03-04 11:00','2021-03-05 18:00','2021-03-05 18:01')"
    assert rows(engine, ranges) == [("2021-03-04 11:00-2021-03-05 18:00", 1), ("2021-03-05 18:00-2021-03-05 18:01", 1)]
    with pytest.raises(ValueError):
        by("Sea/Nowhere")


def test_sibling_metrics_and_words_below_levels(engine):
    found = engine.sql("SELECT SUM(pay) AS s, max_bucket(s) AS top, min_bucket(s) AS low FROM crew GROUP BY post").collect()
    assert [r.asDict() for r in found] == [{"top.keys": "engine", "top": 4080.0, "low.keys": "deck", "low": 3100.0}]
    words = rows(engine, "SELECT COUNT(*) AS n FROM note GROUP BY filters(f, filter(seals, body = 'seal'), filter(tides, body = 'tide')), significant_text(field='body',alias='w',min_doc_count=2,size=1)")
    assert [(r[0], r[1], r[2]) for r in words] == [("seals", "seal", 4), ("tides", "low", 2)]
    with pytest.raises(LoweringError):
        engine.sql("SELECT COUNT(*) FROM note GROUP BY significant_text(field='body'), seen")


def test_lists_of_groups(engine):
    found = {tuple(r) for r in engine.sql("SELECT COUNT(*) AS n FROM harbour GROUP BY (post), (home, post), (side)").select("_grouping", "post", "home", "side", "n").collect()}
    assert found == {(0, "deck", None, None, 2), (0, "engine", None, None, 1), (1, "deck", "Kelp Bay", None, 2), (1, "engine", "Gull Point", None, 1), (2, None, None, "north", 1), (2, None, None, "south", 1)}


def test_parity_defaults(spark):
    e = fixture_engine(spark, parity=True, missing_columns="null")
    e.catalog.register("tide", spark.range(1300).selectExpr("id", "id % 40 AS g", "id + 0 AS i"), "id")
    assert len(rows(e, "SELECT * FROM tide")) == 1000 and len(rows(e, "SELECT * FROM tide LIMIT 1100")) == 1100
    assert len(rows(e, "SELECT COUNT(*) FROM tide GROUP BY terms(field='g',alias='g')")) == 10
    assert len(rows(e, "SELECT a.id FROM tide a JOIN tide b ON a.g = b.g")) == 200
    assert rows(e, "SELECT i / 2 AS h, nothing FROM tide WHERE id = 9") == [(4, None)]


def test_hints_and_pages(engine):
    assert len(rows(engine, "SELECT /*! IGNORE_UNAVAILABLE */ * FROM boat, wreck")) == 2
    with pytest.raises(TableNotFound):
        engine.sql("SELECT * FROM boat, wreck")
    assert len(rows(engine, "SELECT * FROM ber*")) == 9
    assert [len(p) for p in engine.scroll("SELECT /*! USE_SCROLL(4, 1000) */ * FROM berth")] == [4, 4, 1]
    hint = "/*! HIGHLIGHT(body, pre_tags : ['<i>'], post_tags : ['</i>']) */"
    assert sorted(rows(engine, f"SELECT {hint} body FROM note WHERE body = matchQuery('brown')")) == [("brown seal", "<i>brown</i> seal"), ("seal brown", "seal <i>brown</i>")]
    assert engine.sql(f"SELECT {hint} * FROM note WHERE body = matchQuery('brown')").columns[-1] == "body.highlight"
    assert engine.explain("SELECT * FROM boat WHERE berths > 3").startswith("query\n")
    assert engine.json("SELECT title FROM boat ORDER BY berths")["hits"]["total"]["value"] == 2
    assert engine.csv("SELECT title, berths FROM boat ORDER BY berths") == "title,berths\nHeron,3\nPlover,7"
    assert list(csv_lines(engine.sql("SELECT name, home FROM harbour WHERE name IS NOT NULL LIMIT 1"), flat=True))[0] == "name.first,name.last,name.rank,name.shift,home"
    assert engine.hits_of("SELECT /*! DOCS_WITH_AGGREGATION(1, 3) */ COUNT(*) FROM crew GROUP BY post").count() == 3
    assert rows(engine, "SELECT title FROM boat WHERE berths = ? AND title = ?", 7, "Plover") == [("Plover",)]
    inner = engine.sql('SELECT /*! COLLAPSE({"field":"post","inner_hits":{"name":"h","size":1,"sort":[{"years":"desc"}]}}) */ * FROM crew').collect()
    assert {(r.post, r.h[0].years) for r in inner} == {("deck", 58), ("engine", 36)}


def test_delete_and_show(spark, tmp_path):
    e = fixture_engine(spark)
    assert rows(e, "DELETE FROM boat WHERE title = 'Heron'") == [(1,)] and rows(e, "SELECT title FROM boat") == [("Plover",)]
    assert e.write_without("DELETE FROM crew WHERE years > 35", str(tmp_path / "crew")) == 3
    assert len(rows(e, "SELECT * FROM crew")) == 3
    before = sorted(map(str, rows(e, "SELECT * FROM berth")))
    e.catalog.replace("berth", e.catalog.one("berth").df.union(e.catalog.one("berth").df).repartition(3))
    assert rows(e, "DELETE FROM berth WHERE row <> 'pier' LIMIT 5") == [(5,)]
    left = sorted(map(str, rows(e, "SELECT * FROM berth")))
    assert len(left) == 2 * len(before) - 5 and left == sorted(map(str, rows(e, "SELECT * FROM berth"))) and sum("pier" in r for r in left) == 2
    shown = rows(e, "SHOW car*")
    assert ("cargo", "crate", "nested") in shown and ("cargo", "crate.goods", "keyword") in shown


def test_parser():
    tree = parse("SELECT x AS y, count(DISTINCT t.q, 50) FROM `odd table` t WHERE x-y = 2 AND NOT (q > 1 OR z IS NOT NULL) GROUP BY (x), (y, z) ORDER BY x DESC LIMIT 4, 8")
    assert tree.limit == 8 and tree.offset == 4 and len(tree.groups) == 2 and tree.tables[0].name == "odd table"
    assert bind("SELECT * FROM t WHERE x = ? AND y = '?'", ["o'clock"]) == "SELECT * FROM t WHERE x = 'o''clock' AND y = '?'"
    for bad in ("UPDATE boat SET x = 1", "SELECT FROM boat", "SELECT * FROM boat WHERE", "SELECT x y z FROM boat", "INSERT INTO boat VALUES (1)"):
        with pytest.raises(ParseError):
            parse(bad)


def test_unknown_names(engine):
    for bad in ("nothing", "nofunction(berths)"):
        with pytest.raises(LoweringError):
            engine.sql(f"SELECT {bad} FROM boat")
    engine.register_function("thrice", lambda x: x * 3, "int")
    assert sorted(rows(engine, "SELECT thrice(berths) AS t FROM boat")) == [(9,), (21,)]


def test_mixed_types_meet_as_texts(engine):
    got = rows(engine, "SELECT CASE WHEN berths > 5 THEN 'big' ELSE berths END AS a, if(berths > 5, berths, 'small') AS b, coalesce(null, berths, '-') AS c FROM boat ORDER BY berths")
    assert got == [("3", "small", "3"), ("big", "7", "7")]
    assert rows(engine, "SELECT case_new(berths > 5, 1, default, '-') AS a FROM boat ORDER BY berths") == [("-",), ("1",)]


def test_grammar_corners(engine):
    assert rows(engine, 'SELECT title FROM boat WHERE title = "Heron" AND 2 = 2 AND (berths + 1) * 2 = 8 -- a remark') == [("Heron",)]
    assert len(rows(engine, "SELECT include('t*', 's*'), exclude('*er') FROM boat")[0]) == 1
    assert rows(engine, "SELECT split(concat_ws('/', title, berths), '/')[1] AS n FROM boat/anytype b WHERE b.berths BETWEEN 4 AND 9") == [("7",)]
    assert rows(engine, "SELECT STATS(berths) FROM boat")[0][:2] == (2, 10.0)
    assert rows(engine, "SELECT AVG(script('n','doc[\\'berths\\'].value * 2')) AS a FROM boat") == [(10.0,)]
    assert rows(engine, "SELECT COUNT(*) FROM boat HAVING COUNT(*) > 9") == []
    assert [r[0] for r in rows(engine, "SELECT _id FROM cargo ORDER BY NESTED('crate.weight','crate') DESC LIMIT 1, 2")] == ["k1", "k2"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT COUNT(*) AS n FROM cargo GROUP BY nested(crate.owner), reverse_nested(class)",
        "SELECT COUNT(*) AS n FROM cargo GROUP BY nested(crate.owner), filter('some', crate.weight > 1 OR total = 20), reverse_nested(remark.state,'~remark')",
        "SELECT COUNT(*) AS n FROM cargo GROUP BY nested(crate.owner), nested(crate.goods), filter('all', total > 0), reverse_nested(crate.goods,'~crate')",
        "SELECT COUNT(*) AS n FROM cargo GROUP BY nested(crate.owner), terms('field'='class','alias'='c','reverse_nested'='')",
        "SELECT SUM(reverse_nested(total)) AS s, COUNT(*) AS n FROM cargo GROUP BY nested(crate.owner)",
    ],
)
def test_rows_are_once_in_a_bucket_with_and_without_a_shuffle(spark, monkeypatch, text):
    from docsql.operators import aggregate

    from tests.fixtures import CARGOES

    engine = fixture_engine(spark)
    more = [("k4", [("tea", "rin", 1), ("tea", "rin", 9), ("tea", None, 2), None], [("dry", 1)], 40, "m"), ("k5", None, [("dry", 1)], 50, "n"), ("k6", [], None, 60, None)]
    engine.catalog.replace("cargo", spark.createDataFrame(CARGOES + more, engine.catalog.one("cargo").df.schema))
    df = engine.sql(text)
    got = sorted(map(str, df.collect()))
    assert got and "array_distinct" in df._jdf.queryExecution().toString()
    monkeypatch.setattr(aggregate, "_simple_run", lambda *_: 0)
    slow = engine.sql(text)
    assert "array_distinct" not in slow._jdf.queryExecution().toString() and got == sorted(map(str, slow.collect()))


def test_geo_joins(engine):
    on = "ON GEO_INTERSECTS(r.area, l.area)"
    assert sorted(rows(engine, f"SELECT r.label AS r, l.label AS l FROM reef r LEFT JOIN lane l {on}"), key=str) == [("small reef", "lane"), ("wide reef", None)]
    assert sorted(rows(engine, f"SELECT r.label AS r, l.label AS l FROM reef r LEFT JOIN lane l {on} AND r.label = l.label"), key=str) == [("small reef", None), ("wide reef", None)]
    assert rows(engine, "SELECT r.label AS r, l.label AS l FROM reef r JOIN lane l WHERE GEO_INTERSECTS(l.area, r.area)") == [("small reef", "lane")]
    assert rows(engine, f"SELECT r.label AS r, l.label AS l FROM reef r JOIN lane l {on} AND r.label <> l.label") == [("small reef", "lane")]
    assert rows(engine, f"SELECT COUNT(*) AS n FROM reef r JOIN lane l {on}") == [(1,)]
