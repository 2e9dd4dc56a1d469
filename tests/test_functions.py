import json
import random

import pytest
from docsql.functions import dates, geo, text
from docsql.sources.catalog import date_math_name, load_json
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("wkt", "kind", "coordinates"),
    [
        ("POINT (1.5 2)", "Point", [1.5, 2]), ("LINESTRING (0 0, 1 1)", "LineString", [[0, 0], [1, 1]]), ("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "Polygon", [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]),
        ("MULTIPOINT ((1 2), (3 4))", "MultiPoint", [[1, 2], [3, 4]]), ("MULTIPOINT (1 2, 3 4)", "MultiPoint", [[1, 2], [3, 4]]), ("MULTILINESTRING ((1 1, 2 2), (3 3, 4 4))", "MultiLineString", [[[1, 1], [2, 2]], [[3, 3], [4, 4]]]),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]),
    ],
)
def test_wkt(wkt, kind, coordinates):
    assert geo.parse_wkt(wkt) == {"type": kind, "coordinates": coordinates}


def test_bad_wkt():
    for bad in ("CIRCLE (1 2)", "POINT 1 2", "POLYGON ((0 0, 1 1)"):
        with pytest.raises(ValueError):
            geo.parse_wkt(bad)


def test_shapes():
    big, hole = geo.parse_wkt("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 7 2, 7 7, 2 7, 2 2))"), geo.parse_wkt("POLYGON ((3 3, 4 3, 4 4, 3 4, 3 3))")
    assert not geo.shapes_intersect(big, hole)
    assert geo.shapes_intersect(big, geo.parse_wkt("POINT (1 1)")) and not geo.shapes_intersect(big, geo.parse_wkt("POINT (5 5)"))
    assert geo.shapes_intersect(big, geo.parse_wkt("LINESTRING (5 5, 20 5)")) and geo.shapes_intersect(geo.parse_wkt("POLYGON ((-1 -1, 20 -1, 20 20, -1 20, -1 -1))"), big)


def test_shapes_of_a_column(spark):
    """Rows of two columns of shapes, null and equal ones among them, against the shapes pair by pair."""
    shapes = ["POINT (1 1)", "POINT (5 5)", "POINT (10 5)", "LINESTRING (5 5, 20 5)", "LINESTRING (11 0, 11 9)", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", "POLYGON ((4.5 4.5, 5.5 4.5, 5.5 5.5, 4.5 5.5, 4.5 4.5))", "POLYGON ((-1 -1, 20 -1, 20 20, -1 20, -1 -1))"]
    texts = [*(json.dumps(geo.parse_wkt(x)) for x in shapes), None]
    rows = [(a, b) for a in texts for b in texts] * 2
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", geo.intersects(F.col("a"), F.col("b")).alias("hit")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.hit == (None if r.a is None or r.b is None else geo.shapes_intersect(json.loads(r.a), json.loads(r.b)))
    assert {r.hit for r in got} == {True, False, None}
    none = spark.createDataFrame([(None, texts[0])], "a string, b string").select(geo.intersects(F.col("a"), F.col("b")).alias("hit"))
    assert none.first().hit is None


def test_text():
    assert text.wildcard_regex("a%b_c&PERCENT*", sql=True) == "(?s)^a.*b.c%.*$"
    assert [text.needed(4, m, o) for m, o in ((None, None), ("75%", None), (-1, None), (2, "and"))] == [1, 3, 3, 4]


def test_dates(spark):
    assert dates.fixed_micros("90m") == 5_400_000_000 and dates.fixed_micros("+8h") == 28_800_000_000
    one = spark.range(1).select(dates.date_math("2014-08-18||+1M-1d/d").alias("a"), dates.moment("2014-01-02").alias("b"))
    assert [str(x) for x in one.first()] == ["2014-09-17 00:00:00", "2014-01-02 00:00:00"]
    from datetime import datetime

    assert date_math_name("<logs-{now/d-1d}>", datetime(2024, 3, 1)) == "logs-2024.02.29"


def test_bulk_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"index":{"_id":"1"}}\n{"a":1,"m":{"k":"x"}}\n{"index":{"_id":"2"}}\n{"a":2,"m":[{"k":"y"},{"k":"z"}]}\n')
    df = load_json(spark, str(tmp_path / "x.json"), "a int, m array<struct<k:string>>")
    got = {r._id: (r.a, [e.k for e in r.m]) for r in df.collect()}
    assert got == {"1": (1, ["x"]), "2": (2, ["y", "z"])}


def test_span_near(spark):
    df = spark.createDataFrame([("a b c d",), ("c a",), ("a x y c",)], "t string")
    near = lambda slop, order: [r[0] for r in df.select(text.span_near(text.tokens(F.col("t")), [["a"], ["c"]], slop, order)).collect()]
    assert near(1, True) == [True, False, False] and near(2, False) == [True, True, True]


def test_intersecting_shapes_of_all_sizes(spark):
    rng = random.Random(3)

    def shape():
        x, y, side = rng.uniform(-3, 3), rng.uniform(-3, 3), 2.0 ** rng.choice([-30, -9, -3, -1, 0, 1, 2, 9, 40])
        if rng.random() < 0.2:
            return {"type": "Point", "coordinates": [round(x), round(y)]}
        x, y = (round(x), round(y)) if rng.random() < 0.5 else (x, y)
        return {"type": "Polygon", "coordinates": [[[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]]}

    one, two = ([json.dumps(shape()) for _ in range(90)] + [json.dumps({"type": "LineString", "coordinates": []})] for _ in range(2))
    frames = [spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "t string") for texts in (one, two)]
    got = [tuple(r) for r in geo.intersecting(*frames, "a", "b").collect()]
    want = {(a, b) for a in one for b in two if geo.shapes_intersect(json.loads(a), json.loads(b))}
    assert len(got) == len(set(got)) and set(got) == want and 500 < len(want) < 91 * 91
