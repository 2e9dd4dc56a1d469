"""Small invented tables of a harbour: boats, crew, ports, berths, notes, cargoes with nested crates, voyages with legs, areas of the sea."""

from docsql.engine import Engine
from docsql.sources.catalog import Catalog, Child

BOATS = [("b1", "Heron", "Ilse", 3), ("b2", "Plover", "Tomas", 7)]
CREW = [
    ("c1", 11, 1250, "Ilse", 41, "deck"), ("c2", 12, 900, "Tomas", 27, "deck"), ("c3", 13, 2100, "Ruth", 36, "engine"), ("c4", 14, 640, "Pavel", 22, "deck"),
    ("c5", 15, 1980, "Mina", 33, "engine"), ("c6", 16, 310, "Otto", 58, "deck"),
]
#: Sailors (with a home port) and ports (with a name) in one table; the rest of each row is null.
HARBOUR = [
    ("h1", ("Ilse", "Brandt", 2, None), 'Ilse "Anchor"', "Kelp Bay", "deck", ("Jorn", "Anna"), ["mate", "pilot"], None, None, None),
    ("h2", ("Tomas", "Reyes", None, 5), None, "Kelp Bay", "deck", ("Luis", "Vera"), ["cook"], "blue", None, None),
    ("h3", ("Ruth", "Okafor", 3, None), None, "Gull Point", "engine", ("Tomas", "Ada"), ["fitter", "mate"], None, None, None),
    ("h4", None, None, None, None, None, None, None, "Kelp Bay", "north"),
    ("h5", None, None, None, None, None, None, None, "Gull Point", "south"),
]
BERTHS = [("east", 1, None), ("east", 2, None), ("east", 4, None), ("west", 1, None), ("west", 4, None), ("dock", 1, "x"), ("dock", 3, "y"), ("dock", 1, "z"), ("pier", 1, "x")]
NOTES = [
    ("grey seal", None, None), ("grey seal ashore", "2021-03-04 05:06:07", None), ("brown seal", None, None), ("seal brown", "2021-03-05 12:00:00", None), ("low tide", None, 4), ("low tide 7", None, 9),
]
CARGOES = [
    ("k1", [("tea", "rin", 3)], [("dry", 6)], 10, "m"), ("k2", [("salt", "sol", 1), ("tea", "rin", 2)], [("wet", 1)], 20, "n"), ("k3", [("wool", "rin", 5)], [("dry", 2), ("wet", 4)], 30, "m"),
]
VOYAGES = [("v1", "spring"), ("v2", "summer"), ("v3", "autumn")]
LEGS = [("l1", "v1", "Oslo", "fog", 2), ("l2", "v2", "Riga", "sun", 4), ("l3", "v1", "Riga", "fog", 6), ("l4", "v3", "Cork", "gale", 6)]


def box(x, y, w, h):
    return ("Polygon", [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]])


REEFS = [("r1", "small reef", box(20.0, 50.0, 2.0, 1.0), (50.5, 21.0)), ("r2", "wide reef", box(30.0, 40.0, 8.0, 6.0), (43.0, 34.0))]
LANES = [("n1", "lane", box(21.0, 50.5, 12.0, 0.2), (50.6, 27.0)), ("n2", "far lane", box(70.0, 10.0, 1.0, 1.0), (10.5, 70.5))]
_AREA = "_id string, label string, area struct<type:string,coordinates:array<array<array<double>>>>, middle struct<lat:double,lon:double>"


def fixture_engine(spark, **options) -> Engine:
    c = Catalog(spark)
    add = lambda name, rows, schema, **kw: c.register(name, spark.createDataFrame(rows, schema), **kw)
    add("boat", BOATS, "_id string, title string, skipper string, berths int")
    add("crew", CREW, "_id string, number int, pay int, first string, years int, post string")
    add("harbour", HARBOUR, "_id string, name struct<first:string,last:string,rank:int,shift:int>, nick string, home string, post string, kin struct<father:string,mother:string>, skills array<string>, `@flag` string, port string, side string", text=("nick", "name.first"))
    add("berth", BERTHS, "row string, place int, mark string")
    add("note", NOTES, "body string, seen string, `wave height` int", text=("body",))
    c.replace("note", c.one("note").df.selectExpr("body", "cast(seen as timestamp) seen", "`wave height`"))
    add("cargo", CARGOES, "_id string, crate array<struct<goods:string,owner:string,weight:bigint>>, remark array<struct<state:string,votes:bigint>>, total bigint, class string")
    add("leg", LEGS, "_id string, voyage string, town string, weather string, days bigint")
    add("voyage", VOYAGES, "_id string, season string", children={"stage": Child("leg", "voyage")})
    add("reef", REEFS, _AREA)
    add("lane", LANES, _AREA)
    return Engine(spark, c, **options)
