"""Points, distances, polygons and geohash cells as Column expressions, and shapes from well-known text."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Metres of a distance unit.
METRES = {"m": 1.0, "meters": 1.0, "km": 1000.0, "kilometers": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "miles": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254, "nm": 1852.0, "nmi": 1852.0}
#: The digits of a geohash.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Cells of a join of shapes have sides of 2^LOW to 2^(TOP - 1); the level TOP is one cell. Cells are numbered up to MOST either way, the last being open.
LOW, TOP, MOST = -20, 31, float(1 << 50)


def metres(text: str | float) -> float:
    m = re.fullmatch(r"\s*([\d.]+)\s*([A-Za-z]*)\s*", str(text))
    if not m:
        raise ValueError(f"distance {text!r} is not supported")
    return float(m[1]) * METRES[m[2].lower() or "m"]


def distance(point: Column, lon: float, lat: float) -> Column:
    """Great-circle distance in metres."""
    a = F.radians(point["lat"])
    b = math.radians(lat)
    d_lon = F.radians(point["lon"] - lon)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * math.cos(b) * F.pow(F.sin(d_lon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(point: Column, left: float, top: float, right: float, bottom: float) -> Column:
    lon = point["lon"].between(left, right) if left <= right else (point["lon"] >= left) | (point["lon"] <= right)
    return lon & point["lat"].between(bottom, top)


def in_polygon(point: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the ring's sides; the bounding box is tested first. Points on a side count as inside."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    crossings = F.lit(0)
    on_side = F.lit(False)
    x, y = point["lon"], point["lat"]
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crossings = crossings + F.when(((y < y1) != (y < y2)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_side = on_side | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & ((crossings % 2 == 1) | on_side)


def geohash(point: Column, precision: int) -> Column:
    """The cell's name: longitude and latitude bits interleaved, longitude first, five to a digit."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    lon = F.least(F.floor((point["lon"] + 180.0) / 360.0 * F.lit(float(1 << n_lon))), F.lit((1 << n_lon) - 1)).cast("long")
    lat = F.least(F.floor((point["lat"] + 90.0) / 180.0 * F.lit(float(1 << n_lat))), F.lit((1 << n_lat) - 1)).cast("long")
    digits = []
    for d in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            k = 5 * d + b
            source, left = (lon, n_lon - 1 - k // 2) if k % 2 == 0 else (lat, n_lat - 1 - k // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("long"))
        digits.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.when(point["lon"].isNotNull() & point["lat"].isNotNull(), F.concat(*digits))


# ---------------------------------------------------------------- shapes


def parse_wkt(text: str) -> dict:
    """Well-known text to a GeoJSON object; raises ValueError for anything else."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:Z|M)?\s*(\(.*\))\s*", text, re.S)
    kinds = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    if not m or m[1].upper() not in kinds:
        raise ValueError(f"cannot read the shape {text[:60]!r}")
    kind = m[1].upper()
    inner = _nest(m[2])
    if kind == "POINT":
        coordinates = inner[0]
    elif kind == "MULTIPOINT":
        coordinates = [p[0] if isinstance(p[0], list) else p for p in inner]
    else:
        coordinates = inner
    return {"type": kinds[kind], "coordinates": coordinates}


def _nest(text: str) -> list:
    """(a b, c d) to [[a, b], [c, d]], to any depth."""
    body = text.strip()
    if not (body.startswith("(") and body.endswith(")")):
        raise ValueError(f"unbalanced brackets in {text[:60]!r}")
    parts, depth, start = [], 0, 1
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if depth < 0 or depth == 0 and i < len(body) - 1:
            raise ValueError(f"unbalanced brackets in {text[:60]!r}")
        if ch == "," and depth == 1 or i == len(body) - 1:
            parts.append(body[start:i].strip())
            start = i + 1
    return [_nest(p) if p.startswith("(") else [float(x) if re.search(r"[.eE]", x) else int(x) for x in p.split()] for p in parts]


def _sides(shape: dict) -> tuple[np.ndarray, list[list]]:
    """All sides (x1, y1, x2, y2) and all rings of areas, of a GeoJSON shape."""
    kind, c = shape["type"].lower(), shape["coordinates"]
    lines = {"point": lambda: [[c, c]], "multipoint": lambda: [[p, p] for p in c], "linestring": lambda: [c], "multilinestring": lambda: c, "polygon": lambda: c, "multipolygon": lambda: [r for p in c for r in p]}[kind]()
    sides = [(*a[:2], *b[:2]) for line in lines for a, b in zip(line, line[1:], strict=False)]
    return np.array(sides, float).reshape(-1, 4), lines if "polygon" in kind else []


def _cover(rings: list[list], x: float, y: float) -> bool:
    inside = False
    for ring in rings:
        for (x1, y1, *_), (x2, y2, *_) in zip(ring, ring[1:], strict=False):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def shapes_intersect(a: dict, b: dict) -> bool:
    """Whether two GeoJSON shapes have a point in common."""
    return _meet(_sides(a), _sides(b))


def _box(sides: np.ndarray) -> tuple[float, float, float, float]:
    """West, south, east and north of all sides; of none, a box that meets no other."""
    points = sides.reshape(-1, 2)
    return (*points.min(0).tolist(), *points.max(0).tolist()) if len(points) else (math.inf, math.inf, -math.inf, -math.inf)


def _meet(a: tuple[np.ndarray, list[list]], b: tuple[np.ndarray, list[list]]) -> bool:
    (s, rings_a), (t, rings_b) = a, b
    if not len(s) or not len(t):
        return False
    p, q = s[:, None, :], t[None, :, :]
    turn = lambda ax, ay, bx, by, cx, cy: np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    d1, d2 = turn(*(p[..., i] for i in range(4)), q[..., 0], q[..., 1]), turn(*(p[..., i] for i in range(4)), q[..., 2], q[..., 3])
    d3, d4 = turn(*(q[..., i] for i in range(4)), p[..., 0], p[..., 1]), turn(*(q[..., i] for i in range(4)), p[..., 2], p[..., 3])
    overlap = np.ones(d1.shape, bool)
    for i in (0, 1):
        overlap &= np.maximum(np.minimum(p[..., i], p[..., i + 2]), np.minimum(q[..., i], q[..., i + 2])) <= np.minimum(np.maximum(p[..., i], p[..., i + 2]), np.maximum(q[..., i], q[..., i + 2]))
    if (overlap & (d1 * d2 <= 0) & (d3 * d4 <= 0)).any():
        return True
    return bool(rings_a) and _cover(rings_a, *t[0, :2]) or bool(rings_b) and _cover(rings_b, *s[0, :2])


def intersects(left: Column, right: Column) -> Column:
    """Whether two shape columns (GeoJSON texts) intersect; batches go through Arrow."""
    return _intersects()(left, right)


def _read_all(texts: pa.Array) -> tuple[np.ndarray, list]:
    """Which of the distinct shapes each text is (-1: null), and their sides and rings."""
    import json

    coded = texts.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), [_sides(json.loads(t)) for t in coded.dictionary.to_pylist()]


def _intersects():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        # Each distinct shape of a batch is read once; only pairs whose boxes meet are compared side by side.
        (one, of_a), (two, of_b) = _read_all(a), _read_all(b)
        boxes, others = (np.array([_box(x[0]) for x in of], float).reshape(-1, 4) for of in (of_a, of_b))
        given = np.flatnonzero((one >= 0) & (two >= 0))
        p, q = boxes[one[given]], others[two[given]]
        near = given[((p[:, :2] <= q[:, 2:]) & (q[:, :2] <= p[:, 2:])).all(1)]
        out = np.zeros(len(a), bool)
        out[near] = [_meet(of_a[i], of_b[j]) for i, j in zip(one[near].tolist(), two[near].tolist(), strict=True)]
        return pa.array(out, mask=(one < 0) | (two < 0))

    return run


# ---------------------------------------------------------------- joins of shapes


def _boxes():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<w:double,s:double,e:double,n:double>")
    def run(texts: pa.Array) -> pa.Array:
        import json

        found = np.array([_box(_sides(json.loads(t))[0]) for t in texts.to_pylist()], float).reshape(-1, 4)
        # A shape without sides, or with a coordinate that is no number, meets none.
        none = ~((found[:, 0] <= found[:, 2]) & (found[:, 1] <= found[:, 3]))
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(4)], ["w", "s", "e", "n"], mask=pa.array(none))

    return run.asNondeterministic()  # else a test of the box goes below distinct(), and every row is read


def _shapes(texts: DataFrame, name: str) -> DataFrame:
    """The distinct texts of the one column, with their boxes, and as level the power of 2 that is the side of cells as large as the box at least."""
    box = F.col("box")
    side = F.greatest(box["e"] - box["w"], box["n"] - box["s"])
    # A thousandth more than the box has, for rounding.
    level = F.when(side < float(1 << 30), F.greatest(F.coalesce(F.ceil(F.log2(side * 1.001)), F.lit(LOW)), F.lit(LOW))).otherwise(F.lit(TOP)).cast("int")
    out = texts.toDF(name).filter(F.col(name).isNotNull()).distinct().withColumn("box", _boxes()(F.col(name))).filter(box.isNotNull())
    return out.select(name, box.alias(f"{name}_box"), level.alias(f"{name}_level"))


def _cell(x: Column, level: Column) -> Column:
    at = x / F.pow(F.lit(2.0), level.cast("double"))
    return F.when(level == TOP, F.lit(0.0)).otherwise(F.floor(F.greatest(F.least(at, F.lit(MOST)), F.lit(-MOST))).cast("double"))


def _candidates(large: DataFrame, a: str, small: DataFrame, b: str, strict: bool) -> DataFrame:
    """Pairs with meeting boxes where b's level is a's at most, or is less. b is in the cell of its south-west corner, a in every cell where the
    corner of a box so small can be that meets its own: so each pair is in one cell. b has one cell for each level that large has."""
    box, level = F.col(f"{a}_box"), F.col(f"{a}_level")
    side = F.pow(F.lit(2.0), level.cast("double"))
    cells = lambda low, high: F.transform(F.sequence(F.lit(0), (_cell(high, level) - _cell(low - side, level)).cast("int")), lambda i: _cell(low - side, level) + i)
    dealt = large.withColumn("__x", F.explode(cells(box["w"], box["e"]))).withColumn("__y", F.explode(cells(box["s"], box["n"]))).withColumn("__level", level)
    levels = large.select(level.alias("__level")).distinct()
    own = F.col(f"{b}_level")
    corner = small.join(F.broadcast(levels), own < F.col("__level") if strict else own <= F.col("__level"))
    corner = corner.withColumn("__x", _cell(F.col(f"{b}_box.w"), F.col("__level"))).withColumn("__y", _cell(F.col(f"{b}_box.s"), F.col("__level")))
    other = F.col(f"{b}_box")
    meet = (box["w"] <= other["e"]) & (other["w"] <= box["e"]) & (box["s"] <= other["n"]) & (other["s"] <= box["n"])
    return dealt.join(corner, ["__level", "__x", "__y"]).filter(meet)


def intersecting(left: DataFrame, right: DataFrame, l_name: str, r_name: str) -> DataFrame:
    """The distinct pairs of shapes that intersect, of two frames with one column of GeoJSON texts each. Only shapes whose boxes meet are compared."""
    one, two = _shapes(left, l_name), _shapes(right, r_name)
    near = [_candidates(one, l_name, two, r_name, False).select(l_name, r_name), _candidates(two, r_name, one, l_name, True).select(l_name, r_name)]
    return near[0].union(near[1]).filter(intersects(F.col(l_name), F.col(r_name)))
