"""Geometry as ring arrays: WKT, point in polygon, area.

A polygon is array<array<struct<x,y>>>: all rings of all its parts, closed, in
any direction; a point is inside if it lies within an odd number of rings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def point_wkt(lon: Column | str, lat: Column | str) -> Column:
    """P10: POINT(lon lat), null unless both are there."""
    return F.concat(F.lit("POINT("), F.col(lon).cast("string"), F.lit(" "), F.col(lat).cast("string"), F.lit(")"))


def rings_from_wkt(wkt: Column | str) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON; null if the text is no such geometry.

    A third ordinate is dropped (force 2D).  A ring needs four points at least and must be closed.
    """
    w = F.col(wkt) if isinstance(wkt, str) else wkt
    texts = F.regexp_extract_all(w, F.lit(r"\(([^()]+)\)"), F.lit(1))
    pair = lambda p: F.split(F.trim(p), r"\s+")
    rings = F.transform(texts, lambda r: F.transform(F.split(r, ","), lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("x"), F.get(pair(p), F.lit(1)).try_cast("double").alias("y"))))
    good = w.rlike(r"(?is)^\s*(MULTI)?POLYGON\s*Z?\s*\(") & (F.size(rings) > 0) & F.forall(rings, closed)
    return F.when(good, rings)


def closed(ring: Column) -> Column:
    whole = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return (F.size(ring) >= 4) & whole & (F.element_at(ring, 1) == F.element_at(ring, -1))


def rings_from_geojson(coordinates: Column, multi: bool) -> Column:
    """Rings of GeoJSON coordinates (arrays of numbers)."""
    polygons = coordinates if multi else F.array(coordinates)
    return F.transform(F.flatten(polygons), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def simple(ring: Column) -> Column:
    """no two edges of the ring cross or touch but neighbours at their shared corner."""
    n = F.size(ring) - 1
    side = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    within = lambda a, b, c: (c["x"] >= F.least(a["x"], b["x"])) & (c["x"] <= F.greatest(a["x"], b["x"])) & (c["y"] >= F.least(a["y"], b["y"])) & (c["y"] <= F.greatest(a["y"], b["y"]))

    def cross(i: Column, j: Column) -> Column:
        a, b, c, d = ring[i], ring[i + 1], ring[j], ring[j + 1]
        proper = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
        touch = ((side(a, b, c) == 0) & within(a, b, c)) | ((side(a, b, d) == 0) & within(a, b, d)) | ((side(c, d, a) == 0) & within(c, d, a)) | ((side(c, d, b) == 0) & within(c, d, b))
        return proper | touch

    apart = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exists(F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j > i + 1) & ~((i == 0) & (j == n - 1))), lambda j: cross(i, j)))
    return ~F.exists(apart, lambda x: x)


def valid(rings: Column) -> Column:
    """there, and every ring closed and simple."""
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, lambda r: closed(r) & simple(r)), F.lit(False))


def area(rings: Column) -> Column:
    """Twice-signed areas summed as even-odd for nested rings: the outer ring of most area less the rest of its part.

    Exact for one outer ring with holes, and for parts without holes of either direction
    if outer rings and holes are wound against each other.
    """
    signed = lambda ring: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, i: s + ring[i]["x"] * ring[i + 1]["y"] - ring[i + 1]["x"] * ring[i]["y"]) / 2
    return F.abs(F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda a, b: a + b))


def bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    return {"min_x": F.array_min(F.transform(points, lambda p: p["x"])), "max_x": F.array_max(F.transform(points, lambda p: p["x"])), "min_y": F.array_min(F.transform(points, lambda p: p["y"])), "max_y": F.array_max(F.transform(points, lambda p: p["y"]))}


def on_edge(rings: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on a ring."""

    def hit(ring: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: _on(ring[i], ring[i + 1], x, y))

    return F.exists(rings, hit)


def _on(a: Column, b: Column, x: Column, y: Column) -> Column:
    straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
    return straight & (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))


def _crossings(rings: Column, x: Column, y: Column) -> Column:
    """Edges to the right of the point, over all rings."""

    def edges(ring: Column) -> Column:
        over = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"])
        return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: over(ring[i], ring[i + 1])))

    return F.aggregate(F.transform(rings, edges), F.lit(0), lambda a, b: a + b)


def within(rings: Column, x: Column, y: Column) -> Column:
    """Inside, and not on the boundary."""
    return (_crossings(rings, x, y) % 2 == 1) & ~on_edge(rings, x, y)


def intersects(rings: Column, x: Column, y: Column) -> Column:
    """Inside or on the boundary."""
    return (_crossings(rings, x, y) % 2 == 1) | on_edge(rings, x, y)
