"""Point-in-polygon joins by grid cells, and what they fill in.

Boundaries are rows with rings (functions.geo).  Points and polygons meet in an
equi-join on the cells of a grid that a polygon's box covers; the box and then
the exact test decide.  The cell size is such that an average polygon covers a
few cells, so neither side is ever multiplied by the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import postcode, upper_clean
from ..sources.tables import written
from .lookup import dimension

#: Cells of a polygon at most; a larger polygon's cells are wider by powers of two.
CELLS = 64


def boundaries(df: DataFrame, wkt: str = "geom_wkt") -> DataFrame:
    """df with rings and box; rows whose WKT is no polygon are left out."""
    rows = df.withColumn("rings", geo.rings_from_wkt(wkt)).where("rings is not null")
    return rows.withColumns(geo.bounds(F.col("rings")))


def _cell(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("long")


def candidates(points: DataFrame, shapes: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    """Points with the shapes whose box they are in (columns of shapes as they are).

    Each shape is put down at the level of cells, size * 2^level, of which its
    box covers CELLS at most; a point asks once for each level there is.  Cells
    hold a shape's number and box; its rings, which can be large, are fetched by
    number for the pairs that are left.
    """
    shapes = written(shapes.withColumn("_shape", F.monotonically_increasing_id()))
    box = ["min_x", "max_x", "min_y", "max_y"]
    wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide, F.lit(1e-12)) / (size * (int(CELLS**0.5) - 1))))).cast("int")
    put = shapes.select("_shape", *box).withColumn("_level", level).withColumn("_size", F.lit(size) * F.pow(F.lit(2.0), F.col("_level")))
    axis = lambda lo, hi: F.sequence(_cell(F.col(lo), F.col("_size")), _cell(F.col(hi), F.col("_size")))
    put = put.withColumn("_cx", F.explode(axis("min_x", "max_x"))).withColumn("_cy", F.explode(axis("min_y", "max_y"))).drop("_size")
    levels = sorted(r[0] for r in put.select("_level").distinct().collect())  # some dozens at most
    there = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    asked = there.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    asked = asked.withColumn("_s", F.lit(size) * F.pow(F.lit(2.0), F.col("_level"))).withColumns({"_cx": _cell(F.col(lon), F.col("_s")), "_cy": _cell(F.col(lat), F.col("_s"))}).drop("_s")
    inside = (F.col(lon) >= F.col("min_x")) & (F.col(lon) <= F.col("max_x")) & (F.col(lat) >= F.col("min_y")) & (F.col(lat) <= F.col("max_y"))
    pairs = asked.join(dimension(put), ["_level", "_cx", "_cy"]).where(inside).drop("_level", "_cx", "_cy", *box)
    return pairs.join(dimension(shapes.drop(*box)), "_shape").drop("_shape")


def first_within(points: DataFrame, shapes: DataFrame, row_key: str, keep: list[str], order: str = "_ord", lon: str = "longitude", lat: str = "latitude", size: float = 0.25) -> DataFrame:
    """For each row the first shape, in order, that holds its point strictly; rows without one are left out."""
    some = candidates(points.select(row_key, lon, lat), shapes.select("rings", "min_x", "max_x", "min_y", "max_y", order, *[F.col(c).alias(f"_b_{c}") for c in keep]), lon, lat, size)
    hits = some.where(geo.within(F.col("rings"), F.col(lon), F.col(lat)))
    return hits.groupBy(row_key).agg(F.min_by(F.struct(*[f"_b_{c}" for c in keep]), order).alias("_h")).select(row_key, "_h.*")


def smallest_meeting(points: DataFrame, shapes: DataFrame, row_key: str, shape_id: str, lon: str = "longitude", lat: str = "latitude", size: float = 0.25) -> DataFrame:
    """For each row the shape of least area, then id, that its point meets, boundary included."""
    put = shapes.withColumn("_area", geo.area(F.col("rings"))).select("rings", "min_x", "max_x", "min_y", "max_y", "_area", F.col(shape_id).alias("_id"))
    some = candidates(points.select(row_key, lon, lat), put, lon, lat, size)
    hits = some.where(geo.intersects(F.col("rings"), F.col(lon), F.col(lat)))
    return hits.groupBy(row_key).agg(F.min_by("_id", F.struct("_area", "_id")).alias(shape_id))


def _joined(df: DataFrame, hits: DataFrame, row_key: str) -> DataFrame:
    return df.join(hits.withColumnRenamed(row_key, "_hk"), F.col(row_key) == F.col("_hk"), "left").drop("_hk")


def enriched(df: DataFrame, row_key: str = "_row_id", postcodes: DataFrame | None = None, states: DataFrame | None = None, districts: DataFrame | None = None, mukims: DataFrame | None = None, councils: DataFrame | None = None) -> DataFrame:
    """Codes and names from the boundaries that hold the point, where they don't contradict; flags tell which.

    A boundary that agrees with a code counts as its source too.
    """
    flags = ["postcode_from_boundary", "postcode_boundary_conflict", *(f"{x}_{y}" for x in ("state", "district", "mukim") for y in ("from_boundary", "boundary_conflict"))]
    out = df.withColumns({f: F.lit(False) for f in flags})
    if postcodes is not None:
        out = _joined(out, first_within(out, postcodes, row_key, ["postcode", "city", "state"]), row_key)
        hit, own = postcode("_b_postcode"), postcode("postcode_code")
        clash = F.coalesce(hit != own, F.lit(False))
        use = hit.isNotNull() & ~clash
        out = out.withColumns({"postcode_boundary_conflict": clash, "postcode_from_boundary": use, "postcode_city": F.when(use, F.coalesce("postcode_city", upper_clean("_b_city"))).otherwise(F.col("postcode_city")), "postcode_state_name": F.when(use, F.coalesce("postcode_state_name", upper_clean("_b_state"))).otherwise(F.col("postcode_state_name")), "postcode_code": F.when(use, hit).otherwise(F.col("postcode_code"))}).drop("_b_postcode", "_b_city", "_b_state")
    if states is not None and districts is not None and mukims is not None:
        for kind, shapes, more in (("state", states, []), ("district", districts, []), ("mukim", mukims, ["mukim_id"])):
            code, name = f"{kind}_code", f"{kind}_name"
            more = [c for c in more if c in shapes.columns]
            out = _joined(out, first_within(out, shapes, row_key, [code, name, *more]), row_key)
            clash = F.coalesce(F.col(f"_b_{code}").cast("string") != F.col(code).cast("string"), F.lit(False))
            use = F.col(f"_b_{code}").isNotNull() & ~clash
            out = out.withColumns({f"{kind}_boundary_conflict": clash, f"{kind}_from_boundary": use})
            use = F.col(f"{kind}_from_boundary")
            out = out.withColumns({code: F.when(use, F.col(f"_b_{code}")).otherwise(F.col(code)), name: F.when(use, upper_clean(f"_b_{name}")).otherwise(F.col(name)), **{c: F.when(use, F.col(f"_b_{c}")).otherwise(F.col(c)) for c in more}}).drop(f"_b_{code}", f"_b_{name}", *[f"_b_{c}" for c in more])
    if councils is not None:
        out = _joined(out, first_within(out, councils, row_key, ["pbt_id", "pbt_name"]), row_key)
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in ("pbt_id", "pbt_name")}).drop("_b_pbt_id", "_b_pbt_name")
    return out


def reassigned(addresses: DataFrame, layers: dict[str, DataFrame], key: str = "address_id", preserve: bool = True) -> DataFrame:
    """Key, and for each id column of layers the new id beside the old one (old_*); unmatched ids stay or become null."""
    out = addresses.select(key, "longitude", "latitude", *[F.col(c).alias(f"old_{c}") for c in layers])
    for column, shapes in layers.items():
        out = _joined(out, smallest_meeting(out, shapes, key, column), key)
        if preserve:
            out = out.withColumn(column, F.coalesce(column, f"old_{column}"))
    return out.drop("longitude", "latitude")


def change_counts(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, rows with any change, and changes of each id; nulls are values."""
    changed = {c: ~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in columns}
    either = F.lit(False)
    for c in changed.values():
        either |= c
    return pairs.agg(F.count("*").alias("total_rows"), F.count_if(either).alias("changed_rows"), *[F.count_if(c).alias(f"{n}_changes") for n, c in changed.items()])
