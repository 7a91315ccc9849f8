"""Finding, renaming, composing and shaping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, plain_name
from ..sources.tables import written

# Columns by role, and their usual names.
ALIASES = {
    "state_name": ["state", "negeri", "nama_negeri", "nm_negeri"],
    "state_code": ["kod_negeri", "negeri_kod", "state_kod"],
    "district_name": ["district", "daerah", "nama_daerah", "nm_daerah"],
    "district_code": ["kod_daerah", "daerah_kod", "district_kod"],
    "mukim_name": ["mukim", "nama_mukim", "nm_mukim"],
    "mukim_code": ["kod_mukim", "mukim_kod"],
    "locality_name": ["locality", "city", "town", "bandar", "pekan", "nama_bandar"],
    "postcode": ["postcode", "poskod", "postal_code", "zip", "zip_code"],
    "premise_no": ["house_no", "house_number", "no_rumah", "nombor_rumah", "building_no"],
    "lot_no": ["lot", "lot_number", "no_lot", "nombor_lot"],
    "unit_no": ["unit", "unit_number", "no_unit", "nombor_unit"],
    "street_name": ["street", "road_name", "nama_jalan", "jalan"],
    "building_name": ["building", "premise_name", "nama_premis", "nama_premi"],
    "address_type": ["building_type", "property_type", "jenis_bangunan"],
    "country": ["negara"],
}
ADDRESS = ["address", "full_address", "fulladdress", "addr", "alamat_penuh", "alamat", "old_address", "raw_address"]
NEW_ADDRESS = ["new_address", "alamat_baru", "alamatbaru", "address_new"]
PARTS = ["premise_no", "house_no", "lot_no", "unit_no", "building_name", "street_name", "locality_name", "mukim_name", "district_name", "state_name", "postcode", "country"]
LATITUDE = ["latitude", "lat", "y", "coord_lat", "lat_deg", "latitude_deg"]
LONGITUDE = ["longitude", "lon", "lng", "long", "x", "coord_lon", "lon_deg", "lng_deg", "longitude_deg"]


def detect(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column, whatever its case, or by letters and digits only."""
    lower, plain = {c.lower(): c for c in columns}, {plain_name(c): c for c in columns}
    for name in candidates:
        if found := lower.get(name.lower()) or plain.get(plain_name(name)):
            return found
    return None


def detect_address(columns: list[str], candidates: list[str] = ADDRESS) -> str | None:
    """As detect; else the one column whose name tells that it holds addresses."""
    if found := detect(columns, candidates):
        return found

    def speaks(name: str) -> bool:
        n = plain_name(name)
        other = any(t in n for t in ("addresstype", "addresssource", "addressid")) or n == "addressclean" or "address" in n and ("new" in n or "old" in n)
        return not other and ("alamat" in n or n == "address" or any(t in n for t in ("addressline", "fulladdress", "rawaddress")))

    found = [c for c in columns if speaks(c)]
    return found[0] if len(found) == 1 else None


def canonical_names(df: DataFrame, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """Usual names become canonical ones, unless those are there; codes become texts."""
    for name, usual in ALIASES.items():
        if name not in df.columns and (found := detect(df.columns, (overrides or {}).get(name, usual))):
            df = df.withColumnRenamed(found, name)
    return df.withColumns({c: F.col(c).cast("string") for c in ("state_code", "district_code", "mukim_code") if c in df.columns})


def composed(parts: list[str]) -> Column:
    """The cleaned parts, comma-joined; null if there are none."""
    return F.nullif(F.concat_ws(", ", *[clean(c) for c in parts]), F.lit(""))


def chosen_address(df: DataFrame, old: str, new: str | None = None) -> DataFrame:
    """P5: source_address_old and _new, the one to parse, its source, and whether there is none."""
    df = df.withColumn("source_address_old", clean(old)).withColumn("source_address_new", clean(new) if new else F.lit(None).cast("string"))
    return df.withColumns({
        "address_for_parse": F.coalesce("source_address_new", "source_address_old"),
        "address_source": F.when(F.col("source_address_new").isNotNull(), "new").otherwise("old"),
        "is_missing_address": F.coalesce("source_address_new", "source_address_old").isNull(),
    })


def preferred(parsed: str, given: str, given_first: bool = False) -> Column:
    """The parsed or the given component, whichever comes first and is there."""
    a, b = F.col(parsed), clean(given)
    return F.coalesce(b, a) if given_first else F.coalesce(a, b)


def record_id(*columns: str) -> Column:
    """Equal for equal rows."""
    return F.concat(F.lit("rec-"), F.lower(F.hex(F.xxhash64(*columns))))


def numbered(df: DataFrame, *order: str | Column, within: list[str] = (), name: str = "_row_id") -> DataFrame:
    """Row numbers from 0 in an order that has no ties, within equal values of columns, without bringing rows together.

    Without an order the rows keep the one they are read in.  Rows are sorted by
    range over all tasks and written down with their places, so that a lost
    executor changes no number; each task's rows of a group then get the count
    of the group's rows in the tasks before.
    """
    by = [*within, *order]
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by) if order else df
    parts = written(parts.withColumn("_pos", F.monotonically_increasing_id()))
    task = F.shiftright("_pos", 33)
    starts = parts.groupBy(*within, task.alias("_task")).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    # a row for each task and group in it
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*within).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(*[F.col(c).alias(f"_g_{c}") for c in within], F.col("_task"), (before - F.col("_first")).alias("_shift"))
    on = F.shiftright(parts["_pos"], 33) == F.col("_task")
    for c in within:
        on &= parts[c].eqNullSafe(F.col(f"_g_{c}"))
    out = parts.join(starts, on).withColumn("_number", F.col("_pos") + F.col("_shift"))
    return out.drop("_pos", "_task", "_shift", name, *[f"_g_{c}" for c in within]).withColumnRenamed("_number", name)


def projected(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the columns that are there, in this order."""
    return df.select([c for c in names if c in df.columns])


def adaptive(own: DataFrame, other: DataFrame, names: list[str], prefix: str = "_o_") -> list[Column]:
    """Each column from whichever side has it, own first."""
    out = []
    for c in names:
        sides = [F.col(c)] * (c in own.columns) + [F.col(prefix + c)] * (c in other.columns)
        if sides:
            out.append(F.coalesce(*sides).alias(c))
    return out


def defaults(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Columns, and values where they are null or absent."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in values.items()})


def without(df: DataFrame, *names: str) -> DataFrame:
    """Without these and without columns that begin with an underscore."""
    return df.drop(*names, *[c for c in df.columns if c.startswith("_")])


def overlaid(df: DataFrame, new: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Values of new by key, where it has one, over those of df; of several rows of a key the least counts."""
    usable = [c for c in names if c in new.columns]
    values = F.struct(*usable) if usable else F.lit(None)
    new = new.groupBy(key).agg(F.min(values).alias("_least")).select(key, *[F.col(f"_least.{c}").alias(c) for c in usable])
    over = new.select(key, *[F.col(c).alias(f"_over_{c}") for c in usable])
    return df.join(over, key, "left").select(*[F.coalesce(f"_over_{c}", c).alias(c) if c in usable else F.col(c) for c in df.columns], *[F.col(f"_over_{c}").alias(c) for c in usable if c not in df.columns])


def best_score(*columns: str) -> Column:
    """The greatest score, nulls left out."""
    return F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])


def integer_field(payload: str, name: str) -> Column:
    """A field of JSON as a number if it has digits only."""
    text = F.get_json_object(payload, f"$.{name}")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
