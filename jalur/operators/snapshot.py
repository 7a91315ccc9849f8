"""Tables as snapshots: upserts, versions, keys, aliases, reviews, claims.

A change is a new snapshot of the whole table; sources.writers.swap puts it in
the old one's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import sql_key, squeezed
from ..sources.tables import swap, written
from .dedupe import first_rows, key_of_first, latest, surrogate
from .lookup import dimension

# The parts of the key of an address.
KEY_TEXTS = ["premise_no", "building_name", "floor_level", "unit_no", "lot_no"]
KEY_IDS = ["street_id", "locality_id", "mukim_id", "district_id", "state_id", "postcode_id", "pbt_id"]
ALIAS_PARTS = [*KEY_TEXTS, "street_name_prefix", "street_name", "locality_name", "postcode", "district_name", "state_name"]


def upserted(old: DataFrame, staged: DataFrame, keys: list[str], values: list[str], id_col: str | None = None, keep_if_null: list[str] = ()) -> DataFrame:
    """Old with new values by key, and the keys that are new, with ids from the greatest on; nothing is deleted.

    keep_if_null: values that a staged null doesn't replace.  Keys are unique on either side.
    """
    new = staged.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    both = old.join(new, keys, "left")
    updated = both.select(*[(F.coalesce(f"_n_{c}", c) if c in keep_if_null else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c))).alias(c) if c in values else F.col(c) for c in old.columns])
    added = staged.join(old.select(*keys), keys, "left_anti").select(*keys, *values)
    if id_col:
        added = surrogate(added, old, id_col, keys)
    return updated.unionByName(added, allowMissingColumns=True)


def guarded(status: str, apply: bool) -> str:
    """M4: what happens to a batch: blocked, applied or dry_run."""
    return "blocked" if status == "blocked" else "applied" if apply else "dry_run"


def apply_refresh(status: str, apply: bool, snapshot: DataFrame, path: str) -> str:
    """M4: the new snapshot takes the table's place if the batch isn't blocked and is to be applied; what happened."""
    outcome = guarded(status, apply)
    if outcome == "applied":
        swap(snapshot, path)
    return outcome


def rejected(rows: DataFrame, existing: DataFrame, keys: list[str], required: list[str], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows with problem, an array: missing_COLUMN, duplicate (the keys are there already, or twice among rows), unknown_PARENT.

    parents: a column and the table that must have its value, in a column of that name; a null value has no parent to miss.
    """
    there = existing.select(*[F.col(k).alias(f"_e_{k}") for k in keys]).distinct().withColumn("_there", F.lit(True))
    twice = rows.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg((F.count("*") > 1).alias("_twice"))
    out, on, same = rows, F.lit(True), F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"_e_{k}")
        same &= F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    out = out.join(there, on, "left").join(twice, same, "left")
    found = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing_{c}")) for c in required]
    found.append(F.when(F.coalesce("_there", "_twice", F.lit(False)), F.lit("duplicate")))
    for c, table in (parents or {}).items():
        known = table.select(F.col(c).alias(f"_p_{c}")).distinct().withColumn(f"_known_{c}", F.lit(True))
        out = out.join(dimension(known), F.col(c) == F.col(f"_p_{c}"), "left")
        found.append(F.when(F.col(c).isNotNull() & F.col(f"_known_{c}").isNull(), F.lit(f"unknown_{c}")))
    return out.withColumn("problem", F.array_compact(F.array(*found))).select(*rows.columns, "problem")


def changed(old: DataFrame, rows: DataFrame, keys: list[str], required: list[str], paths: list[str], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table with new rows, put into each of the places it is kept in; an error, and no change, if a row is rejected."""
    bad = rejected(rows, old, keys, required, parents).where(F.size("problem") > 0).limit(5).collect()
    if bad:
        raise ValueError(f"rejected: {[tuple(r) for r in bad]}")
    new = written(old.unionByName(rows, allowMissingColumns=True))
    for path in paths:
        swap(new, path)
    return new


def canonical_key() -> Column:
    """SHA-256 of the parts, bar-joined."""
    return F.sha2(F.concat_ws("|", *[sql_key(c) for c in KEY_TEXTS], *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY_IDS], sql_key("country")), 256)


def keyed(addresses: DataFrame) -> DataFrame:
    """canonical_address_key, on the first address of each key."""
    return key_of_first(addresses.withColumn("canonical_address_key", canonical_key()), "canonical_address_key", "address_id")


def alias_rows(addresses: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Raw and normalised text of each address (already joined with its names), and the checksum.

    Of the same checksum the first address stays, and those that exist already are left out.
    """
    raw = F.trim(F.concat_ws(", ", *[F.col(c).cast("string") for c in ALIAS_PARTS if c in addresses.columns]))
    rows = addresses.select("address_id", raw.alias("raw_address_variant")).withColumn("normalized_address_variant", F.upper(F.trim(squeezed("raw_address_variant"))))
    rows = first_rows(rows.withColumn("alias_checksum", F.sha2("normalized_address_variant", 256)), ["alias_checksum"], [F.col("address_id")])
    return rows if existing is None else rows.join(existing.select("alias_checksum").distinct(), "alias_checksum", "left_anti").select(*rows.columns)


def version(features: DataFrame, version_id: int, kind: str, label: str) -> tuple[DataFrame, DataFrame]:
    """M8: a draft version's row, and its features numbered in order."""
    rows = features.withColumns({"version_id": F.lit(version_id), "boundary_type": F.lit(kind)})
    head = rows.groupBy("version_id", "boundary_type").agg(F.count("*").alias("row_count")).withColumns({"version_label": F.lit(label), "status": F.lit("draft")})
    return head, rows


def invalid_features(features: DataFrame, wkt: str = "boundary_wkt") -> DataFrame:
    """Features without a geometry, and with one that isn't valid."""
    rings = geo.rings_from_wkt(wkt)
    there = F.trim(F.coalesce(F.col(wkt), F.lit(""))) != ""
    return features.agg(F.count_if(~there).alias("missing_geometry"), F.count_if(there & ~geo.valid(rings)).alias("invalid_geometry"))


def activated(versions: DataFrame, features: DataFrame, version_id: int) -> tuple[DataFrame, DataFrame]:
    """M9: versions with this one active and the active one of its type superseded; the features that are now the layer."""
    kind = versions.where(F.col("version_id") == version_id).select(F.col("boundary_type").alias("_t"))
    rows = versions.join(dimension(kind), F.col("boundary_type") == F.col("_t"), "left")
    status = F.when(F.col("version_id") == version_id, "active").when(F.col("_t").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_t"), features.where(F.col("version_id") == version_id)


def activate(versions: DataFrame, features: DataFrame, version_id: int, wkt: str = "boundary_wkt") -> tuple[DataFrame, DataFrame]:
    """M9: activated(), unless the version isn't there, has no feature, or has one without a valid geometry: then an error."""
    if versions.where(F.col("version_id") == version_id).isEmpty():
        raise ValueError(f"there is no version {version_id}")
    own = features.where(F.col("version_id") == version_id)
    missing, invalid = invalid_features(own, wkt).first()
    if missing or invalid or own.isEmpty():
        raise ValueError(f"version {version_id} can't be active: {missing} features without a geometry, {invalid} with an invalid one")
    return activated(versions, features, version_id)


def reviewed(reviews: DataFrame, decisions: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews with decisions (review_id, decision approve or reject, reviewed_by) carried out where they're open, and aliases with those of the approved."""
    first = first_rows(decisions, ["review_id"], [F.col("decision")]).select("review_id", F.col("decision").alias("_d"), F.col("reviewed_by").alias("_by"))
    rows = reviews.join(first, "review_id", "left").withColumn("_done", (F.col("status") == "open") & F.col("_d").isNotNull())
    out = rows.withColumns({"status": F.when(F.col("_done"), F.when(F.col("_d") == "approve", "approved").otherwise("rejected")).otherwise(F.col("status")), "reviewed_by": F.when(F.col("_done"), F.col("_by")).otherwise(F.col("reviewed_by"))})
    new = rows.where(F.col("_done") & (F.col("_d") == "approve")).select("address_id", "alias_checksum")
    new = first_rows(new, ["alias_checksum"], [F.col("address_id")]).join(aliases.select("alias_checksum"), "alias_checksum", "left_anti").select("address_id", "alias_checksum")
    return out.drop("_d", "_by", "_done"), aliases.unionByName(new, allowMissingColumns=True)


def merged_jobs(old: DataFrame, new: DataFrame, key: str = "job_id", first: list[str] = ("created_at", "agency_id")) -> DataFrame:
    """The newest row of each key, with the first values of some columns kept; rows of new are the newest by updated_at."""
    keep = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in first])
    fresh = latest(new, [key], "updated_at", [c for c in new.columns if c != "updated_at"])
    updated = fresh.join(keep, key, "left").withColumns({c: F.coalesce(f"_o_{c}", c) for c in first}).drop(*[f"_o_{c}" for c in first])
    return old.join(fresh.select(key), key, "left_anti").unionByName(updated, allowMissingColumns=True)


def claimed(jobs: DataFrame, wanted: DataFrame, worker: Column) -> DataFrame:
    """Queued jobs that are wanted become running; others stay."""
    rows = jobs.join(wanted.select("job_id").distinct().withColumn("_w", F.lit(True)), "job_id", "left").withColumn("_take", F.coalesce(F.col("_w") & (F.col("status") == "queued"), F.lit(False)))
    return rows.withColumns({"status": F.when(F.col("_take"), "running").otherwise(F.col("status")), "claimed_by": F.when(F.col("_take"), worker).otherwise(F.col("claimed_by") if "claimed_by" in jobs.columns else F.lit(None))}).drop("_w", "_take")


def idempotent(requests: DataFrame, key: str, fingerprint: str, order: str) -> DataFrame:
    """Each request as new, replayed (same fingerprint as the first of its key) or conflict (another); a null key is always new.

    The first of each key by a partial aggregate, then a join that AQE can split.
    """
    first = requests.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(fingerprint).alias("f"))).alias("_first"))
    out = requests.join(first, F.col(key) == F.col("_k"), "left")
    return out.withColumn("outcome", F.when(F.col(key).isNull() | (F.col(order) == F.col("_first.o")), "new").when(F.col("_first.f").eqNullSafe(F.col(fingerprint)), "replayed").otherwise("conflict")).drop("_k", "_first")


def revoked(keys: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Keys of these ids are revoked, once."""
    rows = keys.join(ids.select("key_id").distinct().withColumn("_r", F.lit(True)), "key_id", "left").withColumn("_do", F.coalesce(F.col("_r") & (F.col("status") != "revoked"), F.lit(False)))
    return rows.withColumns({"status": F.when(F.col("_do"), "revoked").otherwise(F.col("status")), "revoked_at": F.when(F.col("_do"), at).otherwise(F.col("revoked_at"))}).drop("_r", "_do")


def issued(keys: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Keys with new ones (key_id, name, key_hash), active; ids that are there already are left out."""
    fresh = new.join(keys.select("key_id"), "key_id", "left_anti").withColumns({"status": F.lit("active"), "created_at": at})
    return keys.unionByName(fresh, allowMissingColumns=True)


def touched(keys: DataFrame, used: DataFrame) -> DataFrame:
    """last_used_at of active keys by the latest use (key_id, at); it never goes back."""
    last = used.groupBy("key_id").agg(F.max("at").alias("_at"))
    out = keys.join(last, "key_id", "left")
    return out.withColumn("last_used_at", F.when(F.col("status") == "active", F.greatest("last_used_at", "_at")).otherwise(F.col("last_used_at"))).drop("_at")


def bootstrap_missing(required: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tables that are asked for and not loaded yet."""
    return required.select("table_name").distinct().join(manifest.select("table_name").distinct(), "table_name", "left_anti")
