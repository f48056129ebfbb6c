"""Validation of event batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIXES = ("ingestion.", "vision.", "analytics.")
#: Fields of an event, and the longest text of some.
FIELDS = ("event_id", "event_type", "schema_version", "tenant_id", "store_id", "occurred_at", "correlation_id", "causation_id", "idempotency_key", "aggregate", "payload")
LONGEST = {"schema_version": 16, "correlation_id": 64, "causation_id": 64, "idempotency_key": 256}
MOST_EVENTS = 500
UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def schema_errors(batch: DataFrame) -> Column:
    """Breaches of the event's form by the columns that are there: lengths, version, unknown fields (body, the raw JSON), size of the request (request_size). (V-07)"""
    out = [
        F.when(~F.coalesce(F.length("event_type").between(3, 128), F.lit(False)), "invalid_length"),
        F.when(~F.coalesce("schema_version", F.lit("1.0.0")).rlike(r"^[0-9]+(\.[0-9]+)+$"), "invalid_schema_version"),
    ]
    out += [F.when(F.length(c) > n, f"{c}_too_long") for c, n in LONGEST.items() if c in batch.columns]
    if "body" in batch.columns:
        out.append(F.when(F.size(F.array_except(F.json_object_keys("body"), F.array(*map(F.lit, FIELDS)))) > 0, "extra_fields"))
    if "request_size" in batch.columns:
        out.append(F.when(~F.col("request_size").between(1, MOST_EVENTS), "invalid_batch_size"))
    return F.array_compact(F.array(*out))


def _ordinal(batch: DataFrame, key: str, valid: Column, spread: str = "idx") -> Column:
    """Number of a row among the rows of its key that count, in order of idx. Rows without a key are keyed by idx, so they don't meet."""
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.concat(F.lit("#"), F.col(spread).cast("string")))
    return F.sum(valid.cast("int")).over(Window.partitionBy(own).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))


def validate(batch: DataFrame, stores: DataFrame, uuids: bool = False) -> DataFrame:
    """batch (idx, event_id, event_type, schema_version, tenant_id, store_id, idempotency_key, payload) with errors and defaults. (V-01..V-07, V-10, S-19)

    stores (known_store, known_tenant, perhaps deleted_at) is a small dimension; deleted ones
    aren't found. The store is looked up only for rows without other errors. A row repeats
    another one of the batch only if that one is valid itself. uuids: whether ids of stores
    have to be UUIDs. Errors come as an array; a row is valid if it is empty. session_id and
    correlation_id take their defaults from the payload and from default_correlation.
    """
    sid = F.coalesce("store_id", F.get_json_object("payload", "$.store_id"))
    known = stores.where("deleted_at is null").drop("deleted_at") if "deleted_at" in stores.columns else stores
    b = batch.withColumn("store_id", sid).join(F.broadcast(known), F.col("store_id") == F.col("known_store"), "left")
    prefix = F.lit(False)
    for p in PREFIXES:
        prefix = prefix | F.coalesce(F.startswith(F.col("event_type"), F.lit(p)), F.lit(False))
    good_id = F.col("store_id").rlike(UUID) if uuids else F.lit(True)
    form = F.concat(
        F.array_compact(F.array(F.when(~prefix, "invalid_event_type"))), schema_errors(batch),
    )
    store = F.array_compact(F.array(
        F.when(F.col("store_id").isNull() | ~good_id, "invalid_store_id"),
        F.when((F.size("form") == 0) & F.col("store_id").isNotNull() & good_id & F.col("known_store").isNull(), "store_not_found"),
        F.when((F.size("form") == 0) & F.col("tenant_id").isNotNull() & (F.col("tenant_id") != F.col("known_tenant")), "tenant_store_mismatch"),
    ))
    b = b.withColumn("form", form).withColumn("place", store)
    # First among valid rows wins: a row that is invalid in itself doesn't make later ones repeats.
    sound = (F.size("form") == 0) & (F.size("place") == 0)
    b = b.withColumn("again_id", F.col("event_id").isNotNull() & (F.coalesce(_ordinal(b, "event_id", sound), F.lit(0)) > 0))
    b = b.withColumn("again_key", (F.coalesce("idempotency_key", F.lit("")) != "") & (F.coalesce(_ordinal(b, "idempotency_key", sound & ~F.col("again_id")), F.lit(0)) > 0))
    repeats = F.array_compact(F.array(F.when(F.col("again_id"), "duplicate_event_id_in_batch"), F.when(F.col("again_key"), "duplicate_idempotency_key_in_batch")))
    # A repeat's store isn't looked up.
    errors = F.concat("form", repeats, F.when(F.size(repeats) == 0, F.col("place")).otherwise(F.filter("place", lambda x: x == "invalid_store_id")))
    ok = F.size("errors") == 0
    out = b.withColumn("errors", errors).withColumn("tenant_id", F.coalesce("tenant_id", "known_tenant")).withColumn("status", F.when(ok, "accepted").otherwise("rejected"))
    out = out.withColumn("session_id", F.nullif(F.get_json_object("payload", "$.session_id"), F.lit("")))
    given = [F.col(c) for c in ("correlation_id", "default_correlation") if c in batch.columns]
    if given:
        out = out.withColumn("correlation_id", F.coalesce(*given))
    return out.drop("form", "place", "again_id", "again_key", "known_store", "known_tenant")


def messages(statuses: DataFrame) -> DataFrame:
    """Rows of a pre-flight check: the valid ones have no message. (V-08, V-11)"""
    return statuses.select("idx", "status", F.when(F.size("errors") > 0, F.concat(F.lit("event["), F.col("idx").cast("string"), F.lit("]: "), F.array_join("errors", ", "))).alias("message"))


def summary(statuses: DataFrame) -> DataFrame:
    """Counts and the response code of a batch. (V-08, V-09, K-05)"""
    ok, no, twice = (F.count_if(x) for x in (F.col("status") == "accepted", F.col("status") == "rejected", F.col("status") == "duplicate"))
    return statuses.agg(ok.alias("accepted"), no.alias("rejected"), twice.alias("duplicate"), F.when(no == 0, 202).when(ok + twice == 0, 422).otherwise(207).alias("code"))


# ------------------------------------------------------------ payloads as VARIANT
def parsed(events: DataFrame, payload: str = "payload") -> DataFrame:
    """events whose JSON payload is a VARIANT: parsed once, whatever is read from it. Text that is no JSON is null. (V-10)"""
    return events.withColumn(payload, F.try_parse_json(payload))


def payload_field(path: str, kind: str, payload: str = "payload") -> Column:
    """A field of a parsed payload as `kind`, null where it is missing or is something else. (F-14, F-16)"""
    return F.try_variant_get(payload, path, kind)


def payload_items(path: str, payload: str = "payload") -> Column:
    """Length of a list in a parsed payload; 0 where there is none. (F-15)"""
    return F.coalesce(F.size(F.try_variant_get(payload, path, "array<variant>")), F.lit(0))
