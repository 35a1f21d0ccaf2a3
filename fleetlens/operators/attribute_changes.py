"""Batches of attribute writes on named instances: insert, update, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators.lookup import asked_rows, resolve_instance_id
from fleetlens.operators.ordering import bucket_sums, join_unique
from fleetlens.operators.outcomes import Change, greatest_id, missing_text, outcome
from fleetlens.operators.views import Catalog
from fleetlens.session import stored

KEY = ["instance_id", "name"]
NAME_LIMIT = S.ATTRIBUTE.field("name").limit
VALUE_LIMIT = S.ATTRIBUTE.field("value").limit


def insert_attributes(catalog: Catalog, requests: DataFrame) -> Change:
    """Add the attributes of a JSON object, all of a request or none.

    Requests are judged against the state before the batch. Each attribute goes
    to the lowest valid request that names it; a request that loses one of its
    attributes fails as a whole.
    """
    attribute = catalog["attribute"]
    attributes = F.when(
        E.is_object_text(F.col("body")),
        E.last_entries(F.from_json("body", "map<string,string>")),
    )
    # Names first: the check of the names then reads no body.
    named = resolve_instance_id(
        requests.select("request_id", "db_name", "body"), catalog["instances"]
    )
    parsed = E.computed_once(
        named, {"pairs": attributes}, ["request_id", "instance_id"]
    ).withColumn("n_pairs", F.coalesce(F.size("pairs"), F.lit(0)))
    refused = F.exists(
        "pairs",
        lambda p: p["value"].isNull()
        | E.too_long(p["key"], NAME_LIMIT)
        | E.too_long(p["value"], VALUE_LIMIT),
    )
    judged = stored(
        parsed.withColumn(
            "status",
            F.when(F.col("n_pairs") <= 0, S.BAD_REQUEST)
            .when(F.col("instance_id").isNull(), S.NOT_FOUND)
            .when(refused, S.BAD_REQUEST),
        )
    )
    rows = judged.where(F.col("status").isNull()).select(
        "request_id", "instance_id", "n_pairs", F.posexplode("pairs").alias("pos", "pair")
    )
    rows = rows.select(
        "request_id",
        "instance_id",
        "n_pairs",
        "pos",
        F.col("pair.key").alias("name"),
        F.col("pair.value").alias("value"),
    )
    clashing = rows.join(attribute, KEY, "left_semi").select("request_id").distinct()
    free = rows.join(clashing, "request_id", "left_anti")
    # The least request per attribute by hash; a request names an attribute once.
    claims = free.join(
        free.groupBy(*KEY).agg(F.min("request_id").alias("request_id")), [*KEY, "request_id"]
    )
    won = (
        claims.groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n_won"), F.first("n_pairs").alias("n_all"))
        .where(F.col("n_won") == F.col("n_all"))
        .select("request_id", F.lit(True).alias("_won"), "n_all")
    )
    # A request that has won has all its attributes, so their ids follow one another.
    numbered = bucket_sums(
        won.select("request_id", "n_all"), "request_id", {"_before": F.col("n_all")}
    ).select("request_id", (F.col("_before") + greatest_id(attribute) + 1).alias("_first"))
    added = claims.join(numbered, "request_id").select(
        (F.col("_first") + F.col("pos")).alias("id"), *KEY, "value"
    )
    status = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("_won"), S.CREATED)
        .otherwise(S.CONFLICT)
    )
    won = won.select("request_id", "_won")
    outcomes = outcome(judged.join(won, "request_id", "left"), status, F.col("n_pairs"))
    return Change(
        {"attribute": attribute.unionByName(added)},
        outcomes,
        {"attribute": added},
        append_only=True,
    )


def _addressed(catalog: Catalog, requests: DataFrame) -> DataFrame:
    """Requests with the instance id, and whether the named attribute is there."""
    resolved = resolve_instance_id(requests, catalog["instances"])
    asked = asked_rows(catalog["attribute"], resolved, KEY)
    present = asked.select(*KEY).distinct().withColumn("_present", F.lit(True))
    return join_unique(resolved, present, KEY)


def update_attributes(catalog: Catalog, requests: DataFrame) -> Change:
    """Set one attribute each. The highest valid request of an attribute counts."""
    attribute = catalog["attribute"]
    judged = _addressed(catalog, requests)
    status = (
        F.when(missing_text(F.col("value")), S.BAD_REQUEST)
        .when(F.col("instance_id").isNull(), S.NOT_FOUND)
        .when(E.too_long(F.col("value"), VALUE_LIMIT), S.BAD_REQUEST)
        .when(F.col("_present"), S.NO_CONTENT)
        .otherwise(S.NOT_FOUND)
    )
    valid = judged.withColumn("status", status).where(F.col("status") == S.NO_CONTENT)
    latest = valid.groupBy(*KEY).agg(F.max_by("value", "request_id").alias("_value"))
    merged = attribute.join(latest, KEY, "left")
    updated = merged.select("id", *KEY, F.coalesce("_value", "value").alias("value"))
    changed = merged.where(F.col("_value").isNotNull()).select(
        "id", *KEY, F.col("_value").alias("value")
    )
    return Change({"attribute": updated}, outcome(judged, status), {"attribute": changed})


def delete_attributes(catalog: Catalog, requests: DataFrame) -> Change:
    """Remove one attribute each."""
    attribute = catalog["attribute"]
    judged = _addressed(catalog, requests.select("request_id", "db_name", "name"))
    unnamed = missing_text(F.col("name")) | missing_text(F.col("db_name"))
    status = (
        F.when(unnamed, S.BAD_REQUEST)
        .when(F.col("_present"), S.NO_CONTENT)
        .otherwise(S.NOT_FOUND)
    )
    gone = judged.where(F.col("_present") & ~unnamed).select(*KEY).distinct()
    kept = attribute.join(gone, KEY, "left_anti").select(*S.ATTRIBUTE.columns)
    removed = attribute.join(gone, KEY, "left_semi").select(*S.ATTRIBUTE.columns)
    return Change({"attribute": kept}, outcome(judged, status), {"attribute": removed})
