"""Batches of host writes: insert, change memory, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators.lookup import asked_rows
from fleetlens.operators.ordering import bucket_sums, join_unique
from fleetlens.operators.outcomes import Change, greatest_id, outcome
from fleetlens.operators.views import Catalog


def _judged(catalog: Catalog, requests: DataFrame) -> DataFrame:
    """Requests with the parsed memory, whether it is usable, and whether the host is known."""
    memory = E.strict_int(F.col("memory"))
    limit = S.HOST.field("name").limit
    bad = memory.isNull() | F.col("name").isNull() | E.too_long(F.col("name"), limit)
    read = requests.select("request_id", "name", memory.alias("memory"), bad.alias("bad"))
    known = asked_rows(catalog["host"], requests, ["name"]).select("name").distinct()
    judged = join_unique(read, known.withColumn("known", F.lit(True)), ["name"])
    return judged.withColumn("known", F.coalesce("known", F.lit(False)))


def insert_hosts(catalog: Catalog, requests: DataFrame) -> Change:
    """Add hosts. Of several valid requests for a name the lowest id wins."""
    host = catalog["host"]
    judged = _judged(catalog, requests)
    winners = (
        judged.where(~F.col("bad") & ~F.col("known"))
        .groupBy("name")
        .agg(F.min(F.struct("request_id", "memory")).alias("first"))
        .select("first.request_id", "name", "first.memory")
    )
    added = bucket_sums(winners, "request_id", {"_nth": F.lit(1)}).select(
        (F.col("_nth") + greatest_id(host) + 1).alias("id"), "name", "memory"
    )
    won = winners.select("request_id", F.lit(True).alias("_won"))
    status = (
        F.when(F.col("bad"), S.BAD_REQUEST).when(F.col("_won"), S.CREATED).otherwise(S.CONFLICT)
    )
    outcomes = outcome(judged.join(won, "request_id", "left"), status)
    return Change({"host": host.unionByName(added)}, outcomes, {"host": added}, append_only=True)


def update_hosts(catalog: Catalog, requests: DataFrame) -> Change:
    """Set the memory. Of several valid requests for a host the highest id counts."""
    host = catalog["host"]
    judged = _judged(catalog, requests)
    latest = (
        judged.where(~F.col("bad"))
        .groupBy("name")
        .agg(F.max_by("memory", "request_id").alias("_memory"))
    )
    merged = host.join(latest, "name", "left")
    updated = merged.select("id", "name", F.coalesce("_memory", "memory").alias("memory"))
    changed = merged.where(F.col("_memory").isNotNull()).select(
        "id", "name", F.col("_memory").alias("memory")
    )
    status = F.when(F.col("bad"), S.BAD_REQUEST).when(F.col("known"), S.OK).otherwise(S.NOT_FOUND)
    return Change({"host": updated}, outcome(judged, status), {"host": changed})


def delete_hosts(catalog: Catalog, requests: DataFrame) -> Change:
    """Remove hosts by name."""
    host = catalog["host"]
    judged = _judged(catalog, requests.select("request_id", "name", F.lit("0").alias("memory")))
    gone = requests.select("name").distinct()
    status = F.when(F.col("known"), S.OK).otherwise(S.NOT_FOUND)
    return Change(
        {"host": host.join(gone, "name", "left_anti").select(*S.HOST.columns)},
        outcome(judged, status),
        {"host": host.join(gone, "name", "left_semi").select(*S.HOST.columns)},
    )
