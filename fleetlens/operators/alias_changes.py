"""Batches of alias writes against the pool of DNS names: allocate, release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators.lookup import asked_rows, free_pool
from fleetlens.operators.ordering import join_unique, row_numbers
from fleetlens.operators.outcomes import Change, outcome
from fleetlens.operators.views import Catalog

ALIASES = "functional_aliases"


def allocate_aliases(
    catalog: Catalog, requests: DataFrame, db_name_limit: int | None = None
) -> Change:
    """Give each new db_name the next free DNS name, in request order.

    The n-th request that takes a name gets the n-th free one. When the last
    free name is gone every later request is told so, also a repeated one.
    ``db_name_limit`` refuses longer names (the table declares 8).
    """
    aliases = catalog[ALIASES]
    taken = aliases.where(F.col("db_name").isNotNull()).select(F.col("db_name").alias("_taken"))
    judged = requests.select(
        "request_id",
        "db_name",
        "alias",
        (F.col("alias").isNull() | F.col("db_name").isNull()).alias("bad"),
        (
            E.too_long(F.col("db_name"), db_name_limit)
            | E.too_long(F.col("alias"), S.FUNCTIONAL_ALIASES.field("alias").limit)
        ).alias("long"),
    )
    firsts = (
        judged.where(~F.col("bad") & ~F.col("long"))
        .groupBy("db_name")
        .agg(F.min(F.struct("request_id", "alias")).alias("first"))
        .join(taken, F.col("db_name") == F.col("_taken"), "left_anti")
        .select("first.request_id", "db_name", "first.alias")
    )
    free = row_numbers(free_pool(aliases).select("dns_name"), ["dns_name"])
    wanted = row_numbers(firsts, ["request_id"])
    given = wanted.join(free, "rank").select("request_id", "dns_name", "db_name", "alias")

    # One row: how many names were free, how many were given, the last request served.
    served = given.agg(
        F.count(F.lit(1)).alias("n"), F.max("request_id").alias("last")
    ).first()
    n_free = free.count()
    if n_free == 0:
        empty = F.lit(True)
    elif served["n"] == n_free:
        empty = F.col("request_id") > F.lit(served["last"])
    else:
        empty = F.lit(False)
    won = given.select("request_id", F.lit(True).alias("_won"))
    status = (
        F.when(F.col("bad"), S.BAD_REQUEST)
        .when(F.col("_won"), S.CREATED)
        .when(empty, S.SERVICE_UNAVAILABLE)
        .when(F.col("long"), S.BAD_REQUEST)
        .otherwise(S.CONFLICT)
    )
    outcomes = outcome(judged.join(won, "request_id", "left"), status)
    new = given.select(
        "dns_name", F.col("db_name").alias("_db_name"), F.col("alias").alias("_alias")
    )
    updated = aliases.join(new, "dns_name", "left").select(
        "dns_name",
        F.coalesce("_db_name", "db_name").alias("db_name"),
        F.coalesce("_alias", "alias").alias("alias"),
    )
    changed = given.select("dns_name", "db_name", "alias")
    return Change({ALIASES: updated}, outcomes, {ALIASES: changed})


def release_aliases(catalog: Catalog, requests: DataFrame) -> Change:
    """Free the DNS name of each db_name; of several the smallest."""
    aliases = catalog[ALIASES]
    asked = asked_rows(aliases, requests, ["db_name"])
    smallest = asked.groupBy("db_name").agg(F.min("dns_name").alias("_dns_name"))
    judged = join_unique(requests.select("request_id", "db_name"), smallest, ["db_name"])
    released = smallest.select(
        F.col("_dns_name").alias("dns_name"), F.lit(True).alias("_released")
    )
    kept = F.col("_released").isNull()
    updated = aliases.join(released, "dns_name", "left").select(
        "dns_name",
        F.when(kept, F.col("db_name")).alias("db_name"),
        F.when(kept, F.col("alias")).alias("alias"),
    )
    nothing = F.lit(None).cast("string")
    changed = released.select("dns_name", nothing.alias("db_name"), nothing.alias("alias"))
    status = F.when(F.col("_dns_name").isNotNull(), S.NO_CONTENT).otherwise(S.BAD_REQUEST)
    return Change({ALIASES: updated}, outcome(judged, status), {ALIASES: changed})
