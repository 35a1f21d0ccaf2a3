"""Read the catalog tables and register their views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens import schemas as S
from fleetlens.operators import aggregates, views
from fleetlens.operators.views import Catalog

# The tables that live outside the catalog and are passed through as views.
PASS_THROUGH = [
    "instances",
    "command_definition",
    "command_params",
    "instance_changes",
    "jobs",
    "upgrades",
    "owners",
]

# The tables that are joined by instance, and the column that names it.
BY_INSTANCE = {"instances": "id", "attribute": "instance_id", "volume": "instance_id"}


def read_catalog(
    spark: SparkSession, path: str, tables: list[str] | None = None
) -> Catalog:
    """The catalog tables under ``path``, one parquet folder each, declared schemas."""
    return {
        name: spark.read.schema(S.TABLES[name].schema).parquet(f"{path}/{name}")
        for name in tables or S.TABLES
    }


def write_by_key(catalog: Catalog, path: str, prefix: str, buckets: int) -> list[str]:
    """Store the tables that are joined by instance in buckets of the instance's id.

    Each becomes a table ``prefix + name`` of the session's catalog with its files
    under ``path``, sorted by the key in each of its buckets. Reads with
    ``read_by_key`` are joined and grouped by instance without a shuffle. The
    number of buckets has to grow with the data, up to some hundred MB each; one
    instance's children are always in one bucket.
    """
    names = [name for name in BY_INSTANCE if name in catalog]
    for name in names:
        key = BY_INSTANCE[name]
        (
            catalog[name]
            .repartition(buckets, key)  # so that each bucket is one sorted file
            .write.mode("overwrite")
            .bucketBy(buckets, key)
            .sortBy(key)
            .option("path", f"{path}/{name}")
            .format("parquet")
            .saveAsTable(prefix + name)
        )
    return [prefix + name for name in names]


def read_by_key(spark: SparkSession, prefix: str) -> Catalog:
    """The tables that ``write_by_key`` stored under this prefix."""
    found = {name: prefix + name for name in BY_INSTANCE if spark.catalog.tableExists(prefix + name)}
    if not found:
        raise ValueError(f"no table of the catalog is stored as {prefix}...")
    return {name: spark.table(table) for name, table in found.items()}


def jdbc_options(
    url: str,
    table: str,
    column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options that split a database scan on ``column`` into range reads."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_jdbc(
    spark: SparkSession, name: str, options: dict[str, str], properties: dict[str, str]
) -> DataFrame:
    """One catalog table of a live database; every task reads one range.

    Filters and column choices reach the database. Types follow the declaration.
    """
    source = spark.read.format("jdbc").options(**options).options(**properties).load()
    return source.to(S.TABLES[name].schema)


def register_views(catalog: Catalog, prefix: str = "") -> list[str]:
    """Register the pass-through tables and the published views as temporary views."""
    shown = {name: catalog[name] for name in PASS_THROUGH if name in catalog}
    single = {
        "instance": ("instances", views.instance_view),
        "attribute": ("attribute", views.attribute_view),
        "volume": ("volume", views.volume_view),
        "host": ("host", views.host_view),
        "functional_aliases": ("functional_aliases", views.alias_view),
        "owner": ("owners", views.owner_view),
        "job_stats": ("jobs", aggregates.job_stats),
        "command_stats": ("jobs", aggregates.command_stats),
        "host_aliases": ("instances", aggregates.host_aliases),
    }
    for name, (table, build) in single.items():
        if table in catalog:
            shown[name] = build(catalog[table])
    if {"instances", "attribute", "volume"} <= catalog.keys():
        shown["metadata"] = views.metadata_view(catalog)
    if {"instances", "attribute", "functional_aliases"} <= catalog.keys():
        shown["node_inventory"] = views.node_inventory(
            catalog["instances"], catalog["functional_aliases"], catalog["attribute"]
        )
    for name, df in shown.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in shown]
