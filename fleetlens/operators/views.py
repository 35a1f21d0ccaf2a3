"""Published views of the catalog: projections, child joins, the metadata view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators.ordering import page_of, paged_groups

Catalog = dict[str, DataFrame]

METADATA_COLUMNS = [
    "id",
    "username",
    "db_name",
    "class",
    "db_type",
    "version",
    "hosts",
    "attributes",
    "port",
    "volumes",
    "basedir",
    "bindir",
    "datadir",
    "logdir",
    "socket",
]


# -- projections ---------------------------------------------------------------


def instance_view(instances: DataFrame) -> DataFrame:
    return instances.select(
        *[F.col(c).alias(E.published_name(c)) for c in S.INSTANCES.columns]
    )


def attribute_view(attribute: DataFrame) -> DataFrame:
    return attribute.select(*S.ATTRIBUTE.columns)


def volume_view(volume: DataFrame) -> DataFrame:
    return volume.select(*S.VOLUME.columns)


def host_view(host: DataFrame) -> DataFrame:
    return host.select(*S.HOST.columns)


def alias_view(aliases: DataFrame) -> DataFrame:
    return aliases.select(*S.FUNCTIONAL_ALIASES.columns)


def owner_view(owners: DataFrame) -> DataFrame:
    return owners.select(*S.OWNERS.columns)


# -- children as nested columns ------------------------------------------------


def attribute_map(
    attribute: DataFrame, group_rows: int | None = None
) -> tuple[DataFrame, bool]:
    """One map of attributes per instance; of a repeated name the smallest id counts.

    With a page size an instance with more rows is spread over several pages
    by attribute name; its repeated names are merged before the shuffle.
    """

    def merge_repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys, "name").agg(
            F.min_by("value", "id").alias("value"), F.min("id").alias("id")
        )

    nested, several = paged_groups(
        attribute.where(F.col("name").isNotNull()),
        ["instance_id"],
        ["name"],
        group_rows,
        F.array_sort(F.collect_list(F.struct("name", "id", "value"))).alias("pairs"),
        merge=merge_repeated,
    )
    first_of_name = F.filter(
        F.col("pairs"),
        lambda pair, i: (i == 0) | (pair["name"] != F.get(F.col("pairs"), i - 1)["name"]),
    )
    entries = F.transform(first_of_name, lambda pair: F.struct(pair["name"], pair["value"]))
    return (
        nested.select("instance_id", *page_of(nested), F.map_from_entries(entries).alias("attributes")),
        several,
    )


def volume_array(volume: DataFrame, group_rows: int | None = None) -> tuple[DataFrame, bool]:
    """One array of volume rows per instance, in id order; several pages as above."""
    listed = F.array_sort(F.collect_list(F.struct(*S.VOLUME.columns))).alias("volumes")
    nested, several = paged_groups(volume, ["instance_id"], ["id"], group_rows, listed)
    return nested.select("instance_id", *page_of(nested), "volumes"), several


def no_volumes():
    kind = S.VOLUME.schema.simpleString()
    return F.array().cast(f"array<{kind}>")


# -- joins ---------------------------------------------------------------------


def with_attribute(
    df: DataFrame, attribute: DataFrame, name: str, id_col: str = "id", out: str | None = None
) -> DataFrame:
    """Add the value of one attribute of the instance, NULL where it has none."""
    values = (
        attribute.where(F.col("name") == name)
        .groupBy(F.col("instance_id").alias("_instance_id"))
        .agg(F.min_by("value", "id").alias(out or name))
    )
    return df.join(values, df[id_col] == values["_instance_id"], "left").drop("_instance_id")


def with_attributes(
    df: DataFrame, attribute: DataFrame, id_col: str = "id", group_rows: int | None = None
) -> DataFrame:
    """Add the attribute map; NULL where the instance has none."""
    maps, _ = attribute_map(attribute, group_rows)
    maps = maps.withColumnRenamed("instance_id", "_instance_id")
    return df.join(maps, df[id_col] == maps["_instance_id"], "left").drop("_instance_id")


def with_volumes(
    df: DataFrame, volume: DataFrame, id_col: str = "id", group_rows: int | None = None
) -> DataFrame:
    """Add the volume array; an empty array where there is none."""
    arrays, _ = volume_array(volume, group_rows)
    arrays = arrays.withColumnRenamed("instance_id", "_instance_id")
    return (
        df.join(arrays, df[id_col] == arrays["_instance_id"], "left")
        .drop("_instance_id")
        .withColumn("volumes", F.coalesce("volumes", no_volumes()))
    )


def directory_rules(spark) -> DataFrame:
    return spark.createDataFrame(
        S.DIRECTORY_RULES, ", ".join(f"{c} string" for c in S.DIRECTORY_COLUMNS)
    )


def with_directories(
    df: DataFrame, rules: DataFrame | None = None, keep_unknown: bool = False
) -> DataFrame:
    """Add the five directories; needs ``db_name``, ``db_type``, ``version``, ``port``.

    A row of unknown type is dropped. ``keep_unknown=True`` keeps it with the
    default directories.
    """
    if rules is None:
        # Fixed table of five rows, so it can go to every executor.
        rules = F.broadcast(directory_rules(df.sparkSession))
    paths = S.DIRECTORY_COLUMNS[1:]
    templates = rules.select(
        "db_type", F.lit(True).alias("_known"), *[F.col(p).alias(f"_{p}") for p in paths]
    )
    name, version, port = F.col("db_name"), F.col("version"), F.col("port")
    joined = df.join(templates, "db_type", "left" if keep_unknown else "inner")
    if keep_unknown:
        default = dict(zip(paths, S.DEFAULT_DIRECTORIES))
        joined = joined.withColumns(
            {f"_{p}": F.when(F.col("_known"), F.col(f"_{p}")).otherwise(default[p]) for p in paths}
        )
    return (
        joined.withColumns({p: E.fill_path(F.col(f"_{p}"), name, version, port) for p in paths})
        .drop("_known", *[f"_{p}" for p in paths])
    )


def host_names(df: DataFrame, host: DataFrame, key: str, ids_col: str) -> DataFrame:
    """Turn an id array per row into the array of known host names, in id order."""
    refs = df.select(key, F.explode_outer(F.array_distinct(ids_col)).alias("_host_id"))
    hosts = host.select(F.col("id").alias("_id"), "name")
    named = F.when(F.col("name").isNotNull(), F.struct("_id", "name"))
    return (
        refs.join(hosts, refs["_host_id"] == hosts["_id"], "left")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(named)).alias("_hosts"))
        .select(key, F.transform("_hosts", lambda h: h["name"]).alias("hosts"))
    )


def metadata_view(
    catalog: Catalog,
    only: DataFrame | None = None,
    keep_unknown: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Every instance with its hosts, attributes, port, volumes and directories.

    ``only`` (a table with a distinct ``id``) keeps the view to these instances;
    the child rows of others are dropped before they are grouped. Instances of
    unknown type are left out unless ``keep_unknown`` is set. Output has one row
    per instance. With a page size, ``group_rows``, there is a ``page``, and an
    instance with more child rows has further pages that repeat its own columns.
    """
    instances, attribute, volume = catalog["instances"], catalog["attribute"], catalog["volume"]
    if only is not None:
        instances = instances.join(only.select("id"), "id", "left_semi")
        kept = only.select(F.col("id").alias("instance_id"))
        attribute = attribute.join(kept, "instance_id", "left_semi")
        volume = volume.join(kept, "instance_id", "left_semi")
    base = instances.select(
        "id",
        "username",
        "db_name",
        F.col("category").alias("class"),
        "db_type",
        "version",
        E.split_hosts(F.col("host")).alias("hosts"),
    )
    maps, many_maps = attribute_map(attribute, group_rows)
    arrays, many_arrays = volume_array(volume, group_rows)
    if many_maps or many_arrays:
        base = with_attribute(base, attribute, "port")
        children = maps.join(arrays, ["instance_id", "page"], "full")
        rows = base.join(children, base["id"] == children["instance_id"], "left")
    else:
        rows = (
            base.join(maps.drop("page").withColumnRenamed("instance_id", "id"), "id", "left")
            .join(arrays.drop("page").withColumnRenamed("instance_id", "id"), "id", "left")
            .withColumn("port", F.try_element_at("attributes", F.lit("port")))
        )
    rows = rows.withColumn("volumes", F.coalesce("volumes", no_volumes()))
    columns = [*METADATA_COLUMNS]
    if group_rows is not None:
        page = F.coalesce("page", F.lit(0)) if "page" in rows.columns else F.lit(0)
        rows, columns = rows.withColumn("page", page), [*columns, "page"]
    return with_directories(rows, keep_unknown=keep_unknown).select(*columns)


def node_inventory(
    instances: DataFrame, aliases: DataFrame, attribute: DataFrame
) -> DataFrame:
    """One row per instance and alias, with the connection data of the node."""
    base = instances.select("id", "db_name", "db_type", "category")
    names = aliases.select("db_name", F.col("alias").alias("hostname"))
    nodes = with_attribute(base.join(names, "db_name"), attribute, "port")
    return nodes.select(
        "db_name",
        "hostname",
        "port",
        F.lit(S.NODE_USERNAME).alias("username"),
        "db_type",
        "category",
        E.tags(F.col("db_type"), F.col("category")).alias("tags"),
    )
