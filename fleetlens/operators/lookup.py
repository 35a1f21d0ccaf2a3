"""Batches of lookups: a request table joined to the catalog."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators.ordering import join_unique, page_of
from fleetlens.operators.views import Catalog, attribute_map, directory_rules, metadata_view
from fleetlens.session import stored

# At most about so many instances of a list meet so many requests for it in one place, and those
# in runs: an instance's row is repeated for the requests of a run, one after the other.
ROWS, ASKERS, RUN = 1_000, 16_000, 512


def _same(left: DataFrame, right: DataFrame, on: dict[str, str], mark: str) -> Column:
    return reduce(lambda a, b: a & b, [left[k] == right[f"{mark}{v}"] for k, v in on.items()])


def lookup(
    requests: DataFrame,
    table: DataFrame,
    on: dict[str, str],
    columns: list[str] | None = None,
) -> DataFrame:
    """All rows of ``table`` that match a request, with the ``request_id``.

    ``on`` maps request columns to table columns; ``columns`` picks the table
    columns to return, and only those and the keys are read.
    """
    columns = columns or table.columns
    keys = {v: F.col(v).alias(f"_key_{v}") for v in on.values()}
    right = table.select(*columns, *keys.values())
    left = requests.select("request_id", *[F.col(k).alias(f"_req_{k}") for k in on])
    marked = {f"_req_{k}": v for k, v in on.items()}
    return left.join(right, _same(left, right, marked, "_key_"), "inner").select(
        "request_id", *[right[c] for c in columns]
    )


def missing(requests: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """The requests that match nothing, with their status."""
    right = table.select(*[F.col(v).alias(f"_key_{v}") for v in on.values()])
    return requests.join(right, _same(requests, right, on, "_key_"), "left_anti").withColumn(
        "status", F.lit(S.NOT_FOUND)
    )


def asked_rows(table: DataFrame, requests: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a table that a batch asks for.

    A short batch is sent to the table's scan; only a long one shuffles the
    table, and then by the key that the next step needs.
    """
    return table.join(requests.select(*on).distinct(), on, "left_semi")


def resolve_instance_id(
    requests: DataFrame, instances: DataFrame, out: str = "instance_id"
) -> DataFrame:
    """Add the id of the named instance, NULL where there is none."""
    asked = asked_rows(instances.select("id", "db_name"), requests, ["db_name"])
    ids = asked.groupBy("db_name").agg(F.min("id").alias(out))
    return join_unique(requests, ids, ["db_name"]).select(*requests.columns, out)


def attribute_value(requests: DataFrame, instances: DataFrame, attribute: DataFrame) -> DataFrame:
    """The value of one attribute of a named instance; no row where there is none."""
    asked = requests.select("request_id", "db_name", "name")
    resolved = resolve_instance_id(asked, instances).where(F.col("instance_id").isNotNull())
    values = attribute.select(
        F.col("instance_id").alias("_instance_id"), F.col("name").alias("_name"), "value"
    )
    same = (resolved["instance_id"] == values["_instance_id"]) & (
        resolved["name"] == values["_name"]
    )
    return resolved.join(values, same).select("request_id", "db_name", "name", "value")


def instance_attributes(
    requests: DataFrame,
    instances: DataFrame,
    attribute: DataFrame,
    group_rows: int | None = None,
) -> DataFrame:
    """All attributes of a named instance as a map; no row where it has none."""
    asked = requests.select("request_id", "db_name")
    resolved = stored(
        resolve_instance_id(asked, instances).where(F.col("instance_id").isNotNull())
    )
    maps, _ = attribute_map(asked_rows(attribute, resolved, ["instance_id"]), group_rows)
    return resolved.join(maps, "instance_id").select("request_id", *page_of(maps), "attributes")


def _wanted_hosts(name: Column) -> Column:
    return F.array_distinct(F.transform(F.split(name, ","), lambda host: F.trim(host)))


def _on_hosts(requests: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the rarest of their hosts (``_on``), and the instances by host.

    Instances are counted per asked host. A request for a host that no instance
    has is out.
    """
    asked = requests.select("request_id", _wanted_hosts(F.col("name")).alias("asked"))
    each = asked.select("request_id", F.size("asked").alias("n"), F.explode("asked").alias("_on"))
    placed = instances.select("id", E.split_hosts(F.col("host")).alias("hosts"))
    placed = placed.select("id", "hosts", F.explode(F.array_distinct("hosts")).alias("_on"))
    counts = asked_rows(placed.select("_on"), each, ["_on"]).groupBy("_on").agg(
        F.count(F.lit(1)).alias("rows")
    )
    rarest = (
        each.join(counts, "_on")
        .groupBy("request_id")
        .agg(
            F.min(F.struct("rows", "_on"))["_on"].alias("_on"),
            (F.count(F.lit(1)) == F.first("n")).alias("all_known"),
        )
        .where("all_known")
    )
    return asked.join(rarest, "request_id").select("request_id", "asked", "_on"), placed


def on_rarest_host(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """Requests with the instances on the rarest of their hosts, before the other hosts are tested.

    The join is on the rarest host of a request only; the others are tested on
    the row. So its rows are as many as that host has instances, and no pair has
    to be grouped.
    """
    asked, placed = _on_hosts(requests, instances)
    return asked.join(placed, "_on").select("request_id", "asked", "id", "hosts")


def _has_all() -> Column:
    return F.size(F.array_except("asked", "hosts")) == 0


def match_hosts(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """Pairs of ``request_id`` and instance ``id`` where all asked hosts are present."""
    return on_rarest_host(requests, instances).where(_has_all()).select("request_id", "id")


def match_lists(requests: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`match_hosts` in two tables: ``request_id, asked_list`` and ``asked_list, id``.

    Requests for the same hosts share a list, and its instances are matched
    once, however many ask for it.
    """
    asked, placed = _on_hosts(requests, instances)
    # no host has a comma, so the text tells lists apart
    asked = stored(asked.withColumn("asked_list", F.concat_ws(",", "_on", "asked")))
    lists = asked.select("asked_list", "asked", "_on").distinct()
    matches = lists.join(placed, "_on").where(_has_all()).select("asked_list", "id")
    return asked.select("request_id", "asked_list"), matches


def _metadata_of(matches: DataFrame, catalog: Catalog, group_rows: int | None) -> DataFrame:
    """The rows of ``matches`` with the metadata of their ``id``."""
    view = metadata_view(catalog, only=matches.select("id").distinct(), group_rows=group_rows)
    return matches.join(view, "id").select(*[c for c in matches.columns if c != "id"], *view.columns)


def instances_on_hosts(
    requests: DataFrame, catalog: Catalog, group_rows: int | None = None
) -> DataFrame:
    """Metadata of all instances on a host; ``a,b`` asks for both hosts."""
    asked, matches = match_lists(requests, catalog["instances"])
    found = _metadata_of(stored(matches), catalog, group_rows)
    columns = [c for c in found.columns if c != "asked_list"]
    return found.join(asked, "asked_list").select("request_id", *columns)


def _shares(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Add ``name``: the rows of a list are dealt by ``key`` to shares of about ``size`` rows."""
    shares = df.groupBy("asked_list").agg(F.ceil(F.count(F.lit(1)) / size).alias("_shares"))
    share = F.pmod(F.xxhash64(key), F.col("_shares"))
    return df.join(shares, "asked_list").withColumn(name, share).drop("_shares")


def _rows_of_lists(asked: DataFrame, matches: DataFrame, view: DataFrame) -> DataFrame:
    """A row of ``view`` for each request and each instance of its list.

    The result has requests times instances, so it is cut on both sides: a share
    of a list's instances meets a share of its requests, and the runs of those
    come one after the other. So no task has a whole list, and equal values
    stand together: a file of them takes a fraction of a byte a row, while all
    requests of a list for one instance after the other repeat too late for that.
    """
    asked = _shares(asked, "request_id", ASKERS, "_askers")
    matches = _shares(matches, "id", ROWS, "_rows")
    ids = F.array_sort(F.collect_list("request_id"))
    askers = asked.groupBy("asked_list", "_askers").agg(ids.alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(RUN))
    cut = F.explode(F.transform(starts, lambda start: F.slice("ids", start, RUN)))
    runs = askers.select("asked_list", "_askers", cut.alias("run"))
    runs = runs.join(matches.select("asked_list", "_rows").distinct(), "asked_list")
    found = matches.join(askers.select("asked_list", "_askers"), "asked_list").join(view, "id")
    # A few bytes make many rows here, so Spark must not join partitions by their size; a merge
    # join takes the runs from the left and goes through the instances once for each.
    on = ["asked_list", "_askers", "_rows"]
    parts = int(view.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = runs.repartition(parts, *on).join(found.repartition(parts, *on).hint("merge"), on)
    return pairs.select(F.explode("run").alias("request_id"), *view.columns)


def metadata_lookup(
    requests: DataFrame,
    catalog: Catalog,
    group_rows: int | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answer ``request_id, class, name`` requests: the rows, and a status per request.

    A missing name, an unknown class or an empty host in a list is a bad
    request; a request without rows is not found. Pairs of a request and an
    instance of its hosts are rows of the result only: what is stored, shuffled
    and counted has each list of hosts once. ``shape`` changes the columns of the
    metadata before requests meet it, so that it is done once for an instance.
    """
    empty_host = F.array_contains(_wanted_hosts(F.col("name")), "")
    named = F.coalesce(F.col("name") != "", F.lit(False))
    by_name = named & (F.col("class") == "instance")
    by_host = named & (F.col("class") == "host") & ~empty_host
    instances = catalog["instances"]
    wanted = requests.where(by_name).select("request_id", F.col("name").alias("db_name"))
    by_id = wanted.join(instances.select("id", "db_name"), "db_name").select("request_id", "id")
    asked, of_lists = match_lists(requests.where(by_host), instances)
    matches = stored(by_id.unionByName(of_lists, allowMissingColumns=True))
    of_list = F.col("asked_list").isNotNull()

    view = metadata_view(catalog, only=matches.select("id").distinct(), group_rows=group_rows)
    view = view if shape is None else shape(view)
    of_names = matches.where(~of_list).select("request_id", "id").join(view, "id")
    of_lists = matches.where(of_list).select("asked_list", "id")
    rows = of_names.select("request_id", *view.columns).unionByName(
        _rows_of_lists(asked, of_lists, view)
    )

    known = instances.join(_known_types(instances), "db_type", "left_semi").select("id")
    counted = (
        matches.join(known, "id", "left_semi")
        .groupBy("request_id", "asked_list")
        .agg(F.count(F.lit(1)).alias("_found"))
    )
    per_list = counted.where(of_list).select("asked_list", "_found").join(asked, "asked_list")
    found_by = (
        counted.where(~of_list)
        .select("request_id", "_found")
        .unionByName(per_list.select("request_id", "_found"))
        .groupBy("request_id")
        .agg(F.sum("_found").alias("_found"))
    )
    status = (
        F.when(~F.coalesce(by_name | by_host, F.lit(False)), S.BAD_REQUEST)
        .when(F.col("_found") > 0, S.OK)
        .otherwise(S.NOT_FOUND)
    )
    outcomes = requests.join(found_by, "request_id", "left").select(
        "request_id",
        status.alias("status"),
        F.when(status == S.OK, F.col("_found")).otherwise(F.lit(0)).cast("bigint").alias("affected"),
    )
    return rows, outcomes


def _known_types(instances: DataFrame) -> DataFrame:
    # Fixed table of five rows.
    return F.broadcast(directory_rules(instances.sparkSession).select("db_type"))


def free_pool(aliases: DataFrame) -> DataFrame:
    """Pool rows that no instance uses."""
    return aliases.where(
        F.col("db_name").isNull() & F.col("alias").isNull() & F.col("dns_name").isNotNull()
    )


def next_free(aliases: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` smallest free names."""
    return free_pool(aliases).select("dns_name").orderBy("dns_name").limit(n)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; equal ones are told apart by the rest."""
    rest = [c for c in df.columns if c != key]
    ranked = order + [c for c in rest if c not in order]
    return (
        df.groupBy(key)
        .agg(F.max(F.struct(*ranked)).alias("_row"))
        .select(key, *[f"_row.{c}" for c in rest])
    )
