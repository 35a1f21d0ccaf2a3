"""The registered queries: every operator over the bound driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators import aggregates, checks, lookup, views
from fleetlens.operators.alias_changes import allocate_aliases, release_aliases
from fleetlens.operators.attribute_changes import (
    delete_attributes,
    insert_attributes,
    update_attributes,
)
from fleetlens.operators.host_changes import delete_hosts, insert_hosts, update_hosts
from fleetlens.operators.instance_changes import (
    create_instances,
    delete_instances,
    patch_instances,
)
from fleetlens.operators.outcomes import Change
from fleetlens.session import scratch_folder, stored
from fleetlens.sources import binding, catalog, documents, export, snapshots
from fleetlens.streaming import feed, job_state, jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

OBSERVATION_LIMIT = timedelta(days=1)


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


# -- arrays and maps as text, for comparison ---------------------------------------


def _volumes_text(volumes: Column) -> Column:
    return F.array_join(
        F.transform(
            volumes, lambda v: F.concat(v["id"].cast("string"), F.lit(":"), v["mounting_path"])
        ),
        ",",
    )


def _joined(rows: Column, fields: list[str]) -> Column:
    """An array of structs as text: ``|`` between fields, ``;`` between rows."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws("|", *[r[f] for f in fields])), ";")


def _flat_metadata(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "hosts": F.array_join("hosts", ","),
            "attributes": E.map_text(F.col("attributes")),
            "n_volumes": F.size("volumes"),
            "volumes": _volumes_text(F.col("volumes")),
        }
    )


# -- sources and sinks --------------------------------------------------------------


def _row_number(df: DataFrame) -> Column:
    """A number made from all values of a row; sums of it compare whole tables."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]
    digest = F.md5(F.concat_ws("|", *shown).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


@query("s1_catalog_scan")
def s1_catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_folder(spark)
    for name, df in binding.bind(spark, sf_dir).items():
        df.write.parquet(f"{root}/{name}")
    counts = None
    for name, df in catalog.read_catalog(spark, root).items():
        first = S.TABLES[name].columns[0]
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(first).alias("n_first"),
            F.sum(_row_number(df)).alias("content"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "n_first", "content")
        counts = row if counts is None else counts.unionByName(row)
    return counts


@query("s2_pass_through_views")
def s2_pass_through_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = "fleet_"
    catalog.register_views(
        binding.bind(spark, sf_dir, *catalog.PASS_THROUGH), prefix
    )
    return spark.sql(
        f"""
        SELECT i.db_name, i.db_type, c.n_changes, j.n_jobs
        FROM {prefix}instances i
        LEFT JOIN (SELECT db_name, count(*) AS n_changes FROM {prefix}instance_changes
                   GROUP BY db_name) c ON c.db_name = i.db_name
        LEFT JOIN (SELECT db_name, count(*) AS n_jobs FROM {prefix}jobs
                   GROUP BY db_name) j ON j.db_name = i.db_name
        """
    )


@query("s3_documents_good")
def s3_documents_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = documents.parse_instance_docs(binding.create_requests(spark, sf_dir))
    return good.select(
        "request_id",
        "username",
        "class",
        "creation_date",
        "db_type",
        "db_name",
        "db_size",
        "version",
        "host",
        _joined(F.col("attributes"), ["key", "value"]).alias("attributes"),
        _joined(F.col("volumes"), S.VOLUME_DOC_FIELDS).alias("volumes"),
    )


@query("s3_documents_rejected")
def s3_documents_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = documents.parse_instance_docs(binding.create_requests(spark, sf_dir))
    return rejected.select("request_id", "reason")


@query("s4_append_volumes")
def s4_append_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = _created(spark, sf_dir)
    path = scratch_folder(spark)
    snapshots.append_rows(binding.volume(spark, sf_dir), path)
    snapshots.append_rows(change.changed["volume"], path)
    return spark.read.schema(S.VOLUME.schema).parquet(path)


@query("s5_node_lines")
def s5_node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.node_lines(_inventory(spark, sf_dir))


@query("s5_node_list_xml")
def s5_node_list_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    export.write_node_list(_inventory(spark, sf_dir), path)
    fields = ", ".join(f"_{name} string" for name, _ in export.NODE_ATTRIBUTES)
    nodes = spark.read.format("xml").schema(fields).options(rowTag="node").load(path)
    return nodes.select(*[F.col(f"_{n}").alias(n) for n, _ in export.NODE_ATTRIBUTES])


@query("s6_alias_documents")
def s6_alias_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.lookup(
        binding.name_requests(spark, sf_dir),
        binding.functional_aliases(spark, sf_dir),
        {"db_name": "db_name"},
        ["dns_name", "alias"],
    )
    return export.to_documents(rows, "request_id")


@query("s6_owner_documents")
def s6_owner_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.lookup(
        binding.name_requests(spark, sf_dir),
        views.owner_view(binding.owners(spark, sf_dir)),
        {"db_name": "instance_name"},
    )
    return export.to_documents(rows, "request_id", envelope="data")


@query("s6_metadata_documents")
def s6_metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.instances_on_hosts(
        binding.host_name_requests(spark, sf_dir), _view_tables(spark, sf_dir)
    )
    return export.to_documents(rows, "request_id", order=["id"])


# -- projections --------------------------------------------------------------------


def _view_tables(spark: SparkSession, sf_dir: str) -> views.Catalog:
    return binding.bind(spark, sf_dir, "instances", "attribute", "volume")


@query("p1_instance_view")
def p1_instance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.instance_view(binding.instances(spark, sf_dir))


@query("p2_attribute_view")
def p2_attribute_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.attribute_view(binding.attribute(spark, sf_dir))


@query("p3_volume_view")
def p3_volume_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.volume_view(binding.volume(spark, sf_dir))


@query("p4_host_view")
def p4_host_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.host_view(binding.host(spark, sf_dir))


@query("p5_alias_view")
def p5_alias_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.alias_view(binding.functional_aliases(spark, sf_dir))


@query("p6_owner_view")
def p6_owner_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.owner_view(binding.owners(spark, sf_dir))


# -- lookups ------------------------------------------------------------------------


@query("p7_host_memory")
def p7_host_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(
        binding.host_name_requests(spark, sf_dir),
        binding.host(spark, sf_dir),
        {"name": "name"},
        ["memory"],
    )


@query("f1_instance_by_name")
def f1_instance_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(
        binding.name_requests(spark, sf_dir),
        views.instance_view(binding.instances(spark, sf_dir)),
        {"db_name": "db_name"},
    )


@query("f1_metadata_by_name")
def f1_metadata_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = binding.name_requests(spark, sf_dir).select(
        "request_id", F.lit("instance").alias("class"), F.col("db_name").alias("name")
    )
    rows, _ = lookup.metadata_lookup(requests, _view_tables(spark, sf_dir))
    return _flat_metadata(rows)


@query("f1_owner_by_name")
def f1_owner_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(
        binding.name_requests(spark, sf_dir),
        views.owner_view(binding.owners(spark, sf_dir)),
        {"db_name": "instance_name"},
        ["internal_id", "instance_name", "owner_login", "owner_group"],
    )


@query("f1_alias_by_name")
def f1_alias_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(
        binding.name_requests(spark, sf_dir),
        binding.functional_aliases(spark, sf_dir),
        {"db_name": "db_name"},
        ["dns_name", "alias"],
    )


@query("f1_host_by_name")
def f1_host_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(
        binding.host_name_requests(spark, sf_dir),
        views.host_view(binding.host(spark, sf_dir)),
        {"name": "name"},
    )


@query("f1_host_aliases_by_host")
def f1_host_aliases_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.lookup(
        binding.host_name_requests(spark, sf_dir),
        aggregates.host_aliases(binding.instances(spark, sf_dir)),
        {"name": "host"},
    )
    return found.withColumn("aliases", F.array_join("aliases", ","))


@query("f2_attribute_value")
def f2_attribute_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _view_tables(spark, sf_dir)
    requests = binding.attribute_write_requests(spark, sf_dir)
    return lookup.attribute_value(requests, bound["instances"], bound["attribute"])


@query("f2_all_attributes")
def f2_all_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _view_tables(spark, sf_dir)
    found = lookup.instance_attributes(
        binding.name_requests(spark, sf_dir), bound["instances"], bound["attribute"]
    )
    return found.withColumn("attributes", E.map_text(F.col("attributes")))


@query("f3_instances_on_hosts")
def f3_instances_on_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.instances_on_hosts(
        binding.host_name_requests(spark, sf_dir), _view_tables(spark, sf_dir)
    )
    return _flat_metadata(rows)


@query("f4_free_pool")
def f4_free_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.free_pool(binding.functional_aliases(spark, sf_dir)).select("dns_name")


@query("f5_metadata_rows")
def f5_metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = lookup.metadata_lookup(
        binding.metadata_requests(spark, sf_dir),
        _view_tables(spark, sf_dir),
        shape=_flat_metadata,
    )
    return rows.select("request_id", "id", "db_name", "port", "socket", "n_volumes")


@query("f5_metadata_outcomes")
def f5_metadata_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcomes = lookup.metadata_lookup(
        binding.metadata_requests(spark, sf_dir), _view_tables(spark, sf_dir)
    )
    return outcomes


# -- joins --------------------------------------------------------------------------


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = binding.bind(spark, sf_dir, "instances", "functional_aliases", "attribute")
    return views.node_inventory(
        bound["instances"], bound["functional_aliases"], bound["attribute"]
    )


@query("j1_node_inventory")
def j1_node_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir)


@query("j2_port_of_instance")
def j2_port_of_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _view_tables(spark, sf_dir)
    base = bound["instances"].select("id", "db_name")
    return views.with_attribute(base, bound["attribute"], "port")


@query("j3_attributes_of_instance")
def j3_attributes_of_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _view_tables(spark, sf_dir)
    base = bound["instances"].select("id", "db_name")
    rows = views.with_attributes(base, bound["attribute"])
    return rows.withColumn("attributes", E.map_text(F.col("attributes")))


@query("j4_volumes_of_instance")
def j4_volumes_of_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _view_tables(spark, sf_dir)
    base = bound["instances"].select("id", "db_name")
    rows = views.with_volumes(base, bound["volume"])
    return rows.withColumn("volumes", _volumes_text(F.col("volumes")))


def _with_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _view_tables(spark, sf_dir)
    base = bound["instances"].select("id", "db_name", "db_type", "version")
    return views.with_attribute(base, bound["attribute"], "port")


@query("j5_directories")
def j5_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.with_directories(_with_port(spark, sf_dir))


@query("j5_directories_keep_unknown")
def j5_directories_keep_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.with_directories(_with_port(spark, sf_dir), keep_unknown=True)


@query("j6_host_names")
def j6_host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.host_names(
        binding.host_id_lists(spark, sf_dir), binding.host(spark, sf_dir), "list_id", "host_ids"
    )
    return names.select("list_id", F.array_join("hosts", ",").alias("hosts"))


@query("j7_resolve_instance_id")
def j7_resolve_instance_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resolve_instance_id(
        binding.delete_requests(spark, sf_dir), binding.instances(spark, sf_dir)
    )


@query("j8_missing")
def j8_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.missing(
        binding.delete_requests(spark, sf_dir),
        binding.instances(spark, sf_dir),
        {"db_name": "db_name"},
    )


@query("j9_metadata")
def j9_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_metadata(views.metadata_view(_view_tables(spark, sf_dir)))


@query("j9_metadata_by_key")
def j9_metadata_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    prefix = path.rsplit("/", 1)[1].replace("-", "_") + "_"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    catalog.write_by_key(_view_tables(spark, sf_dir), path, prefix, buckets)
    return _flat_metadata(views.metadata_view(catalog.read_by_key(spark, prefix)))


# -- aggregates ---------------------------------------------------------------------


@query("a1_job_stats")
def a1_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.job_stats(binding.jobs(spark, sf_dir))


@query("a2_command_stats")
def a2_command_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.command_stats(binding.jobs(spark, sf_dir))


@query("a3_host_aliases")
def a3_host_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.host_aliases(binding.instances(spark, sf_dir))
    return rows.withColumn("aliases", F.array_join("aliases", ","))


@query("a4_host_aliases_text")
def a4_host_aliases_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.host_aliases(binding.instances(spark, sf_dir), as_text=True)


@query("a5_attribute_map")
def a5_attribute_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps, _ = views.attribute_map(binding.attribute(spark, sf_dir))
    return maps.withColumn("attributes", E.map_text(F.col("attributes")))


@query("a6_volume_array")
def a6_volume_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays, _ = views.volume_array(binding.volume(spark, sf_dir))
    return arrays.select(
        "instance_id",
        F.size("volumes").alias("n_volumes"),
        _volumes_text(F.col("volumes")).alias("volumes"),
    )


# -- sort, limit, one per key -------------------------------------------------------


@query("l1_next_free")
def l1_next_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.next_free(binding.functional_aliases(spark, sf_dir))


@query("l2_nodes_sorted")
def l2_nodes_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).orderBy("db_name", "hostname")


@query("l3_latest_alias")
def l3_latest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = binding.functional_aliases(spark, sf_dir).where(F.col("db_name").isNotNull())
    return lookup.latest_per_key(used, "db_name", ["alias"])


# -- scalar functions ---------------------------------------------------------------


@query("e_scalar_functions")
def e_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("id") % 9 == 0, "").otherwise(F.col("host"))
    hosts = E.split_hosts(host)
    text = F.when(F.col("id") % 3 == 0, F.concat(F.col("version"), F.lit("7"))).otherwise(
        F.concat(F.lit(" -"), F.col("id").cast("string"))
    )
    return binding.instances(spark, sf_dir).select(
        "id",
        E.tags(F.col("version"), F.col("category")).alias("e1_concat"),
        F.upper("db_name").alias("e2_upper"),
        F.lower("category").alias("e2_lower"),
        F.regexp_replace("db_name", "_", "-").alias("e3_replaced"),
        F.size(hosts).alias("e4_n_hosts"),
        F.when(F.array_contains(hosts, "host7"), "yes").otherwise("no").alias("e9_contains"),
        E.join_hosts(hosts).alias("e11_joined"),
        E.strict_int(text).alias("e12_int"),
    )


# -- change operators ---------------------------------------------------------------


def _created(spark: SparkSession, sf_dir: str) -> Change:
    return create_instances(
        _view_tables(spark, sf_dir), binding.create_requests(spark, sf_dir)
    )


def _patched(spark: SparkSession, sf_dir: str) -> Change:
    return patch_instances(_view_tables(spark, sf_dir), binding.patch_requests(spark, sf_dir))


def _deleted(spark: SparkSession, sf_dir: str) -> Change:
    return delete_instances(_view_tables(spark, sf_dir), binding.delete_requests(spark, sf_dir))


def _attributes_inserted(spark: SparkSession, sf_dir: str) -> Change:
    return insert_attributes(
        _view_tables(spark, sf_dir), binding.attribute_insert_requests(spark, sf_dir)
    )


def _attributes_updated(spark: SparkSession, sf_dir: str) -> Change:
    return update_attributes(
        _view_tables(spark, sf_dir), binding.attribute_write_requests(spark, sf_dir)
    )


def _attributes_deleted(spark: SparkSession, sf_dir: str) -> Change:
    return delete_attributes(
        _view_tables(spark, sf_dir), binding.attribute_write_requests(spark, sf_dir)
    )


def _on_hosts(
    operator: Callable, requests: Query = binding.host_requests
) -> Callable[[SparkSession, str], Change]:
    return lambda spark, sf_dir: operator(
        binding.bind(spark, sf_dir, "host"), requests(spark, sf_dir)
    )


def _allocated(spark: SparkSession, sf_dir: str) -> Change:
    return allocate_aliases(
        binding.bind(spark, sf_dir, "functional_aliases"), binding.alias_requests(spark, sf_dir)
    )


def _released(spark: SparkSession, sf_dir: str) -> Change:
    return release_aliases(
        binding.bind(spark, sf_dir, "functional_aliases"), binding.alias_requests(spark, sf_dir)
    )


def _register_change(
    key: str, apply: Callable[[SparkSession, str], Change], tables: dict[str, str]
) -> None:
    """One query for the outcomes, one for the new state of each table."""
    QUERIES[f"{key}_outcomes"] = lambda spark, sf_dir: apply(spark, sf_dir).outcomes
    for table, word in tables.items():
        QUERIES[f"{key}_{word}"] = lambda spark, sf_dir, t=table: apply(spark, sf_dir).tables[t]


INSTANCE_TABLES = {"instances": "instances", "attribute": "attributes", "volume": "volumes"}

_register_change("m1_create", _created, INSTANCE_TABLES)
_register_change("m2_patch", _patched, INSTANCE_TABLES)
_register_change("m3_delete", _deleted, INSTANCE_TABLES)
_register_change("m4_attribute_insert", _attributes_inserted, {"attribute": "state"})
_register_change("m5_attribute_update", _attributes_updated, {"attribute": "state"})
_register_change("m6_attribute_delete", _attributes_deleted, {"attribute": "state"})
_register_change("m7_host_insert", _on_hosts(insert_hosts), {"host": "state"})
_register_change("m8_host_update", _on_hosts(update_hosts), {"host": "state"})
_register_change(
    "m9_host_delete", _on_hosts(delete_hosts, binding.host_delete_requests), {"host": "state"}
)
_register_change("m10_alias_allocate", _allocated, {"functional_aliases": "state"})
_register_change("m11_alias_release", _released, {"functional_aliases": "state"})


@query("m12_allocated_rows")
def m12_allocated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocated(spark, sf_dir).representation("functional_aliases")


@query("m12_updated_hosts")
def m12_updated_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_hosts(update_hosts)(spark, sf_dir).representation("host")


@query("m12_created_instances")
def m12_created_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.instance_view(_created(spark, sf_dir).representation("instances"))


# -- integrity ----------------------------------------------------------------------


@query("c1_unique")
def c1_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return checks.duplicates(lines, ["l_orderkey", "l_linenumber"])


@query("c1_alias_unique")
def c1_alias_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(binding.functional_aliases(spark, sf_dir), ["db_name"])


@query("c2_not_null")
def c2_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.nulls(binding.instances(spark, sf_dir), S.INSTANCES.columns)


@query("c3_orphans")
def c3_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _deleted(spark, sf_dir).tables["instances"]
    return checks.orphans(binding.attribute(spark, sf_dir), left)


@query("c4_length")
def c4_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = binding.functional_aliases(spark, sf_dir)
    return checks.overlong(aliases, S.FUNCTIONAL_ALIASES.limits)


@query("c_catalog_report")
def c_catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_catalog(binding.bind(spark, sf_dir))


# -- feeds --------------------------------------------------------------------------


@query("t1_feed_state")
def t1_feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = feed.apply_feed(
        binding.feed_state(spark, sf_dir), binding.attribute_feed(spark, sf_dir)
    )
    return state


@query("t1_feed_outcomes")
def t1_feed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcomes = feed.apply_feed(
        binding.feed_state(spark, sf_dir), binding.attribute_feed(spark, sf_dir)
    )
    return outcomes


@query("t1_stream_state")
def t1_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    feed.write_base(binding.feed_state(spark, sf_dir), f"{folder}/state")
    # Three files in feed order, each a batch of its own: the stream takes them as they arrive.
    writes = binding.attribute_feed(spark, sf_dir).repartitionByRange(3, *feed.ORDER)
    writes = stored(writes.withColumn("part", F.spark_partition_id()))
    for part in range(3):
        own = writes.where(F.col("part") == part).drop("part").coalesce(1)
        own.write.mode("append").parquet(f"{folder}/feed")
    feed.stream_feed(
        spark, f"{folder}/feed", f"{folder}/state", f"{folder}/checkpoint", files_per_batch=1
    ).awaitTermination()
    return feed.read_state(spark, f"{folder}/state")


@query("t2_job_outcomes")
def t2_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_outcomes(binding.job_observations(spark, sf_dir), OBSERVATION_LIMIT)


@query("t2_stream_outcomes")
def t2_stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    seen = binding.job_observations(spark, sf_dir)
    seen.repartitionByRange(3, "ts").write.parquet(f"{folder}/in")
    # Time goes on: a later look at a known execution, which changes none of its times.
    passed = OBSERVATION_LIMIT + job_state.DEFAULT_LATENESS + timedelta(seconds=1)
    seen.agg(
        F.max("exec_id").alias("exec_id"),
        (F.max("ts") + F.lit(passed)).alias("ts"),
        F.lit(False).alias("exec_completed"),
        F.lit("running").alias("exec_state"),
    ).write.mode("append").parquet(f"{folder}/in")
    observed = spark.readStream.schema(S.JOB_OBSERVATIONS).parquet(f"{folder}/in")
    job_state.answer_job_outcomes(
        observed, f"{folder}/out", f"{folder}/checkpoint", OBSERVATION_LIMIT
    ).awaitTermination()
    return job_state.read_answers(spark, f"{folder}/out", OBSERVATION_LIMIT)
