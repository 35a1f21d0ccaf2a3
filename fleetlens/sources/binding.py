"""The generic test tables seen as a fleet catalog, and request tables on them.

Every table is derived from whole driver tables. Remainders of keys only choose
what a row looks like, never whether it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.operators.views import Catalog


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _as_table(df: DataFrame, table: S.Table) -> DataFrame:
    """The table's columns in order and type, NULL where the binding has none."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.type.simpleString()})"
            f" AS `{f.name}`"
            for f in table.fields
        ]
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def db_name(key: str, suffix: str | Column = "_x") -> Column:
    return _text("db_", F.col(key), suffix)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "MYSQL")
        .when(F.col("o_orderpriority") == "2-HIGH", "PG")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "InfluxDB")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "ORACLE")
        .otherwise("MONGO")
    )
    host = (
        F.when(key % 17 == 0, F.lit(None))
        .when(key % 5 == 0, _text("host", cust % 40, ",host", cust % 40 + 40))
        .otherwise(_text("host", cust % 40))
    )
    return _as_table(
        _read(spark, sf_dir, "orders").select(
            key.alias("id"),
            _text("user", cust % 50).alias("username"),
            db_name("o_orderkey").alias("db_name"),
            F.col("o_orderstatus").alias("category"),
            F.col("o_orderdate").cast("date").alias("creation_date"),
            kind.alias("db_type"),
            F.when(key % 13 != 0, _text("5.", cust % 10)).alias("version"),
            host.alias("host"),
        ),
        S.INSTANCES,
    )


def attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return _as_table(
        _read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("part"))
        .select(
            (F.col("l_orderkey") * 10 + line).alias("id"),
            F.col("l_orderkey").alias("instance_id"),
            F.when(line == 1, "port").otherwise(_text("attr", line)).alias("name"),
            _text(F.col("part") + 5000).alias("value"),
        ),
        S.ATTRIBUTE,
    )


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_table(
        _read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.min("l_linenumber").alias("line"))
        .select(
            (F.col("l_orderkey") * 1000000 + F.col("l_suppkey")).alias("id"),
            F.col("l_orderkey").alias("instance_id"),
            F.lit("0755").alias("file_mode"),
            F.lit("own").alias("owner"),
            F.lit("grp").alias("group"),
            F.lit("nas").alias("server"),
            F.lit("rw,bg,hard").alias("mount_options"),
            _text("/MNT/data", F.col("line")).alias("mounting_path"),
        ),
        S.VOLUME,
    )


def host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_table(
        _read(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("id"),
            _text("host", F.col("s_suppkey")).alias("name"),
            F.floor(F.abs("s_acctbal")).alias("memory"),
        ),
        S.HOST,
    )


def functional_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    used = key % 3 != 0
    of = F.when(key % 7 == 0, key - 1).otherwise(key)
    return _as_table(
        _read(spark, sf_dir, "part").select(
            _text("dns-", F.lpad(key.cast("string"), 8, "0")).alias("dns_name"),
            F.when(used, _text("db_", of, "_x")).alias("db_name"),
            F.when(used, _text("alias-", key)).alias("alias"),
        ),
        S.FUNCTIONAL_ALIASES,
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders")
    still_open = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
    return _as_table(
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
            _text("user", F.col("o_custkey") % 50).alias("username"),
            db_name("o_custkey").alias("db_name"),
            F.col("o_orderpriority").alias("command_name"),
            F.col("o_orderstatus").alias("type"),
            F.col("o_orderdate").cast("date").alias("creation_date"),
            F.when(~still_open, F.col("l_shipdate").cast("date")).alias("completion_date"),
            F.lit("req").alias("requester"),
            F.lit(0).alias("admin_action"),
            F.col("l_returnflag").alias("state"),
        ),
        S.JOBS,
    )


def command_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_table(
        _read(spark, sf_dir, "orders")
        .select("o_orderpriority", "o_orderstatus")
        .distinct()
        .select(
            F.col("o_orderpriority").alias("command_name"),
            F.col("o_orderstatus").alias("type"),
            _text("/bin/run ", F.col("o_orderpriority")).alias("exec"),
        ),
        S.COMMAND_DEFINITION,
    )


def command_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_table(
        _read(spark, sf_dir, "lineitem").select(
            _text("user", F.col("l_suppkey") % 50).alias("username"),
            db_name("l_orderkey").alias("db_name"),
            F.col("l_returnflag").alias("command_name"),
            F.col("l_linestatus").alias("type"),
            F.col("l_shipdate").cast("date").alias("creation_date"),
            _text("param", F.col("l_linenumber")).alias("name"),
            _text(F.col("l_partkey")).alias("value"),
        ),
        S.COMMAND_PARAMS,
    )


def instance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return _as_table(
        _read(spark, sf_dir, "events").select(
            _text("user", user % 50).alias("username"),
            db_name("user_id").alias("db_name"),
            F.col("event_type").alias("attribute"),
            F.col("ts").cast("date").alias("change_date"),
            _text("user", user).alias("requester"),
            F.col("props").alias("new_value"),
        ),
        S.INSTANCE_CHANGES,
    )


def upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_table(
        _read(spark, sf_dir, "part").select(
            F.col("p_brand").alias("db_type"),
            F.col("p_type").alias("category"),
            _text("5.", F.col("p_size")).alias("version_from"),
            _text("5.", F.col("p_size") + 1).alias("version_to"),
        ),
        S.UPGRADES,
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_table(
        _read(spark, sf_dir, "customer").select(
            _text(F.col("c_custkey")).alias("internal_id"),
            db_name("c_custkey").alias("instance_name"),
            F.col("c_name").alias("owner_login"),
            F.left("c_mktsegment", F.lit(3)).alias("owner_group"),
        ),
        S.OWNERS,
    )


BUILDERS = {
    "instances": instances,
    "attribute": attribute,
    "volume": volume,
    "host": host,
    "functional_aliases": functional_aliases,
    "jobs": jobs,
    "command_definition": command_definition,
    "command_params": command_params,
    "instance_changes": instance_changes,
    "upgrades": upgrades,
    "owners": owners,
}


def bind(spark: SparkSession, sf_dir: str, *tables: str) -> Catalog:
    """The named catalog tables over the driver tables in ``sf_dir``; all by default."""
    return {name: BUILDERS[name](spark, sf_dir) for name in tables or BUILDERS}


# -- feeds -------------------------------------------------------------------------


def attribute_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type") == "purchase", "update")
        .when(F.col("event_type") == "error", "delete")
    )
    feed = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("instance_id"),
        op.alias("op"),
        _text("k", F.get_json_object("props", "$.k")).alias("name"),
        F.col("event_type").alias("value"),
    )
    return feed.where(F.col("op").isNotNull())


def job_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("exec_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        kind.isin("purchase", "error").alias("exec_completed"),
        F.when(kind == "purchase", "succeeded")
        .when(kind == "error", "failed")
        .otherwise("running")
        .alias("exec_state"),
    )


# -- request tables ----------------------------------------------------------------


def create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A create document per order, and a second one for every fourth."""
    key = F.col("o_orderkey")
    lines = (
        _read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.map_from_arrays(
                F.transform(
                    F.array_sort(F.collect_set("l_linenumber")), lambda n: _text("attr", n)
                ),
                F.transform(
                    F.array_sort(F.collect_set("l_linenumber")), lambda n: _text(n + 7000)
                ),
            ).alias("attributes"),
            F.transform(
                F.array_sort(F.collect_set("l_suppkey")),
                lambda s: F.struct(
                    F.lit("grp").alias("group"),
                    F.lit("0755").alias("file_mode"),
                    F.lit("nas").alias("server"),
                    F.lit("rw").alias("mount_options"),
                    F.lit("own").alias("owner"),
                    _text("/MNT/s", s).alias("mounting_path"),
                ),
            ).alias("volumes"),
        )
    )
    orders = _read(spark, sf_dir, "orders")
    copies = F.when(key % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    asked = orders.join(lines, key == F.col("l_orderkey"), "left").select(
        "*", F.explode(copies).alias("copy")
    )
    cust = F.col("o_custkey")
    document = F.to_json(
        F.struct(
            _text("user", cust % 50).alias("username"),
            F.lit("TEST").alias("class"),
            F.lit("2016-07-20").alias("creation_date"),
            F.lit("5.6.17").alias("version"),
            F.when(key % 7 != 0, F.lit("MYSQL")).alias("db_type"),
            db_name("o_orderkey", F.when(key % 2 == 0, "_n").otherwise("_x")).alias("db_name"),
            (cust % 100).alias("db_size"),
            F.when(key % 11 == 0, F.array().cast("array<string>"))
            .when(key % 5 == 0, F.array(_text("host", cust % 40), _text("host", cust % 40 + 40)))
            .otherwise(F.array(_text("host", cust % 40)))
            .alias("hosts"),
            F.col("attributes"),
            F.col("volumes"),
        )
    )
    cut = F.col("o_orderkey") % 23 == 0
    # One small file is one task; the documents are spread as a stored table would be.
    return asked.select(
        (key * 2 + F.col("copy")).alias("request_id"),
        F.when(cut, F.substring(document, 1, 20)).otherwise(document).alias("body"),
    ).repartition("request_id")


def patch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch per order; some replace or clear the children, some rename."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    document = F.to_json(
        F.struct(
            F.when(key % 4 != 0, F.lit("9.9")).alias("version"),
            F.when(key % 5 == 0, F.array(F.lit("newhost"), _text("host", cust % 40))).alias("hosts"),
            F.when(key % 3 == 0, F.array().cast("array<struct<`group`:string>>")).alias("volumes"),
            F.when(key % 7 == 0, F.create_map(F.lit("port"), _text(cust), F.lit("added"), F.lit("1"))).alias(
                "attributes"
            ),
            F.when(key % 13 == 0, _text("renamed_", cust))
            .when(key % 17 == 0, _text("db_", key - 1, "_x"))
            .alias("db_name"),
        )
    )
    cleared = F.when(key % 19 == 0, F.lit('{"description": null, "hosts": []}')).otherwise(document)
    return _read(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        db_name("o_orderkey", F.when(key % 11 == 0, "_gone").otherwise("_x")).alias("db_name"),
        cleared.alias("body"),
    ).repartition("request_id")


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        db_name("o_orderkey", F.when(key % 2 == 0, "_gone").otherwise("_x")).alias("db_name"),
    )


def attribute_insert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object per order with one or two names, two requests for every sixth."""
    key = F.col("o_orderkey")
    copies = F.when(key % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    body = F.to_json(
        F.struct(
            F.when(key % 10 != 0, _text("v", F.col("copy"))).alias("new1"),
            F.when(key % 14 == 0, F.lit("1234")).alias("port"),
            F.when(F.col("copy") == 1, F.lit("z")).alias("new2"),
        )
    )
    null_value = F.lit('{"new1": null}')
    return (
        _read(spark, sf_dir, "orders")
        .select("*", F.explode(copies).alias("copy"))
        .select(
            (key * 2 + F.col("copy")).alias("request_id"),
            db_name("o_orderkey", F.when(key % 9 == 0, "_gone").otherwise("_x")).alias("db_name"),
            F.when(key % 21 == 0, null_value).otherwise(body).alias("body"),
        )
        .repartition("request_id")
    )


def attribute_write_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update or delete of one attribute per order line."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return (
        _read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_partkey").alias("part"))
        .select(
            (key * 10 + line).alias("request_id"),
            db_name("l_orderkey", F.when(key % 9 == 0, "_gone").otherwise("_x")).alias("db_name"),
            F.when(line <= 2, F.lit("port"))
            .when(line == 7, F.lit(None))
            .otherwise(_text("attr", line))
            .alias("name"),
            F.when(line == 4, F.lit("")).otherwise(_text(F.col("part"))).alias("value"),
        )
    )


def host_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host write per event, many for the same names."""
    key = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        key.alias("request_id"),
        _text("host", F.col("user_id")).alias("name"),
        F.when(key % 13 == 0, F.lit("forty-two"))
        .when(key % 17 != 0, _text(key))
        .alias("memory"),
    )


def host_delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host delete per event; every third name is unknown, so that hosts stay."""
    user = F.col("user_id")
    ending = F.when(user % 3 == 0, "_gone").otherwise("")
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), _text("host", user, ending).alias("name")
    )


def alias_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias for each customer's database, a second one for every fifth."""
    key = F.col("c_custkey")
    copies = F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        _read(spark, sf_dir, "customer")
        .select("*", F.explode(copies).alias("copy"))
        .select(
            (key * 2 + F.col("copy")).alias("request_id"),
            db_name("c_custkey").alias("db_name"),
            F.when(key % 17 != 0, _text("a-", key, "-", F.col("copy"))).alias("alias"),
        )
    )


def name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by database name per customer."""
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        db_name("c_custkey", F.when(key % 10 == 0, "_gone").otherwise("_x")).alias("db_name"),
    )


def host_name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by host per supplier; every fourth asks for two hosts."""
    key = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(
        key.alias("request_id"),
        F.when(key % 4 == 0, _text("host", key, ",host", key + 40))
        .otherwise(_text("host", key))
        .alias("name"),
    )


def metadata_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of all classes per customer, with unknown classes and missing names."""
    key = F.col("c_custkey")
    kind = (
        F.when(key % 10 == 0, "cluster")
        .when(key % 100 == 1, "host")
        .otherwise("instance")
    )
    name = F.when(key % 100 == 1, _text("host", key % 90)).otherwise(db_name("c_custkey"))
    return _read(spark, sf_dir, "customer").select(
        key.alias("request_id"), kind.alias("class"), F.when(key % 9 != 0, name).alias("name")
    )


def feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes that exist before the feed: one per viewed key."""
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "view")
        .select(
            F.col("user_id").alias("instance_id"),
            _text("k", F.get_json_object("props", "$.k")).alias("name"),
            F.lit("seed").alias("value"),
        )
        .distinct()
    )


def host_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of host ids per order, with unknown and repeated ids, some empty."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ids = F.when(key % 8 == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(cust % 150, key % 90, cust % 150)
    )
    return _read(spark, sf_dir, "orders").select(key.alias("list_id"), ids.alias("host_ids"))

