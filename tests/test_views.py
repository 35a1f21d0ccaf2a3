import datetime

import pytest
from pyspark.sql import functions as F
from seed import catalog, rows, table

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators import aggregates, lookup, ordering, views
from fleetlens.session import stored
from fleetlens.sources import catalog as sources


def alias(name):
    return S.HOST_ALIAS_PREFIX + name + S.HOST_ALIAS_DOMAIN


@pytest.fixture(scope="module")
def fleet(spark):
    return catalog(spark, edge=True)


@pytest.fixture(scope="module")
def metadata(fleet):
    return {r["db_name"]: r for r in views.metadata_view(fleet).collect()}


def test_unknown_type_is_only_missing_in_metadata(fleet, metadata):
    assert "odd_one" not in metadata
    names = {r["db_name"] for r in views.instance_view(fleet["instances"]).collect()}
    assert "odd_one" in names
    kept = views.metadata_view(fleet, keep_unknown=True).where("db_name = 'odd_one'").first()
    assert kept["basedir"] == f"/#BASEDIR#/{kept['version']}" and kept["socket"] == "/tmp"
    assert kept["bindir"] == kept["basedir"] + "/bin"
    assert kept["datadir"] == "/ORA/dbs03/ODD_ONE/data"
    assert kept["logdir"] == "/ORA/dbs02/ODD_ONE/pg_xlog"


def test_children_of_both_kinds_and_no_page(fleet):
    both = views.with_volumes(
        views.with_attributes(fleet["instances"], fleet["attribute"]), fleet["volume"]
    )
    assert "page" not in both.columns and both.count() == fleet["instances"].count()


def test_one_row_for_a_very_large_key(spark, fleet):
    many = spark.range(120_000).selectExpr(
        "id + 1000 AS id", "CAST(1 AS BIGINT) AS instance_id", "concat('a', id) AS name", "'v' AS value"
    )
    catalog_ = {**fleet, "attribute": many.select(*fleet["attribute"].columns)}
    one = views.metadata_view(catalog_).where("id = 1").selectExpr("size(attributes) AS n").collect()
    assert [r["n"] for r in one] == [120_000]


def test_children_of_an_instance(metadata):
    one = metadata["archive"]
    assert [v["mounting_path"] for v in one["volumes"]] == ["/srv/archive/cold", "/srv/archive/index"]
    assert one["attributes"] == {"port": "3307", "read_only": "yes"} and one["port"] == "3307"
    assert one["socket"] == "/var/lib/mysql/mysql.sock.archive.3307"
    assert one["datadir"] == "/ORA/dbs03/ARCHIVE/mysql"
    assert metadata["sandbox"]["attributes"] is None and metadata["sandbox"]["volumes"] == []


def test_no_attributes_is_null_and_no_volumes_is_empty(metadata):
    bare = metadata["no_port"]
    assert bare["attributes"] is None and bare["volumes"] == [] and bare["socket"] is None
    assert bare["basedir"] == "/usr/local/mysql/mysql-5.5"


def test_hosts(metadata):
    assert metadata["no_port"]["hosts"] == []
    assert metadata["ora_two"]["hosts"] is None
    assert metadata["two_hosts"]["hosts"] == ["host08", "host09"]


def test_directories_per_type(metadata):
    influx, oracle, pg = metadata["Influx_One"], metadata["ora_one"], metadata["two_hosts"]
    assert influx["bindir"] == "/usr/local/influxdb/influxdb-1.0/bin"
    assert influx["datadir"] == "/ORA/dbs03/INFLUX_ONE"
    assert oracle["basedir"] == oracle["bindir"] == "/ORA/dbs01/oracle/product/rdbms"
    assert oracle["socket"] == "/ORA/dbs01/oracle/product/rdbms/network/admin"
    assert pg["basedir"] is None and pg["logdir"] == "/ORA/dbs02/TWO_HOSTS/pg_xlog"


def test_repeated_attribute_takes_the_smallest_id_and_keeps_values_verbatim(metadata):
    assert metadata["two_hosts"]["attributes"] == {"port": "7000", "opt": "a,b={c}"}
    assert metadata["two_hosts"]["port"] == "7000"


def test_host_names(spark, fleet):
    lists = spark.createDataFrame(
        [(1, [3, 1, 1, 99]), (2, []), (3, None)], "list_id int, ids array<int>"
    )
    got = {r["list_id"]: r["hosts"] for r in views.host_names(lists, fleet["host"], "list_id", "ids").collect()}
    assert got == {1: ["rack-a1", "rack-c3"], 2: [], 3: []}


def test_node_inventory(fleet):
    got = rows(
        views.node_inventory(fleet["instances"], fleet["functional_aliases"], fleet["attribute"]),
        "db_name", "hostname", "port", "username", "tags",
    )
    assert [r[0] for r in got] == ["ledger", "orders_eu", "orders_us"]
    assert got[0] == ("ledger", "books.shop.test", "3306", S.NODE_USERNAME, "MYSQL,PROD")


def test_host_aliases_group_by_the_stored_text(fleet):
    got = {r["host"]: r["aliases"] for r in aggregates.host_aliases(fleet["instances"]).collect()}
    assert got["host08,host09"] == [alias("two-hosts")]
    assert got[None] == [alias("ora-two")]
    assert got["host09"] == [alias("Influx-One"), alias("odd-one"), alias("ora-one")]
    text = {
        r["host"]: r["aliases"]
        for r in aggregates.host_aliases(fleet["instances"], as_text=True).collect()
    }
    assert text["host08,host09"] == f"{S.HOST_ALIAS_PREFIX}two_hosts{S.HOST_ALIAS_TEXT_SUFFIX}"


def test_job_statistics(spark):
    d = datetime.date
    jobs = [
        ("a", "run", d(2020, 1, 1), d(2020, 1, 3)),
        ("a", "run", d(2020, 1, 2), None),
        ("a", "run", d(2020, 1, 5), d(2020, 1, 4)),
        ("b", "run", d(2020, 1, 1), None),
        ("b", "stop", d(2020, 1, 1), d(2020, 1, 1)),
    ]
    df = table(spark, "jobs", jobs, ["db_name", "command_name", "creation_date", "completion_date"])
    got = rows(aggregates.job_stats(df), "db_name", "command_name", "count", F.coalesce("mean_duration", F.lit(-1)))
    assert got == [("a", "run", 3, 43200), ("b", "run", 1, -1), ("b", "stop", 1, 0)]
    assert rows(aggregates.command_stats(df), "command_name", "count", "mean_duration") == [
        ("run", 4, 43200),
        ("stop", 1, 0),
    ]


# -- oversized groups ----------------------------------------------------------------


def big_fleet(spark):
    """Instance 1 has 50 attributes and 40 volumes, a third of them repeated names."""
    fleet = catalog(spark)
    attributes = [(100 + n, 1, f"a{n % 34}", f"v{n}") for n in range(50)]
    volumes = [(100 + n, 1, "0755", "o", "g", "s", "rw", f"/p{n}") for n in range(40)]
    extra_a = table(spark, "attribute", attributes, S.ATTRIBUTE.columns)
    extra_v = table(spark, "volume", volumes, S.VOLUME.columns)
    return {
        **fleet,
        "attribute": fleet["attribute"].unionByName(extra_a),
        "volume": fleet["volume"].unionByName(extra_v),
    }


@pytest.mark.parametrize("hot_keys", [10_000, 0])
def test_pages_of_an_oversized_instance_hold_all_children(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(ordering, "HOT_KEYS", hot_keys)
    fleet = big_fleet(spark)
    whole = {r["id"]: r for r in views.metadata_view(fleet).collect()}
    paged = views.metadata_view(fleet, group_rows=10).collect()
    of_one = [r for r in paged if r["id"] == 1]
    assert len(of_one) > 1 and len({r["page"] for r in of_one}) == len(of_one)
    assert {r["port"] for r in of_one} == {"5432"}
    assert {r["socket"] for r in of_one} == {whole[1]["socket"]}
    merged = {}
    for r in of_one:
        assert not merged.keys() & (r["attributes"] or {}).keys()
        merged.update(r["attributes"] or {})
    assert merged == whole[1]["attributes"] and len(merged) == 36
    volumes = sorted(v["id"] for r in of_one for v in r["volumes"])
    assert volumes == [v["id"] for v in whole[1]["volumes"]] and len(volumes) == 41
    for r in paged:
        if r["id"] != 1:
            assert r["page"] == 0 and r[: len(r) - 1] == tuple(whole[r["id"]])


def test_pages_of_an_oversized_host(spark):
    instances = table(
        spark,
        "instances",
        [(n, f"db_{n}", None if n % 2 else "h") for n in range(60)],
        ["id", "db_name", "host"],
    )
    got = aggregates.host_aliases(instances, group_rows=7).collect()
    for host, wanted in ((None, range(1, 60, 2)), ("h", range(0, 60, 2))):
        pages = [r for r in got if r["host"] == host]
        assert len(pages) > 1
        names = sorted(a for r in pages for a in r["aliases"])
        assert names == sorted(alias(f"db-{n}") for n in wanted)


def test_prefix_sums_over_many_partitions(spark):
    df = spark.range(1000).select(
        ((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 3).alias("n")
    )
    got = ordering.prefix_sums(df.repartition(5), ["k"], {"before": F.col("n")}).collect()
    total = 0
    for r in sorted(got, key=lambda r: r["k"]):
        assert r["before"] == total
        total += r["n"]
    numbered = ordering.row_numbers(df.select("k"), ["k"]).collect()
    assert all(r["rank"] == r["k"] + 1 for r in numbered)


# -- lookups -------------------------------------------------------------------------


def host_requests(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "request_id long, name string")


def test_instances_on_hosts(spark, fleet):
    base = catalog(spark)
    got = lookup.instances_on_hosts(host_requests(spark, "rack-b7", "rack-c3", "nowhere"), base)
    assert rows(got, "request_id", "id") == [(0, 2), (0, 5), (0, 6), (1, 4)]
    both = lookup.instances_on_hosts(
        host_requests(spark, "host08,host09", "host09 , host08", "host09", "host08,rack-a1"), fleet
    )
    assert rows(both, "request_id", "id") == [(0, 16), (1, 16), (2, 11), (2, 12), (2, 16)]


def test_metadata_lookup(spark, fleet):
    requests = spark.createDataFrame(
        [
            (1, "instance", "gauges"),
            (2, "host", "rack-a1"),
            (3, "cluster", "rack-a1"),
            (4, "instance", None),
            (5, "instance", "nobody"),
            (6, "instance", "odd_one"),
            (7, "host", "host09,"),
            (8, None, "gauges"),
        ],
        "request_id long, class string, name string",
    )
    got, outcomes = lookup.metadata_lookup(requests, fleet)
    assert rows(got, "request_id", "id") == [(1, 5), (2, 1), (2, 3), (2, 6)]
    assert rows(outcomes, "request_id", "status", "affected") == [
        (1, 200, 1), (2, 200, 3), (3, 400, 0), (4, 400, 0),
        (5, 404, 0), (6, 404, 0), (7, 400, 0), (8, 400, 0),
    ]


def test_lookup_missing_and_attribute_value(spark, fleet):
    requests = spark.createDataFrame(
        [(1, "ledger", "port"), (2, "nobody", "port"), (3, "sandbox", "none")],
        "request_id long, db_name string, name string",
    )
    found = lookup.lookup(requests, fleet["instances"], {"db_name": "db_name"}, ["id", "host"])
    assert found.columns == ["request_id", "id", "host"]
    assert rows(found, "request_id", "id") == [(1, 3), (3, 4)]
    gone = lookup.missing(requests, fleet["instances"], {"db_name": "db_name"})
    assert rows(gone, "request_id", "status") == [(2, 404)]
    value = lookup.attribute_value(requests, fleet["instances"], fleet["attribute"])
    assert rows(value, "request_id", "value") == [(1, "3306")]


def test_pool_and_latest(spark, fleet):
    assert rows(lookup.next_free(fleet["functional_aliases"]), "dns_name") == [("spare-a",)]
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 2), ("b", None, 3)], "k string, o string, v int"
    )
    got = lookup.latest_per_key(df, "k", ["o"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", "y", 2), ("b", None, 3)]


def test_plans_have_no_cross_join_and_push_filters(spark, tmp_path):
    path = str(tmp_path)
    for name, df in catalog(spark).items():
        df.write.parquet(f"{path}/{name}")
    from fleetlens.sources.catalog import read_catalog

    stored = read_catalog(spark, path, list(catalog(spark)))
    plan = views.metadata_view(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    view = views.instance_view(stored["instances"]).where("db_name = 'ledger'").select("id")
    scan = view._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(db_name,ledger)" in scan and "e_group" not in scan


def test_join_unique_with_a_hot_key(spark):
    left = [(n, "hot" if n % 3 else f"k{n}") for n in range(60)] + [(n, None) for n in range(60, 75)]
    df = spark.createDataFrame(left, "id long, k string")
    table_ = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    wanted = sorted((i, k or "", v) for i, k, v in map(tuple, df.join(table_, "k", "left").select(
        "id", F.coalesce("k", F.lit("")), F.coalesce("v", F.lit(0))).collect()))
    got = ordering.join_unique(df, table_, ["k"])
    assert rows(got, "id", F.coalesce("k", F.lit("")), F.coalesce("v", F.lit(0))) == wanted
    assert len(wanted) == 75


def test_metadata_shuffles_each_table_once(spark, tmp_path):
    path = str(tmp_path)
    for name, df in catalog(spark).items():
        df.write.parquet(f"{path}/{name}")
    from fleetlens.sources.catalog import read_catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.metadata_view(read_catalog(spark, path, list(catalog(spark))))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 3


def test_hosts_are_joined_on_the_rarest_one(spark):
    """Every instance is on ``a``, one on ``b``: the join has as many rows as ``b`` has instances."""
    fleet_rows = [(n, f"db_{n}", "a,b" if n == 7 else "a,c" if n % 2 else "a") for n in range(400)]
    instances = table(spark, "instances", fleet_rows, ["id", "db_name", "host"])
    requests = host_requests(spark, "a,b", "b,a", "a,b,c", "a,nowhere", "c,a,a", "b")
    candidates = lookup.on_rarest_host(requests, instances)
    counted = candidates.groupBy("asked").agg(F.count("*").alias("n")).collect()
    by_request = {tuple(r["asked"]): r["n"] for r in counted}
    assert by_request == {("a", "b"): 1, ("b", "a"): 1, ("a", "b", "c"): 1, ("c", "a"): 199, ("b",): 1}
    matches = lookup.match_hosts(requests, instances)
    assert matches.where("id = 7").count() == 3 and matches.count() == 3 + 199


def test_a_value_that_looks_like_a_hole_is_not_filled_again(spark):
    df = spark.createDataFrame(
        [("/x/{name}/{port}", "{port}{NAME}", "1{port}", "33"), ("{version}", "n", "{name}", None),
         ("/a{port}b", "n", "v", None), ("{NAME}{name}/{version}.", "aB", "2", "1"), ("/plain", "n", None, None),
         ("", "n", "v", "1")],
        "t string, name string, version string, port string",
    )
    got = df.select(E.fill_path(F.col("t"), F.col("name"), F.col("version"), F.col("port"))).collect()
    assert [r[0] for r in got] == ["/x/{port}{name}/33", "{name}", None, "ABab/2.", "/plain", ""]


def test_metadata_by_key_has_no_shuffle(spark, tmp_path):
    fleet = catalog(spark, edge=True)
    names = sources.write_by_key(fleet, str(tmp_path), "keyed_", 4)
    assert names == ["keyed_instances", "keyed_attribute", "keyed_volume"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        found = views.metadata_view(sources.read_by_key(spark, "keyed_"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the fixed directory rules are broadcast, the tables stay where they are
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert plan.count("Bucketed: true") == 3
    assert found.count() > 0
    columns = [c for c in found.columns if c != "attributes"]
    expected = views.metadata_view(fleet)
    assert rows(found, *columns) == rows(expected, *columns)
    with pytest.raises(ValueError):
        sources.read_by_key(spark, "nowhere_")


def test_instances_of_a_host_are_matched_once_for_all_who_ask(spark, monkeypatch):
    """Forty requests for a host of fifty instances: stored are its instances, not the pairs."""
    fleet_rows = [(n, f"db_{n}", "PG", "busy" if n < 50 else "quiet") for n in range(60)]
    fleet = {
        "instances": table(spark, "instances", fleet_rows, ["id", "db_name", "db_type", "host"]),
        "attribute": table(spark, "attribute", [(1, 3, "port", "5")], ["id", "instance_id", "name", "value"]),
        "volume": table(spark, "volume", [(1, 4)], ["id", "instance_id"]),
    }
    asked = [(n, "host", "busy" if n % 2 else " busy") for n in range(40)]
    asked += [(40, "host", "quiet"), (41, "host", "busy,quiet"), (42, "instance", "db_7"), (42, "instance", "db_8"),
              (43, "host", "nowhere"), (44, "cluster", "busy"), (None, "instance", "db_9")]
    requests = spark.createDataFrame(asked, "request_id long, class string, name string")
    kept = []

    def spied(df):
        kept.append(df.count())
        return stored(df)

    monkeypatch.setattr(lookup, "stored", spied)
    got, outcomes = lookup.metadata_lookup(requests, fleet)
    on_hosts = lookup.instances_on_hosts(requests.where("class = 'host'"), fleet)
    assert max(kept) <= 50 + 10 + 3
    expected = sorted([(n, i) for n in range(40) for i in range(50)] + [(40, i) for i in range(50, 60)])
    assert sorted(rows(on_hosts, "request_id", "id")) == expected
    pairs = [tuple(r) for r in got.select("request_id", "id").collect()]
    assert sorted(p for p in pairs if p[0] is not None) == sorted([*expected, (42, 7), (42, 8)])
    assert [p for p in pairs if p[0] is None] == [(None, 9)]
    counts = {r["request_id"]: (r["status"], r["affected"]) for r in outcomes.collect()}
    assert all(counts[n] == (200, 50) for n in range(40))
    assert [counts[n] for n in (40, 41, 42, 43, 44, None)] == [
        (200, 10), (404, 0), (200, 2), (404, 0), (400, 0), (404, 0)
    ]


def one_busy_host(spark, n, asked):
    """``n`` instances on a host, and requests for it and for a few others."""
    fleet_rows = [(i, f"db_{i}", "PG", "busy,old" if i % 3 else "busy") for i in range(n)]
    fleet = {
        "instances": table(spark, "instances", fleet_rows, ["id", "db_name", "db_type", "host"]),
        "attribute": table(spark, "attribute", [(i, i, "port", str(5000 + i)) for i in range(n)],
                           ["id", "instance_id", "name", "value"]),
        "volume": table(spark, "volume", [(1, 4), (2, 4)], ["id", "instance_id"]),
    }
    return fleet, spark.createDataFrame(asked, "request_id long, class string, name string")


def test_rows_of_requests_and_instances_are_cut_on_both_sides(spark, monkeypatch):
    """Shares and runs of a few rows give each pair once, with the columns of the shape."""
    for name, size in (("ROWS", 5), ("ASKERS", 4), ("RUN", 3)):
        monkeypatch.setattr(lookup, name, size)
    asked = [(n, "host", "busy" if n < 17 else "old , busy") for n in range(30)]
    asked += [(40, "instance", "db_4"), (40, "instance", "db_5"), (None, "instance", "db_4"), (41, "host", "new")]
    fleet, requests = one_busy_host(spark, 23, asked)
    got, outcomes = lookup.metadata_lookup(
        requests, fleet, shape=lambda view: view.select("id", F.size("volumes").alias("n"), "port")
    )
    assert got.columns == ["request_id", "id", "n", "port"]
    expected = [(n, i) for n in range(30) for i in range(23) if n < 17 or i % 3]
    expected = [(n, i, 2 * (i == 4), str(5000 + i)) for n, i in [*expected, (40, 4), (40, 5)]]
    found = [tuple(r) for r in got.collect()]
    assert sorted(r for r in found if r[0] is not None) == expected
    assert [r for r in found if r[0] is None] == [(None, 4, 2, "5004")]
    counts = {r["request_id"]: r["affected"] for r in outcomes.where("status = 200").collect()}
    assert counts == {n: 23 if n < 17 else 15 for n in range(30)} | {40: 2}


def test_a_file_of_requests_and_instances_is_small(spark, tmp_path):
    """4,001 requests for a host of 300 instances: a row of the file takes half a byte at most."""
    fleet, requests = one_busy_host(spark, 300, [(n, "host", "busy") for n in range(4001)])
    got, _ = lookup.metadata_lookup(requests, fleet)
    got.select("request_id", "id", "db_name", "port", "socket").write.parquet(f"{tmp_path}/rows")
    written = spark.read.parquet(f"{tmp_path}/rows")
    assert written.count() == written.distinct().count() == 4001 * 300
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 4001 * 300 / 2
