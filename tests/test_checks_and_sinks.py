import json
import re

import pytest
from seed import catalog, rows, table

from fleetlens import schemas as S
from fleetlens.operators import checks, lookup, views
from fleetlens.sources import documents, export, snapshots
from fleetlens.sources import catalog as sources


@pytest.fixture(scope="module")
def fleet(spark):
    return catalog(spark, edge=True)


def test_checks(spark, fleet):
    assert rows(checks.duplicates(fleet["attribute"], ["instance_id", "name"]), "key", "n") == [
        ("16|port", 2)
    ]
    assert checks.duplicates(fleet["functional_aliases"], ["db_name"]).count() == 0
    assert rows(checks.nulls(fleet["instances"], ["host", "id", "version"]), "key", "n") == [
        ("host", 1),
        ("version", 2),
    ]
    long = table(spark, "functional_aliases", [("d", "123456789", "a")], S.FUNCTIONAL_ALIASES.columns)
    assert rows(checks.overlong(long, S.FUNCTIONAL_ALIASES.limits), "rule", "key", "n") == [
        ("length", "db_name", 1)
    ]
    lost = checks.orphans(fleet["volume"], fleet["instances"].where("id <> 3"))
    assert rows(lost, "key", "n") == [("3", 3)]
    report = checks.check_catalog({**fleet, "functional_aliases": long})
    assert rows(report, "table", "rule", "key", "n") == [
        ("attribute", "unique:instance_id,name", "16|port", 2),
        ("functional_aliases", "length", "db_name", 1),
    ]
    assert checks.check(fleet["attribute"], S.ATTRIBUTE, unique=()).count() == 0


def test_report_reads_each_table_once(spark, fleet, tmp_path):
    for name, df in fleet.items():
        df.write.parquet(str(tmp_path / name))
    report = checks.check_catalog(sources.read_catalog(spark, str(tmp_path), list(fleet)))
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == len(fleet) and "Join" not in plan
    whole = report._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange") == 1 and "SortAggregate" not in whole


def test_report_compares_whole_keys(spark):
    definitions = [("a|b", "c", None, None), ("a", "b|c", None, None), ("x", "y", None, None),
                   ("x", "y", None, ""), ("x", "y", None, None), (None, None, None, None)]
    df = table(spark, "command_definition", definitions, S.COMMAND_DEFINITION.columns)
    assert rows(checks.check(df, S.COMMAND_DEFINITION), "rule", "key", "n") == [
        ("not_null", "command_name", 1),
        ("not_null", "type", 1),
        ("unique:command_name,type,category", "x|y|", 2),
    ]
    assert checks.check(df.limit(0), S.COMMAND_DEFINITION).count() == 0


def test_report_finds_orphans_of_every_size(spark, fleet):
    hot = spark.range(3000).selectExpr("id + 1000 AS id", "77L AS instance_id")
    more = hot.selectExpr("id", "instance_id", "concat('n', id) AS name", "'v' AS value")
    nameless = more.limit(1).selectExpr("5000L AS id", "CAST(NULL AS long) AS instance_id", "name", "value")
    children = fleet["attribute"].unionByName(more).unionByName(nameless)
    report = checks.check_catalog({"instances": fleet["instances"], "attribute": children})
    assert rows(report.where("rule <> 'unique:instance_id,name'"), "table", "rule", "key", "n") == [
        ("attribute", "not_null", "instance_id", 1),
        ("attribute", "orphan:instance_id", "77", 3000),
    ]


def test_reject_table(spark):
    good = '{"username":"u","class":"T","creation_date":"2020-01-01","db_type":"PG","db_name":"n","hosts":["a"]}'
    docs = spark.createDataFrame(
        [(1, good), (2, "nonsense"), (3, None), (4, good.replace('["a"]', '"a"')),
         (5, good.replace('"PG"', "null")), (6, good[:-1] + ',"attributes":{"x":null}}')],
        "request_id long, body string",
    )
    parsed, rejected = documents.parse_instance_docs(docs)
    assert rows(parsed, "request_id", "db_name", "host") == [(1, "n", "a")]
    assert parsed.first()["volumes"] == []
    assert rows(rejected, "request_id", "reason") == [
        (2, "malformed"), (3, "no body"), (4, "malformed"), (5, "bad field"), (6, "bad child"),
    ]
    assert rejected.where("request_id = 2").first()["body"] == "nonsense"


def inventory(fleet):
    return views.node_inventory(fleet["instances"], fleet["functional_aliases"], fleet["attribute"])


def test_node_lines_escape_and_leave_out_null(spark, fleet):
    odd = table(
        spark, "functional_aliases", [("d", "no_port", "a<b&\"c'"), ("e", "no_port", "Z")],
        S.FUNCTIONAL_ALIASES.columns,
    )
    got = export.node_lines(views.node_inventory(fleet["instances"], odd, fleet["attribute"]))
    assert got.first()["line"] == (
        '<node name="no_port" description="" hostname="a&lt;b&amp;&quot;c&apos;"'
        f' username="{S.NODE_USERNAME}"'
        ' type="TEST" subcategory="MYSQL" tags="MYSQL,TEST"/>'
    )


@pytest.mark.parametrize("single", [True, False])
def test_xml_node_list(spark, fleet, tmp_path, single):
    path = str(tmp_path / "nodes")
    export.write_node_list(inventory(fleet), path, single_file=single)
    files = sorted((tmp_path / "nodes").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert "<project>" in text and (len(files) == 1 or not single)
    names = re.findall(r'<node name="([^"]+)" description="" hostname="([^"]+)"', text)
    assert [n for n, _ in names] == ["ledger", "orders_eu", "orders_us"]


def test_json_documents(spark, fleet):
    requests = spark.createDataFrame([(0, "rack-b7"), (1, "rack-c3")], "request_id long, name string")
    found = lookup.instances_on_hosts(requests, fleet)
    docs = {r["request_id"]: json.loads(r["document"]) for r in export.to_documents(found, "request_id").collect()}
    assert [i["db_name"] for i in docs[0]["response"]] == ["orders_us", "gauges", "archive"]
    last = docs[0]["response"][2]
    assert last["attributes"] == {"port": "3307", "read_only": "yes"} and len(last["volumes"]) == 2
    assert last["hosts"] == ["rack-a1", "rack-b7"]
    assert docs[1]["response"][0]["volumes"] == []
    paged = export.to_documents(found, "request_id", envelope="data", group_rows=2).collect()
    of_zero = [json.loads(r["document"])["data"] for r in paged if r["request_id"] == 0]
    assert len(of_zero) > 1
    assert sorted(i["id"] for page in of_zero for i in page) == [2, 5, 6]


def test_null_fields_are_in_the_document(spark, fleet, tmp_path):
    requests = spark.createDataFrame([(1, "orders_eu")], "request_id long, db_name string")
    found = lookup.lookup(requests, views.instance_view(fleet["instances"]), {"db_name": "db_name"})
    docs = export.to_documents(found, "request_id")
    body = json.loads(docs.first()["document"])["response"][0]
    assert body["slave"] is None and body["class"] == "PROD"
    export.write_documents(docs, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["response"][0]["id"] == 1


def test_appended_rows_are_added(spark, fleet, tmp_path):
    path, schema = str(tmp_path / "host"), "id long, name string, memory int"
    assert snapshots.read_if_present(spark, schema, path).count() == 0
    for _ in range(2):
        snapshots.append_rows(fleet["host"].select("id", "name", "memory"), path)
    assert snapshots.read_if_present(spark, schema, path).count() == 2 * fleet["host"].count()


def test_catalog_views(spark, fleet, tmp_path):
    for name, df in fleet.items():
        df.write.parquet(str(tmp_path / name))
    stored = sources.read_catalog(spark, str(tmp_path), list(fleet))
    names = sources.register_views(stored, "v_")
    assert {"v_instances", "v_instance", "v_metadata", "v_node_inventory"} <= set(names)
    got = spark.sql("SELECT class, port FROM v_metadata WHERE db_name = 'archive'").first()
    assert tuple(got) == ("ACC", "3307")


def test_jdbc_options_split_the_scan():
    options = sources.jdbc_options("jdbc:x", "t", "id", 0, 100, 8)
    assert options["numPartitions"] == "8" and options["upperBound"] == "100"
    assert options["partitionColumn"] == "id" and options["fetchsize"] == "10000"


def test_documents_are_joined_without_collecting_their_rows(spark):
    """Documents within a batch, over several batches, of a null key, with nulls and signs in texts."""
    given = [(k, n, f'{n}"é' if n % 3 else None) for k, size in ((1, 7), (2, 1), (None, 5), (3, 40), (4, 1), (5, 2))
             for n in range(size)]
    df = spark.createDataFrame(given, "request_id long, id long, name string").repartition(5)
    expected = {}
    for k, n, name in given:
        expected.setdefault(k, []).append({"id": n, "name": name})
    for batch in (1, 3, 8, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            docs = export.to_documents(df, "request_id", order=["id"])
            found = docs.collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found) == len(expected)
        assert {r["request_id"]: json.loads(r["document"])["response"] for r in found} == expected
        assert all(r["n_rows"] == len(expected[r["request_id"]]) for r in found)
    assert docs.dtypes == [("request_id", "bigint"), ("n_rows", "bigint"), ("document", "string")]
    assert "collect_list" not in docs._jdf.queryExecution().executedPlan().toString()
    assert export.to_documents(df.where("id < 0"), "request_id").collect() == []
