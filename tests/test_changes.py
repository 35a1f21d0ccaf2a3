import json
import random

import pytest
from seed import affected, catalog, rows, statuses, table

from fleetlens import schemas as S
from fleetlens.operators import lookup, views
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

VOLUME = {
    "mounting_path": "/srv/wiki/pages",
    "server": "filer-7",
    "owner": "noor",
    "group": "web",
    "file_mode": "0750",
    "mount_options": "ro",
}


def document(**changes):
    doc = {
        "db_name": "wiki",
        "db_type": "PG",
        "version": "16.0",
        "class": "DEV",
        "username": "noor",
        "creation_date": "2024-02-29",
        "hosts": ["rack-e5"],
        "attributes": {"port": "5440", "locale": "de"},
        "volumes": [VOLUME],
    }
    doc.update(changes)
    return json.dumps({k: v for k, v in doc.items() if v is not ...})


def requests(spark, rows_, schema):
    return spark.createDataFrame(rows_, schema)


def bodies(spark, *docs):
    return requests(spark, list(enumerate(docs)), "request_id long, body string")


def patches(spark, *named):
    return requests(
        spark,
        [(n, name, body if isinstance(body, str) or body is None else json.dumps(body))
         for n, (name, body) in enumerate(named)],
        "request_id long, db_name string, body string",
    )


@pytest.fixture(scope="module")
def fleet(spark):
    return catalog(spark)


# -- create --------------------------------------------------------------------------


def test_create_read_delete(spark, fleet):
    created = create_instances(fleet, bodies(spark, document()))
    assert statuses(created) == {0: 201} and affected(created) == {0: 4}
    state = created.state(fleet)
    got = views.metadata_view(state).where("db_name = 'wiki'").collect()
    assert len(got) == 1 and got[0]["id"] == 7
    assert [v["id"] for v in got[0]["volumes"]] == [9]
    assert got[0]["attributes"] == {"port": "5440", "locale": "de"}
    assert got[0]["hosts"] == ["rack-e5"]
    asked = requests(spark, [(1, "wiki"), (2, "nobody")], "request_id long, db_name string")
    deleted = delete_instances(state, asked)
    assert statuses(deleted) == {1: 204, 2: 404}
    after = deleted.state(state)
    for name in ("instances", "attribute", "volume"):
        assert rows(after[name], "id") == rows(fleet[name], "id")


def test_create_verdicts(spark, fleet):
    docs = [
        document(db_name="ledger"),  # 0 in use
        document(db_type=...),  # 1 required field absent
        "{broken",  # 2
        None,  # 3
        document(hosts=[]),  # 4
        document(db_name="new", volumes=[{**VOLUME, "owner": None}]),  # 5 bad child
        document(db_name="new"),  # 6 wins
        document(db_name="new", attributes={}),  # 7 repeated
        document(db_name="new", attributes={"a": None}),  # 8 repeated before bad child
        document(db_name="gauges", volumes=[{}]),  # 9 in use before bad child
        document(db_name="x" * 129),  # 10 too long
        document(db_name="other", unknown=1),  # 11 no such column
        document(db_name="sized", db_size="100"),  # 12
        document(db_name="unsized", db_size="many"),  # 13
        document(db_name="plain", hosts=..., volumes=..., attributes=..., host="h1,h2"),  # 14
        '{"username": "u"} trailing',  # 15
        document(db_name="list", hosts="h1"),  # 16
        document(db_name="date", creation_date="soon"),  # 17
        "",  # 18
    ]
    change = create_instances(fleet, bodies(spark, *docs))
    assert statuses(change) == {
        0: 409, 1: 400, 2: 400, 3: 400, 4: 400, 5: 400, 6: 201, 7: 409, 8: 409, 9: 409,
        10: 400, 11: 400, 12: 201, 13: 400, 14: 201, 15: 400, 16: 400, 17: 400, 18: 400,
    }
    assert change.append_only
    added = change.representation("instances")
    assert rows(added, "id", "db_name", "host") == [
        (7, "new", "rack-e5"), (8, "sized", "rack-e5"), (9, "plain", "h1,h2"),
    ]
    assert rows(added.where("db_size is not null"), "db_size") == [(100,)]
    assert rows(change.changed["volume"], "id", "instance_id") == [(9, 7), (10, 8)]
    assert rows(change.changed["attribute"], "instance_id", "name") == [
        (7, "locale"), (7, "port"), (8, "locale"), (8, "port"),
    ]
    assert [i for (i,) in rows(change.changed["attribute"], "id")] == [8, 9, 10, 11]


def test_two_hosts_are_stored_as_one_text(spark, fleet):
    state = create_instances(fleet, bodies(spark, document(hosts=["a", "b"]))).state(fleet)
    assert rows(state["instances"].where("db_name = 'wiki'"), "host") == [("a,b",)]
    one = views.metadata_view(state).where("db_name = 'wiki'").first()
    assert one["hosts"] == ["a", "b"]


def test_repeated_attribute_name_in_a_document_takes_the_last(spark, fleet):
    body = document().replace('"port": "5440", "locale": "de"', '"port": "1", "x": "2", "port": "3"')
    added = create_instances(fleet, bodies(spark, body)).changed["attribute"]
    assert rows(added, "name", "value") == [("port", "3"), ("x", "2")]


# -- patch ---------------------------------------------------------------------------


def test_patch_columns_and_children(spark, fleet):
    change = patch_instances(
        fleet,
        patches(
            spark,
            ("orders_eu", {"version": "9", "description": "x", "status": "3"}),
            ("orders_eu", {"version": "10", "master": None}),
            ("ledger", {"volumes": [], "hosts": ["p", "q"]}),
            ("archive", {"volumes": [VOLUME], "attributes": {"a": "1", "b": "2"}}),
            ("sandbox", {"db_name": "renamed"}),
            ("gauges", {}),
            ("nobody", {"version": "1"}),
        ),
    )
    assert statuses(change) == {0: 204, 1: 204, 2: 204, 3: 204, 4: 204, 5: 204, 6: 404}
    state = change.state(fleet)
    got = {r["id"]: r for r in state["instances"].collect()}
    assert (got[1]["version"], got[1]["description"], got[1]["status"]) == ("10", "x", "3")
    assert got[3]["host"] == "p,q" and got[4]["db_name"] == "renamed"
    assert got[5]["username"] == "ines" and len(got) == 6
    assert rows(state["volume"], "instance_id", "id") == [(1, 7), (2, 4), (5, 8), (6, 9)]
    assert rows(state["attribute"].where("instance_id = 6"), "id", "name", "value") == [
        (8, "a", "1"), (9, "b", "2"),
    ]
    assert rows(change.representation("instances"), "id") == [(1,), (3,), (4,), (5,), (6,)]


def test_patch_refusals(spark, fleet):
    change = patch_instances(
        fleet,
        patches(
            spark,
            ("archive", "not json"),
            ("archive", {"hosts": []}),
            ("archive", {"volumes": None}),
            ("archive", {"username": None}),
            ("archive", {"db_name": "ledger"}),
            ("archive", {"db_name": "archive"}),
            ("orders_us", {"db_name": "fresh"}),
            ("gauges", {"db_name": "fresh"}),
            ("orders_us", {"db_name": "fresh", "state": "S"}),
            ("ledger", {"attributes": {"a": None}}),
            ("ledger", {"nothing": 1}),
            ("nobody", {"nothing": 1}),
            ("nobody", "[]"),
        ),
    )
    assert statuses(change) == {
        0: 400, 1: 400, 2: 400, 3: 400, 4: 409, 5: 204, 6: 204, 7: 409, 8: 204,
        9: 400, 10: 400, 11: 404, 12: 400,
    }
    got = {r["id"]: r for r in change.tables["instances"].collect()}
    assert got[2]["db_name"] == "fresh" and got[2]["state"] == "S" and got[5]["db_name"] == "gauges"
    assert rows(change.tables["volume"], "id") == rows(fleet["volume"], "id")


# -- attributes ----------------------------------------------------------------------


def test_insert_attributes(spark, fleet):
    change = insert_attributes(
        fleet,
        patches(
            spark,
            ("ledger", {"a": "1", "b": "2"}),  # 0
            ("ledger", {"port": "1", "c": "3"}),  # 1 port is there: nothing added
            ("ledger", {}),  # 2
            ("ledger", None),  # 3
            ("nobody", {"a": "1"}),  # 4
            ("sandbox", {"a": None}),  # 5
            ("sandbox", {"a": "x", "n": 5}),  # 6
            ("sandbox", {"a": "y"}),  # 7 later than 6
            ("nobody", {}),  # 8
            ("gauges", {"a": "x" * 251}),  # 9
            ("gauges", "[1]"),  # 10
        ),
    )
    assert statuses(change) == {
        0: 201, 1: 409, 2: 400, 3: 400, 4: 404, 5: 400, 6: 201, 7: 409, 8: 400, 9: 400, 10: 400,
    }
    assert affected(change)[0] == 2 and affected(change)[7] == 0
    assert rows(change.representation("attribute"), "id", "instance_id", "name", "value") == [
        (8, 3, "a", "1"), (9, 3, "b", "2"), (10, 4, "a", "x"), (11, 4, "n", "5"),
    ]


WRITES = "request_id long, db_name string, name string, value string"


def test_update_attributes(spark, fleet):
    asked = requests(
        spark,
        [
            (1, "archive", "read_only", "no"),
            (2, "archive", "read_only", "later"),
            (3, "archive", "none", "1"),
            (4, "nobody", "port", "1"),
            (5, "ledger", "port", ""),
            (6, "ledger", "port", None),
            (7, "orders_eu", "collation", 'a "quoted" one'),
            (8, "nobody", "port", None),
        ],
        WRITES,
    )
    change = update_attributes(fleet, asked)
    assert statuses(change) == {1: 204, 2: 204, 3: 404, 4: 404, 5: 400, 6: 400, 7: 204, 8: 400}
    got = dict(rows(change.tables["attribute"], "id", "value"))
    assert got == {
        1: "5432", 2: 'a "quoted" one', 3: "3306", 4: "8086", 5: "5433", 6: "3307", 7: "later",
    }
    assert rows(change.representation("attribute"), "id") == [(2,), (7,)]


def test_delete_attributes(spark, fleet):
    asked = requests(
        spark,
        [
            (1, "gauges", "port", None),
            (2, "gauges", "port", None),
            (3, "gauges", "none", None),
            (4, "nobody", "port", None),
            (5, "ledger", None, None),
            (6, None, "port", None),
        ],
        WRITES,
    )
    change = delete_attributes(fleet, asked)
    assert statuses(change) == {1: 204, 2: 204, 3: 404, 4: 404, 5: 400, 6: 400}
    assert rows(change.tables["attribute"], "id") == [(1,), (2,), (3,), (5,), (6,), (7,)]


# -- hosts ---------------------------------------------------------------------------

HOST_WRITES = "request_id long, name string, memory string"


def test_hosts(spark, fleet):
    asked = requests(
        spark,
        [
            (1, "rack-c3", "8"),
            (2, "new", "42"),
            (3, "new", "43"),
            (4, "newer", "forty-two"),
            (5, "newer", None),
            (6, "newer", " 7 "),
            (7, "big", "4.5"),
            (8, "huge", "99999999999"),
        ],
        HOST_WRITES,
    )
    inserted = insert_hosts(fleet, asked)
    assert statuses(inserted) == {1: 409, 2: 201, 3: 409, 4: 400, 5: 400, 6: 201, 7: 400, 8: 400}
    assert rows(inserted.representation("host"), "id", "name", "memory") == [
        (4, "new", 42), (5, "newer", 7),
    ]
    updated = update_hosts(
        fleet,
        requests(
            spark,
            [(1, "rack-b7", "1"), (2, "rack-b7", "2"), (3, "rack-b7", "x"), (4, "nobody", "5")],
            HOST_WRITES,
        ),
    )
    assert statuses(updated) == {1: 200, 2: 200, 3: 400, 4: 404}
    assert rows(updated.tables["host"], "id", "memory") == [(1, 48), (2, 2), (3, 8)]
    deleted = delete_hosts(fleet, requests(spark, [(1, "rack-c3", None), (2, "none", None)], HOST_WRITES))
    assert statuses(deleted) == {1: 200, 2: 404}
    assert rows(deleted.tables["host"], "id") == [(1,), (2,)]


# -- aliases -------------------------------------------------------------------------

ALIAS_WRITES = "request_id long, db_name string, alias string"


def test_allocate_and_release(spark, fleet):
    asked = requests(
        spark,
        [
            (1, "ledger", "a"),  # has one
            (2, "wiki", None),  # no alias
            (3, "wiki", "w"),  # takes the first free name
            (4, "gauges", "g"),  # takes the last one
            (5, "orders_eu", "b"),  # the pool is empty by now
            (6, "late", "l"),
        ],
        ALIAS_WRITES,
    )
    change = allocate_aliases(fleet, asked)
    assert statuses(change) == {1: 409, 2: 400, 3: 201, 4: 201, 5: 503, 6: 503}
    assert rows(change.representation("functional_aliases"), "dns_name", "db_name", "alias") == [
        ("spare-a", "wiki", "w"), ("spare-b", "gauges", "g"),
    ]
    state = change.state(fleet)
    assert statuses(allocate_aliases(state, asked)) == {1: 503, 2: 400, 3: 503, 4: 503, 5: 503, 6: 503}
    released = release_aliases(
        state,
        requests(spark, [(1, "wiki", None), (2, "nobody", None), (3, "wiki", None)], ALIAS_WRITES),
    )
    assert statuses(released) == {1: 204, 2: 400, 3: 204}
    assert rows(lookup.free_pool(released.tables["functional_aliases"]), "dns_name") == [
        ("spare-a",)
    ]


def test_allocation_name_limit(spark, fleet):
    asked = requests(spark, [(1, "far_too_long", "a"), (2, "short", "b")], ALIAS_WRITES)
    assert statuses(allocate_aliases(fleet, asked, db_name_limit=8)) == {1: 400, 2: 201}


def test_release_frees_only_the_smallest(spark):
    pool = table(
        spark,
        "functional_aliases",
        [("d2", "db", "a2"), ("d1", "db", "a1"), ("d3", None, None)],
        S.FUNCTIONAL_ALIASES.columns,
    )
    change = release_aliases(
        {"functional_aliases": pool}, requests(spark, [(1, "db", None)], ALIAS_WRITES)
    )
    assert rows(change.tables["functional_aliases"].where("db_name is not null"), "dns_name") == [("d2",)]


def one_by_one(pool, asked):
    """The same requests against a plain dictionary."""
    pool, got = dict(pool), {}
    for request_id, name, alias in sorted(asked):
        free = sorted(d for d, of in pool.items() if of is None)
        if alias is None:
            got[request_id] = 400
        elif not free:
            got[request_id] = 503
        elif name in pool.values():
            got[request_id] = 409
        else:
            pool[free[0]] = name
            got[request_id] = 201
    return pool, got


@pytest.mark.parametrize("free", [0, 7, 40, 200])
def test_allocation_equals_one_by_one(spark, free):
    rng = random.Random(free)
    pool = {f"dns{n:03}": None if n < free else f"used{n}" for n in range(free + 20)}
    names = [f"db{n}" for n in range(80)] + [f"used{free + n}" for n in range(10)]
    asked = [
        (n * 3, rng.choice(names), None if rng.random() < 0.1 else f"a{n}") for n in range(300)
    ]
    aliases = table(
        spark,
        "functional_aliases",
        [(d, of, of and "x") for d, of in pool.items()],
        S.FUNCTIONAL_ALIASES.columns,
    )
    change = allocate_aliases(
        {"functional_aliases": aliases}, requests(spark, asked, ALIAS_WRITES).repartition(4)
    )
    wanted_pool, wanted = one_by_one(pool, asked)
    assert statuses(change) == wanted
    got = {r["dns_name"]: r["db_name"] for r in change.tables["functional_aliases"].collect()}
    assert got == wanted_pool


def test_created_documents_are_never_broadcast(spark):
    # Their files are small however large the documents are, so a size check by files fails.
    change = create_instances(catalog(spark), bodies(spark, document(), document(db_name="blog")))
    for df, key, kind in (
        (change.changed["volume"], "request_id", "Inner"),
        (change.changed["attribute"], "request_id", "Inner"),
        (change.outcomes, "db_name", "LeftOuter"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.splitlines() if f"Join [{key}#" in x and kind in x]
        assert joins and not any("Broadcast" in x for x in joins), joins
    assert len(rows(change.changed["volume"], "id")) == 2
