"""A small fleet of a shop and its books, with the edge rows that operators have to get right."""

from __future__ import annotations

import datetime

from fleetlens import schemas as S

DAY = datetime.date(2023, 3, 14)

INSTANCES = [
    (1, "lena", "orders_eu", "PROD", "PG", "14.2", "rack-a1"),
    (2, "omar", "orders_us", "PROD", "PG", "15.1", "rack-b7"),
    (3, "omar", "ledger", "PROD", "MYSQL", "8.0.31", "rack-a1"),
    (4, "ines", "sandbox", "DEV", "MYSQL", "8.0.20", "rack-c3"),
    (5, "ines", "gauges", "TEST", "InfluxDB", "1.8", "rack-b7"),
    (6, "yuki", "archive", "ACC", "MYSQL", "5.7.44", "rack-a1,rack-b7"),
]
ATTRIBUTES = [
    (1, 1, "port", "5432"),
    (2, 1, "collation", "C"),
    (3, 3, "port", "3306"),
    (4, 5, "port", "8086"),
    (5, 2, "port", "5433"),
    (6, 6, "port", "3307"),
    (7, 6, "read_only", "yes"),
]
# id, instance and path; the owner and server follow from the instance.
VOLUMES = [
    (1, 3, "/srv/ledger/data"),
    (2, 3, "/srv/ledger/log"),
    (3, 3, "/srv/ledger/tmp"),
    (4, 2, "/srv/orders/us"),
    (5, 6, "/srv/archive/cold"),
    (6, 6, "/srv/archive/index"),
    (7, 1, "/srv/orders/eu"),
    (8, 5, "/srv/gauges"),
]
HOSTS = [(1, "rack-a1", 48), (2, "rack-b7", 32), (3, "rack-c3", 8)]
# Two names of the pool are free.
ALIASES = [
    ("eu-orders", "orders_eu", "orders-eu.shop.test"),
    ("books", "ledger", "books.shop.test"),
    ("us-orders", "orders_us", "orders-us.shop.test"),
    ("spare-b", None, None),
    ("spare-a", None, None),
]

EDGE_INSTANCES = [
    (11, "u", "Influx_One", "TEST", "InfluxDB", "1.0", "host09"),
    (12, "u", "ora_one", "TEST", "ORACLE", None, "host09"),
    (13, "u", "ora_two", "TEST", "ORA", "12", None),
    (14, "u", "odd_one", "TEST", "mysql", "1", "host09"),
    (15, "u", "no_port", "TEST", "MYSQL", "5.5", ""),
    (16, "u", "two_hosts", "TEST", "PG", None, "host08,host09"),
]
EDGE_ATTRIBUTES = [
    (21, 16, "port", "7000"),
    (22, 16, "port", "7001"),
    (23, 16, "opt", "a,b={c}"),
]


def table(spark, name, rows, columns):
    """Rows given by some columns as a full catalog table."""
    spec = S.TABLES[name]
    full = [tuple(dict(zip(columns, row)).get(c) for c in spec.columns) for row in rows]
    return spark.createDataFrame(full, spec.schema)


def catalog(spark, edge: bool = False):
    """The seed catalog; ``edge`` adds the edge rows."""
    columns = ["id", "username", "db_name", "category", "db_type", "version", "host"]
    found = INSTANCES + (EDGE_INSTANCES if edge else [])
    users = {r[0]: r[1] for r in INSTANCES}
    volumes = [
        (i, of, "0700", users[of], "dba", f"filer-{of % 2}", "rw,noatime", path)
        for i, of, path in VOLUMES
    ]
    given = {
        "instances": ([(*r, DAY) for r in found], [*columns, "creation_date"]),
        "attribute": (ATTRIBUTES + (EDGE_ATTRIBUTES if edge else []), S.ATTRIBUTE.columns),
        "volume": (volumes, S.VOLUME.columns),
        "host": (HOSTS, S.HOST.columns),
        "functional_aliases": (ALIASES, S.FUNCTIONAL_ALIASES.columns),
    }
    return {name: table(spark, name, *of) for name, of in given.items()}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def statuses(change):
    return {r["request_id"]: r["status"] for r in change.outcomes.collect()}


def affected(change):
    return {r["request_id"]: r["affected"] for r in change.outcomes.collect()}
