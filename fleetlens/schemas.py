"""Declared schemas, keys, length limits and fixed values of the fleet catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The results have to contain these texts as they are.
NODE_USERNAME = "dbod"
HOST_ALIAS_PREFIX = "dbod-"
HOST_ALIAS_DOMAIN = ".cern.ch"
HOST_ALIAS_TEXT_SUFFIX = "domain"

# The result codes a request can end with.
OK = 200
CREATED = 201
NO_CONTENT = 204
BAD_REQUEST = 400
NOT_FOUND = 404
CONFLICT = 409
BAD_GATEWAY = 502
SERVICE_UNAVAILABLE = 503

# Directory layout per database type. {version} and {port} are
# taken as they are, {NAME} is the upper-cased and {name} the lower-cased
# instance name. A NULL in a hole makes the whole path NULL.
DIRECTORY_COLUMNS = ["db_type", "basedir", "bindir", "datadir", "logdir", "socket"]
DEFAULT_DIRECTORIES = [  # of a type without a rule
    "/#BASEDIR#/{version}",
    "/#BASEDIR#/{version}/bin",
    "/ORA/dbs03/{NAME}/data",
    "/ORA/dbs02/{NAME}/pg_xlog",
    "/tmp",
]
DIRECTORY_RULES = [
    (
        "MYSQL",
        "/usr/local/mysql/mysql-{version}",
        "/usr/local/mysql/mysql-{version}/bin",
        "/ORA/dbs03/{NAME}/mysql",
        "/ORA/dbs02/{NAME}/mysql",
        "/var/lib/mysql/mysql.sock.{name}.{port}",
    ),
    (
        "PG",
        "/usr/local/pgsql/pgsql-{version}",
        "/usr/local/pgsql/pgsql-{version}/bin",
        "/ORA/dbs03/{NAME}/data",
        "/ORA/dbs02/{NAME}/pg_xlog",
        "/var/lib/pgsql/",
    ),
    (
        "InfluxDB",
        "/usr/local/influxdb/influxdb-{version}",
        "/usr/local/influxdb/influxdb-{version}/bin",
        "/ORA/dbs03/{NAME}",
        "/ORA/dbs02/{NAME}",
        "/var/lib/pgsql/",
    ),
    (
        "ORACLE",
        "/ORA/dbs01/oracle/product/rdbms",
        "/ORA/dbs01/oracle/product/rdbms",
        "/ORA/dbs03/{NAME}",
        "/ORA/dbs02/{NAME}",
        "/ORA/dbs01/oracle/product/rdbms/network/admin",
    ),
    (
        "ORA",
        "/ORA/dbs01/oracle/product/rdbms",
        "/ORA/dbs01/oracle/product/rdbms",
        "/ORA/dbs03/{NAME}",
        "/ORA/dbs02/{NAME}",
        "/ORA/dbs01/oracle/product/rdbms/network/admin",
    ),
]


@dataclass(frozen=True)
class Field:
    """One column: its Spark type, whether NULL is refused, its text limit."""

    name: str
    type: T.DataType
    required: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Table:
    """A catalog table with the rules its rows have to keep."""

    name: str
    fields: tuple[Field, ...]
    unique: tuple[tuple[str, ...], ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    @property
    def limits(self) -> dict[str, int]:
        return {f.name: f.limit for f in self.fields if f.limit is not None}

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)


def _text(name: str, limit: int | None = None, required: bool = False) -> Field:
    return Field(name, T.StringType(), required, limit)


def _date(name: str, required: bool = False) -> Field:
    return Field(name, T.DateType(), required)


def _int(name: str, required: bool = False) -> Field:
    return Field(name, T.IntegerType(), required)


def _id(name: str, required: bool = False) -> Field:
    # Ids and the links to them are both 64-bit: a mixed pair would put a cast
    # into the join key and cost one more shuffle of the aggregated side.
    return Field(name, T.LongType(), required)


INSTANCES = Table(
    "instances",
    (
        _id("id"),
        _text("username", 32, True),
        _text("db_name", 128, True),
        _text("e_group", 256),
        _text("category", 32, True),
        _date("creation_date", True),
        _date("expiry_date"),
        _text("db_type", 32, True),
        _int("db_size"),
        _int("no_connections"),
        _text("project", 128),
        _text("description", 1024),
        _text("version", 128),
        _text("master", 32),
        _text("slave", 32),
        _text("host", 128),
        _text("state", 32),
        _text("status", 32),
    ),
    unique=(("id",), ("db_name",)),
)

ATTRIBUTE = Table(
    "attribute",
    (
        _id("id"),
        _id("instance_id", True),
        _text("name", 32, True),
        _text("value", 250, True),
    ),
    unique=(("id",), ("instance_id", "name")),
)

VOLUME = Table(
    "volume",
    (
        _id("id"),
        _id("instance_id", True),
        _text("file_mode", 4, True),
        _text("owner", 32, True),
        _text("group", 32, True),
        _text("server", 63, True),
        _text("mount_options", 256, True),
        _text("mounting_path", 256, True),
    ),
    unique=(("id",),),
)

HOST = Table(
    "host",
    (_id("id"), _text("name", 63, True), _int("memory", True)),
    unique=(("id",), ("name",)),
)

FUNCTIONAL_ALIASES = Table(
    "functional_aliases",
    (_text("dns_name", 256, True), _text("db_name", 8), _text("alias", 256)),
    unique=(("dns_name",), ("db_name",)),
)

JOBS = Table(
    "jobs",
    (
        _text("username", 32, True),
        _text("db_name", 128, True),
        _text("command_name", 64, True),
        _text("type", 64, True),
        _date("creation_date", True),
        _date("completion_date"),
        _text("requester", 32, True),
        _int("admin_action", True),
        _text("state", 32, True),
        _text("log"),
        _text("result", 2048),
        _date("email_sent"),
        _text("category", 20),
    ),
    unique=(("username", "db_name", "command_name", "type", "creation_date"),),
)

COMMAND_DEFINITION = Table(
    "command_definition",
    (
        _text("command_name", 64, True),
        _text("type", 64, True),
        _text("exec", 2048),
        _text("category", 20),
    ),
    unique=(("command_name", "type", "category"),),
)

COMMAND_PARAMS = Table(
    "command_params",
    (
        _text("username", 32, True),
        _text("db_name", 128, True),
        _text("command_name", 64, True),
        _text("type", 64, True),
        _date("creation_date", True),
        _text("name", 64, True),
        _text("value"),
        _text("category", 20),
    ),
    unique=(("username", "db_name", "command_name", "type", "creation_date", "name"),),
)

INSTANCE_CHANGES = Table(
    "instance_changes",
    (
        _text("username", 32, True),
        _text("db_name", 128, True),
        _text("attribute", 32, True),
        _date("change_date", True),
        _text("requester", 32, True),
        _text("old_value", 1024),
        _text("new_value", 1024),
    ),
    unique=(("username", "db_name", "attribute", "change_date"),),
)

UPGRADES = Table(
    "upgrades",
    (
        _text("db_type", 32, True),
        _text("category", 32, True),
        _text("version_from", 128, True),
        _text("version_to", 128, True),
    ),
    unique=(("db_type", "category", "version_from"),),
)

OWNERS = Table(
    "owners",
    (
        _text("internal_id", 36, True),
        _text("instance_name", 64),
        _text("description", 450),
        _text("owner_account_type", 20),
        _text("owner_first_name", 24),
        _text("owner_last_name", 40),
        _text("owner_login", 64),
        _text("owner_mail", 128),
        _text("owner_phone1", 5),
        _text("owner_phone2", 5),
        _text("owner_portable_phone", 7),
        _text("owner_department", 3),
        _text("owner_group", 3),
        _text("owner_section", 3),
    ),
    unique=(("internal_id",),),
)

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        INSTANCES,
        ATTRIBUTE,
        VOLUME,
        HOST,
        FUNCTIONAL_ALIASES,
        JOBS,
        COMMAND_DEFINITION,
        COMMAND_PARAMS,
        INSTANCE_CHANGES,
        UPGRADES,
        OWNERS,
    )
}

# The instance as it is published: `category` is called `class`.
VIEW_NAME_OF = {"category": "class"}

VOLUME_DOC_FIELDS = ["group", "file_mode", "server", "mount_options", "owner", "mounting_path"]

ATTRIBUTE_FEED = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("instance_id", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

JOB_OBSERVATIONS = T.StructType(
    [
        T.StructField("exec_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("exec_completed", T.BooleanType()),
        T.StructField("exec_state", T.StringType()),
    ]
)
