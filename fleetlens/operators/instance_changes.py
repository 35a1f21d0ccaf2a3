"""Batches of instance writes: create from documents, patch, delete with children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.operators.lookup import asked_rows, resolve_instance_id
from fleetlens.operators.ordering import bucket_sums, join_unique
from fleetlens.operators.outcomes import Change, greatest_id, outcome
from fleetlens.operators.views import Catalog
from fleetlens.session import stored
from fleetlens.sources.documents import (
    has_key,
    parse_documents,
    stored_host,
)

CHILD_TABLES = ("attribute", "volume")


def _list_size(name: str) -> Column:
    return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))


def _names_in_use(instances: DataFrame, requests: DataFrame, column: str) -> DataFrame:
    """Of the names that the requests ask for those that an instance has."""
    asked = requests.select(F.col(column).alias("db_name"))
    used = asked_rows(instances.select("db_name"), asked, ["db_name"])
    return used.select(F.col("db_name").alias("_used")).distinct()


def _as_instance(df: DataFrame, id_col: Column) -> DataFrame:
    """Document columns as rows of the instances table."""
    return df.select(
        id_col.cast("long").alias("id"),
        *[
            (stored_host() if f.name == "host" else F.col(S.VIEW_NAME_OF.get(f.name, f.name))).alias(
                f.name
            )
            for f in S.INSTANCES.fields
            if f.name != "id"
        ],
    )


def _volume_rows(df: DataFrame, first_id: Column) -> DataFrame:
    """Volumes of ``volumes`` as rows, numbered on from ``first_id``."""
    rows = df.select("instance_id", first_id.alias("_first"), F.posexplode("volumes").alias("pos", "v"))
    return rows.select(
        (F.col("_first") + F.col("pos")).cast("long").alias("id"),
        "instance_id",
        *[F.col("v")[c].alias(c) for c in S.VOLUME.columns[2:]],
    )


def _attribute_rows(df: DataFrame, first_id: Column) -> DataFrame:
    """Entries of ``attribute_list`` as rows, numbered on from ``first_id``."""
    rows = df.select(
        "instance_id", first_id.alias("_first"), F.posexplode("attribute_list").alias("pos", "a")
    )
    return rows.select(
        (F.col("_first") + F.col("pos")).cast("long").alias("id"),
        "instance_id",
        F.col("a.key").alias("name"),
        F.col("a.value").alias("value"),
    )


def create_instances(catalog: Catalog, requests: DataFrame) -> Change:
    """Create instances with their volumes and attributes, all of a document or nothing.

    A bad field of the instance is refused first, then a name in use, then a bad
    child. Of several valid documents for a name the lowest request id wins.
    """
    instances, attribute, volume = (catalog[t] for t in ("instances", "attribute", "volume"))
    parsed = stored(parse_documents(requests.select("request_id", "body"), creating=True))
    judged = parsed.select(
        "request_id",
        "db_name",
        _list_size("volumes").alias("n_volumes"),
        _list_size("attribute_list").alias("n_attributes"),
        F.col("bad_field").alias("bad"),
        "bad_child",
    )
    in_use = _names_in_use(instances, judged, "db_name")
    firsts = (
        judged.where(~F.col("bad") & ~F.col("bad_child"))
        .groupBy("db_name")
        .agg(F.min("request_id").alias("request_id"))
        .join(in_use, F.col("db_name") == F.col("_used"), "left_anti")
    )
    # The least request per name by hash; what it brings is fetched for the winners only.
    # Stored documents are many times their files' size, by which Spark would broadcast them.
    winners = firsts.select("request_id").join(
        judged.select("request_id", "n_volumes", "n_attributes").hint("merge"), "request_id"
    )
    numbered = bucket_sums(
        winners,
        "request_id",
        {"_nth": F.lit(1), "_volumes": F.col("n_volumes"), "_attributes": F.col("n_attributes")},
    ).select(
        "request_id",
        (F.col("_nth") + greatest_id(instances) + 1).alias("instance_id"),
        (F.col("_volumes") + greatest_id(volume) + 1).alias("_volume_id"),
        (F.col("_attributes") + greatest_id(attribute) + 1).alias("_attribute_id"),
    )
    created = parsed.join(numbered.hint("merge"), "request_id")
    added = {
        "instances": _as_instance(created, F.col("instance_id")),
        "volume": _volume_rows(created, F.col("_volume_id")),
        "attribute": _attribute_rows(created, F.col("_attribute_id")),
    }

    # Per asked name either that it is in use, or the request that gets it.
    no_winner = F.lit(None).cast("bigint").alias("_winner")
    names = in_use.select(F.col("_used").alias("db_name"), F.lit(True).alias("_in_use"), no_winner)
    names = names.unionByName(
        firsts.select(
            "db_name", F.lit(False).alias("_in_use"), F.col("request_id").alias("_winner")
        )
    )
    decided = join_unique(judged, names.hint("merge"), ["db_name"])
    status = (
        F.when(F.col("bad"), S.BAD_REQUEST)
        .when(F.col("_in_use"), S.CONFLICT)
        .when(F.col("_winner") == F.col("request_id"), S.CREATED)
        .when(F.col("_winner") < F.col("request_id"), S.CONFLICT)
        .otherwise(S.BAD_REQUEST)
    )
    rows = F.lit(1) + F.col("n_volumes") + F.col("n_attributes")
    return Change(
        {name: catalog[name].unionByName(df) for name, df in added.items()},
        outcome(decided, status, rows),
        added,
        append_only=True,
    )


def _patched_columns() -> list[Column]:
    """Per column the value of the last document that names it, wrapped; NULL if none does."""
    latest = []
    for f in S.INSTANCES.fields:
        if f.name == "id":
            continue
        name = S.VIEW_NAME_OF.get(f.name, f.name)
        if f.name == "host":
            named, value = has_key("host") | has_key("hosts"), stored_host()
        else:
            named, value = has_key(name), F.col(name)
        boxed = F.when(named, F.struct(value.alias("value")))
        latest.append(
            F.max_by(boxed, F.when(named, F.col("request_id"))).alias(f"_new_{f.name}")
        )
    return latest


def patch_instances(catalog: Catalog, requests: DataFrame) -> Change:
    """Change the named columns; replace volumes or attributes where they are given.

    A field that is absent is kept, an empty list removes the children. Of
    several valid patches the highest request id sets each column. A new name
    has to be free before the batch, and goes to the lowest request that asks.
    """
    instances, attribute, volume = (catalog[t] for t in ("instances", "attribute", "volume"))
    asked = resolve_instance_id(
        requests.select("request_id", F.col("db_name"), "body"), instances
    ).withColumnRenamed("db_name", "_of")
    parsed = stored(parse_documents(asked, creating=False))
    renames = has_key("db_name") & (F.col("db_name") != F.col("_of"))
    judged = parsed.withColumn(
        "_verdict",
        F.when(~F.col("well_formed"), S.BAD_REQUEST)
        .when(F.col("instance_id").isNull(), S.NOT_FOUND)
        .when(F.col("bad_field") | F.col("bad_child"), S.BAD_REQUEST),
    ).withColumn("_new_name", F.when(F.coalesce(renames, F.lit(False)), F.col("db_name")))

    # Only renames are joined by name; most patches have none.
    renamed = judged.where(F.col("_verdict").isNull() & F.col("_new_name").isNotNull()).select(
        "request_id", "instance_id", "_new_name"
    )
    in_use = _names_in_use(instances, renamed, "_new_name")
    claims = renamed.groupBy(F.col("_new_name").alias("_claimed")).agg(
        F.min_by("instance_id", "request_id").alias("_claimant")
    )
    clashing = (
        renamed.join(in_use, F.col("_new_name") == F.col("_used"), "left")
        .join(claims, F.col("_new_name") == F.col("_claimed"), "left")
        .where(F.col("_used").isNotNull() | (F.col("_claimant") != F.col("instance_id")))
        .select("request_id", F.lit(S.CONFLICT).alias("_clash"))
    )
    decided = judged.join(clashing, "request_id", "left").withColumn(
        "_verdict", F.coalesce("_verdict", "_clash", F.lit(S.NO_CONTENT))
    )
    valid = decided.where(F.col("_verdict") == S.NO_CONTENT)

    def last_list(name: str, source: str) -> Column:
        named = has_key(name)
        return F.max_by(F.when(named, F.col(source)), F.when(named, F.col("request_id")))

    latest = valid.groupBy("instance_id").agg(
        *_patched_columns(),
        last_list("volumes", "volumes").alias("volumes"),
        last_list("attributes", "attribute_list").alias("attribute_list"),
    )
    numbered = bucket_sums(
        latest.select(
            "instance_id",
            _list_size("volumes").alias("n_volumes"),
            _list_size("attribute_list").alias("n_attributes"),
        ),
        "instance_id",
        {"_before_volume": F.col("n_volumes"), "_before_attribute": F.col("n_attributes")},
    )
    fields = [f.name for f in S.INSTANCES.fields if f.name != "id"]
    new = latest.select("instance_id", *[f"_new_{c}" for c in fields])
    merged = instances.join(new, instances["id"] == new["instance_id"], "left")
    values = [
        F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.value"))
        .otherwise(F.col(c))
        .alias(c)
        for c in fields
    ]
    touched = F.col("instance_id").isNotNull()

    tables = {"instances": merged.select("id", *values)}
    changed = {"instances": merged.where(touched).select("id", *values)}
    for table, source, build in (
        ("volume", "volumes", _volume_rows),
        ("attribute", "attribute_list", _attribute_rows),
    ):
        current = catalog[table]
        given = latest.where(F.col(source).isNotNull()).select("instance_id", source)
        first_id = F.col(f"_before_{table}") + greatest_id(current) + 1
        added = build(given.join(numbered, "instance_id"), first_id)
        kept = current.join(given.select("instance_id"), "instance_id", "left_anti")
        tables[table] = kept.select(*current.columns).unionByName(added)
        changed[table] = added
    return Change(tables, outcome(decided, F.col("_verdict")), changed)


def delete_instances(catalog: Catalog, requests: DataFrame) -> Change:
    """Remove instances with their attributes and volumes. Aliases stay as they are."""
    instances = catalog["instances"]
    judged = resolve_instance_id(requests.select("request_id", "db_name"), instances)
    gone = judged.where(F.col("instance_id").isNotNull()).select("instance_id").distinct()
    ids = gone.select(F.col("instance_id").alias("id"))
    columns = S.INSTANCES.columns
    tables = {"instances": instances.join(ids, "id", "left_anti").select(*columns)}
    removed = {"instances": instances.join(ids, "id", "left_semi").select(*columns)}
    for table in CHILD_TABLES:
        current = catalog[table]
        tables[table] = current.join(gone, "instance_id", "left_anti").select(*current.columns)
        removed[table] = current.join(gone, "instance_id", "left_semi").select(*current.columns)
    status = F.when(F.col("instance_id").isNotNull(), S.NO_CONTENT).otherwise(S.NOT_FOUND)
    return Change(tables, outcome(judged, status), removed)
