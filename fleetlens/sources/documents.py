"""Nested request documents to typed columns; bad ones to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E

# Document fields that are plain columns of an instance, by their published name.
PLAIN_FIELDS = {
    E.published_name(f.name): f for f in S.INSTANCES.fields if f.name != "id"
}
NESTED_FIELDS = ["hosts", "attributes", "volumes"]

_VOLUME_TYPE = "struct<" + ",".join(f"`{c}`:string" for c in S.VOLUME_DOC_FIELDS) + ">"
DOCUMENT_SCHEMA = (
    ", ".join(f"`{name}` string" for name in PLAIN_FIELDS)
    + f", hosts array<string>, attributes map<string,string>, volumes array<{_VOLUME_TYPE}>"
    + ", _corrupt string"
)


def _typed(name: str, text: Column) -> Column:
    kind = PLAIN_FIELDS[name].type.simpleString()
    if kind == "int":
        return E.strict_int(text)
    return text if kind == "string" else text.try_cast(kind)


def has_key(name: str) -> Column:
    """Whether the document names the field, also with a null value."""
    return F.array_contains("doc_keys", name)


def _any(conditions: list[str]) -> Column:
    """True where one condition is; an unknown one does not count."""
    return F.expr(f"coalesce({' OR '.join(f'({c})' for c in conditions)}, false)")


def _refused_text(column: str, limit: int | None) -> list[str]:
    """Conditions under which a required text column refuses a value."""
    return [f"{column} IS NULL", f"char_length({column}) > {limit}"]


def bad_children() -> Column:
    """A volume or attribute that its table would refuse."""
    volume = ["v IS NULL"]
    for name in S.VOLUME_DOC_FIELDS:
        volume += _refused_text(f"v.`{name}`", S.VOLUME.field(name).limit)
    entry = [f"char_length(e.key) > {S.ATTRIBUTE.field('name').limit}"]
    entry += _refused_text("e.value", S.ATTRIBUTE.field("value").limit)
    return _any(
        [
            f"exists(volumes, v -> {' OR '.join(volume)})",
            f"exists(attribute_list, e -> {' OR '.join(entry)})",
        ]
    )


def bad_fields(creating: bool) -> Column:
    """A field of the instance itself that its table would refuse."""

    def named(name: str) -> str:
        return f"array_contains(doc_keys, '{name}')"

    known = ", ".join(f"'{name}'" for name in [*PLAIN_FIELDS, *NESTED_FIELDS])
    checks = [f"size(array_except(doc_keys, array({known}))) > 0"]
    for name, field in PLAIN_FIELDS.items():
        if field.required:
            checks.append(f"`{name}` IS NULL" if creating else f"{named(name)} AND `{name}` IS NULL")
        if field.limit is not None:
            checks.append(f"char_length(`{name}`) > {field.limit}")
        if field.type.simpleString() != "string":
            checks.append(f"`_text_{name}` IS NOT NULL AND `{name}` IS NULL")
    checks += [
        f"{named('hosts')} AND (hosts IS NULL OR size(hosts) = 0)",
        "exists(hosts, h -> h IS NULL)",
        f"char_length(array_join(hosts, ',')) > {S.INSTANCES.field('host').limit}",
    ]
    if not creating:
        checks += [f"{named(n)} AND {n} IS NULL" for n in ("volumes", "attributes")]
    return _any(checks)


def parse_documents(
    df: DataFrame, creating: bool, body_col: str = "body", keep_body: bool = False
) -> DataFrame:
    """Replace the document text by its fields and the verdicts on them.

    ``doc_keys`` lists the named fields, ``well_formed``, ``bad_field`` and
    ``bad_child`` tell what the tables would say to the document.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    kept = [c for c in df.columns if c != body_col or keep_body]
    read = E.computed_once(
        df,
        {
            "_keys": F.json_object_keys(body_col),
            "_closed": E.ends_object(F.col(body_col)),
            "_doc": F.from_json(body_col, DOCUMENT_SCHEMA, options),
        },
        kept,
    )
    is_object = F.col("_keys").isNotNull() & F.col("_closed")
    untyped = [n for n, f in PLAIN_FIELDS.items() if f.type.simpleString() != "string"]
    typed = E.computed_once(
        read,
        {
            "doc_keys": F.coalesce("_keys", F.array().cast("array<string>")),
            "well_formed": F.coalesce(is_object, F.lit(False)) & F.col("_doc._corrupt").isNull(),
            **{name: _typed(name, F.col(f"_doc.{name}")) for name in PLAIN_FIELDS},
            **{f"_text_{name}": F.col(f"_doc.{name}") for name in untyped},
            "hosts": F.col("_doc.hosts"),
            "volumes": F.col("_doc.volumes"),
            "attributes": F.col("_doc.attributes"),
            "attribute_list": E.last_entries(F.col("_doc.attributes")),
        },
        kept,
    )
    return E.computed_once(
        typed,
        {
            "bad_field": ~F.col("well_formed") | bad_fields(creating),
            "bad_child": bad_children(),
        },
        [c for c in typed.columns if not c.startswith("_text_") and c != "attributes"],
    )


def stored_host() -> Column:
    """The host text to store: the joined list where hosts are given."""
    return F.when(has_key("hosts"), E.join_hosts(F.col("hosts"))).otherwise(F.col("host"))


def parse_instance_docs(df: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split documents into parsed instances and rejected texts with a reason."""
    parsed = parse_documents(df, True, body_col, keep_body=True)
    kept = [c for c in df.columns if c != body_col]
    reason = (
        F.when(F.col(body_col).isNull(), "no body")
        .when(~F.col("well_formed"), "malformed")
        .when(F.col("bad_field"), "bad field")
        .when(F.col("bad_child"), "bad child")
    )
    judged = parsed.withColumn("reason", reason)
    plain = [c for c in PLAIN_FIELDS if c != "host"]
    good = judged.where(F.col("reason").isNull()).select(
        *kept,
        *plain,
        stored_host().alias("host"),
        F.coalesce("attribute_list", F.array().cast("array<struct<key:string,value:string>>")).alias(
            "attributes"
        ),
        F.coalesce("volumes", F.array().cast(f"array<{_VOLUME_TYPE}>")).alias("volumes"),
    )
    rejected = judged.where(F.col("reason").isNotNull()).select(
        *kept, body_col, "reason"
    )
    return good, rejected
