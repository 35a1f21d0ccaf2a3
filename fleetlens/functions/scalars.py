"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S

SECONDS_PER_DAY = 24 * 60 * 60


def split_hosts(host: Column) -> Column:
    """The comma list of hosts as an array; an empty text is an empty array."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.split(host, ","))


def join_hosts(hosts: Column) -> Column:
    """An array of hosts as the stored comma list. Reject NULL elements first."""
    return F.array_join(hosts, ",")


def strict_int(text: Column) -> Column:
    """A whole number in 32 bits, else NULL. Fractions and words are not numbers."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("int"))


def mean_seconds(start: Column, end: Column) -> Column:
    """Mean of whole days between two dates, in seconds; open rows do not count."""
    return F.round(F.avg(F.datediff(end, start)) * SECONDS_PER_DAY).cast("bigint")


def host_alias(db_name: Column, prefix: str, domain: str) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(db_name, "_", "-"), F.lit(domain))


def tags(db_type: Column, category: Column) -> Column:
    return F.concat(db_type, F.lit(","), category)


def fill_path(template: Column, name: Column, version: Column, port: Column) -> Column:
    """Fill a directory template; a NULL for a hole that it has gives NULL.

    The path is put together from the template's parts, so what a value holds is
    never taken for a hole.
    """

    def filled(part: Column) -> Column:
        return (
            F.when(part == "{NAME}", F.upper(name))
            .when(part == "{name}", F.lower(name))
            .when(part == "{version}", version)
            .when(part == "{port}", port)
            .otherwise(part)
        )

    parts = F.transform(F.split(template, r"(?=\{)|(?<=\})"), filled)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def last_entries(mapping: Column) -> Column:
    """Entries of a JSON object; of a repeated name the last entry counts."""
    entries = F.map_entries(mapping)
    names = F.map_keys(mapping)
    last = F.filter(
        entries,
        lambda entry, i: ~F.array_contains(
            F.slice(names, i + F.lit(2), F.greatest(F.size(names) - i - 1, F.lit(0))), entry["key"]
        ),
    )
    repeated = F.size(F.array_distinct(names)) != F.size(names)
    return F.when(repeated, last).otherwise(entries)


def ends_object(body: Column) -> Column:
    """Whether nothing follows the last brace; the JSON readers ignore what does."""
    return F.rtrim(body).endswith("}")


def is_object_text(body: Column) -> Column:
    """True where the text is one JSON object and nothing follows it."""
    return F.coalesce(F.json_object_keys(body).isNotNull() & ends_object(body), F.lit(False))


def too_long(text: Column, limit: int | None) -> Column:
    if limit is None:
        return F.lit(False)
    return F.coalesce(F.char_length(text) > limit, F.lit(False))


def map_text(mapping: Column) -> Column:
    """A map as ``k=v`` pairs in name order."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(mapping)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        ),
        ",",
    )


def computed_once(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` and the new columns, each computed one time per row.

    A later filter or projection on a new column would otherwise take the whole
    expression with it, and parse the same text again per mention.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def xml_attribute(name: str, value: Column) -> Column:
    """`` name="value"`` with the value escaped; nothing for NULL."""
    escaped = value
    # The five escapes of XML, the ampersand first.
    for plain, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&apos;"),
    ):
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    return F.coalesce(F.concat(F.lit(f' {name}="'), escaped, F.lit('"')), F.lit(""))


def published_name(column: str) -> str:
    return S.VIEW_NAME_OF.get(column, column)
