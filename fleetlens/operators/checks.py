"""Integrity reports: one row per rule and key that breaks it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.operators.views import Catalog


def duplicates(df: DataFrame, key: list[str], rule: str | None = None) -> DataFrame:
    """Keys that occur more than once; a key with only NULLs is not a key."""
    some_value = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in key])
    shown = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return (
        df.where(some_value)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.lit(rule or "unique:" + ",".join(key)).alias("rule"), shown.alias("key"), "n")
    )


def _counted(df: DataFrame, broken: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass over the table: how many rows break each (rule, key, condition)."""
    counts = df.agg(*[F.count_if(c).alias(f"_{i}") for i, (_, _, c) in enumerate(broken)])
    listed = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(key).alias("key"), F.col(f"_{i}").alias("n"))
            for i, (rule, key, _) in enumerate(broken)
        ]
    )
    return counts.select(F.inline(listed)).where(F.col("n") > 0)


def _null(columns: list[str]) -> list[tuple[str, str, Column]]:
    return [("not_null", c, F.col(c).isNull()) for c in columns]


def _over(limits: dict[str, int]) -> list[tuple[str, str, Column]]:
    return [("length", c, F.char_length(F.col(c)) > n) for c, n in limits.items()]


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Required columns that hold NULL, with the number of rows."""
    return _counted(df, _null(columns))


def overlong(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Text columns with values over their limit, with the number of rows."""
    return _counted(df, _over(limits))


def orphans(
    child: DataFrame, parent: DataFrame, on: str = "instance_id", parent_key: str = "id"
) -> DataFrame:
    """Child keys without a parent, with the number of child rows."""
    # Counted per key before the join: a hot key is one row by then.
    counted = child.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(parent_key).alias(on))
    return counted.join(keys, on, "left_anti").select(
        F.lit(f"orphan:{on}").alias("rule"), F.col(on).cast("string").alias("key"), "n"
    )


# What a rule looks for: a key on several rows, any broken row, or a key without a parent.
_REPEATED, _BROKEN, _ORPHAN = "repeated", "broken", "orphan"


@dataclass(frozen=True)
class _Rule:
    table: str
    rule: str
    kind: str
    key: str | None = None  # the text to show instead of the key's values


def _mark(number: int, holds: Column, values: list[str], own: bool = True) -> Column:
    shown = F.array(*[F.col(c).cast("string") for c in values]).cast("array<string>")
    return F.when(
        holds,
        F.struct(F.lit(number).alias("mark"), shown.alias("values"), F.lit(own).alias("own")),
    )


def _report(
    tables: Catalog,
    unique: dict[str, tuple[tuple[str, ...], ...]],
    children: tuple[str, ...] = (),
) -> DataFrame:
    """All violations from one scan per table and one aggregation.

    A row becomes one mark per key it has and per rule it breaks; the marks of all
    tables are counted together, with partial counts before the only shuffle. A
    parent's id is a mark of the children's rules that isn't ``own``, so orphans
    need no join. Keys are compared whole, a NULL apart from an empty text.
    """
    rules: list[_Rule] = []
    marks: dict[str, list[Column]] = {name: [] for name in tables}

    def add(rule: _Rule, holds: Column, values: list[str]) -> int:
        rules.append(rule)
        marks[rule.table].append(_mark(len(rules) - 1, holds, values))
        return len(rules) - 1

    for name in tables:
        spec = S.TABLES[name]
        for key in unique[name]:
            some = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in key])
            add(_Rule(name, "unique:" + ",".join(key), _REPEATED), some, list(key))
        for rule, column, broken in _null(spec.required) + _over(spec.limits):
            add(_Rule(name, rule, _BROKEN, column), broken, [])
        if name in children:
            lost = _Rule(name, "orphan:instance_id", _ORPHAN)
            number = add(lost, F.col("instance_id").isNotNull(), ["instance_id"])
            parent = _mark(number, F.col("id").isNotNull(), ["id"], own=False)
            marks["instances"].append(parent)

    marked = [
        df.select(F.inline(F.array_compact(F.array(*marks[name]))))
        for name, df in tables.items()
        if marks[name]
    ]
    counted = (
        reduce(DataFrame.unionByName, marked)
        .groupBy("mark", "values")
        .agg(F.count_if("own").alias("n"), F.count_if(~F.col("own")).alias("parents"))
    )
    listed = F.array(
        *[
            F.struct(
                F.lit(r.table).alias("table"),
                F.lit(r.rule).alias("rule"),
                F.lit(r.key).cast("string").alias("key"),
                F.lit(2 if r.kind == _REPEATED else 1).cast("bigint").alias("least"),
            )
            for r in rules
        ]
    )
    found = counted.withColumn("rule", F.get(listed, F.col("mark")))
    broken = (F.col("n") >= F.col("rule.least")) & (F.col("parents") == 0)
    return found.where(broken).select(
        "rule.rule",
        F.coalesce("rule.key", F.array_join("values", "|", "")).alias("key"),
        "n",
        "rule.table",
    )


def check(
    df: DataFrame, table: S.Table, unique: tuple[tuple[str, ...], ...] | None = None
) -> DataFrame:
    """All violations of a table's declared rules. ``unique`` overrides its keys."""
    return _report({table.name: df}, {table.name: table.unique if unique is None else unique})


def check_catalog(catalog: Catalog) -> DataFrame:
    """All violations of all tables, with the children that lost their instance."""
    known = [name for name in ("attribute", "volume") if name in catalog]
    children = tuple(known) if "instances" in catalog else ()
    return _report(catalog, {name: S.TABLES[name].unique for name in catalog}, children)
