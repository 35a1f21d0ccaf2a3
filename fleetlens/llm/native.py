"""Column helpers of the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters between words (the contract's word is a run of any others).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``row``, all columns of any name as one struct, and copies of those that ``df`` has of ``names``."""
    row = F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")
    return df.select(row, *[df[c].alias(c) for c in names if c in df.columns])


def unpacked(df: DataFrame, *changed: str) -> DataFrame:
    """The columns of ``row``, with the changed ones in their places."""
    row = F.col("row")
    for name in changed:
        if name in df.columns:
            row = row.withField(name, F.col(name))
    return df.select(row.alias("row")).select("row.*")
