"""Whole-table order, oversized groups and hot keys, without one task holding all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import stored

# Rows of a key after which its window is cut into runs; the result is the same.
CHUNK_ROWS = 100_000
# With a page size: oversized groups whose keys may be sent to every executor.
HOT_KEYS = 10_000


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add, for each named sum, its total over all rows strictly before a row.

    ``order`` has to be a total order. Rows are range-partitioned and stored
    once, so that the partition number is a fact of the data and not of one run.
    The totals are one row per partition; they carry the sum over the partition
    borders, and only they meet in one window.
    """
    staged = stored(
        df.repartitionByRange(*order)
        .withColumns({name: value.cast("bigint") for name, value in sums.items()})
        .withColumn("_part", F.spark_partition_id())
    )
    before_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        staged.groupBy("_part")
        .agg(*[F.sum(name).alias(f"_{name}") for name in sums])
        .select(
            "_part",
            *[
                F.coalesce(F.sum(f"_{name}").over(before_part), F.lit(0)).alias(f"_{name}")
                for name in sums
            ],
        )
    )
    in_part = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = {
        name: F.coalesce(F.sum(name).over(in_part), F.lit(0)) + F.col(f"_{name}") for name in sums
    }
    return (
        staged.join(F.broadcast(totals), "_part")  # one row per partition
        .withColumns(running)
        .drop("_part", *[f"_{name}" for name in sums])
    )


# A bucket is this many consecutive keys, and a range this many buckets.
BUCKET_BITS, RANGE_BITS = 18, 23


def bucket_sums(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Add, for each named sum, its total over all rows with a smaller ``key``.

    ``key`` is a unique whole number. Its upper bits are its bucket, so where a
    row belongs follows from the row alone: nothing is sampled or stored, and
    the plan runs no job by itself. A bucket holds at most 2^18 rows. Totals are
    one row per bucket, summed up within ranges of at most 2^23 buckets, and
    those in at most 2^23 ranges, however the keys are spread.
    """
    names = list(sums)
    place = F.shiftright(F.col(key).cast("bigint"), BUCKET_BITS)
    rows = df.withColumns({n: v.cast("bigint") for n, v in sums.items()}).withColumn("_bucket", place)

    def before(by: str, order: str) -> dict[str, Column]:
        window = Window.partitionBy(by) if by else Window.partitionBy()
        window = window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return {n: F.coalesce(F.sum(n).over(window), F.lit(0)) for n in names}

    def shifted(low: DataFrame, high: DataFrame, on: str) -> DataFrame:
        above = high.select(on, *[F.col(n).alias(f"_above_{n}") for n in names])
        both = low.join(above, on)
        return both.withColumns({n: F.col(n) + F.col(f"_above_{n}") for n in names}).drop(
            *[f"_above_{n}" for n in names]
        )

    totals = [F.sum(n).alias(n) for n in names]
    buckets = rows.groupBy("_bucket").agg(*totals)
    buckets = buckets.withColumn("_range", F.shiftright("_bucket", RANGE_BITS))
    ranges = buckets.groupBy("_range").agg(*totals).withColumns(before("", "_range"))
    offsets = shifted(buckets.withColumns(before("_range", "_bucket")), ranges, "_range")
    return shifted(rows.withColumns(before("_bucket", key)), offsets, "_bucket").drop("_bucket")


def row_numbers(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add the position of each row in the whole table, from 1, without gaps."""
    return prefix_sums(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def _hot_groups(
    df: DataFrame, keys: list[str], group_rows: int | None
) -> tuple[DataFrame | None, bool, bool]:
    """Keys (as ``_hot_<key>``) with more rows than the limit, and their ``_rows``.

    Returns the table, whether it has rows at all, and whether it is short. A
    short one is a local copy that may be broadcast: at most ``HOT_KEYS`` rows.
    The count reads the key columns only. ``group_rows=None`` leaves it out, for
    a caller who knows that there is no large group.
    """
    if group_rows is None:
        return None, False, True
    groups = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > group_rows)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_rows")
    )
    found = groups.limit(HOT_KEYS + 1).collect()
    if len(found) > HOT_KEYS:
        return groups, True, False
    return df.sparkSession.createDataFrame(found, groups.schema), bool(found), True


def has_hot_groups(
    df: DataFrame, keys: list[str], group_rows: int | None = CHUNK_ROWS
) -> bool:
    """Whether any group has more rows than one task should hold."""
    return _hot_groups(df, keys, group_rows)[1]


def _is_hot(df: DataFrame, groups: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(groups[f"_hot_{k}"]) for k in keys])


def paged_groups(
    df: DataFrame,
    keys: list[str],
    spread_by: list[str],
    group_rows: int | None,
    *aggregates: Column,
    merge: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> tuple[DataFrame, bool]:
    """Group by ``keys``; with a page size in pages of about ``group_rows`` rows.

    Without a page size there is one row per key, at every size of the data, and
    nothing is counted. With one, the groups have a ``page``: larger ones are
    spread by the hash of ``spread_by`` over as many pages as they need, so no
    task gets a whole one; no row is lost. ``merge`` may shorten the rows of a
    page before they are brought together. Returns the groups and whether any
    has more than one page.
    """
    rows, by, several = _paged(df, keys, spread_by, group_rows, merge)
    groups = rows.groupBy(*by).agg(*aggregates)
    if group_rows is not None and not several:
        groups = groups.withColumn("page", F.lit(0))
    return groups, several


def paged_rows(
    df: DataFrame, keys: list[str], spread_by: list[str], group_rows: int | None
) -> DataFrame:
    """The rows of :func:`paged_groups` before they are grouped, with a ``page`` if asked for."""
    rows, _, several = _paged(df, keys, spread_by, group_rows, None)
    return rows if group_rows is None or several else rows.withColumn("page", F.lit(0))


def _paged(
    df: DataFrame,
    keys: list[str],
    spread_by: list[str],
    group_rows: int | None,
    merge: Callable[[DataFrame, list[str]], DataFrame] | None,
) -> tuple[DataFrame, list[str], bool]:
    """Rows, what groups them, and whether some are spread over several pages."""
    if group_rows is None:
        return df, keys, False
    groups, some, short = _hot_groups(df, keys, group_rows)
    if not some:
        return df, keys, False
    pages = F.ceil(F.col("_rows") / F.lit(group_rows)).cast("bigint")
    page = F.coalesce(F.pmod(F.xxhash64(*spread_by), pages), F.lit(0)).cast("int")
    spread = (
        df.join(F.broadcast(groups) if short else groups, _is_hot(df, groups, keys), "left")
        .withColumn("page", page)
        .drop("_rows", *[f"_hot_{k}" for k in keys])
    )
    by_page = [*keys, "page"]
    return spread if merge is None else merge(spread, by_page), by_page, True


def join_unique(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a table that has at most one row per key.

    A hot key of ``df`` is split by Spark's adaptive skew join: its rows are not
    brought together afterwards, results go back by their request.
    """
    return df.join(table, on, "left")


def page_of(df: DataFrame) -> list[str]:
    """The page column, where a page size was asked for."""
    return ["page"] if "page" in df.columns else []


def chunked(
    df: DataFrame, keys: list[str], order: list[str], group_rows: int | None = CHUNK_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_chunk``, which cuts the ordered rows of a key into runs in order.

    Without an oversized key every row is in chunk 0. Otherwise rows are
    range-partitioned by key and order, which cuts a long key at partition
    borders, and the partition number is the chunk. Returns the table and
    whether keys may have several chunks.
    """
    if not has_hot_groups(df, keys, group_rows):
        return df.withColumn("_chunk", F.lit(0)), False
    parts = df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id())
    return stored(parts), True
