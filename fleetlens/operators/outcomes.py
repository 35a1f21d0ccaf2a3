"""What the change operators return."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.views import Catalog

SUCCESS = (200, 201, 204)


@dataclass
class Change:
    """The result of a batch of requests of one kind.

    ``tables`` holds the new state of every table the batch touches, ``changed``
    the rows that are new or have new values. An operator that only adds rows
    sets ``append_only``: its ``changed`` rows can be appended to the stored
    tables, and nothing has to be rewritten.
    """

    tables: Catalog
    outcomes: DataFrame
    changed: Catalog = field(default_factory=dict)
    append_only: bool = False

    def state(self, catalog: Catalog) -> Catalog:
        """The catalog after the batch."""
        return {**catalog, **self.tables}

    def representation(self, table: str) -> DataFrame:
        """The changed rows of a table, with their new values."""
        return self.changed[table]


def outcome(df: DataFrame, status: Column, affected: Column | None = None) -> DataFrame:
    """``request_id, status, affected``; a failed request affects nothing."""
    count = F.lit(1) if affected is None else affected
    judged = df.select(
        "request_id", status.cast("int").alias("status"), count.cast("bigint").alias("_affected")
    )
    done = F.col("status").isin(*SUCCESS)
    return judged.select(
        "request_id", "status", F.when(done, F.col("_affected")).otherwise(F.lit(0)).alias("affected")
    )


def greatest_id(table: DataFrame) -> Column:
    """The greatest id in use, 0 in an empty table: one row that is looked up inside the plan."""
    return F.coalesce(table.agg(F.max("id")).scalar(), F.lit(0))


def missing_text(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True))
