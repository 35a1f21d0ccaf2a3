"""Job statistics and the aliases of each host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import scalars as E
from fleetlens.operators.ordering import page_of, paged_groups


def _durations(jobs: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        E.mean_seconds(F.col("creation_date"), F.col("completion_date")).alias("mean_duration"),
    )


def job_stats(jobs: DataFrame) -> DataFrame:
    """Row count and mean duration per database and command.

    Open jobs count as rows but not in the mean.
    """
    return _durations(jobs, ["db_name", "command_name"])


def command_stats(jobs: DataFrame) -> DataFrame:
    return _durations(jobs, ["command_name"])


def host_aliases(
    instances: DataFrame,
    prefix: str = S.HOST_ALIAS_PREFIX,
    domain: str = S.HOST_ALIAS_DOMAIN,
    as_text: bool = False,
    text_suffix: str = S.HOST_ALIAS_TEXT_SUFFIX,
    group_rows: int | None = None,
) -> DataFrame:
    """The aliases on each host, sorted; the key is the host text as stored.

    A host text with more than ``group_rows`` instances has several pages.
    ``as_text`` gives a comma list of unchanged names instead of an array.
    """
    if as_text:
        alias = F.concat(F.lit(prefix), F.col("db_name"), F.lit(text_suffix))
    else:
        alias = E.host_alias(F.col("db_name"), prefix, domain)
    aliases = F.array_sort(F.collect_list(alias))
    if as_text:
        aliases = F.array_join(aliases, ",")
    rows = instances.select("id", "host", "db_name")
    groups, _ = paged_groups(rows, ["host"], ["id"], group_rows, aliases.alias("aliases"))
    return groups.select("host", *page_of(groups), "aliases")
