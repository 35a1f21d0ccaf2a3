"""Outcome of job executions from status observations, in batch and as a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Limit of the sample configuration, in seconds.
DEFAULT_TIMEOUT = timedelta(seconds=15)

MARKS = ("start", "done_before", "done_ok", "done_after")
MARKS_SCHEMA = "exec_id long, " + ", ".join(f"{name} timestamp_ntz" for name in MARKS)


def _marks(observations: DataFrame) -> DataFrame:
    """What decides an execution: four least times, whatever the number of observations.

    These are the first observation and the first completed ones, by whether
    their state sorts before ``succeeded`` (as NULL does), is it, or sorts after
    it. Of completed observations at one time the least state counts.
    """
    state = F.coalesce("exec_state", F.lit(""))

    def first(condition: Column) -> Column:
        return F.min(F.when(F.col("exec_completed") & condition, F.col("ts")))

    return observations.groupBy("exec_id").agg(
        F.min("ts").alias("start"),
        first(state < "succeeded").alias("done_before"),
        first(state == "succeeded").alias("done_ok"),
        first(state > "succeeded").alias("done_after"),
    )


def least_marks(marks: DataFrame) -> DataFrame:
    """One row per execution from several with parts of what decides it."""
    return marks.groupBy("exec_id").agg(*[F.min(name).alias(name) for name in MARKS])


def decided(marks: DataFrame, timeout: timedelta) -> DataFrame:
    limit = F.col("start") + F.lit(timeout)
    done = F.least("done_before", "done_ok", "done_after")
    in_time = F.coalesce(done < limit, F.lit(False))
    succeeded = (F.col("done_ok") == done) & (F.col("done_before").isNull() | (F.col("done_before") > done))
    return marks.select(
        "exec_id",
        F.when(in_time & succeeded, "succeeded")
        .when(in_time, "failed")
        .otherwise("timed_out")
        .alias("outcome"),
        F.when(in_time, done).otherwise(limit).alias("ended"),
    )


def job_outcomes(observations: DataFrame, timeout: timedelta = DEFAULT_TIMEOUT) -> DataFrame:
    """``succeeded``, ``failed`` or ``timed_out`` per execution.

    The first completed observation decides if it comes before the limit,
    counted from the first observation. One aggregate, with partial sums.
    """
    return decided(_marks(observations), timeout)


# -- the stored marks of a stream ---------------------------------------------------


def _batch_path(state_path: str, batch_id: int) -> str:
    return f"{state_path}/marks/batch_id={batch_id}"


def read_marks(spark: SparkSession, state_path: str) -> DataFrame:
    """The marks of every execution the stream has seen; an error if there is no such stream."""
    stored = spark.read.schema(MARKS_SCHEMA).parquet(f"{state_path}/marks")
    return least_marks(stored)


def read_outcomes(
    spark: SparkSession,
    state_path: str,
    timeout: timedelta = DEFAULT_TIMEOUT,
    until: datetime | None = None,
) -> DataFrame:
    """The outcomes of a stream's executions, as ``job_outcomes`` gives them.

    With ``until`` only of those that are settled by then: completed in time,
    or past their limit. Without it all are answered. An observation that
    arrives late still counts, whenever it comes.
    """
    answered = decided(read_marks(spark, state_path), timeout)
    return answered if until is None else answered.where(F.col("ended") <= F.lit(until))


def stream_job_outcomes(
    observations: DataFrame, state_path: str, checkpoint: str
) -> StreamingQuery:
    """Take in all waiting observations; ``read_outcomes`` answers at any time.

    Each micro-batch is reduced to one row per execution and adds a folder of
    its own, so its cost is that of its rows. Run again, it replaces itself.
    """
    spark = observations.sparkSession
    nothing = spark.createDataFrame([], MARKS_SCHEMA)
    nothing.write.mode("ignore").parquet(_batch_path(state_path, -1))

    def take_in(batch: DataFrame, batch_id: int) -> None:
        _marks(batch).write.mode("overwrite").parquet(_batch_path(state_path, batch_id))

    return (
        observations.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_marks(
    spark: SparkSession, state_path: str, into: str, started_from: datetime | None = None
) -> None:
    """Write the marks as the first batch of a new state folder.

    With ``started_from`` earlier executions are forgotten: the retention.
    """
    marks = read_marks(spark, state_path)
    if started_from is not None:
        marks = marks.where(F.col("start") >= F.lit(started_from))
    marks.write.mode("errorifexists").parquet(_batch_path(into, -1))
