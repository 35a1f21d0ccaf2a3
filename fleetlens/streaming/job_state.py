"""Job outcomes by Spark's own keyed state: answered once the watermark passes the limit.

An execution's state is what decides it, four least times (see
:mod:`fleetlens.streaming.jobs`), whatever the number of its observations. When
the watermark passes its limit, an event-time time-out answers it, completed or
not. The state is then kept until a retention is over, so that an observation
that repeats what is known costs nothing, and dropped.

Rows behind the watermark aren't lost. Spark drops them before a stateful
operator, so each observation goes in twice: with its time, which moves the
watermark and is dropped when late, and without, which never is. What late
rows change comes out as a second output, ``late``, beside the ``settled`` one.
Both hold the same four times, whose least values are the result: the reader
merges them, and an execution that is unknown, forgotten or amended is answered
as the batch form answers it.

Null states, equal times and observations without a time count as in the batch
form; an execution without any time is answered by its first row.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.session import ship_package
from fleetlens.streaming.jobs import DEFAULT_TIMEOUT, MARKS, decided, least_marks

DEFAULT_LATENESS, DEFAULT_RETENTION = timedelta(minutes=10), timedelta(days=7)
# Times are microseconds since 1970 inside.
STATE = ", ".join(f"{name} long" for name in MARKS) + ", settled boolean"
OUTPUT = "exec_id long, kind string, " + ", ".join(f"{name} long" for name in MARKS)
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
Marks = tuple[int | None, ...]


def _least(rows: pd.DataFrame) -> Marks:
    """The four times of some observations; ``place`` says which completed state a row has."""
    us, place = rows["us"].to_numpy(float), rows["place"].to_numpy()
    own = rows["data"].to_numpy() & ~np.isnan(us)
    found = (us[own], *(us[own & (place == k)] for k in (1, 2, 3)))
    return tuple(int(times.min()) if len(times) else None for times in found)


def _merged(one: Marks, two: Marks) -> Marks:
    return tuple(
        min((x for x in pair if x is not None), default=None) for pair in zip(one, two)
    )


def _after(us: int, span: timedelta) -> int:
    """Milliseconds of the first whole one after a time and a span."""
    return (us + span // timedelta(microseconds=1)) // 1000 + 1


def _row(key: Any, kind: str, marks: Marks) -> pd.DataFrame:
    values = {"exec_id": [key], "kind": [kind]}
    values |= {name: pd.array([us], "Int64") for name, us in zip(MARKS, marks)}
    return pd.DataFrame(values)


def _step(timeout: timedelta, retention: timedelta):
    """The state function: takes in the rows of an execution, or a time-out of it."""

    def settle(key: Any, marks: Marks, state: GroupState) -> pd.DataFrame:
        end = _after(marks[0], timeout + retention)
        if end > state.getCurrentWatermarkMs():
            state.update((*marks, True))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        return _row(key, "settled", marks)

    def step(
        key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        if state.hasTimedOut:
            if known[4]:
                state.remove()
            else:
                yield settle(key[0], known[:4], state)
            return
        new: Marks = (None, None, None, None)
        some = False
        for rows in batches:
            some |= bool(rows["data"].any())
            new = _merged(new, _least(rows))
        if not some:
            if known:
                _wait(known, state)
            return
        marks = _merged(known[:4], new) if known else new
        if marks[0] is None:  # no time at all: nothing to wait for
            yield _row(key[0], "late", marks)
        elif known and known[4]:
            if marks != tuple(known[:4]):
                yield _row(key[0], "late", marks)
            state.update((*marks, True))
            _wait((*marks, True), state)
        elif _after(marks[0], timeout) > state.getCurrentWatermarkMs():
            state.update((*marks, False))
            _wait((*marks, False), state)
        elif known:
            yield settle(key[0], marks, state)
        else:  # unknown, and its limit has passed: nothing is kept of it
            yield _row(key[0], "late", marks)

    def _wait(known: tuple, state: GroupState) -> None:
        end = _after(known[0], timeout + retention if known[4] else timeout)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return step


def answer_job_outcomes(
    observations: DataFrame,
    path: str,
    checkpoint: str,
    timeout: timedelta = DEFAULT_TIMEOUT,
    lateness: timedelta = DEFAULT_LATENESS,
    retention: timedelta = DEFAULT_RETENTION,
) -> StreamingQuery:
    """Take in all waiting observations and add what is settled or late to ``path``.

    ``lateness`` is how far the watermark stays behind the newest observation.
    Executions whose limit it hasn't passed stay in the state.
    """
    ship_package(observations.sparkSession)
    state = F.coalesce("exec_state", F.lit(""))
    place = (
        F.when(~F.coalesce("exec_completed", F.lit(False)), 0)
        .when(state < "succeeded", 1)
        .when(state == "succeeded", 2)
        .otherwise(3)
    )
    us = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)")
    twice = observations.select(
        "exec_id",
        us.alias("us"),
        place.alias("place"),
        F.explode(F.array(F.lit(True), F.lit(False))).alias("data"),
    )
    seen = F.when(~F.col("data"), F.timestamp_micros("us"))
    rows = twice.withColumn("seen", seen).withWatermark("seen", f"{lateness.total_seconds()} seconds")
    answered = rows.groupBy("exec_id").applyInPandasWithState(
        _step(timeout, retention), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return (
        answered.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_answers(
    spark: SparkSession, path: str, timeout: timedelta = DEFAULT_TIMEOUT
) -> DataFrame:
    """The answered executions, as the batch form answers them: both outputs merged."""
    rows = spark.read.schema(OUTPUT).parquet(path)
    times = [
        F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, {name} / 1000000.0)").alias(name)
        for name in MARKS
    ]
    return decided(least_marks(rows.select("exec_id", *times)), timeout)
