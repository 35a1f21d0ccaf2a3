"""Job outcomes by Spark's keyed state: equal to the batch form, late rows included."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.streaming import job_state, jobs
from test_feeds import LIMIT, NULL_STATES, OBSERVED, START, observations_with_gaps

FAR = (99, 10_000, False, "running")  # moves the watermark past everything


def answered(spark, tmp_path, batches, lateness=0, retention=timedelta(days=7)):
    """What one stream gives out after all of ``batches``, one file and one start each."""
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in batches:
        observations_with_gaps(spark, part).coalesce(1).write.mode("append").parquet(source)
        reader = spark.readStream.schema(S.JOB_OBSERVATIONS).parquet(source)
        query = job_state.answer_job_outcomes(
            reader, path, checkpoint, LIMIT, timedelta(seconds=lateness), retention
        )
        query.awaitTermination()
    return path, query


def rows(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=str)


def batch_form(spark, seen):
    return rows(jobs.job_outcomes(observations_with_gaps(spark, seen), LIMIT), "exec_id", "outcome", "ended")


def outcomes(spark, path):
    return rows(job_state.read_answers(spark, path, LIMIT), "exec_id", "outcome", "ended")


def kinds(spark, path):
    found = spark.read.schema(job_state.OUTPUT).parquet(path)
    return {(r["exec_id"], r["kind"]) for r in found.collect()}


def without(found, *ids):
    return [r for r in found if r[0] not in ids]


def test_time_outs_answer_by_themselves_once_the_watermark_passes(spark, tmp_path):
    seen = [(1, 0, False, "running"), (2, 1, True, "succeeded"), (3, 11, False, "running")]
    path, _ = answered(spark, tmp_path, [seen])
    # the newest observation is at 11: only the limit of execution 1 has passed by then
    assert outcomes(spark, path) == [(1, "timed_out", START + LIMIT)]


@pytest.mark.parametrize("per_file", [3, 100])
def test_stream_equals_batch_in_any_order(spark, tmp_path, per_file):
    seen = random.Random(per_file).sample(OBSERVED, len(OBSERVED))
    parts = [seen[n : n + per_file] for n in range(0, len(seen), per_file)]
    path, _ = answered(spark, tmp_path, [*parts, [FAR]])
    assert without(outcomes(spark, path), 99) == batch_form(spark, OBSERVED)


def test_null_states_equal_times_and_missing_keys(spark, tmp_path):
    path, _ = answered(spark, tmp_path, [NULL_STATES, [FAR]])
    got, want = outcomes(spark, path), batch_form(spark, NULL_STATES)
    assert sorted(map(str, without(got, 99))) == sorted(map(str, want))


def test_late_rows_come_out_beside_and_change_the_answer(spark, tmp_path):
    first, far = [(1, 5, False, "running"), (2, 5, True, "failed")], [FAR]
    late = [(1, 8, True, "succeeded"), (2, 3, True, "succeeded"), (2, 5, True, "failed"), (7, 1, True, "failed")]
    path, _ = answered(spark, tmp_path, [first, far, late])
    assert kinds(spark, path) >= {(1, "settled"), (2, "settled"), (1, "late"), (2, "late"), (7, "late")}
    got = {r[0]: r[1] for r in outcomes(spark, path)}
    assert got == {1: "succeeded", 2: "succeeded", 7: "failed"}
    assert without(outcomes(spark, path), 99) == without(batch_form(spark, first + far + late), 99)


def test_what_is_known_already_is_not_given_out_again(spark, tmp_path):
    seen = [(1, 5, False, "running"), (1, 7, True, "succeeded")]
    path, _ = answered(spark, tmp_path, [seen, [FAR], seen])
    assert (1, "late") not in kinds(spark, path)


def test_state_is_dropped_after_the_retention(spark, tmp_path):
    seen = [(k, k, False, "running") for k in range(20)]
    path, query = answered(spark, tmp_path, [seen, [FAR], [(98, 20_000, False, "x")]], 0, timedelta(seconds=60))
    left = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert left <= 2 and len(outcomes(spark, path)) >= 20
    # a row of a forgotten execution still counts
    path, _ = answered(spark, tmp_path, [[(3, 4, True, "succeeded")]], 0, timedelta(seconds=60))
    assert {r[0]: r[1] for r in outcomes(spark, path)}[3] == "succeeded"


def test_a_mistyped_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        job_state.read_answers(spark, str(tmp_path / "none")).collect()
