import datetime
import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from seed import rows

from fleetlens import schemas as S
from fleetlens.operators import ordering
from fleetlens.streaming import feed, jobs

START = datetime.datetime(2024, 1, 1)


def random_feed(n, keys, seed=1, hot=0.4):
    """Writes in time order with ties; one key has a good part of them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(keys)
        op = rng.choice(["create", "update", "delete", "delete", "create", "noise"])
        value = None if rng.random() < 0.05 else f"v{i}"
        out.append((i, START + timedelta(seconds=i // 3), key // 3, op, f"k{key % 3}", value))
    return out


def one_by_one(state, writes):
    state, got = dict(state), {}
    for request_id, _, instance, op, name, value in sorted(writes, key=lambda w: (w[1], w[0])):
        key = (instance, name)
        if op not in feed.OPS:
            continue
        if op != "delete" and value is None:
            got[request_id] = 400
        elif op == "create":
            got[request_id] = 409 if key in state else 201
            state.setdefault(key, value)
        elif op == "update":
            got[request_id] = 204 if key in state else 404
            if key in state:
                state[key] = value
        else:
            got[request_id] = 204 if state.pop(key, None) is not None else 404
    return state, got


def as_state(spark, state):
    return spark.createDataFrame([(*k, v) for k, v in state.items()], feed.STATE_SCHEMA)


def as_dict(df):
    return {(r["instance_id"], r["name"]): r["value"] for r in df.collect()}


SEED = {(0, "k0"): "s", (1, "k1"): "s", (99, "k"): "untouched"}


@pytest.fixture
def several_partitions(spark):
    """Keep small shuffles in several partitions, as large ones are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


@pytest.mark.parametrize("group_rows", [ordering.CHUNK_ROWS, 50])
def test_feed_equals_one_by_one(spark, several_partitions, group_rows):
    writes = random_feed(1500, 40)
    df = spark.createDataFrame(writes, S.ATTRIBUTE_FEED).repartition(4)
    state, outcomes = feed.apply_feed(as_state(spark, SEED), df, group_rows)
    wanted_state, wanted = one_by_one(SEED, writes)
    assert {r["request_id"]: r["status"] for r in outcomes.collect()} == wanted
    assert as_dict(state) == wanted_state


def test_chunks_cut_a_long_key(spark, several_partitions):
    df = spark.createDataFrame(random_feed(1500, 40), S.ATTRIBUTE_FEED)
    chunked, several = ordering.chunked(df, feed.KEY, feed.ORDER, 50)
    assert several
    counts = chunked.where("instance_id = 0 AND name = 'k0'").groupBy("_chunk").count().collect()
    assert len(counts) > 1
    assert chunked.count() == df.count()


@pytest.mark.parametrize("files", [1, 3, 10])
def test_stream_equals_batch(spark, tmp_path, files):
    writes = random_feed(300, 20, seed=files)
    source, state_path = str(tmp_path / "in"), str(tmp_path / "state")
    step = len(writes) // files
    feed.write_base(as_state(spark, SEED), state_path)
    spark.createDataFrame(writes[:step], S.ATTRIBUTE_FEED).coalesce(1).write.parquet(source)

    def run():
        feed.stream_feed(
            spark, source, state_path, str(tmp_path / "checkpoint"), files_per_batch=1
        ).awaitTermination()

    for n in range(1, files):
        part = writes[n * step : (n + 1) * step if n < files - 1 else None]
        spark.createDataFrame(part, S.ATTRIBUTE_FEED).coalesce(1).write.mode("append").parquet(source)
        if n % 4 == 0:  # stop and go on from the checkpoint
            run()
    run()
    wanted_state, wanted = one_by_one(SEED, writes)
    assert as_dict(feed.read_state(spark, state_path)) == wanted_state
    got = {r["request_id"]: r["status"] for r in feed.read_outcomes(spark, state_path).collect()}
    assert got == wanted

    feed.compact_state(spark, state_path, str(tmp_path / "compact"))
    assert as_dict(feed.read_state(spark, str(tmp_path / "compact"))) == wanted_state


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    state_path = str(tmp_path / "state")
    feed.write_base(as_state(spark, SEED), state_path)
    first = spark.createDataFrame(random_feed(100, 9, seed=5), S.ATTRIBUTE_FEED)
    for _ in range(2):
        feed._apply_batch(first, 0, state_path, ordering.CHUNK_ROWS)
    wanted_state, wanted = one_by_one(SEED, random_feed(100, 9, seed=5))
    assert as_dict(feed.read_state(spark, state_path)) == wanted_state
    assert feed.read_outcomes(spark, state_path).count() == len(wanted)


def test_a_batch_reads_the_folders_of_its_instances_only(spark, tmp_path):
    state_path = str(tmp_path / "state")
    writes = random_feed(50, 3, seed=2)
    names = {w[S.ATTRIBUTE_FEED.fieldNames().index("name")] for w in writes} - {None}
    state = {(i, name): f"v{i}" for i in range(200) for name in names}
    feed.write_base(as_state(spark, state), state_path)
    batch = spark.createDataFrame(writes, S.ATTRIBUTE_FEED)
    instances = {w[S.ATTRIBUTE_FEED.fieldNames().index("instance_id")] for w in writes}
    before = feed.state_before(spark, state_path, batch, 0)
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", plan), plan
    asked = feed._base(spark, state_path).where(F.col("bucket").isin(
        [r[0] for r in batch.select(feed.bucket_of()).distinct().collect()]
    ))
    files = asked.select(F.input_file_name()).distinct().count()
    # an instance is in one bucket, which has at most four files
    assert 0 < files <= 4 * len(instances) < len(feed._base(spark, state_path).inputFiles())
    known = as_dict(before)
    assert known and known.items() <= state.items() and {k[0] for k in known} <= instances


def test_a_missing_state_is_an_error(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(random_feed(5, 3, seed=2), S.ATTRIBUTE_FEED).write.parquet(source)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feed.stream_feed(spark, source, str(tmp_path / "mistyped"), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feed.read_state(spark, str(tmp_path / "mistyped"))


OBSERVED = [
    # fast success, then noise
    (1, 0, False, "running"), (1, 4, True, "succeeded"), (1, 6, True, "failed"),
    # failure
    (2, 0, False, "running"), (2, 9, True, "aborted"),
    # completes exactly at the limit: too late
    (3, 0, False, "running"), (3, 10, True, "succeeded"),
    # never completes
    (4, 1, False, "running"), (4, 5, False, "running"),
    # complete at once
    (5, 2, True, "succeeded"),
    # far later than its own limit, next to it an unrelated late execution
    (6, 3, False, "running"), (6, 60, True, "succeeded"), (7, 100, False, "running"),
]
LIMIT = timedelta(seconds=10)


def observations(spark, rows_):
    data = [(e, START + timedelta(seconds=s), c, state) for e, s, c, state in rows_]
    return spark.createDataFrame(data, S.JOB_OBSERVATIONS)


def test_job_outcomes(spark):
    got = jobs.job_outcomes(observations(spark, OBSERVED), LIMIT)
    assert rows(got, "exec_id", "outcome") == [
        (1, "succeeded"), (2, "failed"), (3, "timed_out"), (4, "timed_out"),
        (5, "succeeded"), (6, "timed_out"), (7, "timed_out"),
    ]
    ended = {r["exec_id"]: r["ended"] for r in got.collect()}
    assert ended[1] == START + timedelta(seconds=4) and ended[4] == START + timedelta(seconds=11)


def streamed(spark, tmp_path, seen, per_file):
    """The stored marks of a stream over ``seen`` in files of ``per_file`` rows, one a batch."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for n in range(0, len(seen), per_file):
        part = observations(spark, seen[n : n + per_file])
        part.coalesce(1).write.mode("append").parquet(source)
    reader = spark.readStream.schema(S.JOB_OBSERVATIONS).option("maxFilesPerTrigger", 1)
    checkpoint = str(tmp_path / "checkpoint")
    jobs.stream_job_outcomes(reader.parquet(source), state, checkpoint).awaitTermination()
    return state


NULL_STATES = [
    (11, 1, None, None), (11, 2, True, None), (12, 1, None, "succeeded"),
    # equal times: the least state counts, NULL first
    (13, 1, True, "succeeded"), (13, 1, True, "aborted"),
    (14, 1, True, "succeeded"), (14, 1, True, "zombie"),
    (15, 1, True, "succeeded"), (15, 1, True, None),
    (16, None, True, "succeeded"), (None, 1, True, "succeeded"),
]


def observations_with_gaps(spark, seen):
    data = [(e, None if s is None else START + timedelta(seconds=s), c, x) for e, s, c, x in seen]
    return spark.createDataFrame(data, S.JOB_OBSERVATIONS)


@pytest.mark.parametrize("per_file", [1, 4, 100])
def test_job_outcomes_as_a_stream(spark, tmp_path, per_file):
    # In no order of time: late observations count as they do in the batch form.
    seen = random.Random(per_file).sample(OBSERVED, len(OBSERVED))
    state = streamed(spark, tmp_path, seen, per_file)
    batch = jobs.job_outcomes(observations(spark, OBSERVED), LIMIT)
    got = jobs.read_outcomes(spark, state, LIMIT)
    assert rows(got, "exec_id", "outcome", "ended") == rows(batch, "exec_id", "outcome", "ended")
    # Settled after 9 seconds: done, while 3, 4, 6 and 7 still wait for their limits.
    soon = jobs.read_outcomes(spark, state, LIMIT, until=START + timedelta(seconds=9))
    assert [r[0] for r in rows(soon, "exec_id")] == [1, 2, 5]


def test_null_states_and_equal_times(spark, tmp_path):
    seen = NULL_STATES[:-2]
    batch = jobs.job_outcomes(observations(spark, seen), LIMIT)
    assert rows(batch, "exec_id", "outcome") == [
        (11, "failed"), (12, "timed_out"), (13, "failed"), (14, "succeeded"), (15, "failed"),
    ]
    state = streamed(spark, tmp_path, seen, 3)
    got = jobs.read_outcomes(spark, state, LIMIT)
    assert rows(got, "exec_id", "outcome", "ended") == rows(batch, "exec_id", "outcome", "ended")


def test_missing_times_and_keys_are_answered(spark):
    got = jobs.job_outcomes(observations_with_gaps(spark, NULL_STATES[-2:]), LIMIT).collect()
    assert {(r["exec_id"], r["outcome"], r["ended"] is None) for r in got} == {
        (16, "timed_out", True), (None, "succeeded", False),
    }


def test_compacted_marks_forget_old_executions(spark, tmp_path):
    state = streamed(spark, tmp_path, OBSERVED, 5)
    new = str(tmp_path / "new")
    jobs.compact_marks(spark, state, new, started_from=START + timedelta(seconds=2))
    assert [r[0] for r in rows(jobs.read_outcomes(spark, new, LIMIT), "exec_id")] == [5, 6, 7]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jobs.read_outcomes(spark, str(tmp_path / "mistyped"), LIMIT).collect()
