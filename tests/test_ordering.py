"""Sums over value-defined buckets: ids in order without a job while planning."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import instance_changes, ordering
from fleetlens.operators.attribute_changes import insert_attributes
from fleetlens.operators.outcomes import greatest_id
from seed import catalog as fleet


def expected(rows):
    total, out = 0, {}
    for key, n in sorted(rows):
        out[key] = total
        total += n
    return out


@pytest.mark.parametrize(
    "keys",
    [
        [5],
        list(range(50)),
        [2**18 * k + d for k in range(40) for d in (-1, 0, 1)],
        [2**41 * k + 2**18 * j for k in range(-3, 4) for j in range(3)],
        random.Random(1).sample(range(-(2**63), 2**63, 2**20), 200),
        [-(2**63), -1, 0, 1, 2**63 - 1],
    ],
)
def test_sums_do_not_depend_on_how_keys_are_spread(spark, keys):
    rows = [(key, abs(key) % 7) for key in sorted(set(keys))]
    df = spark.createDataFrame(rows, "key long, n int").repartition(3)
    got = ordering.bucket_sums(df, "key", {"before": F.col("n"), "nth": F.lit(1)}).collect()
    assert {r["key"]: r["before"] for r in got} == expected(rows)
    assert sorted(r["nth"] for r in got) == list(range(len(rows)))
    assert set(got[0].asDict()) == {"key", "n", "before", "nth"}


def test_an_empty_table_has_no_sums(spark):
    df = spark.createDataFrame([], "key long, n int")
    assert ordering.bucket_sums(df, "key", {"before": F.col("n")}).collect() == []


def test_the_greatest_id_is_part_of_the_plan(spark):
    ids = spark.createDataFrame([(3,), (None,), (9,)], "id long")
    df = spark.range(2).select((F.col("id") + greatest_id(ids)).alias("x"))
    assert sorted(r["x"] for r in df.collect()) == [9, 10]
    assert spark.range(1).select(greatest_id(ids.where("false"))).first()[0] == 0


def jobs_of(spark, name, make):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    made = make()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return made, len(sc.statusTracker().getJobIdsForGroup(name))


def test_one_stored_step_and_no_other_job_while_planning(spark):
    catalog = fleet(spark)
    requests = spark.createDataFrame([(1, "none", "{}")], "request_id long, db_name string, body string")
    for name, change in (
        ("m1", lambda: instance_changes.create_instances(catalog, requests)),
        ("m2", lambda: instance_changes.patch_instances(catalog, requests)),
        ("m4", lambda: insert_attributes(catalog, requests)),
    ):
        _, jobs = jobs_of(spark, f"planning-{name}", change)
        assert jobs <= 6, (name, jobs)  # the jobs of one written table
