"""A feed of attribute writes, applied in strict order, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens import schemas as S
from fleetlens.operators.ordering import CHUNK_ROWS, chunked
from fleetlens.operators.outcomes import SUCCESS
from fleetlens.sources.snapshots import read_if_present

KEY = ["instance_id", "name"]
ORDER = ["ts", "request_id"]
OPS = ("create", "update", "delete")
# The stored state is cut by a hash of the instance; a fixed value of the layout.
STATE_BUCKETS = 64
STATE_SCHEMA = "instance_id long, name string, value string"
STORED_SCHEMA = f"{STATE_SCHEMA}, bucket int"


def _valid() -> Column:
    """Writes that address a key and, unless they delete, carry a value that fits."""
    keyed = F.col("instance_id").isNotNull() & F.col("name").isNotNull()
    fits = F.col("value").isNotNull() & (
        F.char_length("value") <= S.ATTRIBUTE.field("value").limit
    )
    return keyed & F.col("op").isin(*OPS) & ((F.col("op") == "delete") | fits)


def _order() -> Column:
    return F.struct(*ORDER)


def _existence() -> Column:
    """What a write leaves behind: a create always a row, a delete never one."""
    return F.when(F.col("op") == "create", True).when(F.col("op") == "delete", False)


def _with_existed(state: DataFrame, writes: DataFrame, group_rows: int) -> DataFrame:
    """Add ``existed``: whether the key was there right before each write.

    That is what the last create or delete before it left behind, or the state
    if there is none. A key with very many writes is cut into chunks; what the
    chunks before leave behind is handed on as one row per chunk.
    """
    present = state.select(*KEY, F.lit(True).alias("_present"))
    rows, several = chunked(writes, KEY, ORDER, group_rows)
    rows = rows.withColumn("_left", _existence())
    if several:
        ends = rows.groupBy(*KEY, "_chunk").agg(
            F.max_by("_left", F.when(F.col("_left").isNotNull(), _order())).alias("_end")
        )
        chunks_before = (
            Window.partitionBy(*KEY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        )
        starts = ends.join(present, KEY, "left").select(
            *KEY,
            "_chunk",
            F.coalesce(
                F.last("_end", ignorenulls=True).over(chunks_before),
                F.col("_present"),
                F.lit(False),
            ).alias("_start"),
        )
        rows = rows.join(starts, [*KEY, "_chunk"])
    else:
        rows = rows.join(present, KEY, "left").withColumn(
            "_start", F.coalesce("_present", F.lit(False))
        )
    before = (
        Window.partitionBy(*KEY, "_chunk")
        .orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    last_left = F.last("_left", ignorenulls=True).over(before)
    return rows.withColumn("existed", F.coalesce(last_left, F.col("_start")))


def judge_feed(state: DataFrame, feed: DataFrame, group_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The writes of a feed with their status, as if they came one by one."""
    columns = ["request_id", "ts", "instance_id", "op", "name", "value"]
    known = feed.where(F.col("op").isin(*OPS)).select(*columns)
    valid = F.coalesce(_valid(), F.lit(False))
    status = (
        F.when(F.col("op") == "create", F.when(F.col("existed"), S.CONFLICT).otherwise(S.CREATED))
        .when(F.col("existed"), S.NO_CONTENT)
        .otherwise(S.NOT_FOUND)
    )
    judged = _with_existed(state, known.where(valid), group_rows).select(
        *columns, "existed", status.alias("status")
    )
    refused = known.where(~valid).select(
        *columns, F.lit(False).alias("existed"), F.lit(S.BAD_REQUEST).alias("status")
    )
    return judged.unionByName(refused)


def final_writes(judged: DataFrame) -> DataFrame:
    """Per written key whether it is present in the end, and with which value."""
    done = judged.where(F.col("status").isin(*SUCCESS))
    kept = F.col("op") != "delete"
    last = F.max_by(F.struct(kept.alias("present"), F.when(kept, F.col("value")).alias("value")), _order())
    return done.groupBy(*KEY).agg(last.alias("_last")).select(*KEY, "_last.present", "_last.value")


def _outcomes(judged: DataFrame) -> DataFrame:
    return judged.select(
        "request_id",
        F.col("status").cast("int").alias("status"),
        F.col("status").isin(*SUCCESS).cast("bigint").alias("affected"),
    )


def apply_feed(
    state: DataFrame, feed: DataFrame, group_rows: int | None = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Apply creates, updates and deletes of single attributes in feed order.

    ``state`` has ``instance_id, name, value`` with unique keys. Returns the
    new state and ``request_id, status, affected`` of every known operation.
    """
    judged = judge_feed(state, feed, group_rows)
    return merge_state(state, final_writes(judged)), _outcomes(judged)


def merge_state(state: DataFrame, writes: DataFrame) -> DataFrame:
    """The state with the final write of each written key."""
    new = writes.select(*KEY, "present", F.col("value").alias("_value"))
    merged = state.select(*KEY, "value").join(new, KEY, "full")
    return merged.where(F.coalesce("present", F.lit(True))).select(
        *KEY, F.coalesce("_value", "value").alias("value")
    )


# -- the stored state of a stream ---------------------------------------------------

DELTA_SCHEMA = f"{STORED_SCHEMA}, present boolean, batch_id long"


def bucket_of() -> Column:
    """The folder of the stored state that an instance belongs to."""
    return F.pmod(F.hash("instance_id"), F.lit(STATE_BUCKETS)).cast("int")


def _cut(df: DataFrame) -> DataFrame:
    """By bucket, and by name within it, so that one instance with most rows isn't one task."""
    cut = df.withColumn("bucket", bucket_of())
    return cut.repartition("bucket", F.pmod(F.hash("name"), F.lit(4)))


def _deltas(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame:
    deltas = read_if_present(spark, DELTA_SCHEMA, f"{state_path}/delta")
    return deltas if before is None else deltas.where(F.col("batch_id") < before)


def _base(spark: SparkSession, state_path: str) -> DataFrame:
    """What the stream started from; an error if nothing was stored at the path."""
    return spark.read.schema(STORED_SCHEMA).parquet(f"{state_path}/base")


def _current(base: DataFrame, deltas: DataFrame) -> DataFrame:
    newest = deltas.groupBy(*KEY).agg(
        F.max_by(F.struct("present", "value"), "batch_id").alias("_last")
    )
    return merge_state(base, newest.select(*KEY, "_last.present", "_last.value"))


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The stored attributes: the base with the newest write of each key over it."""
    return _current(_base(spark, state_path), _deltas(spark, state_path))


def state_before(
    spark: SparkSession, state_path: str, feed: DataFrame, batch_id: int
) -> DataFrame:
    """The stored state of a micro-batch's keys; only the folders of its buckets are read."""
    keys = feed.select(*KEY).distinct()
    # at most STATE_BUCKETS numbers
    buckets = [r[0] for r in feed.select(bucket_of().alias("b")).distinct().collect()]
    touched = F.col("bucket").isin(buckets)
    return _current(
        _base(spark, state_path).where(touched).join(keys, KEY, "left_semi"),
        _deltas(spark, state_path, batch_id).where(touched).join(keys, KEY, "left_semi"),
    )


def read_outcomes(spark: SparkSession, state_path: str) -> DataFrame:
    """The status of every request the stream has seen."""
    return _outcomes(spark.read.parquet(f"{state_path}/outcomes"))


def write_base(state: DataFrame, state_path: str) -> None:
    """Store the attributes a new stream starts from."""
    rows = _cut(state.select(*KEY, "value"))
    rows.write.mode("errorifexists").partitionBy("bucket").parquet(f"{state_path}/base")


def _apply_batch(feed: DataFrame, batch_id: int, state_path: str, group_rows: int) -> None:
    """Write the effect of one micro-batch. Written again, it replaces itself."""
    spark = feed.sparkSession
    before = state_before(spark, state_path, feed, batch_id)
    # The judged writes are stored first, so the state is searched one time only.
    judged_path = f"{state_path}/outcomes/batch_id={batch_id}"
    judged = judge_feed(before, feed, group_rows)
    judged.write.mode("overwrite").parquet(judged_path)
    delta = final_writes(spark.read.schema(judged.schema).parquet(judged_path))
    delta_path = f"{state_path}/delta/batch_id={batch_id}"
    _cut(delta).write.mode("overwrite").partitionBy("bucket").parquet(delta_path)


def stream_feed(
    spark: SparkSession,
    path_in: str,
    state_path: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    group_rows: int | None = CHUNK_ROWS,
) -> StreamingQuery:
    """Apply all waiting feed files to the stored state, batch by batch.

    Each micro-batch reads the folders of the stored state that its instances
    are in, and writes only the new values of its keys, in a folder named by the
    batch. A state path without a base is an error.
    """
    _base(spark, state_path)
    reader = spark.readStream.schema(S.ATTRIBUTE_FEED)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(path_in)
        .writeStream.foreachBatch(
            lambda feed, batch_id: _apply_batch(feed, batch_id, state_path, group_rows)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_state(spark: SparkSession, state_path: str, into: str) -> None:
    """Write the current state as the base of a new state folder."""
    write_base(read_state(spark, state_path), into)
