"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Each document gets a hash-random key from its id and text, so that reruns
agree. Sizes are counted once and stored. They are range-sorted by source and
key; sums within a range partition plus the totals of the partitions before it
give every document its place in its source. The place where the running sum
reaches the source's budget is one row per source. A document before it is
taken once more than the full epochs, the one at the cut in part.

Null text has size 0. A null source is a source, the last one. Rows that are
repeated as a whole share their key and so what is taken at the cut. Sources of
size 0 get target 0. An empty table gives an empty result. Only ``doc_id``,
``text`` and ``source`` are read by name; :func:`mixed` keeps the other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.native import SPACE, WORD, packed, unpacked
from fleetlens.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The hash-random key of a document: 128 bits as text."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), own).cast("binary"))


def targets(
    totals: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
) -> DataFrame:
    """``target`` words of each source from its ``source_size``.

    Sources in code point order, null last, take the weights in turn. No
    target is above ``epochs`` times its source; what is left over goes to the
    others by weight. In order of room by weight, the sources filled up are the
    first ones, so one pass of running sums finds them. One row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighted = totals.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, weights)), place).cast("double"),
            "room": F.col("source_size") * float(epochs),
            "budget": F.sum("source_size").over(everything) * float(share),
        }
    )
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    marked = weighted.withColumn(
        "full", F.col("room") * F.sum("weight").over(rest) <= F.col("weight") * left
    )
    full = F.col("full")
    remaining = F.col("budget") - F.sum(F.when(full, F.col("room")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(everything)
    return marked.select(
        "source",
        "source_size",
        F.when(full, F.col("room"))
        .otherwise(F.col("weight") * remaining / open_weight)
        .alias("target"),
    )


def sized(df: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``key`` of each document, stored."""
    text = df["text"].cast("string")
    return stored(
        df.select(
            df["doc_id"].alias("doc_id"),
            df["source"].cast("string").alias("source"),
            size_of(text).alias("size"),
            key_of(df["doc_id"], text, seed).alias("key"),
        )
    )


def cuts(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
) -> DataFrame:
    """One row per source: ``source_size``, ``target``, full ``epochs``, and the
    ``cut_key`` at which the last epoch ends with ``cut_words`` for each of its rows."""
    last = F.col("source").asc_nulls_last()
    places = sizes.groupBy("source", "key").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies")
    )
    ordered = stored(
        places.repartitionByRange(last, "key").withColumn("part", F.spark_partition_id())
    )
    # as many rows as partitions and sources together
    parts = ordered.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before_part = (
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.withColumn(
        "offset", F.coalesce(F.sum("part_size").over(before_part), F.lit(0))
    )
    totals = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    aims = targets(totals, weights, share, epochs).withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(
            F.lit(0)
        ),
    )
    aims = aims.withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")
    )
    in_part = (
        Window.partitionBy("source", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    )
    running = ordered.withColumn("inside", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    o, a = offsets.alias("o"), aims.alias("a")
    r = running.alias("r")
    placed = r.join(
        o, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.part") == F.col("o.part"))
    ).join(a, F.col("r.source").eqNullSafe(F.col("a.source")))
    before = F.col("inside") + F.col("offset")
    found = placed.where((before < F.col("rest")) & (before + F.col("size") >= F.col("rest")))
    cut = found.select(
        F.col("r.source").alias("cut_source"),
        F.col("r.key").alias("cut_key"),
        F.floor((F.col("rest") - before) / F.col("copies")).alias("cut_words"),
    )
    return aims.join(cut, aims["source"].eqNullSafe(cut["cut_source"]), "left").select(
        "source", "source_size", "target", "epochs", "cut_key", "cut_words"
    )


def _last_epoch() -> Column:
    """Words that a row gives to the last, incomplete epoch."""
    at_cut = F.least(F.col("size"), F.col("cut_words"))
    return (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), at_cut)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``."""
    sizes = sized(df, seed)
    aims = stored(cuts(sizes, weights, share, epochs)).withColumnRenamed("source", "aim_source")
    return sizes.join(aims, sizes["source"].eqNullSafe(aims["aim_source"])).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + _last_epoch()).alias("taken"),
    )


def mixed(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The documents of the mix: a row for each epoch that takes them.

    The row at a source's cut has the words up to the budget and, if there is
    an ``n_chars`` column, their length. Documents without words give none. The
    text isn't shuffled: each row is held against the cut of its source.
    """
    aims = stored(cuts(sized(df, seed), weights, share, epochs))
    aims = aims.select(
        F.struct(F.col("source"), "epochs", "cut_key", "cut_words").alias("_mix_aim"),
        F.col("source").alias("_mix_source"),
    )
    df = packed(df, "doc_id", "source", "text", "n_chars")
    text = df["text"].cast("string")
    rows = df.withColumn("_mix_key", key_of(df["doc_id"], text, seed)).join(
        aims, df["source"].cast("string").eqNullSafe(F.col("_mix_source"))
    )
    aim = F.col("_mix_aim")
    at_cut = F.coalesce(F.col("_mix_key") == aim["cut_key"], F.lit(False))
    before = F.coalesce(F.col("_mix_key") < aim["cut_key"], F.lit(False))
    whole = aim["epochs"] + F.when(before, 1).otherwise(0)
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("bigint"), whole.cast("int")),
        F.when(at_cut & (aim["cut_words"] > 0), F.array(aim["cut_words"])).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    taken = rows.where(size_of(F.col("text")) > 0).withColumn("_mix_words", F.explode(copies))
    partial = F.col("_mix_words") >= 0
    pieces = F.split(F.col("text"), f"(?<={WORD[:-1]})(?={SPACE})")
    short = F.array_join(F.slice(pieces, 1, F.greatest(F.col("_mix_words"), F.lit(0)).cast("int")), "")
    columns = {"text": F.when(partial, short).otherwise(F.col("text"))}
    out = taken.withColumns(columns)
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(partial, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return unpacked(out, "text", "n_chars")
