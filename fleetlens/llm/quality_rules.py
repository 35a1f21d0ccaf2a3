"""Quality rules whose thresholds adapt to each language and source.

Measures of every text are counted once and stored. A sketch of each measure
per language and source is a count of logarithmic buckets (eight bits of
precision, so quantiles are right to 1/128 of their value); sketches merge by
adding counts, and the counts don't depend on order or partitions. Thresholds
come from the quartiles alone: a document fails a measure that lies further from
them than ``REACH`` times their distance. Where quartiles (nearly) coincide, as
for measures that are mostly zero, the distance is that of one event (a line, a
symbol, a window found twice) in the middle document of the group, from a sketch of
its own; so limits are lower where texts are longer. A group with fewer than
``MIN_DOCS`` documents uses the merged sketch of its language, and where that is
also short that of all documents. The thresholds are joined back to the documents.

Null text has no words. Null languages and sources are groups of their own.
Documents that fail the base rules aren't in the sketches. Repeated rows are
judged alike. An empty table gives no rows; only ``doc_id``, ``text``, ``lang``
and ``source`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.native import let, total, words
from fleetlens.session import stored

SYMBOLS = "#*$%&|<>"  # fixed by the contract
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent
MIN_DOCS = 50
REACH = 4.0
# Measures in thousandths, and whether low values fail too.
MEASURES = {
    "word_length": True,
    "symbol_share": False,
    "line_repeats": False,
    "word_repeats": False,
}


def _repeat_words(own: Column) -> Column:
    """Words in windows that occur twice or more, from an array of words."""
    ids = F.transform(
        F.sequence(F.lit(1), F.size(own) - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(own, i, F.lit(WINDOW))),
    )

    def covered(hashes: Column) -> Column:
        def neighbours(rows: Column) -> Column:
            def same(row: Column, at: Column) -> Column:
                other = F.get(rows, at)["hash"]
                return F.coalesce(other == row["hash"], F.lit(False))

            found = F.filter(rows, lambda r, j: same(r, j - 1) | same(r, j + 1))
            places = F.array_sort(F.transform(found, lambda r: r["at"]))
            return let(
                places,
                lambda p: total(
                    F.transform(
                        p,
                        lambda x, j: F.least(
                            F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))
                        ).cast("bigint"),
                    )
                ),
            )

        pairs = F.transform(hashes, lambda h, j: F.struct(h.alias("hash"), j.alias("at")))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.array_sort(pairs), neighbours)
        ).otherwise(F.lit(0).cast("bigint"))

    return F.when(F.size(own) > WINDOW, let(ids, covered)).otherwise(F.lit(0).cast("bigint"))


def measures(df: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the base counts and ``base_failed``."""
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = df.select(
        df["doc_id"].alias("doc_id"),
        df["lang"].cast("string").alias("lang"),
        df["source"].cast("string").alias("source"),
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            ),
        ).alias("l"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
    )
    out = counted.select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED
    )
    return out.withColumn("base_failed", failed)


def _share(events: Column, of: str) -> Column:
    return F.floor(events * 1000 / F.greatest(F.col(of), F.lit(1))).cast("bigint")


def _values() -> Column:
    """The measures of a row as an array of names, values and steps in thousandths.

    The step is what one event more adds to the value in this document. For the mean
    word length it is the random error that a mean over so few words has anyway
    (with the variance of a word's length taken as its mean).
    """
    error = F.sqrt("word_chars") * 1000 / F.greatest(F.col("n_words"), F.lit(1))
    values = {
        "word_length": (_share(F.col("word_chars"), "n_words"), F.floor(error).cast("bigint")),
        "symbol_share": (_share(F.col("n_symbols"), "word_chars"), _share(F.lit(1), "word_chars")),
        "line_repeats": (_share(F.col("n_dup_lines"), "n_lines"), _share(F.lit(1), "n_lines")),
        "word_repeats": (_share(F.col("n_repeat_words"), "n_words"), _share(F.lit(2 * WINDOW), "n_words")),
    }
    return F.array(
        *[
            F.struct(F.lit(n).alias("measure"), v.alias("value"), step.alias("step"))
            for n, (v, step) in values.items()
        ]
    )


def bucket(value: Column) -> Column:
    """The least value of the bucket: all but the first eight bits are cut off."""
    drop = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return (F.floor(value / F.pow(F.lit(2), drop)) * F.pow(F.lit(2), drop)).cast("bigint")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per language, source, measure, part (``value`` or ``step``) and bucket."""
    parts = F.array(
        *[
            F.struct(F.lit(part).alias("part"), F.col(f"m.{part}").alias("at"))
            for part in ("value", "step")
        ]
    )
    rows = (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(_values()).alias("m"))
        .select("lang", "source", F.col("m.measure").alias("measure"), F.inline(parts))
    )
    by = ["lang", "source", "measure", "part"]
    return rows.groupBy(*by, bucket(F.col("at")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``n``, ``q1``, ``q3`` and the middle ``step`` of each measure, from merged sketches."""
    by = [*keys, "measure", "part"]
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    ranked = merged.withColumn("up_to", up_to).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*by))
    )

    def at(part: str, quarters: int) -> Column:
        reached = F.col("up_to") * 4 >= F.col("total") * quarters
        return F.min(F.when(reached & (F.col("part") == part), F.col("bucket")))

    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("n"),
        at("value", 1).alias("q1"),
        at("value", 3).alias("q3"),
        at("step", 2).alias("step"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """``low`` and ``high`` of each measure per language and source."""
    own = _quartiles(sketch, ["lang", "source"])
    of_lang = _quartiles(sketch, ["lang"])
    of_all = _quartiles(sketch, [])
    o, p, q = own.alias("o"), of_lang.alias("p"), of_all.alias("q")
    joined = o.join(
        p,
        (F.col("o.measure") == F.col("p.measure")) & F.col("o.lang").eqNullSafe(F.col("p.lang")),
    ).join(q, F.col("o.measure") == F.col("q.measure"))

    def pick(name: str) -> Column:
        return (
            F.when(F.col("o.n") >= MIN_DOCS, F.col(f"o.{name}"))
            .when(F.col("p.n") >= MIN_DOCS, F.col(f"p.{name}"))
            .otherwise(F.col(f"q.{name}"))
        )

    chosen = joined.select(
        F.col("o.lang").alias("lang"),
        F.col("o.source").alias("source"),
        F.col("o.measure").alias("measure"),
        pick("q1").cast("double").alias("q1"),
        pick("q3").cast("double").alias("q3"),
        F.greatest(pick("step"), F.lit(1)).cast("double").alias("step"),
    )
    low = F.col("measure").isin([name for name, both in MEASURES.items() if both])
    reach = F.greatest(F.col("q3") - F.col("q1"), F.col("step")) * REACH
    return chosen.select(
        "lang",
        "source",
        "measure",
        F.when(low, F.col("q1") - reach).otherwise(F.lit(0.0)).alias("low"),
        (F.col("q3") + reach).alias("high"),
    )


def quality(df: DataFrame) -> DataFrame:
    """Per document: the base counts, ``base_failed``, ``kept`` and ``failed_measures``."""
    measured = stored(measures(df))
    limits = (
        thresholds(sketches(measured))
        .groupBy("lang", "source")
        .agg(F.collect_list(F.struct("measure", "low", "high")).alias("limits"))
        .select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "limits")
    )
    joined = measured.join(
        limits,
        F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
        "left",
    ).withColumn("values", _values())
    outside = F.filter(
        F.col("values"),
        lambda v: F.exists(
            F.coalesce(F.col("limits"), F.array().cast(joined.schema["limits"].dataType)),
            lambda t: (t["measure"] == v["measure"])
            & ((v["value"] < t["low"]) | (v["value"] > t["high"])),
        ),
    )
    failed = F.array_sort(F.transform(outside, lambda v: v["measure"]))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
        F.concat_ws(",", failed).alias("failed_measures"),
    )
