"""Secret scans: base patterns, and character Markov models for the rest.

The base patterns give spans of known kinds. Other runs of secret-like
characters are judged by two first-order character models, one of random
strings and one of ordinary identifiers: a run is a secret if the
log-likelihood ratio of all of it, or of its best stretch, reaches
``MIN_RATIO``. Base spans are cut out of the runs and the rest is judged. The models are trained from weakly
labelled samples of all documents: the values of the base spans are random,
runs of letters, also joined by _ or -, are ordinary. The transition table has one row per pair
of characters, whatever the data.

Everything is DataFrame functions. Null text is an empty text and has no span.
Spans are in code points, the end is exclusive. Repeated rows give repeated
results; an empty table gives no rows (and untrained models). Only ``doc_id``
and ``text`` are read by name; :func:`redacted` keeps the other columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.native import let, packed, unpacked
from fleetlens.session import stored

# The base rule (fixed by the contract): kind, pattern, group judged, least length.
KINDS = {
    "assign": (
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        6,
    ),
    # maximal runs, so the least length can be asked for in the pattern
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
# Runs that the models judge; plain numbers are left to other rules.
# Of fewer than 16 characters only those with a digit: short letters alone are taken for words.
_RUN = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?=[0-9+/_-]*[A-Za-z])(?:{_RUN}{{16,}}|(?=[A-Za-z+/_-]*[0-9]){_RUN}{{8,}})={{0,2}}"
# Runs that touch no base span and are this long train the models.
LEAST_RUN, LEAST_TRAINING = 8, 16
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
# The ratio at which a run is called random: odds of one secret in about 20,000 runs.
MIN_RATIO = 10.0
# Letters alone must be this surprising per character too: long ordinary words exist.
MIN_RATIO_PER_CHARACTER = 0.5
# Added to the count of each character, and the weight of characters alone beside pairs.
SMOOTHING, BACKOFF = 0.5, 20.0

Model = list[float]


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern as (start, end, value), leftmost and not overlapping."""

    def placed(parts: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(parts["gaps"], i))
            end = start + F.length(F.get(parts["all"], i))
            value = F.get(parts["values"], i)
            span = F.struct(
                start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value")
            )
            spans = F.when(F.length(value) >= least, F.concat(state["spans"], F.array(span)))
            return F.struct(
                end.cast("int").alias("at"), F.coalesce(spans, state["spans"]).alias("spans")
            )

        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        places = F.sequence(F.lit(0), F.size(parts["all"]) - 1)
        return F.aggregate(places, first, add, lambda s: s["spans"])

    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(
        all_.alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>")
    )


def scanned(df: DataFrame) -> DataFrame:
    """``doc_id`` with the spans of each kind and the candidate runs, as arrays."""
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    return df.select(
        df["doc_id"].alias("doc_id"),
        *[_found(text, *rule).alias(kind) for kind, rule in KINDS.items()],
        _found(text, CANDIDATE, 0, LEAST_RUN).alias("candidates"),
    )


def _other(spans: dict[str, Column], candidates: Column) -> Column:
    """The candidates that touch no base span."""

    def clear(c: Column) -> Column:
        touched = F.lit(False)
        for own in spans.values():
            touched = touched | F.exists(
                own, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])
            )
        return ~touched

    return F.filter(candidates, clear)


def _rest(spans: dict[str, Column], candidates: Column) -> Column:
    """What is left of the candidates when the base spans are cut out."""
    base = F.concat(*[F.transform(own, lambda s: F.struct(s["start"], s["end"])) for own in spans.values()])
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def piece(c: Column, start: Column, end: Column) -> Column:
        value = F.substring(c["value"], start - c["start"] + 1, end - start)
        found = F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))
        return F.when((end > start) & value.rlike(f"^{CANDIDATE}$"), found).otherwise(none)

    def cut(c: Column, all_spans: Column) -> Column:
        def after(state: Column, s: Column) -> Column:
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.concat(state["out"], piece(c, state["at"], s["start"])).alias("out"),
            )

        touching = F.filter(all_spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return F.aggregate(
            touching,
            F.struct(c["start"].alias("at"), none.alias("out")),
            after,
            lambda state: F.concat(state["out"], piece(c, state["at"], c["end"])),
        )

    parted = let(F.array_sort(base), lambda b: F.flatten(F.transform(candidates, lambda c: cut(c, b))))
    return F.when(F.size(base) > 0, parted).otherwise(candidates)


def _transitions(values: DataFrame) -> DataFrame:
    """Counts of character pairs of ``value`` by ``label``."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.length("value") - 1),
        lambda i: F.substring(F.col("value"), i, F.lit(2)),
    )
    rows = values.where(F.length("value") > 1).select("label", F.explode(pairs).alias("pair"))
    return rows.groupBy("label", "pair").count()


def train(scans: DataFrame) -> Model:
    """The log ratio of each transition, by place in the alphabet, in row order.

    What comes to the driver is at most two rows per pair of characters.
    """
    base = F.concat(*[F.transform(F.col(k), lambda s: s["value"]) for k in KINDS])
    spans = {k: F.col(k) for k in KINDS}
    ordinary = F.filter(
        F.transform(_other(spans, F.col("candidates")), lambda s: s["value"]),
        lambda v: (F.length(v) >= LEAST_TRAINING) & v.rlike("^[A-Za-z]+([_-][A-Za-z]+)*$"),
    )
    samples = F.concat(
        F.transform(base, lambda v: F.struct(v.alias("value"), F.lit("random").alias("label"))),
        F.transform(
            ordinary, lambda v: F.struct(v.alias("value"), F.lit("ordinary").alias("label"))
        ),
    )
    known = f"[{ALPHABET.replace('-', '')}-]".replace("/", "\\/")
    counted = _transitions(scans.select(F.explode(samples).alias("s")).select("s.*"))
    counts = {
        (r["label"], r["pair"]): r["count"]
        for r in counted.where(F.col("pair").rlike(f"^{known}{known}$")).collect()
    }
    n, labels = len(ALPHABET), ("random", "ordinary")
    alone = {
        label: [sum(counts.get((label, a + b), 0) for a in ALPHABET) + SMOOTHING for b in ALPHABET]
        for label in labels
    }
    single = {label: [x / sum(own) for x in own] for label, own in alone.items()}
    # random strings may also be of an alphabet that no sample has
    single["random"] = [(x + 1 / n) / 2 for x in single["random"]]
    ratio: Model = []
    for a in ALPHABET:
        logs = {}
        for label in labels:
            row = [counts.get((label, a + b), 0) for b in ALPHABET]
            whole = sum(row) + BACKOFF
            logs[label] = [
                math.log((x + BACKOFF * p) / whole) for x, p in zip(row, single[label])
            ]
        ratio += [x - y for x, y in zip(logs["random"], logs["ordinary"])]
    return ratio


def _ratio(value: Column, model: Column) -> Column:
    """The log-likelihood ratios of a run (``whole``) and of its best stretch (``best``).

    A stretch goes on as long as its characters reach the least ratio on average.
    """

    def place(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))

    def of_codes(codes: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            goes_on = acc["spare"] + x >= MIN_RATIO_PER_CHARACTER
            now = F.when(goes_on, acc["now"] + x).otherwise(0.0)
            return F.struct(
                (acc["whole"] + x).alias("whole"),
                F.when(goes_on, acc["spare"] + x - MIN_RATIO_PER_CHARACTER).otherwise(0.0).alias("spare"),
                now.alias("now"),
                F.greatest(acc["best"], now).alias("best"),
            )

        ratios = F.transform(
            F.sequence(F.lit(0), F.size(codes) - 2),
            lambda i: F.coalesce(
                F.get(model, (F.get(codes, i) - 1) * len(ALPHABET) + F.get(codes, i + 1) - 1),
                F.lit(0.0),
            ),
        )
        start = F.struct(*[F.lit(0.0).alias(k) for k in ("whole", "spare", "now", "best")])
        return F.aggregate(ratios, start, add)

    return let(F.transform(F.sequence(F.lit(1), F.length(value)), place), of_codes)


def _literal(model: Model) -> Column:
    """The table as one constant."""
    return F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")


def _random(spans: dict[str, Column], candidates: Column, model: Model) -> Column:
    """The parts of the candidates beside the base spans that the models call random."""
    table = _literal(model)

    def secret(c: Column) -> Column:
        return let(
            _ratio(c["value"], table),
            lambda r: (r["best"] >= MIN_RATIO)
            | (
                (r["whole"] >= MIN_RATIO)
                & (r["whole"] >= F.length(c["value"]) * MIN_RATIO_PER_CHARACTER)
            ),
        )

    return F.filter(_rest(spans, candidates), secret)


def judged(scans: DataFrame, model: Model) -> DataFrame:
    """``scans`` without the candidates, with the spans that the models add as ``random``."""
    added = _random({k: F.col(k) for k in KINDS}, F.col("candidates"), model)
    return scans.withColumn("random", added).drop("candidates")


def all_spans(kinds: list[str]) -> Column:
    """All spans of a judged row, by start and then kind in the given order."""
    def own(kind: str, k: int) -> Column:
        return F.transform(
            F.col(kind),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(k).alias("k"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
            ),
        )

    parts = [own(kind, k) for k, kind in enumerate(kinds)]
    return F.array_sort(F.concat(*parts))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def find_secrets(df: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, the base spans by kind and the ``random`` ones, as arrays."""
    scans = stored(scanned(df))
    return judged(scans, train(scans))


def redacted(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; ``n_chars``, if there, follows.

    The models are trained first; the texts are then scanned where they are.
    """
    model = train(stored(scanned(df)))
    df = packed(df, "text", "n_chars")
    text = df["text"].cast("string")
    own = {
        f"_secret_{kind}": _found(F.coalesce(text, F.lit("")), *rule) for kind, rule in KINDS.items()
    }
    found = df.withColumns(own).withColumn(
        "_secret_candidates", _found(F.coalesce(text, F.lit("")), CANDIDATE, 0, LEAST_RUN)
    )
    bases = {k: F.col(f"_secret_{k}") for k in KINDS}
    added = _random(bases, F.col("_secret_candidates"), model)
    found = found.withColumn("_secret_random", added)
    every = F.array_sort(
        F.concat(
            *[
                F.transform(
                    F.col(f"_secret_{k}"),
                    lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
                )
                for k in [*KINDS, "random"]
            ]
        )
    )
    found = found.withColumn("_secret_all", every)

    def cut(state: Column, s: Column) -> Column:
        gap = F.greatest(s["start"] - state["at"], F.lit(0))
        piece = F.concat(
            state["out"], F.substring(text, state["at"] + 1, gap), F.lit(mark)
        )
        new = F.struct(piece.alias("out"), s["end"].alias("at"))
        joined = F.struct(state["out"].alias("out"), F.greatest(state["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= state["at"], new).otherwise(joined)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(
        F.col("_secret_all"),
        start,
        cut,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    some = F.size("_secret_all") > 0
    out = found.withColumn("_secret_text", F.when(some, clean).otherwise(F.col("text")))
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(some, F.length("_secret_text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return unpacked(out.withColumn("text", F.col("_secret_text")), "text", "n_chars")
