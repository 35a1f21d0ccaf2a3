"""Token counts with a shortcut for words that are one token.

Offline, once per file: for every vocabulary string the merges are run on it as
a pre-token; the strings that come out as their own single token are proven.
A text is counted by its pre-tokens: a proven one counts one without any merge,
only the rest is merged.

Null text is an empty text with no bytes and no tokens. Rows are independent;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe import PIECE
from fleetlens.llm.tokenizer import (
    CACHE_ENTRIES,
    CACHED_CHARS,
    Splitter,
    Tables,
    WordTransducer,
    load_tables,
    whole_word,
)
from fleetlens.llm.workers import kept, share


def prove_whole_tokens(tables: Tables) -> frozenset[str]:
    """The vocabulary strings that encode alone, as one pre-token, to themselves.

    A string that isn't whole characters can't be a pre-token and is left out.
    """
    proven = []
    for text, i in tables.vocab.items():
        if tables.suffix and not text.endswith(tables.suffix):
            continue  # the last token of a pre-token carries the suffix
        try:
            word = tables.token_bytes[i].removesuffix(b" ").decode()
        except UnicodeDecodeError:
            continue
        if whole_word(tables, word) == [i]:
            proven.append(word)
    return frozenset(proven)


class Counts(dict):
    """Tokens of a piece between white space.

    Each of its pre-tokens counts one if proven and is merged if not. Proven
    words always stay; of the rest as many short pieces as fit.
    """

    def __init__(self, tables: Tables, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.tables, self.proven = tables, proven

    def __missing__(self, word: str) -> int:
        n = 0
        for part in self.tables.words(word):
            n += 1 if part in self.proven else len(whole_word(self.tables, part))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.proven):
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[word] = n
        return n


def count_text(tables: Tables, counts: Counts, text: str) -> int:
    """Tokens of one whole text."""
    total, splitter, run = 0, Splitter(tables), None
    for start in range(0, len(text), PIECE):
        items = splitter.feed(text[start : start + PIECE], start + PIECE >= len(text))
        try:
            total += sum(map(counts.__getitem__, items))
            continue
        except (AttributeError, TypeError):  # special strings or parts of a long pre-token
            pass
        for item in items:
            if isinstance(item, str):
                total += counts[item]
            elif isinstance(item, int):
                total += 1
            else:
                run = run or WordTransducer(tables)
                total += len(run.feed(tables.word_bytes(item[0])))
                if item[1]:
                    total, run = total + len(run.finish()), None
    return total


def _worker_counts(shared) -> tuple[Tables, Counts]:
    tables, proven = shared.value
    return tables, kept(("counts", tables.content), lambda: Counts(tables, proven))


def token_counts(
    df: DataFrame,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``)."""
    tables = load_tables(path)
    # both are as large as one vocabulary
    shared = share(df.sparkSession, (tables, prove_whole_tokens(tables)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = _worker_counts(shared)
        for batch in batches:
            n = [count_text(own, counts, t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_tokens"])

    value = F.coalesce(df[text].cast("string"), F.lit(""))
    rows = df.select(df[key], value.alias("t"), F.octet_length(value).cast("bigint").alias("b"))
    kind = rows.schema[key].dataType.simpleString()
    counted = rows.mapInArrow(work, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
