"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

The merge list fixes after how many further bytes a token can't change any
more (:func:`fleetlens.llm.tokenizer.sufficient_lookahead`). Text is cut into
pre-tokens as it arrives; a pre-token of any length runs through a transducer
that gives out each token as soon as it is stable. Decoding is a state machine
from bytes to text whose state is an unfinished character.

Null text is an empty text. Rows are independent: repeated rows give repeated
results, an empty table an empty one. Only the named columns are read, so other
columns of any name don't matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tokenizer import (
    CACHE_ENTRIES,
    CACHED_CHARS,
    Splitter,
    Tables,
    WordTransducer,
    load_tables,
)
from fleetlens.llm.workers import kept, share

# Characters given to the transducer at once, and ids decoded at once.
PIECE = 1 << 15


class WordIds(dict):
    """Ids of short pieces between white space as little-endian bytes, as many as fit."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, word: str) -> bytes:
        out = _packed(self.tables.chunk_ids(word))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = out
        return out


def _packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Little-endian 32-bit ids of texts given in pieces; memory doesn't grow with the text."""

    def __init__(self, tables: Tables, words: WordIds | None = None):
        self.tables = tables
        self.words = WordIds(tables) if words is None else words
        self.splitter = Splitter(tables)
        self.run: WordTransducer | None = None

    def feed(self, piece: str, last: bool = False) -> bytes:
        items = self.splitter.feed(piece, last)
        try:
            return b"".join(map(self.words.__getitem__, items))
        except (AttributeError, TypeError):  # special strings or parts of a long pre-token
            return b"".join(map(self._item, items))

    def _item(self, item: str | int | tuple[str, bool]) -> bytes:
        if isinstance(item, str):
            return self.words[item]
        if isinstance(item, int):
            return _packed([item])
        self.run = self.run or WordTransducer(self.tables)
        out = self.run.feed(self.tables.word_bytes(item[0]))
        if item[1]:
            out, self.run = out + self.run.finish(), None
        return _packed(out)

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of one whole text."""
        text = text or ""
        for start in range(0, len(text), PIECE):
            yield self.feed(text[start : start + PIECE], start + PIECE >= len(text))


class ByteToText:
    """Text from bytes in pieces; an unfinished character waits for the next piece."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        keep = 0 if last else self._unfinished(data)
        cut = len(data) - keep
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead >= 0xC0:
                width = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if width > back else 0
            if lead < 0x80:
                break
        return 0


class Decoder:
    """Text of ids given in pieces.

    ``joined`` gives the tokens as the file writes them with a space between
    them, which is what the library does for a file without decoder. Otherwise
    each token is the bytes it stands for. Ids that the file doesn't have are
    left out.
    """

    def __init__(self, tables: Tables, skip_special_tokens: bool = False, joined: bool = True):
        self.joined, self.state, self.started = joined, ByteToText(), False
        skip = tables.special_ids if skip_special_tokens else set()
        texts = [t.encode() if t else None for t in tables.tokens] if joined else tables.token_bytes
        self.table = [
            b"" if t is None or i in skip else (b" " + t if joined else t)
            for i, t in enumerate(texts)
        ]

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        size = len(self.table)
        data = b"".join([self.table[i] for i in ids if i < size])
        if self.joined and not self.started and data:
            data, self.started = data[1:], True
        out = self.state.feed(data, last)
        if last:
            self.started = False
        return out


def _decoded(decoder: Decoder, ids: bytes) -> str:
    view = memoryview(ids).cast("I") if ids else []
    pieces = [decoder.feed(view[i : i + PIECE].tolist()) for i in range(0, len(view), PIECE)]
    return "".join([*pieces, decoder.feed([], True)])


def _text_column(df: DataFrame, name: str):
    return F.coalesce(df[name].cast("string"), F.lit(""))


def encode(
    df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and ``ids``, the token ids as little-endian unsigned 32-bit integers."""
    return _mapped(df.select(df[key], _text_column(df, text).alias("t")), path, "ids binary")


def decode(
    df: DataFrame,
    path: str | None = None,
    key: str = "doc_id",
    ids: str = "ids",
    skip_special_tokens: bool = False,
    joined: bool = True,
) -> DataFrame:
    """``key`` and ``decoded``, the text of the ids. Null ids give an empty text."""
    rows = df.select(df[key], F.coalesce(df[ids], F.lit(b"")).alias("i"))
    return _mapped(rows, path, "decoded string", skip_special_tokens, joined)


def round_trip(
    df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``ids`` and ``decoded``: both directions in one pass over the rows."""
    rows = df.select(df[key], _text_column(df, text).alias("t"))
    return _mapped(rows, path, "ids binary, decoded string")


def worker_words(shared) -> tuple[Tables, WordIds]:
    """The tables and the word cache of this worker process for one broadcast."""
    tables = shared.value
    return tables, kept(("bpe", tables.content), lambda: WordIds(tables))


def _mapped(
    rows: DataFrame,
    path: str | None,
    outputs: str,
    skip_special_tokens: bool = False,
    joined: bool = True,
) -> DataFrame:
    """Run the transducers over the second column (t: text, i: ids) of ``rows``."""
    shared = share(rows.sparkSession, load_tables(path))
    key, given = rows.columns
    wants_ids, wants_text = "ids " in outputs, "decoded " in outputs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, words = worker_words(shared)
        encoder = Encoder(tables, words)
        decoder = Decoder(tables, skip_special_tokens, joined)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                values = part.column(1).to_pylist()
                ids = values if given == "i" else [b"".join(encoder.encode(v)) for v in values]
                columns: list = [part.column(0)]
                if wants_ids:
                    columns.append(pa.array(ids, pa.binary()))
                if wants_text:
                    columns.append(pa.array([_decoded(decoder, i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, *[o.split()[0] for o in outputs.split(", ")]]
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, {outputs}")
