"""Token ids in binary blocks whose planes are transposed and compressed one by one.

The documents are range-partitioned by id and sorted, so that the files hold
their ids in ascending order of ``doc_id``. Ids go into blocks of a fixed size;
a block is transposed into byte planes or bit planes, and each plane is
compressed with zstandard. A row of the Parquet files is one block: its payload
and, beside it, the chunk index (where the block lies in its part, where its
planes end, which documents have ids in it), which can be read without the
payload.

Null text is an empty text and has the end id only. Rows with the same
``doc_id`` follow one another, ordered by text. A null ``doc_id`` comes first.
An empty table gives no block and no row. A very long text fills as many blocks
as it needs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.bpe import PIECE
from fleetlens.llm.tokenizer import CACHE_ENTRIES, CACHED_CHARS, Splitter, Tables, default_path
from fleetlens.llm.workers import kept, share
from fleetlens.session import ship_package

BLOCK = 1 << 16
BLOCK_SCHEMA = (
    "part int, block int, first bigint, n_ids int, plane_bits int, plane_ends array<int>, "
    "docs array<bigint>, rows array<bigint>, counts array<int>, payload binary"
)
# The generator polynomial of CRC-32, bit-reversed (a fixed value of the format).
CRC_POLYNOMIAL = 0xEDB88320


def pack(ids: np.ndarray, plane_bits: int = 8, level: int = 3) -> tuple[bytes, list[int]]:
    """The compressed planes of one block and where each ends.

    ``plane_bits`` is 8 for byte planes or 1 for bit planes. Planes above the
    greatest id are all zero and not written.
    """
    planes = []
    width = int(ids.max()).bit_length() if len(ids) else 0
    for low in range(0, width, plane_bits):
        plane = (ids >> np.uint32(low)) & np.uint32((1 << plane_bits) - 1)
        plane = plane.astype(np.uint8)
        planes.append((np.packbits(plane) if plane_bits == 1 else plane).tobytes())
    press = zstandard.ZstdCompressor(level=level)
    pressed = [press.compress(p) for p in planes]
    return b"".join(pressed), np.cumsum([len(p) for p in pressed], dtype=np.int64).tolist()


def unpack(payload: bytes, ends: list[int], n: int, plane_bits: int = 8) -> np.ndarray:
    """The ids of one block."""
    ids = np.zeros(n, dtype="<u4")
    press = zstandard.ZstdDecompressor()
    for k, (start, end) in enumerate(zip([0, *ends], ends)):
        plane = np.frombuffer(press.decompress(payload[start:end]), dtype=np.uint8)
        if plane_bits == 1:
            plane = np.unpackbits(plane, count=n)
        ids |= plane.astype(np.uint32) << np.uint32(k * plane_bits)
    return ids


class LibraryIds(dict):
    """Ids of pieces between white space, by the tokenizers library, as many as fit.

    Pieces are made of pre-tokens, each of which goes through the library once.
    """

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables, self.words = tables, PretokenIds(tables)

    def __missing__(self, piece: str) -> bytes:
        words = self.words
        if piece.isascii() and piece.isalpha():
            out = words[piece]
        elif piece.isascii() and piece[:-1].isalpha() and piece[-1] in ".,":
            out = words[piece[:-1]] + words[piece[-1]]
        else:
            out = b"".join([words[part] for part in self.tables.words(piece)])
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = out
        return out


class PretokenIds(dict):
    """Ids of pre-tokens; the short ones are kept, as many as fit."""

    def __init__(self, tables: Tables):
        from tokenizers import Tokenizer

        super().__init__()
        self.tables = tables
        self.model = Tokenizer.from_str(tables.content.decode()).model
        self.signs = [tables.tokens[i] for i in tables.inner]

    def __missing__(self, word: str) -> bytes:
        own = word  # a letter stands for itself
        if not (word.isascii() and word.isalpha()):
            signs = self.signs
            own = "".join([signs[b] for b in self.tables.word_bytes(word)])
        out = array("I", [t.id for t in self.model.tokenize(own)]).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = out
        return out


def text_ids(words: LibraryIds, text: str) -> bytes:
    """The ids of one whole text; each distinct pre-token goes through the library once."""
    splitter, out = Splitter(words.tables, limit=len(text) + 1), []
    for start in range(0, len(text), PIECE):
        items = splitter.feed(text[start : start + PIECE], start + PIECE >= len(text))
        try:
            out.append(b"".join(map(words.__getitem__, items)))
        except AttributeError:  # special strings in the text
            out += [words[x] if isinstance(x, str) else x.to_bytes(4, "little") for x in items]
    return b"".join(out)


def _worker_words(shared) -> LibraryIds:
    tables = shared.value
    return kept(("planes", tables.content), lambda: LibraryIds(tables))


def write_ids(
    df: DataFrame,
    folder: str,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    block: int = BLOCK,
    plane_bits: int = 8,
) -> None:
    """Encode every text, append ``end_id`` and write the blocks to ``folder``."""
    with open(path or default_path(), "rb") as file:
        shared = share(df.sparkSession, Tables(file.read()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _worker_words(shared), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        held, pieces, number, row = bytearray(), [], 0, 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal number, pieces
            ids = np.frombuffer(bytes(held[: 4 * n]), dtype="<u4")
            del held[: 4 * n]
            inside, rest, room = [], [], n
            for doc, at, count in pieces:
                take = min(count, room)
                room -= take
                if take:
                    inside.append((doc, at, take))
                if count > take:
                    rest.append((doc, at, count - take))
            pieces = rest
            payload, ends = pack(ids, plane_bits)
            docs, rows, counts = (list(x) for x in zip(*inside))
            out = {
                "part": part, "block": number, "first": number * block, "n_ids": n,
                "plane_bits": plane_bits, "plane_ends": ends, "docs": docs, "rows": rows,
                "counts": counts, "payload": payload,
            }
            number += 1
            return pa.RecordBatch.from_pylist([out], schema)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = text_ids(words, value.as_py()) + end
                held += ids
                pieces.append((doc, row, len(ids) // 4))
                row += 1
                while len(held) >= 4 * block:
                    yield cut(block)
        if held:
            yield cut(len(held) // 4)

    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
         ("plane_bits", pa.int32()), ("plane_ends", pa.list_(pa.int32())),
         ("docs", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
         ("counts", pa.list_(pa.int32())), ("payload", pa.binary())]
    )
    value = F.coalesce(df[text].cast("string"), F.lit("")).alias("text")
    rows = df.select(df[key].cast("bigint").alias("doc"), value)
    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc", "text")
    blocks = ordered.mapInArrow(work, BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(folder)  # payloads are compressed


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with their chunk index."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and block: ``part``, ``row`` (of the document in the
    part), ``doc_id``, ``at`` (of the first id in the part), ``n`` and ``ids``
    (little-endian unsigned 32-bit integers)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = unpack(b["payload"], b["plane_ends"], b["n_ids"], b["plane_bits"])
                if sum(b["counts"]) != len(ids):
                    raise ValueError(f"block {b['part']}/{b['block']} doesn't fit its index")
                data, ends = ids.tobytes(), np.cumsum(b["counts"], dtype=np.int64).tolist()
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b["part"]] * len(starts), pa.int32()),
                        pa.array(b["rows"], pa.int64()),
                        pa.array(b["docs"], pa.int64()),
                        pa.array([b["first"] + s for s in starts], pa.int64()),
                        pa.array(b["counts"], pa.int64()),
                        pa.array([data[4 * s : 4 * e] for s, e in zip(starts, ends)], pa.binary()),
                    ],
                    ["part", "row", "doc_id", "at", "n", "ids"],
                )

    ship_package(spark)
    return read_blocks(spark, folder).mapInArrow(
        work, "part int, row bigint, doc_id bigint, at bigint, n bigint, ids binary"
    )


def _times(a: int, b: int) -> int:
    """Product of two bit-reversed polynomials modulo the generator."""
    out = 0
    for k in range(31, -1, -1):
        if b >> k & 1:
            out ^= a
        a = a >> 1 ^ (CRC_POLYNOMIAL if a & 1 else 0)
    return out


def crc32_joined(first: int, second: int, n_bytes: int) -> int:
    """The CRC-32 of two pieces one after the other; ``n_bytes`` is the length of the second."""
    power, square, bits = 1 << 31, 1 << 30, 8 * n_bytes  # 1 and x
    while bits:
        if bits & 1:
            power = _times(square, power)
        square = _times(square, square)
        bits >>= 1
    return _times(power, first) ^ second


def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` of all its ids."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for pieces in batch.column(4).to_pylist():
                crc = pieces[0]["crc"]
                for piece in pieces[1:]:
                    crc = crc32_joined(crc, piece["crc"], 4 * piece["n"])
                crcs.append(crc)
            columns = [*batch.columns[:4], pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "at", "n", "crc"])

    pieces = read_ids(spark, folder).select(
        "part", "row", "doc_id", "at", "n", F.crc32("ids").alias("crc")
    )
    by_row = (
        pieces.groupBy("part", "row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("at").alias("at"),
            F.sum("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"),
        )
        .select("part", "doc_id", "at", "n", "pieces")
        .mapInArrow(joined, "part int, doc_id bigint, at bigint, n bigint, crc bigint")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per part
        read_blocks(spark, folder)
        .groupBy("part")
        .agg(F.sum("n_ids").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    )
    return by_row.join(F.broadcast(offsets), "part").select(
        "doc_id",
        (F.col("at") + F.col("offset")).alias("start"),
        F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )
