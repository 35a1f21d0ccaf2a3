"""Exports: the node list as XML, and JSON documents per request."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars as E
from fleetlens.operators.lookup import latest_per_key
from fleetlens.operators.ordering import page_of, paged_rows
from fleetlens.session import ship_package

# The attributes of a node and the column each one shows.
NODE_ATTRIBUTES = [
    ("name", "db_name"),
    ("description", None),
    ("hostname", "hostname"),
    ("username", "username"),
    ("type", "category"),
    ("subcategory", "db_type"),
    ("port", "port"),
    ("tags", "tags"),
]


def _column(source: str | None):
    return F.lit("") if source is None else F.col(source)


def nodes(inventory: DataFrame) -> DataFrame:
    """One node per db_name; of several the greatest alias counts."""
    return latest_per_key(inventory, "db_name", ["hostname"])


def node_lines(inventory: DataFrame) -> DataFrame:
    """The ``<node .../>`` text per db_name. Values are escaped, NULL is left out."""
    parts = [E.xml_attribute(name, _column(source)) for name, source in NODE_ATTRIBUTES]
    line = F.concat(F.lit("<node"), *parts, F.lit("/>"))
    return nodes(inventory).select("db_name", line.alias("line"))


def write_node_list(inventory: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the node list sorted by name, one file per sorted range.

    ``single_file`` writes one document instead, through one task.
    """
    columns = [_column(source).alias(f"_{name}") for name, source in NODE_ATTRIBUTES]
    listed = nodes(inventory).orderBy("db_name").select(*columns)
    if single_file:
        listed = listed.coalesce(1)
    (
        listed.write.mode("overwrite")
        .format("xml")
        .options(rowTag="node", rootTag="project", attributePrefix="_")
        .save(path)
    )


def to_documents(
    df: DataFrame,
    key: str,
    envelope: str = "response",
    order: list[str] | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """One JSON document per key with its rows in a list under ``envelope``.

    A key with more than ``group_rows`` rows has several pages, each a whole
    document. ``order`` names the columns that tell rows of a key apart.
    """
    columns = [c for c in df.columns if c not in (key, "page")]
    order = order or [c for c, kind in df.dtypes if c in columns and "map<" not in kind]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    paged = paged_rows(df.drop("page"), [key], order, group_rows)
    keys = [key, *page_of(paged)]
    # Rows go to their document's task in order, as a sort that may spill; none are collected.
    rows = (
        paged.select(*keys, *[F.col(c).alias(f"_by_{n}") for n, c in enumerate(order)], text.alias("_text"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, *[f"_by_{n}" for n in range(len(order))], "_text")
        .select(*keys, "_text")
    )
    schema = rows.select(*keys).schema.add("n_rows", "long", False).add("document", "string")
    ship_package(df.sparkSession)
    return rows.mapInArrow(partial(_listed, head=f'{{"{envelope}":[', tail="]}"), schema)


def _listed(
    batches: Iterator[pa.RecordBatch], head: str, tail: str
) -> Iterator[pa.RecordBatch]:
    """The documents of rows ``(keys..., text)`` that follow one another with equal keys.

    One document is open at a time, as the text so far; it is handed on uncopied.
    """
    opened: tuple | None = None  # its keys as arrays of one value
    text, n_rows = bytearray(), 0

    def closed() -> pa.RecordBatch:
        text.extend(tail.encode())
        ends = pa.py_buffer(struct.pack("=2i", 0, len(text)))
        document = pa.Array.from_buffers(pa.string(), 1, [None, ends, pa.py_buffer(text)])
        return _batch(opened, pa.array([n_rows], pa.int64()), document, names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, texts, names = batch.columns[:-1], batch.columns[-1], batch.schema.names[:-1]
        starts = _run_starts(keys, n)
        ends = [*starts[1:], n]
        lists = pa.ListArray.from_arrays(pa.array([*starts, n], pa.int32()), texts)
        joined = pc.binary_join(lists, ",")
        goes_on = opened is not None and all(k[:1].equals(o) for k, o in zip(keys, opened))
        if goes_on:
            text += b","
            text += joined[0].as_buffer()
            n_rows += ends[0]
            if len(starts) == 1:
                continue
        if opened is not None:
            yield closed()
        first = 1 if goes_on else 0
        if len(starts) - 1 > first:  # documents that begin and end in this batch
            own = slice(first, len(starts) - 1)
            at = pa.array(starts[own], pa.int64())
            counts = pa.array([e - s for s, e in zip(starts[own], ends[own])], pa.int64())
            documents = pc.binary_join_element_wise(head, joined[own], tail, "")
            yield _batch([k.take(at) for k in keys], counts, documents, names)
        opened = tuple(k[starts[-1] : starts[-1] + 1] for k in keys)
        text, n_rows = bytearray(head.encode()), n - starts[-1]
        text += joined[len(starts) - 1].as_buffer()
    if opened is not None:
        yield closed()


def _batch(
    keys: Iterable[pa.Array], counts: pa.Array, documents: pa.Array, names: list[str]
) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys, counts, documents], [*names, "n_rows", "document"])


def _run_starts(keys: list[pa.Array], n: int) -> list[int]:
    """Where rows begin whose keys differ from the row before; null is a key like others."""
    changed = pa.array([False] * (n - 1), pa.bool_())
    for key in keys:
        here, before = key[1:], key[:-1]
        other = pc.fill_null(pc.not_equal(here, before), False)
        changed = pc.or_(changed, pc.or_(other, pc.xor(here.is_null(), before.is_null())))
    return [0, *[i + 1 for i in pc.indices_nonzero(changed).to_pylist()]]


def write_documents(documents: DataFrame, path: str) -> None:
    """Write one document per line."""
    documents.select("document").write.mode("overwrite").text(path)
