"""Exact top-k search by inner product without random access.

Every component of the vectors is a list sorted by value. For a query, lists
with a positive weight are read from the top, those with a negative weight from
the bottom. What has been read bounds the score of every vector from below and
above: an unread component lies between the far end of its list and the place
the reading has come to. Reading stops when all but a few vectors are below the
k-th lower bound; the rest of the lists then gives those few their final scores.

The lists are kept per block of vectors, so no task holds more than one block
and a set of queries; each query's best of every block meet in a group of
``k`` per block. The queries are a stated set and are sent to the blocks in
sets of ``QUERY_SET``.

Vectors that are null or hold null, NaN or infinite components take no part,
nor do rows without id; shorter vectors count as if they ended in zeros. Rows
that repeat an id are candidates of their own, but not for queries of that id;
repeated queries are one. Ties go to the smaller id. Scores must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import ship_package, stored

BLOCK, QUERY_SET = 4096, 1024
# Shares of each list after which the bounds are compared.
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 1.0)
# The reading stops when at most this many times k vectors may still qualify.
CONTENDERS = 4


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _number_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which all sums of products are exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound >= 2**63:
        raise ValueError("scores don't fit 63 bits")
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Lists:
    """The sorted lists of one block, read step by step from both ends."""

    def __init__(self, order: np.ndarray, values: np.ndarray, kind: type):
        # order and values: components x vectors, ascending by value
        self.order, self.values, self.kind = order, values, kind
        self.size = order.shape[1]
        self.depth = 0
        d, n = order.shape
        low, high = values[:, :1].astype(kind), values[:, -1:].astype(kind)
        self.top_lower = np.broadcast_to(low, (d, n)).copy()
        self.top_upper = np.broadcast_to(high, (d, n)).copy()
        self.bottom_upper = np.broadcast_to(high, (d, n)).copy()
        self.bottom_lower = np.broadcast_to(low, (d, n)).copy()
        self.unread_top = np.ones((d, n), dtype=bool)
        self.unread_bottom = np.ones((d, n), dtype=bool)

    def read(self, depth: int) -> None:
        """Read on until ``depth`` entries of each list are known from either end."""
        rows = np.arange(len(self.order))[:, None]
        start, self.depth = self.depth, depth
        from_top, from_bottom = slice(self.size - depth, self.size - start), slice(start, depth)
        for at, lower, upper, unread, front in (
            (from_top, self.top_lower, self.top_upper, self.unread_top, self.size - depth),
            (from_bottom, self.bottom_lower, self.bottom_upper, self.unread_bottom, depth - 1),
        ):
            own, found = self.order[:, at], self.values[:, at].astype(self.kind)
            lower[rows, own] = found
            upper[rows, own] = found
            unread[rows, own] = False
            edge = self.values[:, front][:, None].astype(self.kind)
            bound = upper if unread is self.unread_top else lower
            np.copyto(bound, np.broadcast_to(edge, bound.shape), where=unread)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores: queries x vectors."""
        up, down = np.maximum(queries, 0).astype(self.kind), np.minimum(queries, 0).astype(self.kind)
        lower = up @ self.top_lower + down @ self.bottom_upper
        upper = up @ self.top_upper + down @ self.bottom_lower
        return lower, upper


def search_block(
    ids: np.ndarray,
    order: np.ndarray,
    values: np.ndarray,
    query_ids: np.ndarray,
    queries: np.ndarray,
    k: int,
    share: tuple[float, ...] = DEPTHS,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and scores of the block's vectors that may be in its top k."""
    n = len(ids)
    lists = Lists(order, values, _number_type(queries, values.T))
    active = np.arange(len(queries))
    for part in share:
        lists.read(max(int(np.ceil(n * part)), 1))
        if not len(active):
            return
        lower, upper = lists.bounds(queries[active])
        own = query_ids[active][:, None] == ids[None, :]
        if own.any():  # a query is no candidate of its own
            floor = np.iinfo(np.int64).min if lists.kind is np.int64 else -np.inf
            lower[own] = upper[own] = floor
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), lower.min())
        may = (upper >= kth[:, None]) & ~own
        done = may.sum(1) <= CONTENDERS * k
        if lists.depth == n:
            done[:] = True
        if done.any() and lists.depth < n:
            # the contenders' unread components, from the rest of the lists
            final = np.empty_like(values)
            np.put_along_axis(final, order, values, axis=1)
        for i in np.flatnonzero(done):
            found = np.flatnonzero(may[i])
            if lists.depth == n:
                scores = lower[i, found].astype(np.int64)
            else:
                scores = queries[active[i]] @ final[:, found]
            best = np.lexsort((ids[found], -scores))[:k]
            yield int(active[i]), ids[found][best], scores[best]
        active = active[~done]


BLOCK_SCHEMA = "block long, n int, width int, ids binary, order binary, list_values binary"


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: its ids and the sorted list of each component."""

    def build(table: pa.Table) -> pa.Table:  # about BLOCK rows
        ids = table["id"].to_numpy()
        x = _matrix(table["v"].to_pylist(), table["width"][0].as_py())
        order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        values = np.take_along_axis(x.T, order, axis=1)
        out = {
            "block": table["block"][0].as_py(), "n": len(ids), "width": x.shape[1],
            "ids": ids.tobytes(), "order": order.tobytes(), "list_values": values.tobytes(),
        }
        return pa.Table.from_pylist([out], schema)

    schema = pa.schema(
        [("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()),
         ("order", pa.binary()), ("list_values", pa.binary())]
    )
    return rows.groupBy("block").applyInArrow(build, BLOCK_SCHEMA)


def _sets(rows: DataFrame) -> DataFrame:
    """One row per set of queries."""

    def build(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"].to_pylist(), table["width"][0].as_py())
        ids = table["id"].to_numpy()
        return pa.table(
            {"q_ids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([x.tobytes()], pa.binary())}
        )

    return rows.groupBy("block").applyInArrow(build, "q_ids binary, q binary")


def scaled(vector: Column, factor: float = 64.0) -> Column:
    """Components as integers: floor of ``factor`` times the component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(factor)))


def valid(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""

    def bad(x: Column) -> Column:
        d = x.cast("double")
        return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))

    return vector.isNotNull() & ~F.exists(vector, bad)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the best ``k`` of each query.

    ``vectors`` has ``vec_id`` and ``v``, an array of integers. ``is_query``
    marks the stated set of queries.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = stored(
        vectors.select(F.col("vec_id").cast("bigint").alias("id"), "v", is_query.alias("is_query"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
    )
    size = kept.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("is_query"), 1)).alias("q"),
        F.max(F.size("v")).alias("width"),
    ).collect()[0]
    blocks = max(-(-size["n"] // BLOCK), 1)
    sets = max(-(-size["q"] // QUERY_SET), 1)
    rows = kept.withColumn("width", F.lit(size["width"] or 0))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    lists = stored(_blocks(dealt))
    queries = rows.where("is_query").select("id", "v", "width").distinct()
    asked = _sets(queries.withColumn("block", F.pmod(F.xxhash64("v", "id"), F.lit(sets))))
    # each set of queries meets each block once
    sent = asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    cells = sent.join(lists, F.col("at") == F.col("block")).select(
        "n", "width", "ids", "order", "list_values", "q_ids", "q"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = batch.slice(i, 1).to_pylist()[0]
                n, width = c["n"], c["width"]
                ids = np.frombuffer(c["ids"], np.int64)
                order = np.frombuffer(c["order"], np.int32).reshape(width, n)
                values = np.frombuffer(c["list_values"], np.int64).reshape(width, n)
                q_ids = np.frombuffer(c["q_ids"], np.int64)
                q = np.frombuffer(c["q"], np.int64).reshape(len(q_ids), width)
                if width == 0:  # vectors without components: every score is 0
                    order, values = np.arange(n, dtype=np.int32)[None], np.zeros((1, n), np.int64)
                    q = np.zeros((len(q_ids), 1), np.int64)
                found = list(search_block(ids, order, values, q_ids, q, k))
                if not found:
                    continue
                names = [np.full(len(own), q_ids[p]) for p, own, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(names)),
                        pa.array(np.concatenate([o for _, o, _ in found])),
                        pa.array(np.concatenate([s for _, _, s in found])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    best = cells.mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def search_embeddings(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Top ``k`` for the rows whose ``vec_id`` is divisible by ``every``."""
    vector = F.col("embedding")
    good = embeddings.where(valid(vector)).select("vec_id", scaled(vector).alias("v"))
    return top_k(good, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), k)
