"""A Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

The leaves of a source, ordered by ``doc_id``, are cut into aligned blocks of
``ARITY ** HEIGHT``. A block is a subtree and is stored in van Emde Boas order:
split at half its height, the top part first, then the parts below it one after
the other, each laid out the same way. Addresses are arithmetic on the number
of leaves, so blocks hold no pointers and no gaps, also where the last one is
short. Building a block and reading the siblings of a leaf go through the same
addresses. The roots of the blocks are the leaves of the next round of blocks,
until a tree has one block; rounds are as many as the logarithm of the number
of documents. No task holds more than a block.

A field that is null is hashed as ``-``. Empty and very long texts are hashed
like others, in the JVM. Rows with one ``doc_id`` in a source are ordered by
their leaf, a null ``doc_id`` comes first; rows repeated as a whole have equal
leaves beside each other, each with its own proof. A null source is a source
of its own, the first. An empty table has no rows, no root and gives an empty
result. Only the five named columns are read; other columns, of any name, don't
matter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import ship_package, stored

ARITY = 3
# Levels of a block above its leaves: 729 leaves.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KEY = ["tree", "block"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def count(n: int, level: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    return -(-n // ARITY**level)


def depth(n: int) -> int:
    """Levels of a whole tree over ``n`` leaves, the leaves included."""
    levels = 1
    while count(n, levels - 1) > 1:
        levels += 1
    return levels


def size(n: int, levels: int) -> int:
    """Nodes of the lowest ``levels`` levels over ``n`` leaves."""
    return sum(count(n, k) for k in range(levels))


def address(n: int, levels: int, level: int, index: int) -> int:
    """Where a node lies in the van Emde Boas order of a subtree with ``n`` leaves.

    Several nodes may be left on the highest level only if ``levels`` is 1.
    """
    start = 0
    while levels > 1:
        below = levels // 2
        bottom = ARITY ** (below - 1)  # leaves of a whole bottom part
        top = count(n, below)
        if level >= below:
            n, levels, level = top, levels - below, level - below
            continue
        part = index // ARITY ** (below - 1 - level)
        start += size(top, levels - below) + part * size(bottom, below)
        index -= part * ARITY ** (below - 1 - level)
        n, levels = min(bottom, n - part * bottom), below
    return start + index


@lru_cache(maxsize=64)
def addresses(n: int, levels: int) -> tuple[tuple[int, ...], ...]:
    """The addresses of all nodes of a block, by level."""
    return tuple(
        tuple(address(n, levels, k, i) for i in range(count(n, k))) for k in range(levels)
    )


class Block:
    """One aligned subtree in van Emde Boas order."""

    def __init__(self, n: int, levels: int, store: bytes):
        self.n, self.levels, self.store = n, levels, store
        self.places = addresses(n, levels)

    @classmethod
    def build(cls, leaves: list[str], levels: int) -> Block:
        n, nodes = len(leaves), [""] * size(len(leaves), levels)
        places = addresses(n, levels)
        for place, leaf in zip(places[0], leaves):
            nodes[place] = leaf
        for children, parents in zip(places, places[1:]):
            for i, place in enumerate(parents):
                run = children[ARITY * i : ARITY * (i + 1)]
                nodes[place] = digest("".join([nodes[c] for c in run]))
        return cls(n, levels, bytes.fromhex("".join(nodes)))

    def node(self, level: int, index: int) -> str:
        at = 32 * self.places[level][index]
        return self.store[at : at + 32].hex()

    @property
    def root(self) -> str:
        return self.node(self.levels - 1, 0)

    def siblings(self, leaf: int) -> tuple[list[str], list[str]]:
        """Level by level, the digests of the run to the left and to the right of a leaf's path."""
        left, right = [], []
        for level in range(self.levels - 1):
            first = leaf - leaf % ARITY
            end = min(first + ARITY, len(self.places[level]))
            left.append("".join([self.node(level, i) for i in range(first, leaf)]))
            right.append("".join([self.node(level, i) for i in range(leaf + 1, end)]))
            leaf //= ARITY
        return left, right


def _width() -> int:
    return ARITY**HEIGHT


def field(value: Column) -> Column:
    """A value as it is hashed: ``-``, or its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    own = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(text.isNull(), F.lit("-")).otherwise(own)


def leaf_of(df: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row, with another text if one is given."""
    values = [df[name] if name != "text" or text is None else text for name in FIELDS]
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``at``, the place of each row in its ``tree`` by ``order``, and ``n``, the rows of it.

    Rows are range-sorted and stored, so that a row's place is a fact; a tree
    lies in consecutive partitions. What carries the count over the borders is
    one row per tree and partition that has rows of it.
    """
    by = ["tree", *order]
    runs = stored(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        runs.groupBy("tree", "part")
        .agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
        .select(
            "tree",
            "part",
            (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("rows").over(tree).alias("n"),
        )
    )
    return (
        runs.join(spans, ["tree", "part"])
        .withColumn("at", F.col("row") + F.col("shift"))
        .drop("part", "row", "shift")
    )


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / F.lit(_width())).cast("bigint"))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of all trees, round by round from the leaves.

    ``nodes`` has ``tree``, ``at``, ``n`` and ``leaf``. A round has ``tree``,
    ``block``, ``n`` (nodes of the tree that are leaves in this round), ``top``
    (the block is the last one of its tree), ``store`` and ``root``.
    """
    width = _width()

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n")[0].as_py()
        levels = depth(n) if n <= width else HEIGHT + 1
        block = Block.build(table.column("leaf").to_pylist(), levels)
        row = {
            "tree": table.column("tree")[0].as_py(), "block": table.column("block")[0].as_py(),
            "n": n, "top": n <= width, "store": block.store, "root": block.root,
        }
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("top", pa.bool_()),
         ("store", pa.binary()), ("root", pa.string())]
    )
    ship_package(nodes.sparkSession)
    largest = nodes.agg(F.max("n")).first()[0] or 0  # one row
    rounds: list[DataFrame] = []
    while not rounds or largest > 1:
        rows = _blocked(nodes.select("tree", "at", "n", "leaf"))
        made = rows.groupBy(*KEY).applyInArrow(
            build, "tree string, block bigint, n bigint, top boolean, store binary, root string"
        )
        rounds.append(stored(made))
        largest = count(largest, HEIGHT)
        nodes = rounds[-1].where(~F.col("top")).select(
            "tree",
            F.col("block").alias("at"),
            F.ceil(F.col("n") / F.lit(width)).alias("n"),
            F.col("root").alias("leaf"),
        )
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree`` and ``root`` of every tree."""
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.where("top").select("tree", "root")


def paths(nodes: DataFrame, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """All columns of ``nodes``, with ``left`` and ``right``: the siblings of each level's run.

    ``above`` has the ``left`` and ``right`` of each tree's root. The blocks are
    opened from the last round down: each hands its own path on to the blocks
    below it.
    """
    width = _width()
    inner: DataFrame | None = None
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k].select(*KEY, "n", "top", "store")
        opened = blocks.where("top").join(above, "tree")
        if inner is not None:
            opened = opened.unionByName(blocks.where("not top").join(inner, KEY))
        if not k:
            break
        inner = stored(opened.groupBy(*KEY).applyInArrow(_handed_on, _PATH))
    kind = _blocked(nodes).schema
    for side in ("left", "right"):
        kind = kind.add(side, T.ArrayType(T.StringType()))

    def join(leaves: pa.Table, block: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("at")
        found = _siblings(block, [a % width for a in leaves.column("at").to_pylist()])
        for name, values in zip(("left", "right"), found):
            leaves = leaves.append_column(name, pa.array(values, pa.list_(pa.string())))
        return leaves

    both = _blocked(nodes).groupBy(*KEY).cogroup(opened.groupBy(*KEY))
    return both.applyInArrow(join, kind).drop("block")


_PATH = "tree string, block bigint, left array<string>, right array<string>"


def _siblings(row: pa.Table, leaves: list[int]) -> tuple[list[list[str]], list[list[str]]]:
    """Siblings of leaves of the block in ``row``, up to the root of everything."""
    own = row.to_pylist()[0]
    n, number = own["n"], own["block"]
    levels = depth(n) if own["top"] else HEIGHT + 1
    block = Block(min(_width(), n - number * _width()), levels, own["store"])
    found = [block.siblings(i) for i in leaves]
    return [a + own["left"] for a, _ in found], [b + own["right"] for _, b in found]


def _handed_on(row: pa.Table) -> pa.Table:
    """The paths of the blocks whose roots are the leaves of the block in ``row``."""
    own, width = row.select(["tree", "block", "n"]).to_pylist()[0], _width()
    leaves = list(range(min(width, own["n"] - own["block"] * width)))
    left, right = _siblings(row, leaves)
    text = pa.list_(pa.string())
    return pa.table(
        {
            "tree": pa.array([own["tree"]] * len(leaves), pa.string()),
            "block": pa.array([own["block"] * width + i for i in leaves], pa.int64()),
            "left": pa.array(left, text),
            "right": pa.array(right, text),
        }
    )


class Manifest(NamedTuple):
    """``leaves`` in their places, the blocks of the sources' trees, ``sources`` in their
    places (``source``, ``leaf``: the subroot) and the blocks of the tree over them."""

    leaves: DataFrame
    rounds: list[DataFrame]
    sources: DataFrame
    upper: list[DataFrame]


def manifest(df: DataFrame, altered: Column | None = None) -> Manifest:
    """Build and store the trees. ``altered`` is another text of each row, whose digest is
    kept beside the leaf as ``altered`` (null where it is the same)."""
    tree = F.when(df["source"].isNull(), F.lit("0")).otherwise(
        F.concat(F.lit("1"), df["source"].cast("string"))
    )
    leaf, other = leaf_of(df), F.lit(None).cast("string")
    if altered is not None:
        changed = ~altered.eqNullSafe(df["text"])
        other = F.when(changed, leaf_of(df, altered))
    rows = df.select(
        df["doc_id"].alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), other.alias("altered")
    )
    leaves = placed(stored(rows), ["doc_id", "leaf"])
    rounds = grow(leaves)
    subroots = roots(rounds).select(
        F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf")
    )
    sources = placed(subroots, ["source"])
    return Manifest(leaves, rounds, sources, grow(sources))


def prove(own: Manifest) -> DataFrame:
    """Per document ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (the siblings' digests
    one after the other), ``folded_root`` (from the altered leaf, if there is one, and the
    siblings) and ``verified``."""
    none = F.array().cast("array<string>")
    start = roots(own.upper).select("tree", none.alias("left"), none.alias("right"), "root")
    upper = paths(own.sources, own.upper, start.drop("root"))
    above = stored(
        upper.join(start.select("tree", "root"), "tree").select(
            F.col("source").alias("tree"), "left", "right", F.col("leaf").alias("subroot"), "root"
        )
    )
    rows = paths(own.leaves, own.rounds, above.select("tree", "left", "right"))
    rows = rows.join(above.select("tree", "subroot", "root"), "tree")
    run = F.arrays_zip("left", "right")
    sides = F.transform(run, lambda s: F.concat(s["left"], s["right"]))
    folded = F.aggregate(
        run,
        F.coalesce("altered", "leaf"),
        lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]).cast("binary"), 256),
    )
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.array_join(sides, "").alias("proof"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
