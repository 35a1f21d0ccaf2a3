"""Similarity join of word shingles by chosen paths.

A text is the set of its runs of five words. Equal sets are one, with a count.
Each set is embedded into ``HASHES`` coordinates by minhash, so that two sets
agree in a coordinate with the probability of their Jaccard similarity. A run
of the join is a tree of buckets: a bucket chooses one or two coordinates by a
hash of its path and splits its sets by their values there; sets that are
similar share a path more often than not, others soon part. A bucket that is
small enough is compared by brute force on a sketch. What its sets still share
after ``MAX_DEPTH`` choices is a dense group; it is cut into blocks and compared
block by block. Runs are repeated until the chance that two sets at the
threshold meet reaches ``RECALL``.

The candidates of all runs form groups. The members' texts are read once more
and every pair inside a group is compared exactly, block by block, without
writing pairs: each block gives the number of links of its sets and edges that
span what is linked. Classes are the connected components of exact links.

Rows: ``doc_id``, ``class_id`` (the least ``doc_id`` of its class) and
``n_links`` (other documents at or above the threshold, copies included).
Shorter texts than five words are one shingle; null texts and texts without
words are similar to nothing. Repeated rows are copies of each other. A null
``doc_id`` takes no part and is returned with null class and no links. Words
are compared as they are written. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.native import packed
from fleetlens.session import ship_package, stored

WORDS, THRESHOLD = 5, 0.8
HASHES = 128
RECALL = 0.999
MAX_DEPTH = 3
# Sets that a bucket may have to be compared at once, on the way and at the end.
SMALL, BLOCK = 256, 1024
# Sets of an exact block; a pair of blocks is compared by one task.
EXACT_BLOCK = 512
# A candidate's sketch may show this much less than the threshold: over three
# standard deviations of the estimate.
SLACK = 0.15
SECOND = 0.25  # the chance that a bucket chooses a second coordinate
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def meeting_chance(similarity: float = THRESHOLD, depth: int = MAX_DEPTH) -> float:
    """The chance that two sets share a bucket after ``depth`` choices of one run."""
    p = 1.0
    for _ in range(depth):
        x = similarity * p
        p = (1 - SECOND) * x + SECOND * (1 - (1 - x) ** 2)
    return p


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(threshold)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words of a text."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = _mixed(out + hashes[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


_RNG = np.random.default_rng(9)
_FACTORS = _RNG.integers(0, 2**63, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 2**63, HASHES).astype(np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """The minhash of a set in each coordinate, as 32 bits."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 2048):
        part = own[start : start + 2048]
        values = part[:, None] * _FACTORS[None] + _TERMS[None]
        out = np.minimum(out, values.min(axis=0))
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def sketch(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, in four 64-bit words a row."""
    two = (signatures & np.uint32(3)).astype(np.uint8)
    bytes_ = two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6
    return np.ascontiguousarray(bytes_).view(np.uint64)


def _estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each sketch of ``a`` with each of ``b``, from the share of equal coordinates."""
    unequal = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        x = a[:, k][:, None] ^ b[:, k][None]
        x = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
        unequal += np.bitwise_count(x)
    return 1 - unequal / HASHES * (4 / 3)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric boolean matrix links."""
    unseen, edges = np.ones(len(linked), dtype=bool), []
    for start in np.flatnonzero(linked.any(axis=1)):
        if not unseen[start]:
            continue
        unseen[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            for new in np.flatnonzero(linked[at] & unseen):
                unseen[new] = False
                edges.append((at, new))
                queue.append(new)
    return edges


def grouped(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """The groups of rows that follow one another with equal ``keys``; bounded by the caller."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = first != last
        starts = np.flatnonzero(change)
        if len(starts) and starts[0] == 0 and held:
            yield pa.Table.from_batches(held)
            held = []
        elif held:
            end = int(starts[0]) if len(starts) else batch.num_rows
            held.append(batch.slice(0, end))
            if len(starts):
                yield pa.Table.from_batches(held)
                held = []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(int(start), int(end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches([part])
            else:
                held = [part]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _features(df: DataFrame) -> DataFrame:
    """``doc_id``, ``set_id`` (0: no words) and the ``signature`` of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, signatures = [], []
                for text in part.column(1).to_pylist():
                    own = shingles(text)
                    ids.append(set_id(own))
                    signatures.append(signature(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.int64()), pa.array(signatures, pa.binary())],
                    ["doc_id", "set_id", "signature"],
                )

    rows = df.select(df["doc_id"].cast("bigint").alias("doc_id"), df["text"].cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, set_id bigint, signature binary")


def set_id(own: np.ndarray) -> int:
    """A 64-bit number of a set of shingles; 0 of the empty one."""
    if not len(own):
        return 0
    return (xxhash.xxh3_64_intdigest(own.tobytes()) or 1) - (1 << 63)


LEVEL_SCHEMA = "node bigint, set_id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def _chosen(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates that each bucket chooses: one, and a second one by chance."""
    h = _mixed(nodes + np.uint64(0xD1B54A32D192ED03))
    first = h % np.uint64(HASHES)
    second = (first + np.uint64(1) + (h >> np.uint64(20)) % np.uint64(HASHES - 1)) % np.uint64(HASHES)
    two = (h >> np.uint64(44)) < np.uint64(int(SECOND * (1 << 20)))
    return first.astype(np.int64), second.astype(np.int64), two


def _split(nodes: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next buckets of rows in buckets: (bucket, row), one or two a row."""
    first, second, two = _chosen(nodes)
    rows = np.arange(len(nodes))
    where = np.concatenate([rows, rows[two]])
    at = np.concatenate([first, second[two]])
    value = signatures[where, at].astype(np.uint64)
    return _mixed(_mixed(nodes[where] + at.astype(np.uint64)) ^ value), where


def _level(rows: DataFrame, runs: int | None = None) -> DataFrame:
    """The buckets of the next level. ``rows`` has ``set_id``, ``signature`` and, but for the root, ``node``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                n = part.num_rows
                data = b"".join(part.column("signature").to_pylist())
                signatures = np.frombuffer(data, np.uint32).reshape(n, HASHES)
                sets = part.column("set_id").to_numpy()
                found = []
                if runs is None:
                    found.append(_split(part.column("node").to_numpy().view(np.uint64), signatures))
                else:
                    for run in range(runs):
                        root = _mixed(np.full(n, run + 1, np.uint64))
                        found.append(_split(root, signatures))
                nodes = np.concatenate([f[0] for f in found]).view(np.int64)
                where = np.concatenate([f[1] for f in found])
                words = sketch(signatures).view(np.int64)[where]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(sets[where]), *[pa.array(words[:, k]) for k in range(4)]],
                    ["node", "set_id", "s0", "s1", "s2", "s3"],
                )

    return rows.mapInArrow(work, LEVEL_SCHEMA)


def _compared(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that span the similar sketches of each bucket; a bucket is at most two blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )
            a.clear()
            b.clear()
            return made

        for table in grouped(batches, keys):
            if table.num_rows < 2:
                continue
            ids = table["set_id"].to_numpy()
            words = np.stack([table[f"s{k}"].to_numpy().view(np.uint64) for k in range(4)], axis=1)
            linked = _estimated(words, words) >= THRESHOLD - SLACK
            np.fill_diagonal(linked, False)
            for x, y in spanning(linked):
                a.append(int(ids[x]))
                b.append(int(ids[y]))
            if len(a) > 10_000:
                yield out()
        if a:
            yield out()

    sorted_ = buckets.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(work, "a bigint, b bigint")


def in_blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Rows of large groups, copied to the pairs of blocks ``i`` <= ``j`` that compare them.

    A group of n rows has about n / ``block`` blocks; each of its rows goes to
    as many pairs as there are blocks.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", own)
    other = dealt.withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    )
    return other.withColumns(
        {"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}
    ).drop("_other", "_blocks")


def candidates(sets: DataFrame, runs: int | None = None) -> DataFrame:
    """Edges (``a``, ``b``) that connect every group of similar sets found in any run.

    ``sets`` has ``set_id`` and ``signature``.
    """
    level = stored(_level(sets.select("set_id", "signature"), runs or runs_needed()))
    edges = None
    for depth in range(1, MAX_DEPTH + 1):
        counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = level.join(counts, "node")
        small = _compared(sized.where(F.col("n") <= SMALL).drop("n"), ["node"])
        edges = small if edges is None else edges.unionByName(small)
        large = sized.where(F.col("n") > SMALL)
        if depth == MAX_DEPTH:
            blocks = in_blocks(large, "n", BLOCK)
            edges = edges.unionByName(_compared(blocks, ["node", "i", "j"]))
            break
        known = sets.select("set_id", "signature")
        level = stored(_level(large.select("node", "set_id").join(known, "set_id")))
    return edges.distinct()


def _sizes_of_overlap(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each two sets."""
    n = len(sets)
    values, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(columns, minlength=len(values))
    shared = np.flatnonzero(often > 1)
    number = np.full(len(values), -1)
    number[shared] = np.arange(len(shared))
    keep = number[columns] >= 0
    rows, columns = rows[keep], number[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((n, n), np.float32)
    for start in range(0, len(shared), 4096):
        a, b = np.searchsorted(columns, [start, start + 4096])
        part = np.zeros((n, min(4096, len(shared) - start)), np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _exact(members: DataFrame) -> DataFrame:
    """Links and spanning edges of groups of sets: (``kind``, ``a``, ``b``, ``n``).

    ``members`` has ``component``, ``i``, ``j``, ``_own`` (block), ``set_id``,
    ``copies`` and ``shingles``. Pairs of blocks i < j give the links between
    the two, i = j those inside.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["component", "i", "j"]):
            if table.num_rows < 2:
                continue
            ids, copies = table["set_id"].to_numpy(), table["copies"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            lengths = np.array([len(s) for s in sets])
            common = _sizes_of_overlap(sets)
            whole = lengths[:, None] + lengths[None] - common
            linked = common * 10 >= whole * round(THRESHOLD * 10)
            if table["i"][0] != table["j"][0]:
                block = table["_own"].to_numpy()
                linked &= block[:, None] != block[None]
            np.fill_diagonal(linked, False)
            links = linked @ copies
            some = np.flatnonzero(links)
            edges = spanning(linked)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["link"] * len(some) + ["edge"] * len(edges), pa.string()),
                    pa.array([*ids[some].tolist(), *[int(ids[x]) for x, _ in edges]], pa.int64()),
                    pa.array([0] * len(some) + [int(ids[y]) for _, y in edges], pa.int64()),
                    pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64()),
                ],
                ["kind", "a", "b", "n"],
            )

    keys = ["component", "i", "j"]
    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(work, "kind string, a bigint, b bigint, n bigint")


def _with_shingles(df: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (``doc_id``, ``set_id``, ...) with their sets, from the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                # a repeated id may bring a text that isn't the member's
                right = [
                    set_id(s) == i for s, i in zip(sets, part.column("set_id").to_pylist())
                ]
                packed = pa.array([s.tobytes() for s in sets], pa.binary())
                columns = [*[part.column(c) for c in names[:-1]], packed]
                made = pa.RecordBatch.from_arrays(columns, names)
                yield made.filter(pa.array(right))

    names = ["component", "size", "set_id", "copies", "shingles"]
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the same plan at every size: members grow with the documents
    joined = rows.join(members.hint("merge"), "doc_id").select(*names[:-1], "text")
    found = joined.mapInArrow(
        work, "component bigint, size bigint, set_id bigint, copies bigint, shingles binary"
    )
    return found


def join(df: DataFrame, runs: int | None = None) -> DataFrame:
    """``doc_id``, ``class_id`` and ``n_links`` of every document."""
    return _judged(df, runs).select("doc_id", "class_id", "n_links")


def _judged(df: DataFrame, runs: int | None = None) -> DataFrame:
    """:func:`join` with ``set_id`` and ``class_set``, the set of the row that stands for the class."""
    ship_package(df.sparkSession)
    features = stored(_features(df))
    own = features.where(F.col("set_id") != 0).where(F.col("doc_id").isNotNull())
    sets = stored(
        own.groupBy("set_id").agg(
            F.min("doc_id").alias("doc_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("signature").alias("signature"),
        )
    )
    groups = components(candidates(sets, runs)).withColumnRenamed("id", "set_id")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = stored(
        groups.join(sizes, "component").join(sets.select("set_id", "doc_id", "copies"), "set_id")
    )
    found = _with_shingles(df, members).dropDuplicates(["set_id"])
    exact = stored(_exact(in_blocks(found, "size", EXACT_BLOCK)))
    links = exact.where("kind = 'link'").groupBy("a").agg(F.sum("n").alias("links"))
    classes = components(exact.where("kind = 'edge'").select("a", "b"))
    named = classes.join(sets.select(F.col("set_id").alias("id"), "doc_id"), "id")
    first = F.min(F.struct("doc_id", F.col("id").alias("set_id")))
    least = named.groupBy("component").agg(first.alias("first"))
    least = least.select(
        "component", F.col("first.doc_id").alias("class_id"), F.col("first.set_id").alias("class_set")
    )
    by_set = (
        named.join(least, "component")
        .select(F.col("id").alias("set_id"), "class_id", "class_set")
        .join(links.select(F.col("a").alias("set_id"), "links"), "set_id", "left")
    )
    all_sets = sets.join(by_set, "set_id", "left").select(
        "set_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_set", "set_id").alias("class_set"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    rows = features.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    return rows.join(all_sets, "set_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "set_id",
        "class_set",
    )


def one_of_each(df: DataFrame, runs: int | None = None) -> DataFrame:
    """The documents without those that are similar to an earlier one of their class.

    The row with the least id, and of that id the least set, stands for its class
    and stays; of rows that are repeated as a whole one stays. An id on rows with
    different texts is judged for each text.
    """
    judged = _judged(df, runs)
    others = judged.where("class_id != doc_id OR class_set != set_id")
    others = others.select("doc_id", "set_id").distinct()
    rows = _with_set_id(df)
    same = (rows["row.doc_id"] == others["doc_id"]) & (rows["set_id"] == others["set_id"])
    kept = rows.join(others, same, "left_anti").select("row")
    # a map can't be compared, its text can
    maps = "map<" in df.schema.simpleString()
    once = kept.withColumn("whole", F.to_json("row") if maps else F.lit(None).cast("string"))
    return once.dropDuplicates(["whole"] if maps else ["row"]).select("row.*")


def _with_set_id(df: DataFrame) -> DataFrame:
    """``row``, all columns of ``df`` as one struct, and ``set_id``, the number of its text's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [set_id(shingles(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.int64())], ["row", "set_id"]
            )

    given = packed(df, "text").withColumn("text", F.col("text").cast("string"))
    return given.mapInArrow(work, given.select("row").schema.add("set_id", "long"))
