"""Quality of texts by a convolutional network over their bytes, in numpy.

Every byte has a learned vector; learned filters over ``WIDTH`` bytes answer at
every position of the text. Their answers are max-pooled in chunks of two
neighbouring blocks, so that chunks overlap by half and cover the whole text. A
hidden layer reads each chunk; the greatest and the mean of its units over all
chunks are combined into one probability.

The network is fitted on at most ``SAMPLE`` labelled documents per class in
hash order, of each at most ``FIT_CHUNKS`` chunks spread evenly over the whole
text; labels of the held-out fold are never read. The classes are weighed as
they occur among all labels that may be learned from. Texts are scored whole,
in pieces of a bounded size, whatever their length.

Null and empty texts are one chunk of padding and get its score. Repeated rows
get equal scores. Labels other than 0 and 1 are left out; of contradicting ones
of a document the lower counts. Without labels of both classes every score is
the share of 1 among them, and 0 without any. An empty table gives an empty
result. ``doc_id`` and ``text`` are all that is read; other columns, of any
name, don't matter. A null ``doc_id`` isn't held out and isn't learned from.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.workers import kept, share
from fleetlens.session import ship_package

FOLDS, HELD_OUT = 3, 1
# Documents of each class that the network is fitted on, and chunks of each.
SAMPLE, FIT_CHUNKS = 1000, 8
# Bytes of a block (a chunk is two), of a filter, and the sizes of the layers.
BLOCK, WIDTH = 256, 6
VECTOR, FILTERS, HIDDEN = 8, 32, 16
PAD = 256  # what follows the last byte; its vector is zero
# Positions answered at once.
PIECE = 256 * BLOCK
EPOCHS, BATCH, RATE = 14, 32, 4e-3


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    value = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold
    return F.coalesce(value, F.lit(False))


def n_blocks(n_bytes: int) -> int:
    return max(2, -(-n_bytes // BLOCK))


def padded(data: bytes) -> np.ndarray:
    """The numbers of the bytes, filled to whole blocks and what the last filter reads."""
    out = np.full(n_blocks(len(data)) * BLOCK + WIDTH - 1, PAD, dtype=np.int32)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


def chunk_starts(n_bytes: int, most: int) -> list[int]:
    """Where at most ``most`` chunks begin, spread evenly over all of a text."""
    chunks = n_blocks(n_bytes) - 1
    if chunks <= most:
        return [BLOCK * k for k in range(chunks)]
    return [BLOCK * (k * (chunks - 1) // (most - 1)) for k in range(most)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The weights, by name, and what they say about a text."""

    def __init__(self, rng: np.random.Generator):
        def normal(*shape: int, size: float) -> np.ndarray:
            return rng.normal(0, size, shape).astype(np.float32)

        self.name = uuid.uuid4().hex
        self.weights = {
            "vectors": normal(PAD + 1, VECTOR, size=0.5),
            "filters": normal(WIDTH * VECTOR, FILTERS, size=(WIDTH * VECTOR) ** -0.5),
            "hidden": normal(FILTERS, HIDDEN, size=FILTERS**-0.5),
            "hidden_0": np.zeros(HIDDEN, np.float32),
            "out": normal(2 * HIDDEN, size=HIDDEN**-0.5),
            "out_0": np.zeros(1, np.float32),
        }
        self.weights["vectors"][PAD] = 0

    def answers(self, numbers: np.ndarray) -> np.ndarray:
        """What each filter answers at each position; the last ones only are read by a filter."""
        vectors = self.weights["vectors"][numbers]
        n, step = len(numbers) - WIDTH + 1, vectors.strides[0]
        windows = np.lib.stride_tricks.as_strided(
            vectors, (n, WIDTH * VECTOR), (step, vectors.itemsize), writeable=False
        )
        return np.ascontiguousarray(windows) @ self.weights["filters"]

    def block_maxima(self, data: bytes) -> np.ndarray:
        numbers, out = padded(data), []
        for start in range(0, len(numbers) - WIDTH + 1, PIECE):
            found = self.answers(numbers[start : start + PIECE + WIDTH - 1])
            out.append(found.reshape(-1, BLOCK, FILTERS).max(1))
        return np.concatenate(out)

    def probability(self, text: str) -> float:
        blocks, w = self.block_maxima(text.encode("utf-8", "replace")), self.weights
        chunks = np.maximum(blocks[:-1], blocks[1:])
        hidden = np.maximum(chunks @ w["hidden"] + w["hidden_0"], 0)
        whole = np.concatenate([hidden.max(0), hidden.mean(0, dtype=np.float64)])
        return round(float(sigmoid(whole @ w["out"] + w["out_0"])[0]), 6)

    def gradients(
        self, chunks: np.ndarray, owner: np.ndarray, truth: np.ndarray, weight: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Of the weighted log-loss over documents; ``owner`` has each chunk's document, sorted."""
        w, n = self.weights, len(chunks)
        width = 2 * BLOCK
        each = [self.answers(c) for c in chunks]
        at = np.stack([a.argmax(0) for a in each])
        pooled = np.stack([a[p, np.arange(FILTERS)] for a, p in zip(each, at)])
        raw = pooled @ w["hidden"] + w["hidden_0"]
        hidden = np.maximum(raw, 0)
        starts = np.searchsorted(owner, np.arange(len(truth)))
        sizes = np.diff([*starts, n])
        peak = np.maximum.reduceat(hidden, starts)
        mean = np.add.reduceat(hidden, starts) / sizes[:, None]
        whole = np.concatenate([peak, mean], 1)
        wrong = (sigmoid(whole @ w["out"] + w["out_0"]) - truth) * weight / weight.sum()
        to_whole = wrong[:, None] * w["out"]
        first = hidden == peak[owner]
        first &= np.cumsum(first, 0) - np.concatenate(
            [np.zeros((1, HIDDEN), int), np.cumsum(first, 0)]
        )[starts][owner] == 1
        to_hidden = first * to_whole[owner, :HIDDEN]
        to_hidden = to_hidden + to_whole[owner, HIDDEN:] / sizes[owner, None]
        to_raw = to_hidden * (raw > 0)
        to_pooled = to_raw @ w["hidden"].T
        read = np.minimum(at, width - 1)[:, :, None] + np.arange(WIDTH)
        numbers = chunks[np.arange(n)[:, None, None], read]
        vectors = w["vectors"][numbers]
        to_filters = np.einsum("nf,nfke->kef", to_pooled, vectors).reshape(-1, FILTERS)
        filters = w["filters"].reshape(WIDTH, VECTOR, FILTERS)
        to_vectors = np.einsum("nf,kef->nfke", to_pooled, filters).reshape(-1, VECTOR)
        flat = numbers.ravel()
        vectors_all = np.stack(
            [np.bincount(flat, to_vectors[:, e], PAD + 1) for e in range(VECTOR)], 1
        )
        vectors_all[PAD] = 0
        return {
            "vectors": vectors_all,
            "filters": to_filters,
            "hidden": pooled.T @ to_raw,
            "hidden_0": to_raw.sum(0),
            "out": whole.T @ wrong,
            "out_0": wrong.sum(keepdims=True),
        }


def fit(rows: list[tuple[int, list[bytes]]], shares: tuple[float, float]) -> Network:
    """A network from labelled documents, each a list of chunks; ``shares`` of classes 0 and 1."""
    rng = np.random.default_rng(0)
    net = Network(rng)
    width = 2 * BLOCK + WIDTH - 1
    docs = []
    for _, chunks in rows:
        own = np.full((len(chunks), width), PAD, dtype=np.int32)
        for line, data in zip(own, chunks):
            line[: len(data)] = np.frombuffer(data, dtype=np.uint8)
        docs.append(own)
    truth = np.array([label for label, _ in rows], dtype=float)
    found = np.array([(truth == c).sum() for c in (0, 1)])
    weight = np.array([shares[int(c)] / found[int(c)] for c in truth]) * len(truth)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    steps = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            owner = np.repeat(np.arange(len(own)), [len(docs[i]) for i in own])
            chunks = np.concatenate([docs[i] for i in own])
            steps += 1
            for name, g in net.gradients(chunks, owner, truth[own], weight[own]).items():
                one, two = moments[name]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                scale = np.sqrt(two / (1 - 0.999**steps)) + 1e-8
                net.weights[name] -= (rate * one / (1 - 0.9**steps) / scale).astype(np.float32)
    return net


def _known(labels: DataFrame) -> DataFrame:
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    own = own.where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    return own.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """The network, or the score of everything if only one class has labels."""
    known = _known(labels)
    found = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(found.values())
    if len(found) < 2:
        return float(found.get(1, 0) > 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [known.where(F.col("quality") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    text = F.coalesce(df["text"].cast("string"), F.lit("")).alias("text")
    # at most ``2 * sample`` ids
    rows = df.select(df["doc_id"], text).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    ship_package(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = []
            for t in batch.column(1).to_pylist():
                data = t.encode("utf-8", "replace")
                starts = chunk_starts(len(data), FIT_CHUNKS)
                chunks.append([data[s : s + 2 * BLOCK + WIDTH - 1] for s in starts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chunks, pa.list_(pa.binary()))], ["quality", "chunks"]
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [
            (label, chunks)
            for batch in batches
            for label, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        ]
        if len({label for label, _ in own}) == 2:
            net = fit(sorted(own), (found[0] / total, found[1] / total))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    cut_rows = rows.select("quality", "text").mapInArrow(cut, "quality int, chunks array<binary>")
    # an id may be on many rows; the sample stays bounded
    few = cut_rows.orderBy(F.xxhash64("chunks"), "quality").limit(2 * sample)
    fitted = few.repartition(1).mapInArrow(work, "net binary").collect()  # one network
    return pickle.loads(fitted[0]["net"]) if fitted else found[1] / total


def score(df: DataFrame, net: Network | float) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    if not isinstance(net, Network):
        return df.select("doc_id", F.lit(net).cast("double").alias("score"))
    shared = share(df.sparkSession, net)  # a fixed number of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("quality", shared.value.name), lambda: shared.value)
        for batch in batches:
            said = [own.probability(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(said, pa.float64())], ["doc_id", "score"]
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select(df["doc_id"], F.coalesce(df["text"].cast("string"), F.lit("")))
    return rows.mapInArrow(work, f"doc_id {kind}, score double")


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    return score(df, train(df, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
