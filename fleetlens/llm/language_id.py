"""Language of texts by a linear-chain conditional random field over their words.

Each word is a position. Its features are affixes, character n-grams inside it
and its place in a lexicon of frequent training words; transitions between the
languages of neighbouring words are learned. Forward-backward gives every word
a distribution over languages, also in text that switches between them; the
language of a text is the one with most words, by their probabilities.

The model is fitted on at most ``SAMPLE`` documents per language in hash order,
from the folds that aren't held out. Sequences are spliced from passages of
different documents, so that switches occur in training. Only text and ``lang``
of those documents are read; ``source`` and ``doc_id`` are no inputs.

Null texts and texts without a letter get ``und`` and score 0. Without any
training document every text does. Repeated rows get equal results; columns
beside those named don't matter. A null ``doc_id`` isn't held out and isn't
learned from.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.workers import kept, share
from fleetlens.session import ship_package

FOLDS, HELD_OUT = 4, 2
# Documents per language that the model is fitted on.
SAMPLE = 150
FEATURES = 1 << 15
LEXICON = 4000
WORD = re.compile(r"[^\W\d_]+")
SEQUENCE, ROUNDS, RATE, DECAY = 64, 30, 0.3, 1e-5
CHUNK = 64
CACHE_ENTRIES = 1 << 18


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    value = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold
    return F.coalesce(value, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: their numbers one after the other, and where each word's begin.

    Grams of two to four characters of the word between blanks; those at a blank
    are its affixes. A word of the lexicon has a feature of its own. Place 0 is
    the constant, the next ones are the lexicon, the rest are hashed.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32)
    codes = codes.astype(np.uint64)
    blank = codes == 32
    owner = np.cumsum(blank) - 1
    places, numbers = [np.arange(len(words))], [np.zeros(len(words), np.int64)]
    for n in (2, 3, 4):
        if len(codes) < n:
            break
        value = np.full(len(codes) - n + 1, n, np.uint64)
        inside = np.ones(len(value), dtype=bool)
        for k in range(n):
            own = codes[k : len(codes) - n + 1 + k]
            value = (value ^ own) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            if 0 < k < n - 1:
                inside &= own != 32
        inside &= ~(blank[: len(value)] & blank[n - 1 :]) if n == 2 else True
        places.append(owner[: len(value)][inside])
        hashed = value[inside] % np.uint64(FEATURES - LEXICON - 1)
        numbers.append(hashed.astype(np.int64) + LEXICON + 1)
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        own = np.array(known)
        places.append(own[:, 0])
        numbers.append(own[:, 1] + 1)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(words)))
    return np.concatenate(numbers)[order], starts


class Model:
    """Languages, feature weights and transition scores."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, lexicon):
        self.langs, self.weights, self.moves = langs, weights, moves
        self.lexicon = lexicon
        self.name = uuid.uuid4().hex

    def emissions(self, words: list[str]) -> np.ndarray:
        numbers, starts = features(words, self.lexicon)
        scores = np.add.reduceat(self.weights[numbers], starts, axis=0)
        return np.exp(scores - scores.max(1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, x.ndim))
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def posteriors(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Forward-backward over many texts at once; one row of probabilities per word.

    Texts are cut into chunks. The product of a chunk's steps is a matrix; the
    matrices carry the messages from chunk to chunk, so the result is that of
    the whole text whatever its length.
    """
    k, step = len(moves), np.exp(moves)
    lengths = np.array([len(e) for e in emissions])
    chunks = np.maximum(-(-lengths // CHUNK), 1)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    n = int(chunks.sum())
    e, real = np.ones((n * CHUNK, k)), np.zeros(n * CHUNK, dtype=bool)
    for own, start, length in zip(emissions, first * CHUNK, lengths):
        e[start : start + length] = own
        real[start : start + length] = True
    e, real = e.reshape(n, CHUNK, k), real.reshape(n, CHUNK)
    opening = np.zeros(n, dtype=bool)
    opening[first] = True
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(CHUNK):
        moved = (product.reshape(-1, k) @ step).reshape(n, k, k) * e[:, t, None, :]
        if t == 0:  # nothing comes before the first word of a text
            moved[opening] = product[opening] * e[opening, 0, None, :]
        product = np.where(real[:, t, None, None], _scaled(moved), product)
    forward, backward = np.ones((n, k)), np.ones((n, k))
    for j in range(1, int(chunks.max(initial=1))):
        at = first[chunks > j] + j
        forward[at] = _scaled(np.einsum("nk,nkl->nl", forward[at - 1], product[at - 1]))
    for j in range(1, int(chunks.max(initial=1))):
        at = (first + chunks - 1)[chunks > j] - j
        backward[at] = _scaled(np.einsum("nkl,nl->nk", product[at + 1], backward[at + 1]))
    alpha, beta = np.empty((n, CHUNK, k)), np.empty((n, CHUNK, k))
    now = forward
    for t in range(CHUNK):
        moved = now @ step
        if t == 0:
            moved[opening] = now[opening]
        now = np.where(real[:, t, None], _scaled(moved * e[:, t]), now)
        alpha[:, t] = now
    now = backward
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = now
        now = np.where(real[:, t, None], _scaled((now * e[:, t]) @ step.T), now)
    both = (alpha * beta).reshape(n * CHUNK, k)
    both /= np.maximum(both.sum(1, keepdims=True), 1e-300)
    return [both[s : s + m] for s, m in zip(first * CHUNK, lengths)]


def _spliced(
    docs: list[tuple[np.ndarray, int]], rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and languages of training sequences, each of passages of several texts."""
    pieces: list[tuple[np.ndarray, int]] = []
    for own, lang in docs:
        at = 0
        while at < len(own):
            n = int(rng.integers(6, 60))
            pieces.append((own[at : at + n], lang))
            at += n
    order = rng.permutation(len(pieces))
    numbers = np.concatenate([pieces[i][0] for i in order])
    langs = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order])
    n = max(len(numbers) // SEQUENCE, 1)
    size = min(len(numbers), n * SEQUENCE)
    width = size // n
    return numbers[:size].reshape(n, width), langs[:size].reshape(n, width)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model from texts and their languages."""
    texts = [(words_of(text), lang) for text, lang in sorted(rows)]
    texts = [(w, lang) for w, lang in texts if w]
    if not texts:
        return None
    langs = sorted({lang for _, lang in texts})
    counts = Counter(w for words, _ in texts for w in words)
    common = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]
    lexicon = {w: i for i, (w, n) in enumerate(common) if n > 1}
    vocabulary = {w: i for i, w in enumerate(sorted(counts))}
    flat, starts = features(list(vocabulary), lexicon)
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(flat)]))
    docs = [
        (np.array([vocabulary[w] for w in words]), langs.index(lang)) for words, lang in texts
    ]
    numbers, truth = _spliced(docs, np.random.default_rng(0))
    k, (n, width) = len(langs), numbers.shape
    weights, moves = np.zeros((FEATURES, k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1.0)
    for _ in range(ROUNDS):
        scores = np.add.reduceat(weights[flat], starts, axis=0)
        e = np.exp(scores - scores.max(1, keepdims=True))[numbers]
        step = np.exp(moves)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = _scaled(e[:, 0])
        for t in range(1, width):
            alpha[:, t] = _scaled((alpha[:, t - 1] @ step) * e[:, t])
        beta[:, -1] = 1.0
        for t in range(width - 2, -1, -1):
            beta[:, t] = _scaled((beta[:, t + 1] * e[:, t + 1]) @ step.T)
        share_ = alpha * beta
        share_ /= share_.sum(2, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(1, width):
            joint = alpha[:, t - 1, :, None] * step[None] * (beta[:, t] * e[:, t])[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        share_[np.arange(n)[:, None], np.arange(width)[None], truth] -= 1.0
        by_word = np.stack(
            [np.bincount(numbers.ravel(), share_[..., c].ravel(), len(starts)) for c in range(k)], 1
        )
        gradient = np.stack(
            [np.bincount(flat, by_word[owner, c], FEATURES) for c in range(k)], 1
        ) / numbers.size + DECAY * weights
        change = (pairs - gold_moves) / numbers.size + DECAY * moves
        seen_w += gradient**2
        seen_m += change**2
        weights -= RATE * gradient / np.sqrt(seen_w)
        moves -= RATE * change / np.sqrt(seen_m)
    return Model(langs, weights.astype(np.float32), moves, lexicon)


class Tagger:
    """Emissions of words, kept for as many as fit."""

    def __init__(self, model: Model):
        self.model = model
        self.places: dict[str, int] = {}
        self.rows = np.empty((1024, len(model.langs)))

    def emissions(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.places) > CACHE_ENTRIES:
            self.places.clear()
        new = [w for w in {w for words in texts for w in words} if w not in self.places]
        start = len(self.places)
        while start + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        if new:
            self.places.update(zip(new, range(start, start + len(new))))
            self.rows[start : start + len(new)] = self.model.emissions(new)
        at = self.places.__getitem__
        return [self.rows[list(map(at, words))] for words in texts]

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Probabilities of the languages of each word of each text."""
        return posteriors(self.emissions(texts), self.model.moves)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share of the words, of each text."""
        words = [words_of(t) for t in texts]
        words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
        some = [i for i, w in enumerate(words) if w]
        out = [("und", 0.0)] * len(texts)
        for i, rows in zip(some, self.tag([words[i] for i in some]) if some else []):
            shares = rows.mean(0)
            best = int(shares.argmax())
            out[i] = (self.model.langs[best], float(min(shares[best], 1.0)))
        return out


def train(df: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a table of documents; see the module for what it reads."""
    known = df.select("doc_id", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= sample)
    ids = ids.select("doc_id").distinct()
    own = df.select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("text", "lang")])
    # at most ``sample`` ids per language
    rows = own.join(F.broadcast(ids), "doc_id").where("lang is not null and text is not null")
    ship_package(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = {
            pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        }
        yield pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps(fit(sorted(pairs)))], pa.binary())], ["model"]
        )

    # the sample meets in one task, the scan that it is taken from doesn't
    fitted = rows.select("text", "lang").repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""
    if model is None:
        return df.select(
            "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).cast("double").alias("score")
        )
    shared = share(df.sparkSession, model)  # a fixed number of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tagger = kept(("language", own.name), lambda: Tagger(own))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                said = tagger.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([lang for lang, _ in said], pa.string()),
                        pa.array([score for _, score in said], pa.float64()),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def identify(df: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document."""
    return predict(df, train(df)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
