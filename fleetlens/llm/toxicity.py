"""Toxicity of texts that may be disguised by leetspeak, spacing and repetition.

A word that looks disguised is a path through a lattice: each sign may stand
for letters, may be a separator, or may repeat the one before; a separator is
nothing or the end of a word. Viterbi decoding finds the most likely words
under a character trigram model of all documents (the source) and costs of
each disguise (the channel). Blanks are in the lattice too, as nothing or the
end of a word: tokens that give a feature when joined count if that reading
is nearly as likely as the best one, the nearer the weaker the feature. The restored words are
scored by features learned from labelled documents: whole words and word
beginnings that toxic documents have and hardly any clean ones.

The trigram counts cover every document and are one row per trigram of 27
signs. The classifier is fitted on at most ``SAMPLE`` labelled documents per
class, taken in hash order; labels of the held-out fold are never read.

Null text is an empty text. Empty texts get the score of a text without any
feature. Repeated rows get equal scores. Without toxic training labels every
score is 0; an empty table gives an empty result. Only ``doc_id`` and ``text``
are read; extra columns of any name and type are carried along as one struct.
Very long texts are scored in one pass, in time proportional to their length. A
null ``doc_id`` isn't held out.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.workers import kept, share
from fleetlens.session import ship_package

FOLDS, HELD_OUT = 5, 0
# Labelled documents of each class that the classifier is fitted on.
SAMPLE = 1500
# What a feature needs: toxic documents, log-odds against chance beyond those of
# the best of all features tried, what a clean occurrence takes from them, and
# by how much a word beginning must exceed what it continues to.
MIN_SUPPORT, MIN_EVIDENCE, DOUBT, MORE_THAN_LONGER = 4, 2.5, 8.0, 1.3
BEGINNINGS = (4, 5, 6)
CACHE_ENTRIES = 1 << 18

# What signs commonly stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
}
WILD = "*"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Costs of the channel, as log-probabilities.
STANDS_FOR, SEPARATOR, NOISE, WILD_COST, NO_LETTER = -1.0, -0.5, -9.0, -3.0, -5.0
ONE_OF_TWO, ONE_OF_MANY, TWO_OF_MANY = -3.0, -0.3, -0.6
# Of a sign of LEET that is no digit, to end a word.
ENDS_WORD = -2.0
# Of a blank, to be nothing: between two single signs, and elsewhere.
SPACED, JOINED = -0.5, -2.0
# Signs of the shortest spaced word; the tokens on each side that are read with it; how
# much more the log-odds of its feature must be than what the best reading is likelier by.
LEAST, AROUND, SURER = 3, 8, 2.5

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
PLAIN = re.compile(r"(?:([^\W\d_])(?!\1))*")  # letters before any that is doubled
DOUBLE, TRIPLE, REPEATED = (re.compile(r"(.)\1" + more) for more in ("", r"\1", "+"))
SIGNS = 27  # letters and everything else
_NUMBER = {c: k + 1 for k, c in enumerate(LETTERS)}
Model = np.ndarray | list[list[list[float]]]


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    value = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold
    return F.coalesce(value, F.lit(False))


def _sign_table() -> np.ndarray:
    """Number of each code point below U+0250: its base letter, or 0."""
    out = np.zeros(0x251, dtype=np.int64)
    for point in range(0x250):
        base = unicodedata.normalize("NFD", chr(point).lower())[0]
        out[point] = LETTERS.find(base) + 1
    return out


_TABLE = _sign_table()


def sign_numbers(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return _TABLE[np.minimum(points, 0x250)]


def count_trigrams(df: DataFrame) -> np.ndarray:
    """Trigram counts of all texts, each between blanks; rows follow the input, not its size in one place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIGNS**3, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(start, 256).to_pylist()
                n = sign_numbers(" " + "  ".join(texts) + " ")
                codes = (n[:-2] * SIGNS + n[1:-1]) * SIGNS + n[2:]
                counts += np.bincount(codes, minlength=SIGNS**3)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], ["code", "n"]
        )

    ship_package(df.sparkSession)
    text = F.coalesce(df["text"].cast("string"), F.lit("")).alias("text")
    rows = df.select(text).mapInArrow(work, "code int, n bigint")
    out = np.zeros(SIGNS**3, dtype=np.int64)
    for row in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most 27^3 rows
        out[row["code"]] = row["n"]
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a sign after two others, interpolated with shorter histories."""
    three = counts.reshape(SIGNS, SIGNS, SIGNS).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIGNS)
    p2 = two / np.maximum(two.sum(1, keepdims=True), 1)
    p3 = three / np.maximum(three.sum(2, keepdims=True), 1)
    return np.log(0.7 * p3 + 0.2 * p2[None] + 0.1 * p1[None, None])


def _sign(c: str) -> str:
    """The sign itself, or a blank for all separators."""
    return c if c.isalpha() or c in LEET or c == WILD else " "


def _lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of one sign, what it may stand for and at which cost; a blank ends a word."""
    pieces = token.split()
    lengths = [sum(_sign(c) != " " for c in t) for t in pieces] if len(pieces) > 1 else []
    at = 0 if all(lengths[:1]) else -1
    lengths = [n for n in lengths if n]
    for sign, run in groupby(token, _sign):
        given = list(run)
        n = len(given)
        if sign == WILD:
            wild = [(c * n, WILD_COST * n) for c in LETTERS] if n <= 2 else []
            gone = NO_LETTER if n <= 2 else SEPARATOR
            yield [("", gone), (" ", gone), *wild]
        elif sign in LEET:
            end = NOISE * n if sign.isdigit() else ENDS_WORD
            step = [("", NOISE * n), (" ", end)]
            step += [(c * min(n, 2), STANDS_FOR * n) for c in LEET[sign]]
            if n > 1:
                step += [(c, STANDS_FOR * n + ONE_OF_TWO / 2) for c in LEET[sign]]
            yield step
        elif any(map(str.isspace, given)):
            at += 1
            single = lengths[at - 1 : at + 1] == [1, 1]
            yield [("", SPACED if single else JOINED), (" ", SPACED if single else 0.0)]
        elif sign == " ":
            yield [("", SEPARATOR), (" ", SEPARATOR)]
        elif n == 1:
            yield [(sign, 0.0)]
        elif n == 2:
            yield [(sign * 2, 0.0), (sign, ONE_OF_TWO)]
        else:
            yield [(sign, ONE_OF_MANY), (sign * 2, TWO_OF_MANY)]


def viterbi(token: str, model: Model) -> str:
    """The most likely words of a disguised text, with blanks between them; equal ones by text."""
    return _decoded(token, model)[1]


def _decoded(token: str, model: Model) -> tuple[float, str]:
    """The log-probability and the words of the best path."""
    rows = model.tolist() if isinstance(model, np.ndarray) else model
    number = _NUMBER
    if not token.isascii():
        own = {c: LETTERS.find(unicodedata.normalize("NFD", c)[0]) + 1 for c in set(token)}
        number = own | _NUMBER
    # by the last two letters: the score and the text after what all paths share
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    shared = []
    for k, step in enumerate(_lattice(token)):
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for letters, cost in step:
                x, y, now, new = a, b, score + cost, text
                if letters != " ":
                    for c in letters:
                        z = number[c]
                        now += rows[x][y][z]
                        x, y = y, z
                    new += letters
                elif x or y:  # the end of a word and a fresh start
                    now += rows[x][y][0]
                    x, y, new = 0, 0, new + " "
                old = reached.get((x, y))
                if old is None or (now, new) > old:
                    reached[(x, y)] = (now, new)
        best = reached
        if k % 64 == 63:
            shared.append(commonprefix([text for _, text in best.values()]))
            best = {s: (score, text[len(shared[-1]) :]) for s, (score, text) in best.items()}
    ends = [
        (score + (rows[a][b][0] if a or b else 0.0), text) for (a, b), (score, text) in best.items()
    ]
    score, text = max(ends)
    return score, ("".join(shared) + text).strip()


def _readings(form: str, model: Model) -> Iterator[str]:
    """What a form with other signs than letters may say, each as words with blanks between them."""
    yield viterbi(form, model)
    signs = "".join(map(_sign, form))
    parts = "".join(c if s != " " else " " for c, s in zip(form, signs)).split()
    if len(parts) > 1:  # all separators nothing, all separators ends of words
        yield viterbi("".join(parts), model)
        yield from (p if p.isalpha() else viterbi(p, model) for p in parts)
    yield "".join(c if c.isalpha() else " " for c in form)  # undisguised words


def restored(token: str, model: Model) -> list[str]:
    """The words that a lower-case token may stand for; one of letters also stands for itself."""
    core = EDGES.sub("", token)
    if core.isalpha() and not TRIPLE.search(core) and len(core) + 2 < len(token) or core == token:
        forms = [core]
    else:  # one or two signs at an edge may be letters
        front = token[: token.find(core)] if core else token
        back = token[len(front) + len(core) :]
        front = front if len(front) <= 2 and all(c in LEET for c in front) else ""
        back = back if len(back) <= 2 and all(c in LEET for c in back) else ""
        forms = [core] + ([front + core + back] if front + back else [])
    out: dict[str, None] = {}
    for form in forms:
        if form.isalpha():
            found = [form]
        elif any(c.isalpha() for c in form):
            found = [w for reading in _readings(form, model) for w in reading.split()]
        else:
            continue
        for word in found:
            if not TRIPLE.search(word):
                out[word] = None
            if DOUBLE.search(word):  # repetition: the likeliest letters, and each letter once
                out[viterbi(word, model)] = None
                out[REPEATED.sub(r"\1", word)] = None
    return [*out]


def spaced(tokens: list[str]) -> Iterator[str]:
    """Words written as single signs: three or more in a row, with separators, by blanks and joined."""
    run: list[str] = []
    for token in [*tokens, "  "]:
        signs = [c for c in token if _sign(c) != " "]
        if len(signs) < 2 and token != "  ":
            run += signs
            continue
        if len(run) >= LEAST:
            yield "".join(run)
            yield " ".join(run)
        run = []


def keys(word: str) -> list[str]:
    """The features of a word."""
    return [f"={word}", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def text_keys(text: str, model: np.ndarray) -> set[str]:
    """All features of a text, restored."""
    tokens = text.lower().split()
    words = {w for t in {*tokens, *spaced(tokens)} for w in restored(t, model)}
    return {k for w in words for k in keys(w)}


def _contexts(text: str, model: np.ndarray, wanted: set[str]) -> Iterator[tuple[str, tuple[str, str]]]:
    """The wanted features of a text, each with the words on both sides of its place."""
    tokens = text.lower().split()
    for before, token, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
        for word in restored(token, model):
            for key in keys(word):
                if key in wanted:
                    yield key, (before, after)
    for token in spaced(tokens):
        for word in restored(token, model):
            yield from ((key, (text, "")) for key in keys(word) if key in wanted)


def fit(rows: list[tuple[str, int]], model: np.ndarray) -> tuple[dict[str, float], float]:
    """Weights of the chosen features and the score of texts without any.

    ``rows`` are distinct texts with their class. Support is counted in distinct
    surroundings, so that many near copies of one text count once. A feature is
    chosen if its support in toxic texts can't be chance among all features and
    hardly any clean text has it; a word beginning only if it says more than
    the words and longer beginnings that start with it. Its weight is the share
    of toxic support, smoothed.
    """
    model = model.tolist()
    toxic = [text for text, label in rows if label]
    n_clean = len(rows) - len(toxic)
    if not toxic:
        return {}, 0.0
    of_toxic: Counter[str] = Counter()
    for text in toxic:
        of_toxic.update(text_keys(text, model))
    often = {k for k, n in of_toxic.items() if n >= MIN_SUPPORT}
    del of_toxic
    of_clean: Counter[str] = Counter()
    for text, label in rows:
        if not label:
            of_clean.update(often & text_keys(text, model))
    wanted = {k for k in often if of_clean[k] * 200 <= n_clean}
    places: dict[str, tuple[set, set]] = {k: (set(), set()) for k in wanted}
    found_in: list[set[str]] = []
    for text, label in rows:
        own = set()
        for key, place in _contexts(text, model, wanted):
            places[key][0 if label else 1].add(place)
            own.add(key)
        if label:
            found_in.append(own)
    evidence = math.log(len(rows) / len(toxic)) if n_clean else 1.0
    needed = MIN_EVIDENCE + math.log(max(len(wanted), 1))
    strong = {
        k: len(yes)
        for k, (yes, no) in places.items()
        if len(yes) >= MIN_SUPPORT and len(yes) * evidence - len(no) * DOUBT >= needed
    }
    longest: Counter[str] = Counter()  # the best support of a longer feature, by beginning
    for key, n in strong.items():
        word = key.removeprefix("=")
        for k in BEGINNINGS:
            if k < len(word) or k == len(word) and key != word:
                longest[word[:k]] = max(longest[word[:k]], n)
    chosen = [
        k for k, n in strong.items() if k.startswith("=") or n > MORE_THAN_LONGER * longest[k]
    ]
    weights = {
        k: (len(places[k][0]) + 0.5) / (len(places[k][0]) + len(places[k][1]) + 1.0)
        for k in sorted(chosen)
    }
    missed = sum(1 for own in found_in if not any(k in weights for k in own))
    return weights, (missed + 0.1) / (missed + n_clean + 1.0)


NOTHING: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())


class Scorer(dict):
    """Chosen features of each token, and the beginnings of features that it may spell as a whole.

    Of the tokens as many as fit are kept. A token is decoded only if one of its
    readings comes by the word of a feature.
    """

    def __init__(self, model: np.ndarray, weights: dict[str, float], base: float):
        super().__init__()
        self.model, self.weights, self.base = model.tolist(), weights, base
        self.words = {k.removeprefix("=") for k in weights}
        self.starts = {w[:n] for w in self.words for n in range(len(w) + 1)}
        self.steps: dict[tuple[str, str], frozenset[str]] = {}

    def __missing__(self, token: str) -> tuple[frozenset[str], frozenset[str]]:
        found: frozenset[str] = frozenset()
        if self._reaches(token):
            words = restored(token, self.model)
            found = frozenset(k for w in words for k in keys(w) if k in self.weights)
        begun = self._longer("", token) - {""}
        out = (found, frozenset(begun)) if found or begun else NOTHING
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out

    def _reaches(self, token: str) -> bool:
        """Whether any reading of a token comes by the word of a feature."""
        plain = PLAIN.match(token).group()
        if plain == token:
            return plain in self.words or any(plain[:n] in self.words for n in BEGINNINGS)
        at, letters_only = {""}, token.isalpha()
        for step in _lattice(token):
            reached = set()
            for letters, _ in step:
                if letters == " ":  # the end of a word, whatever it is, and a fresh start
                    reached.add("")
                    continue
                for start in at:
                    if start + letters in self.starts:
                        reached.add(start + letters)
            if not reached.isdisjoint(self.words):
                return True
            if letters_only and not reached:
                return False
            at = reached
        return False

    def _longer(self, start: str, token: str) -> set[str]:
        """Beginnings of features after one more token."""
        head = PLAIN.match(token).group()
        again = {start} if start and head == token == start[-1] else set()
        starts = {start + head} if start + head in self.starts else set()
        if not starts or head == token:
            return starts | again
        for step in _lattice(token[len(head) :]):
            if not starts:
                break
            starts = {s + x for s in starts for x, _ in step if x != " " and s + x in self.starts}
        return starts | again

    def _step(self, start: str, token: str) -> frozenset[str]:
        out = self.steps.get((start, token))
        if out is None:
            out = frozenset(self._longer(start, token))
            if len(self.steps) >= CACHE_ENTRIES:
                self.steps.clear()
            if len(token) <= 64:
                self.steps[(start, token)] = out
        return out

    def _joined(self, tokens: list[str], begun: list[frozenset[str]]) -> Iterator[str]:
        """Features of words that are spread over several tokens, in one pass.

        Open are the beginnings of features that the tokens up to here spell,
        each with the last place from which they do: there is one per beginning.
        """
        opened: dict[str, int] = {}
        for i, (token, own) in enumerate(zip(tokens, begun)):
            if not opened and not own:
                continue
            now: dict[str, int] = {}
            for start, at in opened.items():
                for longer in self._step(start, token):
                    if now.get(longer, -1) < at:
                        now[longer] = at
            for word, at in now.items():
                if word in self.words and len(word) >= LEAST and opened.get(word) != at:
                    yield from self._if_likely(tokens, at, i + 1, word)
            now.update(dict.fromkeys(own, i))
            opened = now

    def _if_likely(self, tokens: list[str], at: int, end: int, word: str) -> Iterator[str]:
        """The features of ``word`` that its reading of ``tokens[at:end]`` is likely enough for."""
        lost = self._lost(tokens, at, end, word)
        for k in (f"={word}", word):
            if k in self.weights:
                odds = math.log(self.weights[k] / (1 - self.weights[k]))
                if lost <= odds - SURER:
                    yield k

    def _lost(self, tokens: list[str], at: int, end: int, word: str) -> float:
        """By how much ``tokens[at:end]`` as ``word`` is less likely than the best reading."""
        first, last = max(at - AROUND, 0), end + AROUND

        def cost(a: str, b: str, nothing: bool) -> float:
            single = sum(_sign(c) != " " for c in a) < 2 and sum(_sign(c) != " " for c in b) < 2
            return SPACED if single else JOINED if nothing else 0.0

        own = sum(cost(a, b, True) for a, b in zip(tokens[at:end], tokens[at + 1 : end]))
        own += _decoded(word, self.model)[0]
        for part, beside in ((tokens[first:at], at - 1), (tokens[end:last], end - 1)):
            if part:
                own += cost(tokens[beside], tokens[beside + 1], False)
                own += _decoded(" ".join(part), self.model)[0]
        return _decoded(" ".join(tokens[first:last]), self.model)[0] - own

    def score(self, text: str) -> float:
        tokens = text.lower().split()
        known = list(map(self.__getitem__, tokens))
        found = set().union(*[features for features, _ in known if features])
        begun = [own for _, own in known]
        if any(begun):
            found.update(self._joined(tokens, begun))
        doubt = 1 - self.base
        for k in sorted(found):
            doubt *= 1 - self.weights[k]
        return 1 - doubt


def _sample(df: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``text`` and ``toxic`` of at most ``size`` labelled documents per class."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", "toxic").where(F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [
        known.where(F.col("toxic") == c).dropDuplicates(["doc_id"]).orderBy(*order).limit(size)
        for c in (0, 1)
    ]
    ids = picked[0].unionByName(picked[1])
    own = df.select(df["doc_id"], F.coalesce(df["text"].cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most 2 * size ids


def train(df: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, dict, float]:
    """The character model, the feature weights and the score without features."""
    model = log_model(count_trigrams(df)).astype(np.float64)
    shared = share(df.sparkSession, model)  # 27^3 numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {
            (text, label)
            for batch in batches
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        }
        weights, base = fit(sorted(rows), shared.value)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*weights, None], pa.string()), pa.array([*weights.values(), base])],
            ["key", "weight"],
        )

    # a bounded sample; the scan it is taken from stays spread over tasks
    sample = _sample(df, labels, size).repartition(1)
    fitted = sample.mapInArrow(work, "key string, weight double").collect()  # chosen features
    weights = {r["key"]: r["weight"] for r in fitted if r["key"] is not None}
    return model, weights, next((r["weight"] for r in fitted if r["key"] is None), 0.0)


def score(df: DataFrame, trained: tuple[np.ndarray, dict, float]) -> DataFrame:
    """``row``, all columns of ``df`` as one struct, and ``toxicity``, the score of the restored text."""
    shared = share(df.sparkSession, (uuid.uuid4().hex, trained))
    given = df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"),
        F.coalesce(df["text"].cast("string"), F.lit("")).alias("text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts = shared.value
        scorer = kept(("toxicity", name), lambda: Scorer(*parts))
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], ["row", "toxicity"]
            )

    schema = given.select("row").schema.add("toxicity", "double")
    return given.mapInArrow(work, schema)


def toxicity(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    scored = score(df.select("doc_id", "text"), train(df, labels))
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
