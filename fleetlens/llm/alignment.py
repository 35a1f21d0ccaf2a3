"""Alignment of two tokenizers: which tokens of one cover the bytes of the other's.

A text is encoded by a byte-level BPE file (A) and a piece file with byte
fallback (B). The cumulative ends of both token lists are the keys of two
dictionaries from end to index; the keys they share, sorted, slice both lists
into groups, and the links of a group are the pairs whose bytes overlap.

The text is cut at single spaces and line feeds between other signs. Both
tokenizers have a border there whatever stands around it (A's pre-tokens begin
at the space, no piece of B has a space inside or a line feed), so a cut is a
shared end and pieces are aligned once each: a worker keeps those it has met.

An id pair's count needs all documents. Documents are worked on in blocks of a
bounded number of bytes; a block holds each of its pairs once, so what is
shuffled to count and to bring the counts back grows with pairs per block, not
with links. Counts meet the documents again by block.

Null and empty texts have no tokens, nor have texts that one of the files can't
give back byte by byte: zeros and no groups. Very long texts are cut like
others; a piece without a cut is encoded whole. Rows are independent, so
repeated rows (also of one ``doc_id``) have repeated results, and all of their
links count. An empty table gives an empty result. Only the key and the text
column are read; other columns, of any name, don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tokenizer import byte_alphabet
from fleetlens.llm.workers import kept, share
from fleetlens.session import stored

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Pieces up to this many characters are kept by a worker, and how many of them.
CACHED_CHARS, CACHE_ENTRIES = 48, 1 << 19
# Bytes of text after which a block of documents is closed.
BLOCK_BYTES = 8 << 20
# Documents whose new pieces are given to the libraries at once.
AT_ONCE = 64
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
SPACE = "▁"  # stands for a space in pieces (a fixed value of the format)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def groups_of(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """Slices (from, to in A; from, to in B) between the ends that both lists have."""
    a_at = dict(zip(a_ends, range(1, len(a_ends) + 1)))
    b_at = dict(zip(b_ends, range(1, len(b_ends) + 1)))
    out, a, b = [], 0, 0
    for end, a_to in a_at.items():  # ends ascend, so the shared ones are in order
        b_to = b_at.get(end)
        if b_to is not None:
            out.append((a, a_to, b, b_to))
            a, b = a_to, b_to
    return out


def links_of(
    a_ends: list[int], b_ends: list[int], group: tuple[int, int, int, int]
) -> Iterator[tuple[int, int]]:
    """Index pairs of a group whose byte ranges overlap: at most as many as it has tokens."""
    i, a_to, j, b_to = group
    while i < a_to and j < b_to:
        yield i, j
        a_end, b_end = a_ends[i], b_ends[j]
        i += a_end <= b_end
        j += b_end <= a_end


class Aligned(NamedTuple):
    """A piece or text: its groups as text, its links as packed pairs, its numbers of tokens."""

    groups: bytes
    pairs: bytes
    tokens: int  # those of A, and those of B above bit 40


class Files:
    """Both tokenizer files, read on the driver; as large as two vocabularies."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        own = default_paths()
        with open(a_path or own[0], "rb") as file:
            self.a = file.read()
        with open(b_path or own[1], "rb") as file:
            self.b = file.read()
        spec = json.loads(self.a)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("A has to be a byte-level file without normalizer")
        self.name = hashlib.sha256(self.a + self.b).hexdigest()


class Aligner(dict):
    """Aligned pieces of texts; of the short ones as many as fit are kept.

    A missing entry of a piece is ``None`` if its bytes aren't given back.
    """

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        value = {s: bytes([b]) for b, s in enumerate(byte_alphabet())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: b"".join([value[s] for s in t]) for t, i in vocab.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.width = len(pieces)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece of B reaches over a space or has a line feed")

    def aligned(self, a: list[int], b: list[int], data: bytes) -> tuple | None:
        """The parts of :class:`Aligned` for the ids of both files; ``None`` if not given back."""
        a_parts = list(map(self.a_bytes.__getitem__, a))
        b_parts = list(map(self.b_bytes.__getitem__, b))
        if b"".join(a_parts) != data or b"".join(b_parts) != data:
            return None
        width = self.width
        if len(a) == 1 or len(b) == 1:  # one group, and every token of one covers the other's
            groups = f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()
            pairs = array("I", [i * width + j for i in a for j in b]).tobytes()
            return groups, pairs, len(a) | len(b) << 40
        a_ends, b_ends = list(accumulate(map(len, a_parts))), list(accumulate(map(len, b_parts)))
        if a_ends == b_ends and a_ends[0]:  # the tokens are the same, each pair is a group
            texts = [f"{i}|{j}" for i, j in zip(a, b)]
            pairs = array("I", [i * width + j for i, j in zip(a, b)])
            return ";".join(texts).encode(), pairs.tobytes(), len(a) | len(b) << 40
        texts, pairs = [], []
        for group in groups_of(a_ends, b_ends):
            i, a_to, j, b_to = group
            if a_to == i + 1 and b_to == j + 1:
                texts.append(f"{a[i]}|{b[j]}")
                pairs.append(a[i] * width + b[j])
                continue
            own, other = a[i:a_to], b[j:b_to]
            texts.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
            if len(own) == 1 or len(other) == 1:
                pairs += [x * width + y for x in own for y in other]
            else:
                pairs += [a[x] * width + b[y] for x, y in links_of(a_ends, b_ends, group)]
        # a plain tuple: there are many, and the garbage collector needn't follow it
        return ";".join(texts).encode(), array("I", pairs).tobytes(), len(a) | len(b) << 40

    def _encoded(self, pieces: list[str]) -> list[tuple | None]:
        """Align pieces that begin with a space or a line feed."""
        a = self.a.encode_batch_fast(pieces, add_special_tokens=False)
        # B puts a space before what it gets; before a line feed it is a token of its own
        b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [
            self.aligned(x.ids, y if p[0] == " " else y[1:], p.encode())
            for p, x, y in zip(pieces, a, b)
        ]

    def pieces(self, text: str) -> list[str]:
        return CUT.split(" " + text)

    def texts(self, texts: list[str]) -> list[Aligned | None]:
        """Align texts as a whole; ``None`` for those without tokens."""
        cut = [self.pieces(t) if t else [] for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self})
        if len(self) + len(new) > CACHE_ENTRIES:
            self.clear()
            new = list({p for pieces in cut for p in pieces})
        long: dict[str, tuple | None] = {}
        for piece, found in zip(new, self._encoded(new) if new else []):
            (self if len(piece) <= CACHED_CHARS else long)[piece] = found
        return [self._joined(t, p, long) for t, p in zip(texts, cut)]

    def _joined(self, text: str, pieces: list[str], long: dict) -> Aligned | None:
        if not pieces:
            return None
        try:
            found = list(map(self.__getitem__, pieces))
        except KeyError:
            found = [self[p] if p in self else long[p] for p in pieces]
        try:
            groups, pairs, tokens = zip(*found)
        except TypeError:  # a piece that isn't given back: judge the text as a whole
            a = self.a.encode(" " + text, add_special_tokens=False).ids
            whole = self.aligned(a, self.b.encode(text), (" " + text).encode())
            return Aligned(*whole) if whole else None
        return Aligned(b";".join(groups), b"".join(pairs), sum(tokens))


def _aligner(shared) -> Aligner:
    files = shared.value
    return kept(("alignment", files.name), lambda: Aligner(files))


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[key].alias("doc_id"), F.coalesce(df[text].cast("string"), F.lit("")))


def align(
    df: DataFrame,
    a_path: str | None = None,
    b_path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each group in order.
    """
    shared = share(df.sparkSession, Files(a_path, b_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                found = aligner.texts(part.column(1).to_pylist())
                groups = [f.groups.decode() if f else "" for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *_numbers(found), pa.array(groups, pa.string())],
                    ["doc_id", *NUMBERS, "groups"],
                )

    rows = _documents(df, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{n} bigint" for n in NUMBERS)
    return rows.mapInArrow(work, f"doc_id {kind}, {numbers}, groups string")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _numbers(found: list[Aligned | None]) -> list[pa.Array]:
    low = (1 << 40) - 1
    rows = [
        (f.tokens & low, f.tokens >> 40, f.groups.count(b";") + 1, len(f.pairs) // 4)
        if f
        else (0, 0, 0, 0)
        for f in found
    ]
    return [pa.array(column, pa.int64()) for column in zip(*rows)]


def _blocks(df: DataFrame, shared, block_bytes: int) -> DataFrame:
    """Documents in blocks, each followed by one row with the pairs of its block.

    A document's row has ``links``: for each of its links the place of its pair
    in the block's list, sorted, as 16-bit numbers with the upper halves behind
    the lower ones. The row of a block has ``pairs``, the list, and ``times``,
    how many links of the block each has.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _aligner(shared), TaskContext.get().partitionId()
        number, held, weight = 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, weight
            name, ids = f"{task}-{number}", pa.concat_arrays([h[0] for h in held])
            found = [f for h in held for f in h[1]]
            own = [np.frombuffer(f.pairs if f else b"", dtype="<u4") for f in found]
            pairs, at, times = np.unique(
                np.concatenate(own), return_inverse=True, return_counts=True
            )
            often = np.argsort(-times, kind="stable")  # small numbers for the usual pairs
            rank = np.empty_like(often)
            rank[often] = np.arange(len(often))
            places = np.split(rank[at], np.cumsum([len(o) for o in own])[:-1])
            links = [halves(np.sort(p)) for p in places]
            shas = [hashlib.sha256(f.groups).hexdigest() if f else "" for f in found]
            n = len(found)
            number, held, weight = number + 1, [], 0
            out = [
                pa.array([name] * (n + 1), pa.string()),
                pa.array([False] * n + [True]),
                pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                *[pa.concat_arrays([x, pa.array([0], pa.int64())]) for x in _numbers(found)],
                pa.array([*shas, None], pa.string()),
                pa.array([*links, None], pa.binary()),
                pa.array([None] * n + [pairs[often].tolist()], pa.list_(pa.int64())),
                pa.array([None] * n + [times[often].tolist()], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                texts = part.column(1).to_pylist()
                held.append((part.column(0), aligner.texts(texts)))
                weight += sum(map(len, texts))
                if weight >= block_bytes:
                    yield close()
        if held:
            yield close()

    kind = df.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{n} bigint" for n in NUMBERS)
    names = ["block", "is_block", "doc_id", *NUMBERS, "groups_sha256", "links", "pairs", "times"]
    return df.mapInArrow(
        work,
        f"block string, is_block boolean, doc_id {kind}, {numbers}, groups_sha256 string, "
        "links binary, pairs array<bigint>, times array<bigint>",
    )


def halves(numbers: np.ndarray) -> bytes:
    """32-bit numbers as all their lower halves, then all their upper ones."""
    own = np.ascontiguousarray(numbers, dtype="<u4").view("<u2").reshape(-1, 2)
    return own.T.tobytes()


def wholes(data: bytes) -> np.ndarray:
    """The numbers of :func:`halves`."""
    own = np.frombuffer(data, dtype="<u2").reshape(2, -1).astype(np.int64)
    return own[0] | own[1] << 16


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """``pair``, ``count`` over all documents, and ``best``: whether no A id has more with its B id."""
    links = blocks.where("is_block").select(
        F.explode(F.arrays_zip("pairs", "times")).alias("link")
    )
    counts = stored(
        links.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("count"))
    )
    b = F.pmod("pair", F.lit(width))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    # one row per id of B's vocabulary
    return counts.join(F.broadcast(highest), b == highest["b"]).select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def linked(
    df: DataFrame,
    a_path: str | None = None,
    b_path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document the numbers of :func:`align`, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    files = Files(a_path, b_path)
    shared = share(df.sparkSession, files)
    width = Aligner(files).width
    blocks = stored(_blocks(_documents(df, key, text), shared, block_bytes))
    asked = blocks.where("is_block").select(
        F.col("block").alias("asking"), F.posexplode("pairs").alias("at", "pair")
    )
    counts = asked.join(pair_counts(blocks, width), "pair").select("asking", "at", "count", "best")

    def judge(documents: pa.Table, counts: pa.Table) -> pa.Table:
        n = counts.num_rows
        value, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = counts.column("at").to_numpy()
        value[at] = counts.column("count").to_numpy()
        best[at] = counts.column("best").to_numpy(zero_copy_only=False)
        places = [wholes(x) for x in documents.column("links").to_pylist()]
        sums = [(int(best[p].sum()), int(value[p].sum())) for p in places]
        out = documents.drop_columns(["block", "links"])
        for k, name in enumerate(("n_best", "count_sum")):
            out = out.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
        return out

    rows = blocks.where("not is_block").select(
        "block", "links", "doc_id", *NUMBERS, "groups_sha256"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{n} bigint" for n in NUMBERS)
    return (
        rows.groupBy("block")
        .cogroup(counts.groupBy("asking"))
        .applyInArrow(
            judge,
            f"doc_id {kind}, {numbers}, groups_sha256 string, n_best bigint, count_sum bigint",
        )
    )
