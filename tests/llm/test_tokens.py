import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from fleetlens.llm import bitplanes, bpe, token_counts  # noqa: E402
from fleetlens.llm.tokenizer import default_path, load_tables, sufficient_lookahead  # noqa: E402
from fleetlens.session import scratch_folder  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def tables():
    return load_tables()


def wanted(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_round_trip_equals_the_library(docs, rows, library):
    got = sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in bpe.round_trip(docs).collect())
    want = []
    for i, text, *_ in rows:
        ids = wanted(library, text)
        want.append((i or -1, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert [(a, bytes(b), c) for a, b, c in got] == sorted(want)


def test_encode_then_decode(docs, empty):
    ids = bpe.encode(docs)
    both = {(r["doc_id"], r["decoded"]) for r in bpe.round_trip(docs).collect()}
    assert {(r["doc_id"], r["decoded"]) for r in bpe.decode(ids).collect()} == both
    assert bpe.round_trip(empty).count() == 0


def test_pieces_of_any_size_give_the_same_ids(tables, library):
    rnd = random.Random(3)
    signs = "abcdehlmrstv'''  \n\t019²ⅧéßΣİ!!?漢글̧́🙂\x1c\x85<|>"
    texts = ["".join(rnd.choice(signs) for _ in range(200)) for _ in range(60)]
    texts += ["the" * 3000, "!" * 5000 + "'s", "ab" * 400 + "'re" + "x" * 900, "<|endoftext|>a<|endo"]
    for text in texts:
        want = np.array(wanted(library, text), "<u4").tobytes()
        for size, limit in ((7, 20), (100, 50), (5000, 4096)):
            encoder = bpe.Encoder(tables)
            encoder.splitter.limit = limit
            out = b"".join(encoder.feed(text[i : i + size]) for i in range(0, len(text), size))
            assert out + encoder.feed("", True) == want


def test_lookahead_needs_a_proper_list():
    assert sufficient_lookahead([("a", "b")]) == 1
    assert sufficient_lookahead([("a", "b"), ("c", "ab")]) == 2 - 1 + 1
    with pytest.raises(ValueError):
        sufficient_lookahead([("ab", "c")])


def test_bytes_in_pieces_become_the_same_text():
    data = "aé漢🙂b".encode() + b"\xff\xe6\xbc"
    for size in (1, 2, 3, 50):
        state = bpe.ByteToText()
        out = "".join(state.feed(data[i : i + size]) for i in range(0, len(data), size))
        assert out + state.feed(b"", True) == data.decode("utf-8", "replace")


def test_counts(docs, rows, library, empty):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs).collect())
    want = []
    for i, text, *_ in rows:
        n = len(wanted(library, text))
        want.append((i or -1, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts.token_counts(empty).count() == 0


def test_proven_words_are_one_token(tables, library):
    proven = token_counts.prove_whole_tokens(tables)
    assert len(proven) > 30_000
    for word in random.Random(1).sample(sorted(proven), 300):
        assert tables.words(word) != [word] or len(wanted(library, word)) == 1


@pytest.mark.parametrize("plane_bits", [1, 8])
def test_planes_round_trip(plane_bits):
    rng = np.random.default_rng(0)
    for n in (1, 7, 1000):
        ids = rng.integers(0, 70_000, n).astype("<u4")
        payload, ends = bitplanes.pack(ids, plane_bits)
        assert (bitplanes.unpack(payload, ends, n, plane_bits) == ids).all()


def test_crc_of_pieces():
    a, b = b"some bytes", b"and more of them" * 99
    assert bitplanes.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert bitplanes.crc32_joined(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("block, plane_bits", [(1 << 16, 8), (100, 1)])
def test_files_hold_all_ids_in_order(spark, docs, rows, library, block, plane_bits):
    folder = scratch_folder(spark)
    bitplanes.write_ids(docs, folder, block=block, plane_bits=plane_bits)
    got = sorted(
        tuple(r) for r in bitplanes.document_index(spark, folder).na.fill(-1, ["doc_id"]).collect()
    )
    want, start = [], 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] or -1, r[1] or "")):
        ids = np.array([*wanted(library, text), 1], "<u4")
        want.append((i or -1, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_no_documents_no_blocks(spark, empty):
    folder = scratch_folder(spark)
    bitplanes.write_ids(empty, folder)
    assert bitplanes.document_index(spark, folder).count() == 0
