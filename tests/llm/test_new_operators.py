"""Quality classifier, tokenizer alignment and Merkle manifest against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import alignment, merkle_manifest, quality_classifier, queries
from fleetlens.llm.merkle_manifest import address, count, depth, size
from fleetlens.llm.tokenizer import byte_alphabet
from tests.llm.conftest import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def plain_proofs(rows):
    """doc_id, leaf, subroot, root, proof digest, folded root and verdict of every row."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row, text):
        i, _, lang, source = row
        n = None if row[1] is None else len(row[1])
        return sha("".join(map(field, (i, source, lang, n, text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            first = i - i % 3
            yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])
            i //= 3

    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [levels([leaf(r, r[1]) for r in by_source[s]]) for s in order]
    upper = levels([t[-1][0] for t in trees])
    root = upper[-1][0]
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(by_source[s]):
            sides = [*path(trees[k], i), *path(upper, k)]
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            now = leaf(row, row[1].replace("\n", "") if even and row[1] is not None else row[1])
            for left, right in sides:
                now = sha(left + now + right)
            proof = sha("".join(a + b for a, b in sides))
            out.append((row[0], trees[k][0][i], trees[k][-1][0], root, proof, now, now == root))
    return out


def proofs(spark, docs):
    own = merkle_manifest.manifest(docs, queries.without_line_feeds(docs))
    return [
        (r.doc_id, r.leaf, r.subroot, r.root, sha(r.proof), r.folded_root, r.verified)
        for r in merkle_manifest.prove(own).collect()
    ]


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses_fill_a_block_without_gaps(levels):
    least, most = 3 ** max(levels - 2, 0), 3 ** (levels - 1)
    for n in sorted({1, 2, least, least + 1, (least + most) // 2, max(most - 1, 1), most}):
        found = [address(n, levels, k, i) for k in range(levels) for i in range(count(n, k))]
        if count(n, levels - 1) == 1:
            assert sorted(found) == list(range(size(n, levels)))


def test_the_lower_half_of_a_block_lies_together():
    # 4 levels: the top two first, then each lower part of two levels in one piece
    assert [address(27, 4, 3, 0), *[address(27, 4, 2, i) for i in range(3)]] == [0, 1, 2, 3]
    for part in range(9):
        own = [address(27, 4, 1, part), *[address(27, 4, 0, 3 * part + i) for i in range(3)]]
        assert own == list(range(4 + 4 * part, 8 + 4 * part))


def test_manifest_equals_plain_trees(spark, docs, rows):
    assert Counter(proofs(spark, docs)) == Counter(plain_proofs(rows))


def test_manifest_over_several_rounds_of_blocks(spark, monkeypatch):
    rows = [(i * 7, f"text {i}\n{i % 5}", "en", "hot" if i % 3 else f"s{i % 13}") for i in range(1700)]
    rows += [(1, "a\nb", None, None), (1, "a\nb", None, None), (5, None, "de", "alone")]
    docs = table(spark, rows).repartition(7)
    own = merkle_manifest.manifest(docs)
    assert len(own.rounds) == 2 and depth(1133) == 8
    assert Counter(proofs(spark, docs)) == Counter(plain_proofs(rows))


def test_manifest_of_an_empty_table(spark, empty):
    assert proofs(spark, empty) == []


def test_null_altered_text_is_a_change(spark):
    docs = table(spark, [(1, "a", "en", "x"), (2, "b", "en", "x")])
    own = merkle_manifest.manifest(docs, F.when(docs["doc_id"] == 2, docs["text"]))
    assert {r.doc_id: r.verified for r in merkle_manifest.prove(own).collect()} == {1: False, 2: True}


# Alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def plain_alignment(libraries, rows):
    a, b = libraries
    value = {s: bytes([n]) for n, s in enumerate(byte_alphabet())}

    def a_bytes(i):
        return b"".join(value[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(parts):
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        return list(zip(ends, ends[1:]))

    found, counts = [], Counter()
    for i, text, *_ in rows:
        text = text or ""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs, ys = [a_bytes(t) for t in x], [b_bytes(t) for t in y]
        if not text or not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            found.append((i, [], [], [], []))
            continue
        sx, sy = spans(xs), spans(ys)
        groups, links, p, q = [], [], 0, 0
        for end in sorted({e for _, e in sx} & {e for _, e in sy}):
            p_to = next(k for k in range(p, len(sx)) if sx[k][1] == end) + 1
            q_to = next(k for k in range(q, len(sy)) if sy[k][1] == end) + 1
            groups.append(",".join(map(str, x[p:p_to])) + "|" + ",".join(map(str, y[q:q_to])))
            links += [
                (x[k], y[m])
                for k in range(p, p_to)
                for m in range(q, q_to)
                if sx[k][0] < sy[m][1] and sy[m][0] < sx[k][1]
            ]
            p, q = p_to, q_to
        counts.update(links)
        found.append((i, x, y, groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, len(x), len(y), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links),
         sum(counts[k] for k in links), sha(";".join(groups)) if x else "")
        for i, x, y, groups, links in found
    ]


ODD = [
    "a▁b and c", "two  blanks\n\nand lines\n \n x", " leading", "trailing \n", "\n", " ", "<0x41><s></s>",
    "tab\there\x1cthere \x1d x", "naïve café 漢字かな交じり 🙂🙂 é", "don't we'll '\n's", "<|endoftext|> it's",
    "no break   line 　 wide", "x\ny z\n w \r\n end", "\x00 null \x00", "a​b ﻿ c 1234567",
]


def test_alignment_equals_the_libraries(spark, docs, rows, libraries):
    odd = [(100 + i, t, "en", "a") for i, t in enumerate(ODD)]
    both = docs.unionByName(table(spark, odd))
    got = alignment.linked(both, block_bytes=4000).select(
        "doc_id", *alignment.NUMBERS, "n_best", "count_sum", "groups_sha256"
    )
    want = plain_alignment(libraries, [*rows, *odd])
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_block_size_does_not_matter(spark, docs):
    names = ["doc_id", *alignment.NUMBERS, "n_best", "count_sum", "groups_sha256"]
    one, many = (alignment.linked(docs, block_bytes=n).select(*names) for n in (1 << 30, 1))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, many.collect()))


def test_groups_are_given_as_text(spark):
    row = alignment.align(table(spark, [(1, "hello world", "en", "a")])).first()
    assert row.n_groups == row.groups.count(";") + 1 and sha(row.groups)
    assert [len(side.split(",")) > 0 for g in row.groups.split(";") for side in g.split("|")]


def test_alignment_of_empty_tables_and_texts(spark, empty):
    assert alignment.linked(empty).collect() == []
    none = table(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "▁", "en", "a")])
    rows = alignment.linked(none).collect()
    assert {(r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in rows} == {(0, 0, 0, "")}


def test_halves_round_trip():
    numbers = np.array([0, 1, 65535, 65536, 1 << 30])
    assert alignment.wholes(alignment.halves(numbers)).tolist() == numbers.tolist()
    assert len(alignment.wholes(b"")) == 0


# Quality classifier


def labelled(spark, n=240):
    """Bad documents carry signs or one word only; a good one may have either in passing."""
    rng = np.random.default_rng(3)
    words = ["house", "river", "and", "the", "window", "light", "under", "green", "stone", "walk"]
    rows, labels = [], []
    for i in range(n):
        own = [words[k] for k in rng.integers(0, len(words), rng.integers(30, 200))]
        good = i % 3 > 0
        if not good:
            own = [w + "#*&%"[k % 4] * 3 for k, w in enumerate(own)] if i % 2 else [own[0]] * len(own)
        rows.append((i, " ".join(own), "en", "a"))
        labels.append((i, int(good), 0))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_documents_it_was_not_fitted_on(spark):
    docs, labels = labelled(spark)
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    fold = [r for r in got if r.held_out]
    assert {r.doc_id for r in fold} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == r.quality for r in fold]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_probability_equals_loops_over_every_position():
    net = quality_classifier.Network(np.random.default_rng(1))
    w = {k: v.astype(float) for k, v in net.weights.items()}
    block, width = quality_classifier.BLOCK, quality_classifier.WIDTH
    for text in ("", "a", "é" * 300, "some words " * 90):
        data = list(text.encode())
        blocks = max(2, -(-len(data) // block))
        data += [quality_classifier.PAD] * (blocks * block + width - len(data))
        hidden = []
        for chunk in range(blocks - 1):
            pooled = np.full(quality_classifier.FILTERS, -np.inf)
            for at in range(block * chunk, block * (chunk + 2)):
                own = np.concatenate([w["vectors"][b] for b in data[at : at + width]])
                pooled = np.maximum(pooled, own @ w["filters"])
            hidden.append(np.maximum(pooled @ w["hidden"] + w["hidden_0"], 0))
        whole = np.concatenate([np.max(hidden, 0), np.mean(hidden, 0)])
        want = 1 / (1 + np.exp(-(whole @ w["out"] + w["out_0"][0])))
        assert net.probability(text) == pytest.approx(want, abs=1e-5)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(5)
    net = quality_classifier.Network(rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    chunks = rng.integers(0, 256, (5, 2 * quality_classifier.BLOCK + quality_classifier.WIDTH - 1))
    owner, truth, weight = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        w, total = net.weights, 0.0
        for k in range(3):
            pooled = np.stack([net.answers(c).max(0) for c in chunks[owner == k]])
            hidden = np.maximum(pooled @ w["hidden"] + w["hidden_0"], 0)
            p = quality_classifier.sigmoid(
                np.concatenate([hidden.max(0), hidden.mean(0)]) @ w["out"] + w["out_0"]
            )[0]
            total -= weight[k] * np.log(p if truth[k] else 1 - p)
        return total / weight.sum()

    found = net.gradients(chunks, owner, truth, weight)
    for name, at in (("vectors", (65, 2)), ("filters", (7, 3)), ("hidden", (4, 5)),
                     ("hidden_0", (1,)), ("out", (20,)), ("out_0", (0,))):
        kept = net.weights[name][at]
        net.weights[name][at] = kept + 1e-6
        up = loss()
        net.weights[name][at] = kept - 1e-6
        down = loss()
        net.weights[name][at] = kept
        assert found[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_long_texts_are_scored_piece_by_piece(monkeypatch):
    net = quality_classifier.Network(np.random.default_rng(2))
    text = "".join(chr(97 + i * i % 23) for i in range(9000))
    whole = net.probability(text)
    monkeypatch.setattr(quality_classifier, "PIECE", 2 * quality_classifier.BLOCK)
    assert net.probability(text) == pytest.approx(whole, abs=2e-6)


def test_chunks_for_the_fit_reach_both_ends():
    assert quality_classifier.chunk_starts(100, 8) == [0]
    starts = quality_classifier.chunk_starts(100_000, 8)
    assert starts[0] == 0 and len(starts) == 8 and starts[-1] + 2 * quality_classifier.BLOCK >= 100_000


def test_classifier_without_labels_and_on_odd_texts(spark, docs, rows, empty):
    kind = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], kind)
    assert {r.score for r in quality_classifier.classify(docs, none).collect()} == {0.0}
    train_docs, labels = labelled(spark, 60)
    odd = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (2, 7, 0), (2, None, 0)], kind)
    net = quality_classifier.train(train_docs, labels.unionByName(odd))
    got = quality_classifier.score(docs, net).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert len({r.score for r in got if r.doc_id == 8}) == 1
    assert quality_classifier.classify(empty, labels).collect() == []


def test_aligned_pieces_by_each_way_agree_with_brute_force():
    """One token against several, equal ends, and groups of several on both sides."""
    aligner = alignment.Aligner(alignment.Files())
    aligner.a_bytes = {1: b"abc", 2: b"a", 3: b"bc", 4: b"d", 5: b"ab", 6: b"c"}
    aligner.b_bytes = [b"", b"a", b"bc", b"abc", b"d", b"ab", b"c", b"cd"]
    cases = [([1], [1, 2]), ([2, 3], [3]), ([2, 3, 4], [1, 2, 4]), ([5, 6, 4], [1, 2, 4]),
             ([1, 4], [1, 2, 4]), ([2, 3, 4], [3, 4]), ([5, 6, 4, 1], [1, 2, 4, 5, 6])]
    for a, b in cases:
        data = b"".join(aligner.a_bytes[i] for i in a)

        def spans(parts):
            ends = [sum(map(len, parts[: n + 1])) for n in range(len(parts))]
            return [(e - len(p), e) for e, p in zip(ends, parts)]

        of_a, of_b = spans([aligner.a_bytes[i] for i in a]), spans([aligner.b_bytes[i] for i in b])
        pairs = [x * aligner.width + y for x, (s, e) in zip(a, of_a) for y, (t, u) in zip(b, of_b) if s < u and t < e]
        cuts = sorted({e for _, e in of_a} & {e for _, e in of_b})
        groups, at = [], 0
        for cut in cuts:
            own = [",".join(str(x) for x, (s, e) in zip(ids, where) if at <= s and e <= cut)
                   for ids, where in ((a, of_a), (b, of_b))]
            groups.append("|".join(own))
            at = cut
        found = aligner.aligned(a, b, data)
        assert found[0].decode() == ";".join(groups)
        assert sorted(np.frombuffer(found[1], "<u4").tolist()) == sorted(pairs)
        assert found[2] == len(a) | len(b) << 40
