import itertools
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import language_id, toxicity

CLEAN = "the quick brown fox jumps over a lazy dog while seven calm birds sing in old green trees".split()


def toxic_corpus(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        words = [str(w) for w in rng.choice(CLEAN, 60)]
        bad = i % 4 == 0
        if bad:
            for word in ("dreadfool", "nastyhead"):
                words[int(rng.integers(0, 60))] = word
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def tables(spark, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_disguised_words_are_found(spark):
    rows, labels = toxic_corpus(np.random.default_rng(2))
    hidden = ["the dr3adf00l sings", "n-a-s-t-y-h-e-a-d", "d r e a d f o o l", "nnnastyheeeead!!"]
    rows += [(1000 + i, text) for i, text in enumerate(hidden)]
    rows += [(2000, None), (2001, ""), (2002, "the quick fox"), (2002, "the quick fox"), (None, "dog")]
    df, marks = tables(spark, rows, labels)
    out = toxicity.toxicity(df, marks).collect()
    said = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(said[1000 + i]["predicted"] == 1 for i in range(len(hidden)))
    assert not any(said[i]["predicted"] for i in (2000, 2001, 2002, None))
    for i, label in labels:
        assert said[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert said[i]["predicted"] == label


def test_no_labels_and_no_documents(spark):
    df, none = tables(spark, [(1, "text"), (2, None)], [(7, 1)])
    none = none.where("doc_id < 0")
    assert [r["score"] for r in toxicity.toxicity(df, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(df.where("false"), none).count() == 0


def test_viterbi_is_the_best_path():
    counts = np.zeros(27**3, np.int64)
    for word in ("idiot", "trash", "stupid"):
        n = toxicity.sign_numbers(f"  {word} ")[1:]
        codes = (n[:-2] * 27 + n[1:-1]) * 27 + n[2:]
        np.add.at(counts, codes, 50)
    model = toxicity.log_model(counts)
    for token in ("1d1ot", "tr4sh", "stuupid", "5tup!d"):
        best = None
        for path in itertools.product(*toxicity._lattice(token)):
            text, score = "".join(t for t, _ in path), sum(c for _, c in path)
            n = [0, 0, *[toxicity.LETTERS.find(c) + 1 for c in text], 0]
            score += sum(model[n[i], n[i + 1], n[i + 2]] for i in range(len(n) - 2))
            best = max(best or (score, text), (score, text))
        assert toxicity.viterbi(token, model) == best[1]


LANGS = {"aa": ["kala", "mana", "tola", "naka"], "bb": ["strig", "plorf", "gnist", "brusk"]}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(3, 3))
    texts = [rng.random((n, 3)) + 0.01 for n in (1, 2, 6, 64, 65, 130)]
    for e, got in zip(texts, language_id.posteriors(texts, moves)):
        step, alpha = np.exp(moves), [e[0]]
        for row in e[1:]:
            alpha.append((alpha[-1] / alpha[-1].sum() @ step) * row)
        beta = [np.ones(3)]
        for row in e[:0:-1]:
            beta.append(step @ (beta[-1] / beta[-1].sum() * row))
        both = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got, both / both.sum(1, keepdims=True))


def test_languages_of_texts_and_words(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(80):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, " ".join(str(w) for w in rng.choice(LANGS[lang], 40)), lang))
    rows += [(900, None, "aa"), (901, "12 % 4", "aa"), (902, "kala mana kala strig", None)]
    rows += [(903, "kala " * 9000, None), (902, "kala mana kala strig", None), (None, "gnist", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(said[i]["lang_pred"] == ["aa", "bb"][i % 2] for i in range(80))
    assert said[900]["lang_pred"] == said[901]["lang_pred"] == "und" and said[900]["score"] == 0
    assert said[902]["lang_pred"] == said[903]["lang_pred"] == "aa" and said[None]["lang_pred"] == "bb"
    assert said[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)
    model = language_id.train(df)
    tags = language_id.Tagger(model).tag([["kala", "mana", "strig", "plorf", "gnist"]])[0]
    assert [model.langs[k] for k in tags.argmax(1)] == ["aa", "aa", "bb", "bb", "bb"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(df).collect()] == ["und"]
    assert language_id.identify(df.where("false")).count() == 0


INSULTS = ("idiot", "stupid", "moron", "loser")


def insulting_corpus(rng):
    """Documents of clean words, of which every fourth also has insults; more words than letters."""
    other = "you are a an it is in the of to and on was that day door moon good little off".split()
    rows, labels = [], []
    for i in range(400):
        words = [str(w) for w in rng.choice([*CLEAN, *other], 60)]
        if i % 4 == 0:
            for word in INSULTS:
                words[int(rng.integers(0, 60))] = word
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def predicted(spark, texts):
    rows, labels = insulting_corpus(np.random.default_rng(3))
    df, marks = tables(spark, rows + [(1000 + i, t) for i, t in enumerate(texts)], labels)
    said = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(df, marks).collect()}
    assert all(said[i] == label for i, label in labels)
    return [t for i, t in enumerate(texts) if said[1000 + i]]


def test_doubled_letters_and_words_beside_separators_are_found(spark):
    hidden = ["the stuupid fox", "an iddiot", "mooron", "a losser", "idiot,moron", "idiot/loser", "idiot...you"]
    hidden += ["<b>idiot</b>", "you(idiot)", "day;1d10t", "i-d-i-o-t/fox", "fox*idiot*fox", "i--d--i--o--t"]
    clean = ["good,door", "a little/moon", "off...you", "<b>good</b>", "i-n/t-h-e", "the good little door"]
    assert predicted(spark, [*hidden, *clean]) == hidden


def test_spaced_words_beside_others_are_found(spark):
    hidden = ["you are a i d i o t", "y o u i d i o t", "i d i o t m o r o n", "i. d. i. o. t.", "i - d - i - o - t"]
    hidden += ["the id iot day", "a los er", "you stu pi d fox", "l 0 s 3 r", "a mor0 n", "y o u a r e a n i d i o t"]
    clean = ["g o o d d o o r", "in the little day", "a b c d e f", "y o u a r e t h e f o x", "to off you is a day"]
    assert predicted(spark, [*hidden, *clean]) == hidden


def slow_score(scorer, text):
    """The score with every token decoded and a fresh look ahead from each of them."""
    tokens = text.lower().split()
    found = {
        k for t in tokens for w in toxicity.restored(t, scorer.model) for k in toxicity.keys(w)
        if k in scorer.weights
    }
    for at in range(len(tokens)):
        starts = scorer._longer("", tokens[at]) - {""}
        for end in range(at + 1, len(tokens)):
            before, starts = starts, {x for s in starts for x in scorer._longer(s, tokens[end])}
            for word in sorted(starts - before):
                if word in scorer.words and len(word) >= toxicity.LEAST:
                    found.update(scorer._if_likely(tokens, at, end + 1, word))
    doubt = 1 - scorer.base
    for k in sorted(found):
        doubt *= 1 - scorer.weights[k]
    return 1 - doubt


@pytest.fixture(scope="module")
def insults():
    rng = np.random.default_rng(3)
    rows, labels = insulting_corpus(rng)
    text = "  ".join(t for _, t in rows)
    n = toxicity.sign_numbers(f" {text} ")
    codes = (n[:-2] * toxicity.SIGNS + n[1:-1]) * toxicity.SIGNS + n[2:]
    model = toxicity.log_model(np.bincount(codes, minlength=toxicity.SIGNS**3))
    weights, base = toxicity.fit(sorted((t, k) for (_, t), (_, k) in zip(rows, labels)), model)
    return toxicity.Scorer(model, weights, base), rows


def test_one_pass_equals_decoding_everything(insults):
    scorer, rows = insults
    rng = np.random.default_rng(8)
    parts = [*CLEAN, *INSULTS, "1d10t", "xx-1diot", "i", "d", "o", "t", "-", "m*ron", "stu", "pid", "l", "0",
             "s", "e", "r", "a", "aa", "lo", "ser.", "id", "iot", "id,iot", "(idiot", "7", "...", "ooo"]
    texts = [t for _, t in rows[:20]] + ["", "xx-1diot", "i d i d i o t", "s t u p i d i o t"]
    texts += [" ".join(str(w) for w in rng.choice(parts, 25)) for _ in range(150)]
    assert insults[0].weights and all(
        scorer.score(t) == pytest.approx(slow_score(scorer, t), abs=1e-12) for t in texts
    )


@pytest.mark.parametrize("piece", ["a ", "i - ", "i d i ", "a1 ", "idiot ", "i", "x" * 30 + " "])
def test_time_grows_with_the_length_of_a_text(insults, piece):
    scorer, _ = insults
    began = time.perf_counter()
    scorer.score(piece * 20_000)
    assert time.perf_counter() - began < 5


def test_other_columns_of_any_name_are_carried_along(spark):
    rows, labels = insulting_corpus(np.random.default_rng(3))
    docs, marks = tables(spark, rows, labels)
    names = ["toxicity", "_toxicity_text", "row", "_text", "a.b"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names], F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    scored = toxicity.score(wide, toxicity.train(wide, marks))
    assert scored.select("row.*").columns == wide.columns
    row = scored.where("row.doc_id = 0").first()
    assert [row["row"][n] for n in names] == names and row["row"]["map"] == {"k": 1}
    assert row["toxicity"] >= 0.5
