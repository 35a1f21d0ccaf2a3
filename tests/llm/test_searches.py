import numpy as np
import pytest

from fleetlens.llm import jaccard_join, topk_search
from fleetlens.llm.components import components

pytest.importorskip("xxhash")


def brute_top(rows, k=20, every=20):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, np.floor(64 * np.array(v, float)).astype(int)))
    out = []
    for q, a in good:
        if q % every == 0:
            found = sorted((-int(a @ b), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_with_ties_and_bad_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    same = [0.5, -0.25, 0.125, 0.0]
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, same) for i in range(300, 460)]
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0]), (540, [float("nan")] * 4), (None, same)]
    rows += [(560, [float("inf"), 0.0, 0.0, 0.0]), (580, [1e6, -1e6, 3.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("vec_id", "embedding", "1 AS score", "2 AS block")
    want = brute_top(rows)
    assert sorted(map(tuple, topk_search.search_embeddings(df).collect())) == want
    monkeypatch.setattr(topk_search, "BLOCK", 40)
    monkeypatch.setattr(topk_search, "QUERY_SET", 7)
    assert sorted(map(tuple, topk_search.search_embeddings(df).collect())) == want
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, topk_search.search_embeddings(few).collect())) == brute_top(rows[:5])
    assert topk_search.search_embeddings(df.where("false")).count() == 0


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-30, 30, (90, 6)), rng.integers(-30, 30, (5, 6))
    order = np.argsort(x, axis=0, kind="stable").T
    lists = topk_search.Lists(order, np.take_along_axis(x.T, order, axis=1), np.float64)
    for depth in (1, 10, 45, 89, 90):
        lists.read(depth)
        lower, upper = lists.bounds(q)
        assert (lower <= q @ x.T).all() and (upper >= q @ x.T).all()
    assert (lower == upper).all()


def brute_join(rows):
    sets = []
    for i, text in rows:
        w = jaccard_join.WORD.findall(text or "")
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w and i is not None else None)
    n, group = len(rows), [*range(len(rows))]
    links = [0] * n
    for a in range(n):
        for b in range(n):
            if a != b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = i if g not in least else min(least[g], i)
    return sorted((i if i is not None else -1, least[g] if i is not None else -1, k) for (i, _), g, k in zip(rows, group, links))


def near_copies(rng, n_groups=25):
    rows = []
    for g in range(n_groups):
        base = [f"t{int(x)}" for x in rng.integers(0, 5000, int(rng.integers(5, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = f"c{int(rng.integers(0, 99))}"
            rows.append((len(rows) + 100, " ".join(own)))
    return rows


def test_join_equals_brute_force(spark, docs, rows, empty, monkeypatch):
    own = near_copies(np.random.default_rng(4)) + [(i, t) for i, t, *_ in rows]
    df = spark.createDataFrame(own, "doc_id long, text string")
    want = brute_join(own)

    def found():
        return sorted(
            (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2])
            for r in jaccard_join.join(df).collect()
        )

    assert found() == want
    # small limits: deep trees, blocks of blocks
    for name, value in {"SMALL": 3, "BLOCK": 2, "EXACT_BLOCK": 2}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    assert found() == want
    assert jaccard_join.join(empty).count() == 0


def test_one_of_each_class_stays(docs):
    kept = sorted((r["doc_id"] or -1) for r in jaccard_join.one_of_each(docs).collect())
    assert kept == [-1, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14]


def test_an_id_on_different_texts_is_judged_for_each(spark):
    copy, unique = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = " ".join(f"c{i}" for i in range(60))
    rows = [(1, copy), (2, copy), (2, unique), (3, near), (3, near + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, jaccard_join.one_of_each(df).collect()))
    assert kept[:2] == [(1, copy), (2, unique)] and [i for i, _ in kept[2:]] == [3]


def test_recall_formula():
    assert 0 < jaccard_join.meeting_chance() < 1
    missed = (1 - jaccard_join.meeting_chance()) ** jaccard_join.runs_needed()
    assert missed <= 1 - jaccard_join.RECALL


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
