"""Operator 4 against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return sorted(((k, len(sets[i]), least[find(i)] if least[find(i)] is not None else k) for i, (k, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()), key=repr)


def family(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def test_corpus(spark, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("block,shingles", [(4, 1 << 22), (2048, 900), (2048, 1 << 22)])
def test_borderline_families(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    rng = random.Random(6)
    texts = []
    for size in (6, 12, 40, 130, 500, 1200):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        texts += family(rng, 9, base, max(1, size // 40)) + [" ".join(base[: int(size * 0.8)]), " ".join(base[: int(size * 0.83) + 1])]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_trees_lose_no_link():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for i in range(120):
        s = pool[(i // 6) * 20 : (i // 6) * 20 + 20].copy()
        s[rng.random(20) < 0.12] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    links = jaccard.dual_join(sets, None)
    parent = list(range(120))
    for a, b in links:
        assert jaccard.linked(sets[a], sets[b])
        x, y = jaccard.find(np.array(parent), a), jaccard.find(np.array(parent), b)
        parent[max(x, y)] = min(x, y)
    top = lambda x: x if parent[x] == x else top(parent[x])
    assert all(top(i) == top(j) for i, j in itertools.combinations(range(120), 2) if jaccard.linked(sets[i], sets[j]))


def test_words_that_agree_under_any_polynomial_are_told_apart(spark):
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(i, "".join("ab"[x ^ i] for x in thue[:n])) for n in (1024, 2048) for i in (0, 1)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("most", [1, 3])
def test_frequent_shingles_are_dealt_without_loss(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "FREQUENT", most * 40)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = family(rng, 60, base, 3) + [" ".join(f"x{i}y{j}" for j in range(30)) + " " + " ".join(base[:30]) for i in range(40)] + family(rng, 9, [f"v{i}" for i in range(20)], 1)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_frequent_hashes_stay():
    rng = np.random.default_rng(3)
    often = jaccard.Frequent(16)
    for _ in range(50):
        x = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        x[:60], x[60:100] = 7, 8
        often.add(x)
    often.settle()
    assert {7, 8} <= set(often.keys.tolist()) and len(often.keys) <= 16


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard.components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert jaccard.components(e.where("false")).count() == 0


def test_representatives(spark, docs, corpus, empty):
    kept = jaccard.representatives(docs.withColumn("k", F.lit(1)))
    assert kept.columns[-1] == "k"
    rows = kept.collect()
    sets = [shingles(r["text"]) for r in rows]
    assert sum(not s for s in sets) == sum(not shingles(r[1]) for r in corpus)
    for a, b in itertools.combinations([s for s in sets if s], 2):
        assert 100 * len(a & b) < 80 * len(a | b)
    assert len([s for s in sets if s]) == len({c for k, n, c in brute([(i, r[1]) for i, r in enumerate(corpus)]) if n})
    assert jaccard.representatives(empty).count() == 0 and jaccard.near_duplicates(empty).count() == 0


def test_filter_passes_all_that_is_wanted(spark):
    rows = spark.range(3000).selectExpr("id as k", "id * 7 as th")
    wanted = spark.range(0, 3000, 9).selectExpr("id * 7 as mh")
    got = {r["k"] for r in jaccard.possibly_in(rows, "th", wanted, "mh").collect()}
    assert {*range(0, 3000, 9)} <= got and len(got) < 350
    assert jaccard.possibly_in(rows, "th", wanted.where("false"), "mh").count() == 0
