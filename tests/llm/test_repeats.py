"""Operator 3 against a count of all strings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import repeats


def brute(texts, n=repeats.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((len(b), int(gone.sum()), bytes(np.frombuffer(b, dtype=np.uint8)[~gone])))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_corpus(spark, corpus):
    check(spark, [r[1] for r in corpus if r[1] is None or len(r[1]) < 20000])


def test_edges_of_passages(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    core = word(700)
    texts = [word(rng.randint(0, 300)) + core[a : a + n] + word(rng.randint(0, 300)) for a, n in ((0, 700), (100, 400), (101, 400), (250, 200), (251, 199), (0, 199), (300, 201))]
    check(spark, [*texts, "x" * 900, "xy" * 300, word(150) * 3, core + core])


@pytest.mark.parametrize("widths", [(16, 1), (1,)])
def test_very_long_rows_and_grams_of_many_kinds(spark, monkeypatch, widths):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(40_000))
    texts = [text, text[10_000:30_000] + "z" + text[:5_000], *(("q%d" % i) * 5 + text[7_000:7_260] + "r%d" % i for i in range(30))]
    monkeypatch.setattr(repeats, "SLICE_BYTES", 4096)
    monkeypatch.setattr(repeats, "HOT", 5)
    monkeypatch.setattr(repeats, "WIDTHS", widths)
    check(spark, texts)


def test_parts_of_contexts_hold_every_string_once():
    rng = random.Random(4)
    n = repeats.LENGTH
    for width in (1, 16):
        for d, starts in ((0, 1), (40, 12), (136, 137), (100, 101), (17, 18)):
            c = bytes(rng.choice(b"ab") for _ in range(starts + n - 1))
            seen = []
            for a, k, core in repeats.narrower(c, d, width):
                assert len({(d - j) // width for j in range(a, a + k)}) == 1 and len(core) == n - width + 1
                for j in range(a, a + k):
                    seen.append(j)
                    at = j - (d - (d - j) // width * width)
                    assert c[j : j + n][-at : -at + len(core)] == core
            assert sorted(seen) == list(range(starts))


@pytest.mark.parametrize("shard", [1, 3, 1000])
def test_merge_does_not_depend_on_shards(monkeypatch, shard):
    rng = random.Random(7)
    gram = bytes(rng.choice(b"ab") for _ in range(repeats.GRAM))
    ctx, d, g = [], [], []
    for _ in range(60):
        left, right = rng.randint(0, repeats.SPREAD), rng.randint(0, repeats.SPREAD)
        if left + right < repeats.SPREAD:
            right = repeats.SPREAD - left
        c = b"L" * (left - left // 2) + bytes(rng.choice(b"ab") for _ in range(left // 2 % 3)) + b"M" * (left // 2 - left // 2 % 3) + gram + b"R" * rng.randint(0, right)
        c += bytes(rng.choice(b"xy") for _ in range(max(0, left + repeats.GRAM + right - len(c))))
        ctx.append(c), d.append(left), g.append(5)
    once = {c: (x, y) for c, x, y in zip(ctx, d, g)}
    ctx = list(once)
    monkeypatch.setattr(repeats, "SHARD", shard)
    got = repeats.repeated_starts(np.array([once[c][1] for c in ctx]), np.array([once[c][0] for c in ctx]), ctx)
    seen = Counter()
    n = repeats.LENGTH
    for c in ctx:
        seen.update((once[c][0] - i, c[i : i + n]) for i in range(len(c) - n + 1) if 0 <= once[c][0] - i <= repeats.SPREAD)
    for c, s in zip(ctx, got):
        want = [i for i in range(len(c) - n + 1) if seen[(once[c][0] - i, c[i : i + n])] > 1]
        assert [x for x in s.tolist() if 0 <= once[c][0] - x <= repeats.SPREAD] == want


def test_wholly_equal_rows_are_copies(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, texts = word(260), [word(300), word(400)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1] + passage), (3, word(50)), (3, passage[20:250] + "end")]
    got = sorted((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((k, removed) for (k, _), (_, removed, _) in zip(rows, brute([t for _, t in rows])))
    assert got == want


def test_odd_tables(docs, corpus, empty):
    assert repeats.remove_repeats(empty).count() == 0
    out = repeats.remove_repeats(docs.withColumn("spans", F.lit(1)), keep=["doc_id", "spans"])
    assert out.count() == len(corpus) and dict(out.dtypes)["spans"].startswith("array")
