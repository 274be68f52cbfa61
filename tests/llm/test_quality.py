"""Operator 1: counts against plain Python, the model against a plain loop."""

import math
import re

import pyspark.sql.functions as F

from tessera.llm import quality


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(map(t.count, quality.SYMBOLS)), len(lines) - len(set(lines)), len(covered))


def test_counts(docs, corpus):
    got = quality.statistics(docs.withColumn("n_words", F.lit("clash"))).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(r["text"])


def test_model_equals_a_plain_loop(spark):
    k = len(quality.RULES)
    rows = [(sum(3**j * d for j, d in enumerate(v)), n) for v, n in (([1] * k, 80), ([2] * k, 15), ([1, 2] * (k // 2), 9), ([0] * k, 4), ([0, 1, 1, 0, 2, 1], 30))]
    p, g, b = quality.PRIOR_GOOD, [quality.RIGHT_GOOD] * k, [quality.RIGHT_BAD] * k
    votes = [[c // 3**j % 3 for j in range(k)] for c, _ in rows]

    def post(v):
        s = math.log(p / (1 - p)) + sum(math.log(g[j] / (1 - b[j])) if x == 1 else math.log((1 - g[j]) / b[j]) if x == 2 else 0 for j, x in enumerate(v))
        return 1 / (1 + math.exp(-s))

    for _ in range(quality.ROUNDS):
        r = [post(v) for v in votes]
        w = [n for _, n in rows]
        m = quality.PRIOR_VOTES
        clamp = lambda x, at: min(at[1], max(at[0], x))
        p2 = (sum(a * q for a, q in zip(w, r)) + m * quality.PRIOR_GOOD) / (sum(w) + m)
        g2 = [clamp((sum(a * q for a, q, v in zip(w, r, votes) if v[j] == 1) + m * quality.RIGHT_GOOD) / (sum(a * q for a, q, v in zip(w, r, votes) if v[j]) + m), quality.GOOD_RANGE) for j in range(k)]
        b2 = [clamp((sum(a * (1 - q) for a, q, v in zip(w, r, votes) if v[j] == 2) + m * quality.RIGHT_BAD) / (sum(a * (1 - q) for a, q, v in zip(w, r, votes) if v[j]) + m), quality.BAD_RANGE) for j in range(k)]
        p, g, b = p2, g2, b2
    got = {x["votes"]: x["quality"] for x in quality.posteriors(spark.createDataFrame(rows, "votes long, n long")).collect()}
    for (code, _), v in zip(rows, votes):
        assert abs(got[code] - post(v)) < 1e-9


def test_odd_tables(docs, corpus, empty):
    out = quality.quality_rules(docs.withColumn("kept", F.lit(1))).collect()
    assert len(out) == len(corpus)
    assert all(r["base_failed"] == (plain(r["text"])[0] < 50 or 100 * plain(r["text"])[4] > 50 * plain(r["text"])[0]) for r in out)
    assert all(not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1 for r in out)
    assert quality.quality_rules(empty).count() == 0


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] == (r["label"] == 1) for r in out)
