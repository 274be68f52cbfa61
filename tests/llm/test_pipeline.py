"""The pipeline against the stages' brute-force versions on a small table."""

import random

import corpus_pipeline
from tessera.llm import quality
from tessera.llm.common import stored

from .conftest import SCHEMA, prose
from .test_jaccard import brute as components
from .test_repeats import brute as removed


#: Columns that operators use inside or return.
EXTRA = ["quality", "n_words", "kept", "spans", "dk", "votes", "k", "t", "a.b", "__h"]


def test_stages(spark, corpus, tmp_path):
    rng = random.Random(12)
    rows = [*corpus, *((500 + i, prose(rng, 120) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(rng, 40), "en", "s", 1) for i in range(3))]
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in EXTRA)) for r in rows], f"{SCHEMA}, {extra}").write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, one), (_, two), (_, three), (_, four), (_, five) = corpus_pipeline.STAGES
    want = sorted(((r["doc_id"], r["text"]) for r in quality.quality_rules(docs.select("doc_id", "text")).where("kept").collect()), key=repr)
    a = stored(one(spark, docs, sf))
    assert a.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in a.collect()), key=repr) == want and want
    b = stored(two(spark, a, sf))
    groups = {}
    for i, _, c in components([(i, t) for i, (_, t) in enumerate(want)]):
        groups.setdefault(c, []).append(want[i][0])
    least = [min((x for x in ids if x is not None), default=None) for ids in groups.values()]
    assert b.columns == docs.columns and sorted((r["doc_id"] for r in b.collect()), key=repr) == sorted(least, key=repr)
    c = stored(three(spark, b, sf))
    kept = [k.decode("utf-8", "replace") for _, _, k in removed([r["text"] for r in b.collect()])]
    assert c.columns == docs.columns and sorted(r["text"] for r in c.collect()) == sorted(kept)
    d = stored(four(spark, c, sf))
    assert d.columns == docs.columns and d.count() == c.count() and d.where("text like '%0123456789abcdef%'").count() == 0
    assert d.where("length(text) <> n_chars").count() == 0
    for r in d.collect():
        assert all(r[x] == f"{x} {r['doc_id']}" for x in EXTRA)
    out = five(spark, d, sf)
    assert sorted((r["doc_id"] for r in out.where("start = 0").collect()), key=repr) == sorted((r["doc_id"] for r in d.collect()), key=repr)
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
