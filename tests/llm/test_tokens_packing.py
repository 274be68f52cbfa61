"""Operators 5 and 9: exact ids, round trips, gapless sequences."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import packing, tokens

PATH, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def encoded(df, **kw):
    parts = {}
    for r in tokens.bpe_encode(df, PATH, P.PATTERN, **kw).collect():
        for _ in range(1):
            parts.setdefault((r["doc_id"], r["row_key"]), []).append(r)
    return parts


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (1000, 100), (1 << 15, 512)])
def test_chunks_give_the_whole_texts_ids(spark, corpus, chunk, overlap):
    rows = [(i, r[1]) for i, r in enumerate(corpus)] + [(900, "a" * 500 + " b"), (901, "x  \n\n  y'll  " * 60), (902, " " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    enc = tokens.encoding(PATH, P.PATTERN)
    parts = encoded(df, chunk_chars=chunk, overlap_chars=overlap)
    assert len(parts) == len(rows)
    for (k, _), rs in parts.items():
        rs.sort(key=lambda r: r["piece"])
        text = dict(rows)[k] or ""
        ids = np.frombuffer(b"".join(r["ids"] for r in rs), dtype="<u4").tolist()
        assert ids == enc.encode_ordinary(text)
        assert b"".join(r["decoded"] for r in rs) == text.encode() == tokens.bpe_decode(b"".join(r["ids"] for r in rs), PATH, P.PATTERN)


def test_digests_of_pieces(spark, corpus):
    rows = [(r[0], r[1]) for r in corpus] + [(7000, "long " * 500)] * 2
    _, pieces = tokens.bpe_tables(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, chunk_chars=200, overlap_chars=40)
    enc, want = tokens.encoding(PATH, P.PATTERN), []
    for k, t in rows:
        if t and len(t) > 200:
            ids = np.array(enc.encode_ordinary(t), dtype="<u4")
            want.append((k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, tokens.digests(pieces).collect()), key=repr) == sorted(want, key=repr)


def test_repeated_long_rows_are_counted(spark):
    df = spark.createDataFrame([(1, "word " * 100)] * 3, "doc_id long, text string")
    got = tokens.bpe_encode(df, PATH, P.PATTERN, chunk_chars=100, overlap_chars=20).collect()
    assert {r["copies"] for r in got} == {3}
    assert tokens.bpe_encode(df.where("false"), PATH, P.PATTERN).count() == 0


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def word_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_word_ids_equal_the_tokenizers(corpus):
    rng = random.Random(1)
    odd = ["", None, "Don't STOP. it's, ok..", "naïve Ünï ß İstanbul ΣΑΣ", "<|endoftext|> x <|ENDOFTEXT|>", "a\tb\r\nc d e", "1234 5.6, 7,. ,x", "é ́x", "x\x01y \x01", "ſ K"]
    odd += ["".join(rng.choice("ab.,'! \n\tÀé<|>5") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    letters = "abcdefghijklmnopqrstuvwxyzßàáéèïñóöøùûüýþÿÀÉÖÞ×÷"
    odd += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(50)) for _ in range(100)]
    odd += ["a" * 5000, "ß" * 25, "Straße. MASSE, ÿ ÷ × ÿß", "foo%%% $$$ a1b22 x" * 30]
    texts = odd + [r[1] for r in corpus]
    ids = packing.WordIds(WORDS)
    for _ in range(2):  # the second time from the table
        for t, raw in zip(texts, ids(texts)):
            assert np.frombuffer(raw, dtype="<u4").tolist() + [packing.END_ID] == word_ids(t), repr(t)[:80]


def test_a_full_table_gives_the_same_ids(corpus, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_BITS", 4)
    monkeypatch.setattr(packing, "SLOTS", 16)
    ids = packing.WordIds(WORDS)
    for r in corpus:
        assert np.frombuffer(ids([r[1]])[0], dtype="<u4").tolist() + [packing.END_ID] == word_ids(r[1])


def test_packing_is_gapless_and_whole(spark, docs, corpus, empty):
    cut = packing.pieces(docs, WORDS).cache()
    rows = packing.pack(cut).collect()
    assert len(rows) == cut.count()
    want = sorted((len(i), zlib.crc32(np.array(i[:4096], dtype="<u4").tobytes())) for i in (word_ids(r[1]) for r in corpus))
    assert sorted((r["doc_tokens"], r["ids_crc32"]) for r in rows if r["start"] == 0) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert sorted(by) == list(range(len(by)))
    assert packing.pack(packing.pieces(empty, WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_once_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([np.minimum(4096, rng.lognormal(6.3, 1.1, 4000).astype(int) + 1), np.full(500 * seed, 4096)])
    hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    made, segments = packing.plan(hist)
    used = {}
    for _, often, parts in made:
        assert sum(parts) <= 4096
        for p in parts:
            used[p] = used.get(p, 0) + often
    assert used == hist
    pad = sum(often * (0 if sum(p) & (sum(p) - 1) == 0 else 4096 - sum(p)) for _, often, p in made)
    assert pad < 0.01 * lengths.sum()
    assert len(made) < 4096 * 4
    for n, c in hist.items():
        ranks = sorted((int(a), int(k)) for length, a, k, _, _ in segments if length == n)
        at = 0
        for a, k in ranks:
            assert a == at
            at += k
        assert at == c
    assert packing.plan({})[0] == []
