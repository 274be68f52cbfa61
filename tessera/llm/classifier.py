"""Quality classifier on learned subword embeddings (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, map_batches, row_slices, table, text_bytes
from tessera.llm.hashing import powers, prefix, windows, words

#: Rows that the model is fitted on, at most about so many; they and their texts come to the driver.
SAMPLE_ROWS = 4000
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 5)
EPOCHS, RATE = 8, 0.4
#: A sample text of more bytes than this is left aside while fitting, so that 64 MB come to the driver at most; scoring reads every text whole.
SAMPLE_BYTES = 1 << 14
THRESHOLD = 0.7
_SHIFT = np.uint64(64 - 18)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h ^ np.uint64(salt)) * _MIX >> _SHIFT).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For slices of rows [a, b): families of features as (bucket of each, row borders into them).

    Families: byte n-grams of each size in GRAMS, blanks included; words; and one of two marks for each
    three-word window, whether the row had it before or not. Nothing crosses rows.
    """
    for a, b in row_slices(offsets):
        part = data[offsets[a] : offsets[b]]
        bounds = offsets[a : b + 1] - offsets[a]
        sums = prefix(part)
        inverse = powers(len(sums))[1]
        out = []
        for n in GRAMS:
            ok = bounds[1:] - n + 1
            lens = np.maximum(ok - bounds[:-1], 0)
            at = np.concatenate(([0], np.cumsum(lens)))
            if at[-1]:
                # positions of the rows' grams, one after another
                pos = np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], lens)
                h = (sums[pos + n] - sums[pos]) * inverse[pos]
                h ^= h >> np.uint64(32)
                out.append((_bucket(h, n), at))
        hashes, at = words(part, bounds)
        out.append((_bucket(hashes, 11), at))
        three = windows(hashes, 3)
        lens = np.maximum(np.diff(at) - 2, 0)
        to = np.concatenate(([0], np.cumsum(lens)))
        if to[-1]:
            pos = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], lens)
            own = three[pos] + np.repeat(np.arange(b - a, dtype=np.uint64) * _MIX, lens)
            again = np.ones(len(own), dtype=bool)
            again[np.unique(own, return_index=True)[1]] = False
            marks = _bucket(np.array([1, 2], dtype=np.uint64) * _MIX, 13)
            out.append((marks[again.astype(np.int64)], to))
        yield a, b, out


@dataclass
class Model:
    """Softmax weights folded into the embeddings: one number a bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; without any feature, that of the bias."""
        out = np.zeros(len(offsets) - 1)
        for a, b, families in features(data, offsets):
            total, count = np.zeros(b - a), np.zeros(b - a)
            for bucket, at in families:
                run = np.concatenate(([0.0], np.cumsum(self.weights[bucket], dtype=np.float64)))
                total += run[at[1:]] - run[at[:-1]]
                count += np.diff(at)
            out[a:b] = total / np.maximum(count, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit(texts: list[bytes], labels: list[int], seed: int = 3) -> Model:
    """Plain stochastic gradient descent, a document a step, the rate falling to zero.

    A document's vector is the mean of its features' vectors; softmax over two classes, log loss. The
    classes' weights differ by one vector, so that is what is learned. Without labels of both classes
    the model says how frequent 1 is (a half without any).
    """
    n, ones = len(labels), sum(labels)
    if not 0 < ones < n:
        share = (ones + 0.5) / (n + 1)
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, families in features(data, offsets):
        for i in range(b - a):
            every = np.concatenate([bucket[at[i] : at[i + 1]] for bucket, at in families])
            bucket, times = np.unique(every, return_counts=True)
            docs.append((bucket, (times / max(len(every), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.uniform(-1, 1, DIM).astype(np.float32)
    bias = np.float32(np.log(ones / (n - ones)))
    steps, done = EPOCHS * n, 0
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            bucket, share = docs[i]
            if not len(bucket):
                continue
            v = vectors[bucket]
            h = share @ v
            p = 1 / (1 + np.exp(-np.clip(h @ out + bias, -30, 30)))
            g = np.float32(labels[i] - p) * rate
            # a rare feature's share is tiny: its step is scaled up as the number of features
            vectors[bucket] = v + (g * np.minimum(share * len(bucket), 4))[:, None] * out[None, :]
            out = out + g * h
            bias = bias + g * np.float32(0.1)
    return Model((vectors @ out).astype(np.float32), float(bias))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[int]]:
    """At most about `rows` labelled texts, by hash of the key, however many there are; null labels teach nothing."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 40)) < int((1 << 40) * rows / n))
    got = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).where(F.coalesce(F.octet_length("t"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(known), "k").collect()
    got.sort(key=lambda r: (r["k"], r["y"], bytes(r["t"] or b"")))
    return [bytes(r["t"] or b"") for r in got], [r["y"] for r in got]


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the columns of docs other than the text; clashing ones are replaced."""
    keep = [c for c in docs.columns if c not in (text, "score", "predicted")]
    rows = docs.select(*keep, F.col(text).cast("binary").alias("__t"))
    kinds = dict(rows.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(*text_bytes(batch.column(len(keep))))
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"])

    return map_batches(rows, run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*sample(docs.where(~held_out()), labels.where(~held_out())))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
