"""Byte-level BPE encoding by overlapping chunks, and decoding (operator 5)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, table

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The tokenizer of a file of ranks; one for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str, upto: int | None = None) -> list[int]:
    """Where pre-tokens of the text begin, from its start on; with `upto`, those before that position and the next."""
    out = []
    for m in splitter(pattern).finditer(text):
        out.append(m.start())
        if upto is not None and m.start() >= upto:
            break
    return out


def _encode(batch: pa.RecordBatch, path: str, pattern: str) -> pa.RecordBatch:
    """Ids of each row's text (as little-endian 32-bit words) and the bytes that they decode to."""
    enc = encoding(path, pattern)
    ids, back, count = [], [], []
    for text in batch.column(batch.schema.names.index("text")).to_pylist():
        got = enc.encode_ordinary(text or "")
        ids.append(np.array(got, dtype="<u4").tobytes())
        back.append(enc.decode_bytes(got))
        count.append(len(got))
    keep = [n for n in batch.schema.names if n != "text"]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.names.index(n)) for n in keep] + [pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
        names=[*keep, "n_tokens", "ids", "decoded"],
    )


def bpe_encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """The rows of both tables of `bpe_tables`; a reader of one kind only takes that table, as no filter passes the encoder."""
    whole, pieces = bpe_tables(docs, path, pattern, key, text, chunk_chars, overlap_chars)
    return whole.unionByName(pieces)


def bpe_tables(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> tuple[DataFrame, DataFrame]:
    """(key, row_key, piece, n_tokens, ids, decoded, copies): texts of one piece, and each piece of each longer text, in the order of `piece`.

    A text up to `chunk_chars` long is one piece. A longer one is cut into chunks that overlap by
    `overlap_chars`; each is pre-tokenised on its own, from its own start. Where two neighbours put a
    pre-token boundary at the same place inside their overlap, both go on alike from there, because a
    match depends on nothing to its left: that is where the text is cut. The pieces between cuts are then
    encoded independently, so one document's work is spread over tasks. If any two neighbours of a
    document don't meet inside the overlap (a run of many thousand letters, say), the document is encoded
    in one piece, which is always right.

    Null and empty texts give one piece without tokens. Repeated keys are kept apart by a row key made
    of key and text; wholly equal rows share it and their pieces are equal too (`copies` counts them).
    Other columns of `docs` are not read, whatever their names.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk_chars).select("k", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("row_key"), "text")
    schema_k = dict(rows.dtypes)["k"]
    out_schema = f"k {schema_k}, piece int, row_key string, n_tokens long, ids binary, decoded binary"
    encode = lambda b: _encode(b, path, pattern)

    long = rows.where(F.length("text") > chunk_chars).withColumn("row_key", F.concat_ws(":", F.sha2("text", 256), F.col("k").cast("string")))
    distinct = long.dropDuplicates(["row_key"])
    n = F.ceil(F.length("text") / F.lit(chunk_chars)).cast("int")
    chunks = distinct.select("row_key", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * chunk_chars + 1, F.lit(chunk_chars + overlap_chars)))).alias("chunk", "text"))

    def zones(batch: pa.RecordBatch) -> pa.RecordBatch:
        head, tail = [], []
        for chunk, text in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist(), strict=True):
            # the last match of a chunk may go on beyond it, so its end is no boundary yet
            at = boundaries(text, pattern)
            last = len(text) - 1
            base = chunk * chunk_chars
            head.append([base + x for x in at if x < overlap_chars])
            tail.append([base + x for x in at if chunk_chars <= x < last])
        return pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("chunk"), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["row_key", "chunk", "head", "tail"])

    met = map_batches(chunks.repartition(F.col("row_key"), F.col("chunk")), zones, "row_key string, chunk int, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("row_key").orderBy("chunk")
    cuts = met.withColumn("cut", F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))).groupBy("row_key").agg(
        F.sort_array(F.collect_list("cut")).alias("cuts"), F.sum(F.when(F.col("cut").isNull() & (F.col("chunk") > 0), 1).otherwise(0)).alias("unmet")
    )
    cuts = cuts.select("row_key", F.when(F.col("unmet") == 0, F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"))).otherwise(F.array(F.lit(0).cast("long"))).alias("cuts"))
    ends = F.transform("cuts", lambda c, i: F.struct(c.alias("a"), F.coalesce(F.try_element_at("cuts", i + 2), F.length("text").cast("long")).alias("b")))
    pieces = (
        distinct.join(cuts, "row_key")
        .withColumn("ends", ends)
        .select("k", "row_key", F.posexplode(F.transform("ends", lambda e: F.substring(F.col("text"), (e["a"] + 1).cast("int"), (e["b"] - e["a"]).cast("int")))).alias("piece", "text"))
    )
    pieces = map_batches(pieces.select("k", "piece", "row_key", "text").repartition(F.col("row_key"), F.col("piece")), encode, out_schema)
    copies = long.groupBy("row_key").agg(F.count("*").alias("copies"))
    pieces = pieces.join(copies, "row_key").select("k", "row_key", "piece", "n_tokens", "ids", "decoded", "copies")
    whole = map_batches(short, encode, out_schema).select("k", "row_key", "piece", "n_tokens", "ids", "decoded", F.lit(1).cast("long").alias("copies"))
    return whole.withColumnRenamed("k", key), pieces.withColumnRenamed("k", key)


def bpe_decode(ids: bytes, path: str, pattern: str) -> bytes:
    """Bytes of ids given as little-endian 32-bit words: the tokens' bytes, one after another."""
    return encoding(path, pattern).decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes, for each document."""
    import public_tokenizers

    whole, pieces = bpe_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    one = whole.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return one.unionByName(digests(pieces))


def digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for each text of the table of pieces, repeated rows as often as they are.

    Pieces come sorted, so that a task holds two running digests however long a text is.
    """
    kind = dict(pieces.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict | None = None
        n, a, b = 0, hashlib.sha256(), hashlib.sha256()

        def done() -> pa.RecordBatch:
            k = last["copies"]
            return pa.RecordBatch.from_arrays([pa.array([last[key]] * k, kept), pa.array([n] * k, pa.int64()), pa.array([a.hexdigest()] * k), pa.array([b.hexdigest()] * k)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            kept = batch.schema.field(key).type
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if last is not None and r["row_key"] != last["row_key"]:
                    yield done()
                    n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                n += r["n_tokens"]
                a.update(r["ids"])
                b.update(r["decoded"])
                last = {c: r[c] for c in (key, "row_key", "copies")}
        if last is not None:
            yield done()

    ordered = pieces.repartition("row_key").sortWithinPartitions("row_key", "piece")
    return ordered.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
