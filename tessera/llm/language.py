"""Language identification by compression with per-language dictionaries (operator 10)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import held_out, map_batches, table

#: Bytes of dictionary for each language, and rows whose whole texts may enter it: the bounds of the sample.
DICT_BYTES, SAMPLE_ROWS = 1 << 16, 256
LEVEL, BLOCK, SHORT = 3, 1024, 400
#: The best dictionary must save this share against the second, else the prediction counts as rejected.
MARGIN = 0.005
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    """Lower-case letters of the text, everything else collapsed to single spaces."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def views(body: bytes) -> list[bytes]:
    """What is compressed for a text: its blocks, and for a short text its words and word pairs as well.

    Blocks keep the dictionary, not the text's own history, in charge. Sizes are whole bytes, so a short
    text is looked at several times, which breaks ties.
    """
    parts = [b" " + body[i : i + BLOCK] + b" " for i in range(0, len(body), BLOCK)]
    if len(body) < SHORT:
        w = body.split()
        parts += [b" " + x + b" " for x in w] + [b" " + x + b" " + y + b" " for x, y in zip(w, w[1:], strict=False)]
    return parts


@lru_cache(maxsize=4)
def compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    import zstandard as zstd

    out = []
    for _, content in dictionaries:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        p = zstd.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=BLOCK, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        out.append(zstd.ZstdCompressor(compression_params=p, dict_data=d))
    return out


def fit_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[tuple[str, bytes], ...]:
    """Per-language raw-content dictionaries, the most frequent language first.

    From each language at most SAMPLE_ROWS whole texts, picked by a hash of key and text, are
    brought to the driver, texts of over DICT_BYTES / 4 bytes left aside unless there are no others, and of those the first DICT_BYTES characters; their
    normalised texts are strung together up to DICT_BYTES. The bounds don't depend on the input's size;
    the count of rows of each language, which breaks ties, covers all rows. Null languages and texts teach
    nothing.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # of a frequent language only rows with small hashes are ranked: enough of them, however many rows there are
    spark = labelled.sparkSession
    share = F.broadcast(spark.createDataFrame([(c, min(1.0, 8 * SAMPLE_ROWS / n)) for c, n in counts.items()], "lang string, share double"))
    narrow = rows.select("lang", "h", (F.octet_length("text") > DICT_BYTES // 4).alias("late"))
    narrow = narrow.join(share, "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40)).drop("share")
    ranked = narrow.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("late", "h"))).where(F.col("rank") <= SAMPLE_ROWS)
    picked = rows.select("lang", "h", "text").join(F.broadcast(ranked.select("lang", "h", "rank")), ["lang", "h"])
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "rank", F.substring("text", 1, DICT_BYTES).alias("text")).collect():
        texts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    out = []
    for code in sorted(texts, key=lambda c: (-counts[c], c)):
        body = b" ".join(normalised(t) for _, t in sorted(texts[code]))[:DICT_BYTES]
        if len(body) >= 8:
            out.append((code, body))
    return tuple(out)


def identify(docs: DataFrame, dictionaries: tuple[tuple[str, bytes], ...], text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to the columns of `docs` other than `text`.

    Every block of the whole text is compressed with each language's dictionary; the smallest sum wins,
    ties go to the language with more training rows. `score` is one minus the ratio of the best to the
    second size, scaled to 0..1 and 0.5 where only one language is known. Within MARGIN of each other the two best count as too close: `rejected`
    is true and the caller may discard the label. A text that is null or has no letter gives `und`, score
    0, rejected. Columns of docs that clash with the added names are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score", "rejected")]
    names = [code for code, _ in dictionaries]
    source = docs.select(*keep, F.col(text).alias("__text"))
    kinds = dict(source.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tools = compressors(dictionaries)
        pred, score, rejected = [], [], []
        for t in batch.column(len(keep)).to_pylist():
            body = normalised(t or "")
            if not body or not tools:
                pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                continue
            parts = views(body)
            sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in tools], dtype=np.float64)
            best = int(sizes.argmin())
            rest = np.delete(sizes, best)
            gap = 1.0 - sizes[best] / rest.min() if len(rest) else 1.0
            pred.append(names[best]), score.append(min(1.0, 0.5 + 2.0 * gap) if len(rest) else 0.5), rejected.append(bool(gap < MARGIN))
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return map_batches(source, run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    known = fit_dictionaries(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), known)
