"""Training-corpus pipeline: documents in, packed sequences out, a stage an operator.

Each stage but the last returns the columns of its input; those that it doesn't know pass through unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shielded, stored, table
from tessera.llm.jaccard import representatives
from tessera.llm.packing import pack, pieces
from tessera.llm.quality import quality_rules
from tessera.llm.repeats import remove_repeats
from tessera.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are; accuracies are estimated over this stage's input."""
    rows, back = shielded(docs, "text")
    return back(quality_rules(rows).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest doc_id; null ids come last, equal ones go by text hash."""
    rows, back = shielded(docs, "doc_id", "text")
    return back(representatives(rows))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat anywhere in this stage's input.

    A removed range may cut a character in two; what is left of one becomes U+FFFD. n_chars follows the text. A null text becomes empty.
    """
    rows, back = shielded(docs, "text", "n_chars")
    out = remove_repeats(rows)
    return back(_counted(out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with every secret span replaced by a mask."""
    rows, back = shielded(docs, "text", "n_chars")
    return back(_counted(redact(rows)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences."""
    return pack(stored(pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeats), ("secret scans", secrets), ("packing", packing)]

#: SQL can express neither the tokenizer nor byte-wise repeats at reasonable cost; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
