"""File sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRACE_SCHEMA = "id long, caused_by long, node long, kind string, at long, fields map<string, long>"
RUN_SCHEMA = "seed long, workload string, violated boolean, invariant string, signature string, detail string, node_nanos long, one_minimal boolean"
DRILL_FIELDS = ("suite", "mutation", "must_detect", "caught", "seeds", "first_seed", "by", "invariant", "client_visible", "control", "note")


def written(df: DataFrame) -> DataFrame:
    """The rows written once below spark.checkpoint.dir and read back, which cuts the plan's lineage.

    Where no such folder is set, one in the temporary folder takes its place on a single machine; a cluster must name one.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_sorted(df: DataFrame, path: str, key: str = "key", partitions: int | None = None, bloom: bool = True) -> None:
    """Sorted runs: files of disjoint key ranges, sorted inside, with min/max and optional Bloom filters in the footers."""
    spread = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    writer = spread.sortWithinPartitions(key).write
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def read_sorted(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Simulation runs from JSON lines; sidecars of injection sites lie beside them and are left aside."""
    return spark.read.option("pathGlobFilter", "*[!y].jsonl").schema(RUN_SCHEMA).json(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Injection sites (id, name, activations) from the sidecars."""
    return spark.read.option("pathGlobFilter", "*.buggify.jsonl").schema("id string, name string, activations long").json(path)


def parse_drills(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a drill report: lines of eleven fields behind a DRILL mark, split at bars; others are skipped."""
    parts = F.split(F.col(value), r"\|")
    rows = lines.where(F.col(value).startswith("DRILL|")).select(F.slice(parts, 2, 100).alias("p")).where(F.size("p") == len(DRILL_FIELDS))
    return rows.select(*(F.trim(F.col("p")[i]).alias(n) for i, n in enumerate(DRILL_FIELDS)))


def parse_ledger(documents: DataFrame, value: str = "value") -> DataFrame:
    """(id, field, text) of entries in a ledger kept as Markdown: headings with an id, then `field: text` lines."""
    entry = F.explode(F.expr(rf"slice(split({value}, r'(?m)^(?=#+ +[A-Z]+-\d+)'), 1, 1000000)")).alias("e")
    e = documents.select(entry).withColumn("id", F.regexp_extract("e", r"^#+ +([A-Z]+-\d+)", 1)).where("id <> ''")
    pairs = F.explode(F.expr(r"transform(filter(split(e, '\n'), l -> l rlike r'^[a-z_]+ *[:=] '), l -> struct(regexp_extract(l, r'^([a-z_]+)', 1) as field, trim(regexp_extract(l, r'^[a-z_]+ *[:=] (.*)$', 1)) as text))")).alias("p")
    return e.select("id", pairs).select("id", "p.field", "p.text")


def parse_reproduction(lines: DataFrame, value: str = "value") -> DataFrame:
    """(suite, seed) of `reproduce = suite n` lines."""
    pattern = r"^\s*reproduce\s*=\s*(\S+)\s+(\d+)"
    hit = lines.where(F.col(value).rlike(pattern))
    return hit.select(F.regexp_extract(value, pattern, 1).alias("suite"), F.regexp_extract(value, pattern, 2).cast("long").alias("seed"))


def history_text(mops: DataFrame, history: DataFrame) -> DataFrame:
    """(history_id, txn_id, at, line): invoke and completion lines of each transaction in keyword notation."""
    op = F.when(F.col("type") == "append", F.format_string("[:append %d %d]", "key", "element")).otherwise(F.concat(F.lit("[:r "), F.col("key").cast("string"), F.lit(" "), F.lit("{}"), F.lit("]")))
    seen = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("observed", F.array().cast("array<bigint>")), lambda x: x.cast("string")), " "), F.lit("]"))
    m = mops.withColumns({"asked": F.replace(op, F.lit("{}"), F.lit("nil")), "told": F.replace(op, F.lit("{}"), seen)})
    lists = m.groupBy("history_id", "txn_id").agg(F.sort_array(F.collect_list(F.struct("pos", "asked", "told"))).alias("l"))
    line = lambda kind, field: F.concat(F.lit("{:type "), kind, F.lit(", :process "), F.col("process").cast("string"), F.lit(", :value ["), F.array_join(F.transform("l", lambda x: x[field]), " "), F.lit("]}"))
    done = F.when(F.col("outcome") == "committed", ":ok").when(F.col("outcome") == "aborted", ":fail").otherwise(":info")
    h = history.join(lists, ["history_id", "txn_id"])
    both = F.explode(F.array(F.struct(F.col("invoked").alias("at"), line(F.lit(":invoke"), "asked").alias("line")), F.struct(F.col("completed").alias("at"), line(done, "told").alias("line")))).alias("x")
    return h.select("history_id", "txn_id", both).select("history_id", "txn_id", "x.at", "x.line")
