"""Ordered key-value storage: merge-on-read, scans, compaction, catalogues and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import contains, level_target_bytes, overlaps_closed

L0_TRIGGER, BASE_BYTES = 4, 128 << 10


def newest_entries(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, seq, op, value): each key's newest entry, of those up to the snapshot."""
    seen = ops if snapshot is None else ops.where(F.col("seq") <= snapshot)
    newest = seen.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("e"))
    return newest.select("key", "e.seq", "e.op", "e.value")


def merge_on_read(*sources: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, value, seq) of live keys over all sources; a key whose newest entry deletes it is hidden.

    One partial aggregation before the shuffle keeps a key's history from meeting in one task.
    """
    ops = sources[0]
    for other in sources[1:]:
        ops = ops.unionByName(other)
    return newest_entries(ops, snapshot).where("op <> 'del'").select("key", "value", "seq")


def scan(ops: DataFrame, lo=None, hi=None, limit: int = 0, snapshot: int | None = None) -> DataFrame:
    """Live entries with lo <= key < hi in key order; a null bound is open, limit 0 means all."""
    start, end = F.lit(lo), F.lit(hi)
    if lo is not None or hi is not None:
        ops = ops.where(contains(start, end, F.col("key")))
    out = merge_on_read(ops, snapshot=snapshot).orderBy("key")
    return out.limit(limit) if limit else out


def point_get(ops: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, found, value) for each wanted key."""
    live = merge_on_read(ops.join(keys.select("key").distinct(), "key", "left_semi"), snapshot=snapshot)
    return keys.join(live, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "value")


def assign_sequences(batch: DataFrame, first_seq: int, order: str = "pos") -> DataFrame:
    """A write batch's operations with consecutive sequence numbers in the order of `order` (0, 1, ...)."""
    return batch.withColumn("seq", F.col(order) + F.lit(first_seq))


def compaction_output(ops: DataFrame, bottom: bool) -> DataFrame:
    """(key, seq, op, value) that a compaction writes: newest per key, without tombstones at the bottom."""
    out = newest_entries(ops)
    return out.where("op <> 'del'") if bottom else out


def level_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def compaction_pick(files: DataFrame, trigger: int = L0_TRIGGER, base: int = BASE_BYTES) -> DataFrame:
    """One row (level): 0 if level 0 has enough files, else the level 1-5 most over its target, else -1."""
    s = level_sizes(files)
    score = F.when(F.col("level").between(1, 5), F.col("bytes") / level_target_bytes(F.col("level"), base))
    s = s.withColumn("score", score)
    top = s.agg(
        F.coalesce(F.max(F.when(F.col("level") == 0, F.col("files"))), F.lit(0)).alias("l0"),
        F.max_by(F.when(F.col("score") > 1, F.col("level")), F.when(F.col("score") > 1, F.struct("score", -F.col("level")))).alias("over"),
    )
    return top.select(F.when(F.col("l0") >= trigger, F.lit(0)).otherwise(F.coalesce("over", F.lit(-1))).cast("long").alias("level"))


def compaction_inputs(files: DataFrame, level: int) -> DataFrame:
    """All of level 0 or the first file of another level, and what they overlap one level down."""
    own = files.where(F.col("level") == level)
    if level > 0:
        own = own.orderBy("smallest", "number").limit(1)
    span = F.broadcast(own.agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi")))
    below = files.where(F.col("level") == level + 1).join(span, overlaps_closed(F.col("smallest"), F.col("largest"), F.col("lo"), F.col("hi"))).select(files.columns)
    return own.unionByName(below)


def files_overlapping(files: DataFrame, lo, hi) -> DataFrame:
    return files.where(overlaps_closed(F.col("smallest"), F.col("largest"), F.lit(lo), F.lit(hi)))


def orphan_files(on_disk: DataFrame, live: DataFrame) -> DataFrame:
    return on_disk.join(live.select("number"), "number", "left_anti")


def valid_prefix(records: DataFrame, order: str = "pos", valid: str = "valid", within: list[str] | None = None) -> DataFrame:
    """Records of each log before its first invalid one."""
    bad = records.where(~F.col(valid))
    if within:
        first = bad.groupBy(*within).agg(F.min(order).alias("__bad"))
        out = records.join(first, within, "left")
    else:
        out = records.join(F.broadcast(bad.agg(F.min(order).alias("__bad"))))
    return out.where(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")


def manifest_state(edits: DataFrame) -> DataFrame:
    """(level, number, file_size) that stand after a manifest's edits; in an edit deletions come first."""
    rank = F.when(F.col("action") == "add", 1).otherwise(0)
    last = edits.groupBy("level", "number").agg(F.max_by(F.struct("action", "file_size"), F.struct("edit_no", rank)).alias("e"))
    return last.where("e.action = 'add'").select("level", "number", "e.file_size")


def surviving_entries(appends: DataFrame, truncations: DataFrame) -> DataFrame:
    """Entries (record_no, idx, ...) that no later truncation record (record_no, from_idx) cut off.

    Truncations are rare against entries, so they are the broadcast side of the anti join.
    """
    return appends.alias("a").join(F.broadcast(truncations.alias("t")), (F.col("t.record_no") > F.col("a.record_no")) & (F.col("t.from_idx") <= F.col("a.idx")), "left_anti")


def bloom_bits(keys: DataFrame, bits: int, hashes: int = 6) -> DataFrame:
    """(bit) positions that a Bloom filter of the keys sets, by double hashing."""
    h = F.expr(f"explode(transform(sequence(0, {hashes - 1}), i -> (pmod(xxhash64(key), {bits}) + i * pmod(xxhash64(key, 1), {bits})) % {bits}))")
    return keys.select(h.alias("bit")).distinct()


def bloom_maybe(probes: DataFrame, filter_bits: DataFrame, bits: int, hashes: int = 6) -> DataFrame:
    """(key, maybe): whether all of a key's bits are set; never false for a key of the filter."""
    h = F.expr(f"explode(transform(sequence(0, {hashes - 1}), i -> (pmod(xxhash64(key), {bits}) + i * pmod(xxhash64(key, 1), {bits})) % {bits}))")
    hit = probes.select("key").distinct().select("key", h.alias("bit")).join(filter_bits.withColumn("on", F.lit(1)), "bit", "left")
    return hit.groupBy("key").agg((F.count("on") == F.count("*")).alias("maybe"))
