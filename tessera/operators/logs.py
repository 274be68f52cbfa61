"""Replicated logs: quorums, commit indexes, matching, slices and batch application."""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_rows, nothing


def half_commit(progress: DataFrame, voters: Column) -> Column:
    """The index that a majority of the voters has, from (peer, match) rows under a groupBy; a peer that is missing has 0."""
    have = F.collect_list(F.when(F.array_contains(voters, F.col("peer")), F.col("match")))
    n = F.size(voters)
    padded = F.sort_array(F.concat(have, F.array_repeat(F.lit(0).cast("long"), F.greatest(n - F.size(have), F.lit(0)))), False)
    return F.when(n > 0, F.element_at(padded, (F.floor(n / 2) + 1).cast("int")))


def quorum_commit(progress: DataFrame, incoming: list[int], outgoing: list[int] | None = None) -> DataFrame:
    """(leader, candidate): the highest index that a quorum holds; of a joint configuration, of both halves."""
    a = half_commit(progress, F.array(*map(F.lit, incoming)))
    both = a if not outgoing else F.least(a, half_commit(progress, F.array(*map(F.lit, outgoing))))
    return progress.groupBy("leader").agg(both.alias("candidate"))


def advance_commit(candidates: DataFrame, entries: DataFrame, state: DataFrame) -> DataFrame:
    """(leader, commit): the candidate if it is beyond the commit index and of the leader's own term, else as before."""
    e = entries.select(F.col("node").alias("leader"), F.col("idx").alias("candidate"), F.col("term").alias("at_term"))
    j = state.join(candidates, "leader", "left").join(e, ["leader", "candidate"], "left")
    ok = (F.col("candidate") > F.col("commit")) & (F.col("at_term") == F.col("term"))
    return j.select("leader", F.when(ok, F.col("candidate")).otherwise(F.col("commit")).alias("commit"))


def log_mismatches(entries: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """(a, b, idx): where two nodes' logs agree on a later index and term but differ at idx, above both snapshots.

    An equi self-join on the index, then one running maximum from the end of each pair of logs.
    """
    e = entries
    if snapshots is not None:
        e = e.join(F.broadcast(snapshots), "node", "left").where("idx > coalesce(snapshot_index, 0)")
    a = e.select(F.col("node").alias("a"), "idx", F.col("term").alias("a_term"), F.col("data").alias("a_data"))
    b = e.select(F.col("node").alias("b"), "idx", F.col("term").alias("b_term"), F.col("data").alias("b_data"))
    pair = a.join(b, "idx").where("a < b")
    same_term = F.col("a_term") == F.col("b_term")
    last = pair.groupBy("a", "b").agg(F.max(F.when(same_term, F.col("idx"))).alias("agreed"))
    differ = ~same_term | ~F.col("a_data").eqNullSafe(F.col("b_data"))
    return pair.where(differ).join(F.broadcast(last), ["a", "b"]).where("idx <= agreed").select("a", "b", "idx")


def diverging(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that have more than one distinct value, and how many: one leader a term, one command an index, and so on."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n")).where("n > 1")


def regressions(samples: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Samples below the running maximum of the samples before them."""
    top = F.max(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn("before", top).where(F.col(value) < F.col("before"))


def last_at(points: DataFrame, entries: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(at, idx): for each of the distinct points (at), the greatest entry's idx at or before it; points before all entries are left out.

    One running maximum inside each stretch of `width` positions, and one over the stretches' last entries, a row a stretch.
    """
    p = points.select(F.col("at").cast("long").alias("at")).where("at is not null").distinct().select("at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("idx"))
    e = entries.select(F.col("idx").cast("long").alias("idx")).where("idx is not null").distinct().select(F.col("idx").alias("at"), F.lit(0).alias("kind"), "idx")
    both = p.unionByName(e).withColumn("stretch", F.expr(f"at div {width}"))
    inside = F.max("idx").over(Window.partitionBy("stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("last").over(Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = both.groupBy("stretch").agg(F.max("idx").alias("last")).select("stretch", before.alias("carried"))
    found = both.withColumn("inside", inside).where("kind = 1").join(carried, "stretch")
    return found.select("at", F.coalesce("inside", "carried").alias("idx")).where("idx is not null")


def log_slice(entries: DataFrame, start: int, max_count: int, max_bytes: int) -> DataFrame:
    """Each node's entries from `start` on until a count or until one more would pass the bytes; the first always fits."""
    order = Window.partitionBy("node").orderBy("idx")
    e = entries.where(F.col("idx") >= start).withColumns({"n": F.row_number().over(order), "bytes": F.sum(F.length("data")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return e.where((F.col("n") <= max_count) & ((F.col("n") == 1) | (F.col("bytes") <= max_bytes))).select("node", "idx", "term", "data")


def conflict_by_term(entries: DataFrame, idx: int, term: int) -> DataFrame:
    """(node, idx): the last index up to `idx` whose term is at most `term`; 0 if none. Terms never fall in a log."""
    e = entries.groupBy("node").agg(F.max(F.when((F.col("idx") <= idx) & (F.col("term") <= term), F.col("idx"))).alias("idx"))
    return e.select("node", F.coalesce("idx", F.lit(0).cast("long")).alias("idx"))


def apply_appends(batches: DataFrame) -> DataFrame:
    """(node, batch, accepted, last_idx) of append batches folded into each node's log in order.

    A batch is (node, batch, prev_idx, prev_term, terms): it needs the entry before it to match; a conflicting suffix is
    cut, entries already there stay. Each batch depends on the log that the ones before made, so a node is one fold, which
    holds that log only.
    """

    def make(_):
        log = array("q")

        def step(node, batch, prev_idx, prev_term, terms):
            ok = prev_idx <= len(log) and (prev_idx == 0 or log[prev_idx - 1] == prev_term)
            if ok:
                for at, t in enumerate(terms, prev_idx):
                    if at < len(log) and log[at] != t:
                        del log[at:]
                    if at >= len(log):
                        log.append(t)
            return node, batch, ok, len(log)

        return step, nothing

    rows = batches.select("node", "batch", "prev_idx", "prev_term", "terms")
    return fold_rows(rows, "node", ["batch"], make, "node long, batch long, accepted boolean, last_idx long")


def causal_depth(trace: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root, depth) of each event's chain of causes, by pointer doubling: 2^rounds hops at most.

    Every round is one equi-join that doubles all distances, so depth n takes log2 n joins.
    """
    from tessera.sources.files import written

    at = trace.select("id", F.coalesce("caused_by", "id").alias("up"), F.when(F.col("caused_by").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    for _ in range(rounds):
        nxt = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = written(at.join(nxt, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        at = step.select("id", "up", "depth")
        if step.where("moved").isEmpty():
            break
    return at.select("id", F.col("up").alias("root"), "depth")
