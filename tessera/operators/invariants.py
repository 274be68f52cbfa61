"""Invariants over samples of state: named queries that return violations.

Every check takes a mapping of relation names to DataFrames and returns (detail) rows, none if it holds. Samples carry
`tick` and `node`; nodes that are down or booting are not judged. `registry` maps an id to its cost class and check.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import contains, terminal
from tessera.operators import audits, logs, topology, versions

State = Mapping[str, DataFrame]
Check = Callable[[State], DataFrame]
EPOCH_TICKS = 1000
registry: dict[str, tuple[str, Check]] = {}


def invariant(name: str, cost: str = "tick") -> Callable[[Check], Check]:
    def add(check: Check) -> Check:
        registry[name] = (cost, check)
        return check

    return add


def text(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Rows as one detail string."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in cols]
    return df.select(F.concat_ws(" ", *parts).alias("detail"))


def violations(state: State, names: list[str] | None = None) -> DataFrame:
    """(id, detail) of all violations of the named invariants whose relations are given (all by default)."""
    out = None
    for name in names or registry:
        found = registry[name][1](state).select(F.lit(name).alias("id"), "detail")
        out = found if out is None else out.unionByName(found)
    assert out is not None
    return out


def never_fired(armed: list[str], fired: DataFrame) -> DataFrame:
    """Armed invariants without any violation: candidates for a vacuous check."""
    spark = fired.sparkSession
    return spark.createDataFrame([(a,) for a in armed], "id string").join(fired.select("id").distinct(), "id", "left_anti")


def epochs(samples: DataFrame) -> DataFrame:
    """The samples at which checks of the epoch class run."""
    return samples.where(F.col("tick") % EPOCH_TICKS == 0)


def majorities_overlap(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return (2 * both > F.size(a)) & (2 * both > F.size(b))


def _step(*by: str):
    return Window.partitionBy(*by).orderBy("tick")


@invariant("RAFT-01")
def one_leader_a_term(s: State) -> DataFrame:
    return text(logs.diverging(s["raft_state"].where("role = 'leader' and alive"), ["term"], "node"), "term", "n")


@invariant("RAFT-02")
def leader_keeps_its_log(s: State) -> DataFrame:
    w = _step("node")
    r = s["raft_state"].withColumns({"p_len": F.lag("last_index").over(w), "p_term": F.lag("term").over(w), "p_role": F.lag("role").over(w)})
    return text(r.where("role = 'leader' and p_role = 'leader' and term = p_term and last_index < p_len"), "tick", "node")


@invariant("RAFT-03", "epoch")
def logs_match(s: State) -> DataFrame:
    return text(logs.log_mismatches(s["raft_entries"]), "a", "b", "idx")


def due_commits(lead: DataFrame, due: DataFrame, fan: int = 32, depth: int = 4) -> DataFrame:
    """Pairs of an election (l_term, tick, snapshot_index) and a commit of an earlier term and tick beyond its snapshot.

    Commits lie in a tree by tick whose nodes know their least term and tick and their greatest index; an election goes
    down only where all three allow a pair, level by level in equi-joins, instead of meeting every commit.
    """
    may = "least_term < l_term and least_tick < tick and most_idx > snapshot_index"
    ends = F.broadcast(due.agg(F.min("c_tick").alias("lo"), F.max("c_tick").alias("hi")))
    leaf = F.floor((F.col("c_tick") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * fan**depth).alias("part")
    placed = due.join(ends).select(*due.columns, leaf)
    levels = [placed.groupBy("part").agg(F.min("commit_term").alias("least_term"), F.min("c_tick").alias("least_tick"), F.max("idx").alias("most_idx"))]
    for _ in range(depth):
        up = F.expr(f"part div {fan}").alias("part")
        levels.append(levels[-1].groupBy(up).agg(F.min("least_term").alias("least_term"), F.min("least_tick").alias("least_tick"), F.max("most_idx").alias("most_idx")))
    found = lead.join(F.broadcast(levels.pop()), F.expr(may)).select(*lead.columns, "part")
    while levels:
        below = levels.pop().withColumns({"down": F.col("part"), "part": F.expr(f"part div {fan}")})
        found = found.join(below, "part").where(may).select(*lead.columns, F.col("down").alias("part"))
    return found.join(placed, "part").where("commit_term < l_term and c_tick < tick and idx > snapshot_index").drop("part")


@invariant("RAFT-04", "epoch")
def leaders_are_complete(s: State) -> DataFrame:
    """Entries committed in an earlier term that a new leader lacks or holds differently; those below its snapshot are exempt."""
    lead = s["elections"].select("tick", F.col("node").alias("leader"), F.col("term").alias("l_term"), "snapshot_index")
    due = s["commits"].select("idx", "term", "data", F.col("tick").alias("c_tick"), F.col("commit_term"))
    want = due_commits(lead, due)
    have = s["raft_entries"].select(F.col("node").alias("leader"), "idx", F.col("term"), "data")
    return text(want.join(have, ["leader", "idx", "term", "data"], "left_anti"), "leader", "l_term", "idx")


@invariant("RAFT-05")
def one_command_an_index(s: State) -> DataFrame:
    return text(logs.diverging(s["commits"], ["idx"], "data"), "idx", "n")


@invariant("RAFT-06")
def terms_rise(s: State) -> DataFrame:
    sound = s["raft_state"].where("not corrupted")
    down = logs.regressions(sound, ["node"], "tick", "durable_term").select("tick", "node")
    return text(down.union(sound.where("term < durable_term").select("tick", "node")), "tick", "node")


@invariant("RAFT-07")
def one_vote_a_term(s: State) -> DataFrame:
    return text(logs.diverging(s["raft_state"].where("durable_vote > 0"), ["node", "durable_term"], "durable_vote"), "node", "durable_term")


@invariant("RAFT-08")
def commits_rise(s: State) -> DataFrame:
    return text(logs.regressions(s["raft_state"], ["node"], "tick", "durable_commit"), "tick", "node")


@invariant("RAFT-09", "commit")
def commits_are_durable(s: State) -> DataFrame:
    """Commits without a durable quorum; a node that is down counts as having the entry, as nobody can tell."""
    c = s["commits"].select("idx", "voters").distinct()
    held = s["holders"].select("idx", F.col("node").alias("h"))
    down = s["raft_state"].where("not alive").select(F.col("node").alias("h")).distinct()
    n = c.select("idx", "voters", F.explode("voters").alias("h")).join(held.withColumn("has", F.lit(True)), ["idx", "h"], "left").join(F.broadcast(down.withColumn("down", F.lit(True))), "h", "left")
    got = n.groupBy("idx").agg(F.count_if(F.coalesce("has", "down", F.lit(False))).alias("got"), F.count("*").alias("of"))
    return text(got.where("2 * got <= of"), "idx", "got", "of")


@invariant("RAFT-10", "commit")
def leaders_commit_their_term(s: State) -> DataFrame:
    w = _step("node")
    r = s["raft_state"].withColumns({"p": F.lag("commit").over(w), "p_role": F.lag("role").over(w), "p_term": F.lag("term").over(w)})
    moved = r.where("role = 'leader' and p_role = 'leader' and term = p_term and commit > p").select("tick", "node", F.col("commit").alias("idx"), F.col("term").alias("own"))
    return text(moved.join(s["raft_entries"].select("node", "idx", F.col("term").alias("at")), ["node", "idx"]).where("at <> own"), "tick", "node", "idx")


@invariant("RAFT-11")
def snapshots_stay_behind(s: State) -> DataFrame:
    return text(s["raft_state"].where("snapshot_index > applied or first_index > applied + 1"), "tick", "node")


@invariant("RAFT-12")
def configs_follow_commits(s: State) -> DataFrame:
    """A node's configuration differs from that of the last configuration entry it committed."""
    c = s["raft_state"].select("tick", "node", F.col("commit").alias("at"), F.array_sort("voters").alias("voters"))
    e = s["config_entries"].select("idx", F.array_sort("voters").alias("implied"))
    due = logs.last_at(c.select("at"), e).join(e, "idx").select("at", "implied")
    return text(c.join(due, "at").where("voters <> implied"), "tick", "node")


@invariant("RAFT-13")
def leases_exclude(s: State) -> DataFrame:
    live = s["raft_state"].where("lease_expiry > now").select("tick", "node", (F.col("lease_expiry") - F.col("now")).alias("left"), "uncertainty")
    g = live.groupBy("tick").agg(F.count_distinct("node").alias("n"), F.min("left").alias("left"), F.max("uncertainty").alias("u"))
    return text(g.where("n > 1 and left > u"), "tick", "n")


@invariant("RAFT-14", "commit")
def reads_are_linear(s: State) -> DataFrame:
    return text(audits.stale_reads(s["linear_reads"], s["acked_writes"]), "key", "op")


@invariant("RAFT-15", "commit")
def learners_do_not_count(s: State) -> DataFrame:
    """Commit indexes beyond what the voters alone justify."""
    m = s["matches"].select("tick", "commit", "voters", F.explode("voters").alias("v"), "match")
    at = m.select("tick", "commit", F.size("voters").alias("n"), F.coalesce(F.col("match")[F.col("v")], F.lit(0).cast("long")).alias("m"))
    g = at.groupBy("tick", "commit", "n").agg(F.sort_array(F.collect_list("m"), False).alias("ms"))
    return text(g.where(F.col("commit") > F.element_at("ms", (F.floor(F.col("n") / 2) + 1).cast("int"))), "tick", "commit")


@invariant("RAFT-16")
def one_entry_a_term_and_index(s: State) -> DataFrame:
    return text(logs.diverging(s["raft_entries"], ["idx", "term"], "data"), "idx", "term")


@invariant("MVCC-01", "quiesce")
def snapshots_are_stable(s: State) -> DataFrame:
    return text(audits.model_mismatches(s["snapshot_reads"], s["model_reads"]), "key", "read_ts")


@invariant("MVCC-02", "commit")
def safepoints_stay_below(s: State) -> DataFrame:
    """Published safepoints above the floor recorded at the moment of publication."""
    return text(s["safepoints"].where("safepoint > floor"), "tick", "safepoint", "floor")


@invariant("MVCC-03", "quiesce")
def chains_descend(s: State) -> DataFrame:
    return text(versions.order_violations(s["chains"], "pos"), "key", "commit_ts")


@invariant("MVCC-04", "quiesce")
def versions_survive(s: State) -> DataFrame:
    """Versions that the model has above the safepoint and the store has not."""
    return text(s["model_versions"].join(s["chains"].select("key", "commit_ts"), ["key", "commit_ts"], "left_anti"), "key", "commit_ts")


@invariant("MVCC-05", "quiesce")
def intents_have_owners(s: State) -> DataFrame:
    return text(audits.persistent_suspects(s["suspects"]), "audit", "key", "owner")


@invariant("MVCC-06")
def waits_do_not_circle(s: State) -> DataFrame:
    return text(versions.wait_cycles(s["waits"]), "waiter", "cycle_length")


@invariant("MVCC-07")
def older_do_not_wait(s: State) -> DataFrame:
    return text(versions.wait_die_violations(s["waits"], s["txns"]), "waiter", "blocker")


@invariant("MVCC-08")
def locks_have_live_owners(s: State) -> DataFrame:
    j = s["locks"].join(s["txns"].select("txn", "status"), "txn", "left")
    return text(j.where(F.col("status").isNull() | terminal(F.col("status"))), "key", "txn", "status")


@invariant("SHARD-01")
def ranges_tile(s: State) -> DataFrame:
    return text(topology.coverage_violations(s["ranges"]), "id", "problem")


@invariant("SHARD-02", "epoch")
def keys_lie_inside(s: State) -> DataFrame:
    return text(topology.keys_outside(s["held_keys"], s["ranges"]), "key", "range_id")


@invariant("SHARD-03")
def frozen_have_left_neighbours(s: State) -> DataFrame:
    """Frozen ranges without an adjacent left neighbour on the same replicas."""
    r = s["placed_ranges"]
    left = r.select(F.col("end").alias("start"), F.array_sort("replicas").alias("l_replicas")).where("start is not null")
    j = r.where("frozen").join(left, "start", "left")
    return text(j.where(F.col("l_replicas").isNull() | (F.col("l_replicas") != F.array_sort("replicas"))), "id")


@invariant("SHARD-04")
def range_leases_exclude(s: State) -> DataFrame:
    """Two valid leases of a range at once, and hand-overs closer than twice the clock bound."""
    x = s["leases"]
    held = x.where("start <= now and now < expiry").groupBy("tick", "range_id").agg(F.count_distinct("holder").alias("n")).where("n > 1").select(F.concat_ws(" ", F.col("tick"), F.col("range_id"), F.lit("overlap")).alias("detail"))
    w = Window.partitionBy("range_id").orderBy("tick", "start")
    h = x.withColumns({"p_holder": F.lag("holder").over(w), "p_expiry": F.lag("expiry").over(w)})
    near = h.where("holder <> p_holder and start < p_expiry + 2 * uncertainty")
    return held.union(text(near, "tick", "range_id", F.lit("hand-over")))


@invariant("SHARD-05")
def generations_rise(s: State) -> DataFrame:
    w = _step("id")
    span = F.struct("start", "end", F.array_sort("replicas").alias("replicas"))
    r = s["range_samples"].withColumn("span", span)
    r = r.withColumns({"p_gen": F.lag("generation").over(w), "p_span": F.lag("span").over(w)})
    return text(r.where((F.col("generation") < F.col("p_gen")) | ((F.col("generation") == F.col("p_gen")) & ~F.col("span").eqNullSafe(F.col("p_span")))), "tick", "id")


@invariant("SHARD-06")
def voters_change_safely(s: State) -> DataFrame:
    """Added voters that were no caught-up learners, or voter sets whose majorities are disjoint."""
    w = _step("id")
    r = s["range_samples"].withColumns({"p_voters": F.lag("replicas").over(w), "p_learners": F.lag("learners").over(w), "p_caught": F.lag("caught_up").over(w)}).where("p_voters is not null")
    added = F.array_except("replicas", "p_voters")
    fit = F.size(F.array_except(added, F.array_intersect("p_learners", "p_caught"))) == 0
    return text(r.where(~fit | ~majorities_overlap(F.col("replicas"), F.col("p_voters"))), "tick", "id")


@invariant("SHARD-07")
def meta_index_agrees(s: State) -> DataFrame:
    """Ranges that the second-level index lacks, or lists in another bucket than their rank says."""
    want = topology.meta_buckets(s["ranges"])
    j = want.join(s["meta"].select("id", F.col("bucket").alias("has")), "id", "full")
    return text(j.where("has is null or bucket is null or has <> bucket"), "id")


@invariant("SHARD-08")
def quiesced_peers_are_level(s: State) -> DataFrame:
    lead = s["peers"].where("quiesced and role = 'leader'").select("range_id", F.col("applied").alias("want"))
    return text(s["peers"].where("alive").join(lead, "range_id").where("applied < want"), "range_id", "node")


@invariant("SHARD-09", "epoch")
def replicas_agree(s: State) -> DataFrame:
    return text(logs.diverging(s["digests"], ["range_id", "applied"], "digest"), "range_id", "applied")


@invariant("SHARD-CLIENT", "commit")
def lease_reads_move_on(s: State) -> DataFrame:
    return text(audits.stale_reads(s["lease_reads"], s["done_reads"], "range_id"), "range_id", "op")


@invariant("TXN-01", "epoch")
def intents_have_records(s: State) -> DataFrame:
    return text(s["intents"].join(s["txn_records"].select("txn"), "txn", "left_anti"), "key", "txn")


@invariant("TXN-02")
def terminal_is_final(s: State) -> DataFrame:
    w = Window.partitionBy("txn", "range_id", "node").orderBy("tick")
    r = s["record_samples"].withColumns({"p": F.lag("status").over(w), "p_applied": F.lag("applied").over(w)})
    return text(r.where(terminal(F.col("p")) & (F.col("p") != F.col("status")) & (F.col("applied") >= F.col("p_applied"))), "tick", "txn")


@invariant("TXN-03")
def commits_follow_starts(s: State) -> DataFrame:
    return text(s["txn_outcomes"].where("status = 'committed' and commit_ts <= start_ts"), "txn")


@invariant("TXN-04", "epoch")
def version_chains_descend(s: State) -> DataFrame:
    return text(versions.order_violations(s["chains"], "pos"), "key", "commit_ts")


@invariant("TXN-09", "commit")
def timestamps_are_unique(s: State) -> DataFrame:
    twice = text(logs.diverging(s["txn_outcomes"].where("status = 'committed'"), ["commit_ts"], "txn"), F.lit("twice"), "commit_ts")
    return twice.union(text(logs.regressions(s["oracle_samples"], ["node"], "tick", "high_water"), F.lit("back"), "tick", "node"))


@invariant("TXN-11", "epoch")
def staging_lists_its_keys(s: State) -> DataFrame:
    """Staging records without keys, and intents of the same epoch on keys that the longest list lacks."""
    st = s["staging"].groupBy("txn", "epoch").agg(F.max_by("keys", F.size("keys")).alias("keys"))
    bare = text(st.where("size(keys) = 0"), "txn", F.lit("no keys"))
    off = s["intents"].join(st, ["txn", "epoch"]).where(~F.array_contains("keys", F.col("key")))
    return bare.union(text(off, "txn", "key"))


@invariant("TXN-12")
def waits_across_nodes_do_not_circle(s: State) -> DataFrame:
    w = s["remote_waits"].groupBy("waiter").agg(F.min("blocker").alias("blocker"))
    return text(versions.wait_cycles(w), "waiter", "cycle_length")


@invariant("CTR-01")
def promises_are_held(s: State) -> DataFrame:
    p = s["promised"].groupBy("node").agg(F.count("*").alias("p")).join(s["held"].groupBy("node").agg(F.count("*").alias("h")), "node", "left")
    return text(p.where("p > coalesce(h, 0)"), "node")


@invariant("CTR-02")
def promises_are_applied(s: State) -> DataFrame:
    return text(s["promised"].join(s["applied"], ["node", "id"], "left_anti"), "node", "id")


@invariant("CTR-03", "quiesce")
def acknowledged_survive(s: State) -> DataFrame:
    return text(audits.lost_operations(s["acked"], s["applied"], ["id"]), "id")


# Specification properties, as queries over tables of transactions, versions and logs.


def commits_are_grounded(state: DataFrame) -> DataFrame:
    """Commit indexes beyond the log's end."""
    return state.where("commit > last_index")


def learners_are_not_voters(state: DataFrame) -> DataFrame:
    return state.where(F.arrays_overlap("voters", "learners"))


def key_lists_are_complete(records: DataFrame, writes: DataFrame) -> DataFrame:
    """Staging or committed records whose list lacks a key that they wrote."""
    w = writes.groupBy("txn").agg(F.collect_set("key").alias("wrote"))
    return records.where("status in ('staging', 'committed')").join(w, "txn").where(F.size(F.array_except("wrote", "keys")) > 0).select("txn")


def partial_commits(records: DataFrame, writes: DataFrame, made: DataFrame) -> DataFrame:
    """(txn, key) that a committed transaction wrote and that has no version of it."""
    c = records.where("status = 'committed'").select("txn")
    return writes.join(c, "txn", "left_semi").join(made.select("txn", "key"), ["txn", "key"], "left_anti").select("txn", "key")


def aborted_traces(records: DataFrame, made: DataFrame) -> DataFrame:
    """Versions that aborted transactions left."""
    return made.join(records.where("status = 'aborted'").select("txn"), "txn", "left_semi")


def misdated_versions(records: DataFrame, made: DataFrame) -> DataFrame:
    """Versions whose timestamp is not their transaction's commit timestamp."""
    r = records.where("status = 'committed'").select("txn", F.col("commit_ts").alias("want"))
    return made.join(r, "txn").where("commit_ts <> want")


def snapshot_breaches(observed: DataFrame, txns: DataFrame) -> DataFrame:
    """Observed versions from after the reader's start."""
    return observed.join(txns.select("txn", "start_ts"), "txn").where("version_ts > start_ts")


def spans_hold(ranges: DataFrame, lo, hi) -> DataFrame:
    """Ranges that contain both ends of a span."""
    return ranges.where(contains(F.col("start"), F.col("end"), F.lit(lo)) & contains(F.col("start"), F.col("end"), F.lit(hi)))
