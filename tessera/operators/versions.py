"""Multi-version reads, garbage collection, intents and locks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import is_older


def as_of(versions: DataFrame, at: DataFrame, ts: str, out: str = "v") -> DataFrame:
    """`at` with a struct (commit_ts, tombstone, value) of the key's newest version up to `ts`, or null.

    A union of both sides and one running last value: no pair of version and read is ever formed.
    """
    seen = F.struct("commit_ts", "tombstone", "value")
    v = versions.select("key", F.col("commit_ts").alias("__ts"), F.lit(0).alias("__kind"), seen.alias("__v"))
    kind = v.schema["__v"].dataType
    row = F.struct(*at.columns)
    v = v.withColumn("__row", F.lit(None).cast(at.select(row.alias("r")).schema["r"].dataType))
    r = at.select("key", F.col(ts).alias("__ts"), F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__v"), row.alias("__row"))
    order = Window.partitionBy("key").orderBy("__ts", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = v.unionByName(r).withColumn(out, F.last("__v", ignorenulls=True).over(order))
    return both.where("__kind = 1").select("__row.*", out)


def committed_value(versions: DataFrame, reads: DataFrame) -> DataFrame:
    """(key, read_ts, found, value, commit_ts): snapshot reads of committed versions; a tombstone is not found."""
    got = as_of(versions, reads.select("key", "read_ts").distinct(), "read_ts")
    found = F.col("v").isNotNull() & ~F.coalesce(F.col("v.tombstone"), F.lit(False))
    return got.select("key", "read_ts", found.alias("found"), F.when(found, F.col("v.value")).alias("value"), F.coalesce("v.commit_ts", F.lit(0).cast("long")).alias("commit_ts"))


def snapshot_read(versions: DataFrame, intents: DataFrame, reads: DataFrame, own_first: bool = False) -> DataFrame:
    """(key, read_ts, reader, outcome, value, ts, blocker) for reads (key, read_ts, reader, uncertainty_limit).

    In this order: another's intent from before the read blocks it; without versions an own intent answers; a
    newest version in (read_ts, limit] makes the read uncertain; an own intent answers; the newest version up to
    read_ts answers. With own_first the own intent answers before the uncertainty test, at read_ts.
    """
    chains = versions.groupBy("key").agg(F.lit(True).alias("chain"))
    at = as_of(versions, as_of(versions, reads, "read_ts", "now"), "uncertainty_limit", "later")
    i = intents.select("key", F.col("txn").alias("i_txn"), F.col("start_ts").alias("i_start"), F.col("value").alias("i_value"))
    r = at.join(i, "key", "left").join(chains, "key", "left")
    foreign = F.col("i_txn").isNotNull() & (F.col("i_txn") != F.col("reader")) & (F.col("i_start") <= F.col("read_ts"))
    own = F.col("i_txn").isNotNull() & (F.col("i_txn") == F.col("reader"))
    uncertain = F.coalesce((F.col("uncertainty_limit") > F.col("read_ts")) & (F.col("later.commit_ts") > F.col("read_ts")), F.lit(False))
    bare = F.col("chain").isNull()
    found = F.col("now").isNotNull() & ~F.coalesce(F.col("now.tombstone"), F.lit(False))
    outcome = F.when(foreign, "blocked")
    if own_first:
        outcome = outcome.when(own, "found")
    outcome = outcome.when(bare & own, "found").when(bare, "not_found").when(uncertain, "uncertain").when(own, "found").when(found, "found").otherwise("not_found")
    r = r.withColumns({"outcome": outcome, "mine": own & (F.lit(own_first) | bare | ~uncertain) & ~foreign})
    value = F.when(F.col("mine"), F.col("i_value")).when(F.col("outcome") == "found", F.col("now.value"))
    ts = F.when(F.col("outcome") == "uncertain", F.col("later.commit_ts")).when(F.col("mine"), F.col("read_ts") if own_first else F.lit(0).cast("long")).when(F.col("outcome") == "blocked", F.col("i_start")).otherwise(F.coalesce("now.commit_ts", F.lit(0).cast("long")))
    return r.select("key", "read_ts", "reader", "outcome", value.alias("value"), ts.alias("ts"), F.when(F.col("outcome") == "blocked", F.col("i_txn")).alias("blocker"))


def gc_split(versions: DataFrame, safepoint: DataFrame) -> DataFrame:
    """Versions with `kept`: all after the safepoint, and of those up to it the newest of each key, tombstone or not."""
    old = versions.join(F.broadcast(safepoint))
    rank = F.row_number().over(Window.partitionBy("key", F.col("commit_ts") <= F.col("safepoint")).orderBy(F.col("commit_ts").desc()))
    return old.withColumn("kept", (F.col("commit_ts") > F.col("safepoint")) | (rank == 1))


def versions_of(versions: DataFrame) -> DataFrame:
    """(key, n, newest, chain): every version newest first, with its tombstone flag, uncapped."""
    chain = F.sort_array(F.collect_list(F.struct("commit_ts", "tombstone", "value")), False)
    return versions.groupBy("key").agg(F.count("*").alias("n"), chain.alias("chain")).select("key", "n", F.element_at("chain", 1)["commit_ts"].alias("newest"), "chain")


def safepoint(closed: DataFrame, commits: DataFrame, starts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row (safepoint): the least of the closed timestamp, the highest commit, open starts and snapshots."""
    lows = [closed.agg(F.max("ts").alias("ts")), commits.agg(F.max("ts").alias("ts")), starts.agg(F.min("ts").alias("ts")), snapshots.agg(F.min("ts").alias("ts"))]
    every = lows[0]
    for x in lows[1:]:
        every = every.union(x)
    return every.agg(F.min("ts").alias("safepoint"))


def order_violations(versions: DataFrame, position: str) -> DataFrame:
    """Versions that are not strictly older than the one before them in a chain listed by `position`."""
    prev = F.lag("commit_ts").over(Window.partitionBy("key").orderBy(position))
    return versions.withColumn("previous", prev).where(F.col("commit_ts") >= F.col("previous"))


def apply_decisions(versions: DataFrame, intents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, intents) after decisions (txn, status, commit_ts): committed intents become versions, aborted ones go."""
    d = decisions.select("txn", "status", F.col("commit_ts").alias("__ts"))
    due = intents.join(d, "txn")
    new = due.where("status = 'committed'").select("key", F.col("__ts").alias("commit_ts"), F.lit(False).alias("tombstone"), "value")
    rest = intents.join(due.where("status in ('committed', 'aborted')").select("key", "txn"), ["key", "txn"], "left_anti")
    return versions.select("key", "commit_ts", "tombstone", "value").unionByName(new), rest


def commit_all(writes: DataFrame, intents: DataFrame, versions: DataFrame) -> DataFrame:
    """(txn, ok) for writes (txn, key, commit_ts): each key needs the txn's intent, or a version at exactly commit_ts."""
    mine = intents.select("txn", "key", F.lit(True).alias("mine"))
    done = versions.select("key", "commit_ts", F.lit(True).alias("done"))
    j = writes.join(mine, ["txn", "key"], "left").join(done, ["key", "commit_ts"], "left")
    return j.groupBy("txn").agg(F.bool_and(F.coalesce("mine", "done", F.lit(False))).alias("ok"))


def put_intents(requests: DataFrame, held: DataFrame) -> DataFrame:
    """(log_index, key, txn, ok): a request is refused while another transaction holds the key's intent.

    Only the first holder of a key can ever be granted in a batch without releases: the held one, or the earliest request.
    """
    first = F.first("txn").over(Window.partitionBy("key").orderBy("log_index").rowsBetween(Window.unboundedPreceding, 0))
    r = requests.join(held.select("key", F.col("txn").alias("holder")), "key", "left").withColumn("first", first)
    return r.select("log_index", "key", "txn", (F.coalesce("holder", "first") == F.col("txn")).alias("ok"))


def resolve_locks(requests: DataFrame) -> DataFrame:
    """Outcome of each lock request (log_index, key, txn, start_ts, shared), in log order within its key.

    already_held, granted, wound (an older requester meets a younger holder) or wait. The state is the list of
    holders of one key, so each key's requests fold in one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        holders: dict[int, tuple[int, bool]] = {}
        out = []
        for r in pdf.sort_values("log_index").itertuples():
            mine = holders.get(r.txn)
            if mine is not None and (r.shared or not mine[1]):
                out.append("already_held")
                continue
            clash = [(t, s) for t, (s, shared) in sorted(holders.items()) if t != r.txn and not (shared and r.shared)]
            if not clash:
                holders[r.txn] = (r.start_ts, bool(r.shared))
                out.append("granted")
            else:
                t, s = clash[0]
                out.append("wound" if (r.start_ts, r.txn) < (s, t) else "wait")
        return pdf.sort_values("log_index")[["log_index", "key", "txn"]].assign(outcome=out)

    kinds = dict(requests.dtypes)
    return requests.groupBy("key").applyInPandas(fold, f"log_index {kinds['log_index']}, key {kinds['key']}, txn {kinds['txn']}, outcome string")


def wait_die_violations(waits: DataFrame, txns: DataFrame) -> DataFrame:
    """Waits in which the waiter is older than its blocker: wound-wait should have wounded instead."""
    w = txns.select(F.col("txn").alias("waiter"), F.col("start_ts").alias("w_ts"))
    b = txns.select(F.col("txn").alias("blocker"), F.col("start_ts").alias("b_ts"))
    return waits.join(w, "waiter").join(b, "blocker").where(is_older(F.col("w_ts"), F.col("waiter"), F.col("b_ts"), F.col("blocker"))).select("waiter", "blocker")


def wait_cycles(waits: DataFrame) -> DataFrame:
    """(waiter, cycle_length): waiters whose chain of blockers comes back to them, after however many hops.

    Each waiter waits for one other. Pointer doubling: every round is one equi-join that doubles all walks, and those
    that reach somebody who doesn't wait end. After as many hops as there are waiters, walks end at exactly the members
    of cycles; a member's walk has been all around by then, so its smallest waiter names the cycle.
    """
    from tessera.sources.files import written

    at = written(waits.select("waiter", F.col("blocker").alias("at"), F.col("waiter").alias("least")).distinct())
    n, hops = at.count(), 1
    while hops < n:
        nxt = at.select(F.col("waiter").alias("at"), F.col("at").alias("at2"), F.col("least").alias("more"))
        at = written(at.join(nxt, "at").select("waiter", F.col("at2").alias("at"), F.least("least", "more").alias("least")))
        if at.isEmpty():
            break
        hops *= 2
    members = at.join(at.select("at").distinct().withColumnRenamed("at", "waiter"), "waiter").select("waiter", "least")
    return members.join(members.groupBy("least").agg(F.count("*").alias("cycle_length")), "least").select("waiter", "cycle_length")
