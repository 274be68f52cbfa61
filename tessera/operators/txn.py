"""Distributed transactions: prewrites, records, refreshes, verdicts and clocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import contains, expired, terminal
from tessera.operators.versions import as_of


def prewrites(requests: DataFrame, intents: DataFrame, versions: DataFrame) -> DataFrame:
    """(txn, key, result) of prewrites (txn, key, epoch, start_ts) against a state.

    An own intent of a later epoch makes it stale_epoch, else it is ok; another's intent locks; a version newer than
    the start is a conflict.
    """
    i = intents.select("key", F.col("txn").alias("i_txn"), F.col("epoch").alias("i_epoch"))
    newest = versions.groupBy("key").agg(F.max("commit_ts").alias("newest"))
    r = requests.join(i, "key", "left").join(newest, "key", "left")
    own = F.col("i_txn") == F.col("txn")
    result = F.when(own & (F.col("epoch") < F.col("i_epoch")), "stale_epoch").when(own, "ok").when(F.col("i_txn").isNotNull(), "locked").when(F.col("newest") > F.col("start_ts"), "conflict").otherwise("ok")
    return r.select("txn", "key", result.alias("result"))


def resolutions(requests: DataFrame, intents: DataFrame) -> DataFrame:
    """(txn, key, op, result) of commits and rollbacks (txn, key, epoch, op) of intents."""
    i = intents.select("key", F.col("txn").alias("i_txn"), F.col("epoch").alias("i_epoch"))
    r = requests.join(i, "key", "left")
    stale = F.when(F.col("op") == "commit", F.col("i_epoch") != F.col("epoch")).otherwise(F.col("i_epoch") > F.col("epoch"))
    result = F.when(F.col("i_txn").isNull(), "not_found").when(F.col("i_txn") != F.col("txn"), "rejected").when(stale, "stale_epoch").otherwise("ok")
    return r.select("txn", "key", "op", result.alias("result"))


def record_lattice(writes: DataFrame) -> DataFrame:
    """(log_index, txn, result, status) of record writes folded in log order, a transaction a group.

    Writes are (log_index, txn, epoch, status, commit_ts, heartbeat, pushed_to, keys). A terminal record never changes:
    an identical replay is ok, else the write meets `terminal`. A lower epoch is stale. Heartbeat and pushed_to only
    rise; a pending write onto a record leaves status, commit timestamp and keys; empty keys replace none.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rec: dict | None = None
        out = []
        for w in pdf.sort_values("log_index").itertuples():
            keys = list(w.keys) if w.keys is not None else []
            if rec is None:
                rec = {"epoch": w.epoch, "status": w.status, "commit": w.commit_ts, "beat": w.heartbeat, "push": w.pushed_to, "keys": keys}
                result = "ok"
            elif rec["status"] in ("committed", "aborted"):
                result = "ok" if (w.status, w.commit_ts, w.epoch) == (rec["status"], rec["commit"], rec["epoch"]) else "terminal"
            elif w.epoch < rec["epoch"]:
                result = "stale_epoch"
            else:
                rec["epoch"], rec["beat"], rec["push"] = w.epoch, max(rec["beat"], w.heartbeat), max(rec["push"], w.pushed_to)
                if w.status != "pending":
                    rec["status"], rec["commit"] = w.status, w.commit_ts
                    rec["keys"] = keys or rec["keys"]
                result = "ok"
            out.append((w.log_index, w.txn, result, rec["status"]))
        return pd.DataFrame(out, columns=["log_index", "txn", "result", "status"])

    return writes.groupBy("txn").applyInPandas(fold, "log_index long, txn long, result string, status string")


def push_records(pushes: DataFrame, records: DataFrame, now) -> DataFrame:
    """(txn, status, pushed_to) after one push each: absent records become aborted, terminal ones stay, expired ones abort."""
    r = records.select("txn", F.col("status").alias("old"), F.col("pushed_to").alias("at"), "ttl", "heartbeat")
    j = pushes.join(r, "txn", "left")
    dead = expired(F.col("ttl"), F.col("heartbeat"), F.lit(now))
    status = F.when(F.col("old").isNull(), "aborted").when(terminal(F.col("old")), F.col("old")).when(dead, "aborted").otherwise(F.col("old"))
    to = F.when(F.col("old").isNull(), F.col("push_to")).when(terminal(F.col("old")) | dead, F.col("at")).otherwise(F.greatest("at", "push_to"))
    return j.select("txn", status.alias("status"), to.alias("pushed_to"))


def read_refresh(read_set: DataFrame, versions: DataFrame) -> DataFrame:
    """(txn, ok): whether every key that a transaction read (txn, key, read_ts, up_to) shows the same version at up_to."""
    both = as_of(versions, as_of(versions, read_set, "read_ts", "seen"), "up_to", "now")
    same = F.col("seen.commit_ts").eqNullSafe(F.col("now.commit_ts"))
    return both.groupBy("txn").agg(F.bool_and(same).alias("ok"))


def commit_verdicts(prewritten: DataFrame, refreshed: DataFrame, isolation: str = "serializable") -> DataFrame:
    """(txn, verdict): aborted on any failed prewrite, or, above snapshot isolation, on a failed refresh."""
    p = prewritten.groupBy("txn").agg(F.bool_and(F.col("result") == "ok").alias("written"))
    j = p.join(refreshed, "txn", "full")
    fresh = F.lit(True) if isolation == "snapshot" else F.coalesce("ok", F.lit(True))
    return j.select("txn", F.when(F.coalesce("written", F.lit(True)) & fresh, "committed").otherwise("aborted").alias("verdict"))


def implicit_commits(records: DataFrame, intents: DataFrame, versions: DataFrame) -> DataFrame:
    """(txn, committed) of staging records (txn, epoch, commit_ts, keys): each key has the intent of this epoch, or a
    version at the record's non-zero commit timestamp; a record without keys is not committed."""
    r = records.where("status = 'staging'").select("txn", "epoch", "commit_ts", F.explode_outer("keys").alias("key"))
    i = intents.select("txn", "epoch", "key", F.lit(True).alias("laid"))
    v = versions.select("key", "commit_ts", F.lit(True).alias("done"))
    j = r.join(i, ["txn", "epoch", "key"], "left").join(v, ["key", "commit_ts"], "left")
    there = F.coalesce("laid", F.lit(False)) | (F.coalesce("done", F.lit(False)) & (F.col("commit_ts") != 0))
    return j.groupBy("txn").agg(F.bool_and(there & F.col("key").isNotNull()).alias("committed"))


def resolved_blockers(intents: DataFrame, records: DataFrame) -> DataFrame:
    """(key, txn, action): what a push of each intent's record leads to: roll_back, commit or wait; none aborts."""
    r = records.select("txn", "status")
    action = F.when(F.col("status").isNull() | (F.col("status") == "aborted"), "roll_back").when(F.col("status") == "committed", "commit").otherwise("wait")
    return intents.join(r, "txn", "left").select("key", "txn", action.alias("action"))


def orphaned_intents(intents: DataFrame, records: DataFrame) -> DataFrame:
    """(key, txn, status) of intents whose record is absent or not terminal."""
    return intents.join(records.select("txn", "status"), "txn", "left").where("status is null or status not in ('committed', 'aborted')").select("key", "txn", "status")


def best_records(copies: DataFrame) -> DataFrame:
    """Each transaction's record among copies on several ranges: terminal before pending, then the higher epoch."""
    cols = [c for c in copies.columns if c != "txn"]
    rank = F.struct(F.when(terminal(F.col("status")), 1).otherwise(0), F.col("epoch"))
    return copies.groupBy("txn").agg(F.max_by(F.struct(*cols), rank).alias("r")).select("txn", *(F.col(f"r.{c}") for c in cols))


def audited_values(versions: DataFrame, intents: DataFrame, records: DataFrame) -> DataFrame:
    """(key, value): a committed record's intent wins over the newest version; tombstones have no value."""
    newest = versions.groupBy("key").agg(F.max_by(F.struct("tombstone", "value"), "commit_ts").alias("v"))
    due = intents.join(records.where("status = 'committed'").select("txn"), "txn").select("key", F.col("value").alias("i_value"), F.lit(True).alias("due"))
    j = newest.join(due, "key", "full")
    return j.select("key", F.when(F.col("due"), F.col("i_value")).when(~F.col("v.tombstone"), F.col("v.value")).alias("value"))


def export_span(rows: DataFrame, lo=None, hi=None) -> DataFrame:
    """The rows of a key span; records go by their primary, which is their key here."""
    return rows.where(contains(F.lit(lo), F.lit(hi), F.col("key")))


def oracle_reservations(requests: DataFrame) -> DataFrame:
    """(log_index, first, last) that a timestamp oracle grants requests (part, log_index, n), in log order."""
    last = F.sum("n").over(Window.partitionBy("part").orderBy("log_index").rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("last", last).select("part", "log_index", (F.col("last") - F.col("n") + 1).alias("first"), "last")


def hybrid_clock(ticks: DataFrame) -> DataFrame:
    """(node, seq, ts): a node's clock readings, each max(wall, the last + 1).

    In closed form: the running maximum of wall - position, and the position on top.
    """
    order = Window.partitionBy("node").orderBy("seq")
    n = ticks.withColumn("i", F.row_number().over(order))
    lead = F.max(F.col("wall") - F.col("i")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("node", "seq", (lead + F.col("i")).alias("ts"))
