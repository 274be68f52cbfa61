"""Workload audits: conservation, lost and doubled operations, durability, freshness."""

from __future__ import annotations

from array import array
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import Decided, attempts, fold_rows, nothing


def first_attempts(ops: DataFrame) -> DataFrame:
    """Each operation's first entry in the log; retries of an op_id return its outcome and change nothing."""
    rank = F.row_number().over(Window.partitionBy("op_id").orderBy("log_index"))
    return ops.withColumn("__n", rank).where("__n = 1").drop("__n")


def conservation(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row: accounts, their total before and after all transfers were applied once, unconditionally."""
    t = first_attempts(transfers)
    moves = t.select(F.explode(F.array(F.struct(F.col("source").alias("account"), (-F.col("amount")).alias("d")), F.struct(F.col("target").alias("account"), F.col("amount").alias("d")))).alias("m")).select("m.*")
    change = moves.groupBy("account").agg(F.sum("d").alias("d"))
    j = accounts.join(change, "account", "full")
    before, after = F.coalesce("balance", F.lit(0)), F.coalesce("balance", F.lit(0)) + F.coalesce("d", F.lit(0))
    return j.agg(F.count("balance").alias("accounts"), F.sum(before).alias("before"), F.sum(after).alias("after"))


def transfer_ledger(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """(part, log_index, op_id, outcome) of transfers folded in log order, each group of accounts its own state.

    Transfers carry a `part`, the replicated range that both accounts lie in (wrong_range where target's part
    differs, as `target_part`). A retry returns the recorded outcome; a balance below the amount refuses; a transfer to the wrong
    range is not recorded, as another range may decide it. A part's fold holds its accounts' balances and the outcomes of
    operations that will be tried again.
    """
    counted = attempts(transfers, "part", "op_id")
    moves = counted.select("part", F.lit(1).alias("kind"), "log_index", "op_id", "source", "target", "target_part", "amount", "attempts")
    null = F.lit(None).cast("long")
    held = accounts.where("account is not null").select("part", F.lit(0).alias("kind"), null.alias("log_index"), null.alias("op_id"), F.col("account").alias("source"), null.alias("target"), null.alias("target_part"), F.coalesce("balance", F.lit(0)).alias("amount"), null.alias("attempts"))

    def make(part):
        names, balance, decided = array("q"), array("q"), Decided()

        def place(account) -> int:
            """Accounts come first, in ascending order."""
            i = bisect_left(names, account) if account is not None else len(names)
            return i if i < len(names) and names[i] == account else -1

        def step(part, kind, log_index, op_id, source, target, target_part, amount, tries):
            if kind == 0:
                names.append(source)
                balance.append(amount)
                return None
            outcome = decided.known(op_id, tries)
            if outcome is None:
                a, b = (place(source), place(target)) if target_part == part else (-1, -1)
                if a < 0 or b < 0:
                    outcome = "wrong_range"
                elif balance[a] < amount:
                    outcome = decided.decide(op_id, "insufficient_funds")
                else:
                    balance[a] -= amount
                    balance[b] += amount
                    outcome = decided.decide(op_id, "ok")
            return part, log_index, op_id, outcome

        return step, nothing

    return fold_rows(held.unionByName(moves), "part", ["kind", "log_index", "op_id", "source"], make, "part long, log_index long, op_id long, outcome string")


def lost_operations(acknowledged: DataFrame, remembered: DataFrame, keys: list[str]) -> DataFrame:
    """Acknowledged rows that nothing remembers."""
    return acknowledged.select(*keys).distinct().join(remembered.select(*keys), keys, "left_anti")


def multiples(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def durability(acked: DataFrame, held: DataFrame, members: DataFrame) -> DataFrame:
    """(key, node) where a live member lacks a key's newest acknowledged write (key, idx) or has an older one (node, key, idx)."""
    newest = acked.groupBy("key").agg(F.max("idx").alias("want"))
    have = held.groupBy("node", "key").agg(F.max("idx").alias("has"))
    want = newest.join(F.broadcast(members.select("node")))
    return want.join(have, ["node", "key"], "left").where("has is null or has < want").select("key", "node", "want", "has")


def stale_reads(reads: DataFrame, writes: DataFrame, key: str = "key") -> DataFrame:
    """Reads (op, key, invoked, idx) that return less than a write (key, acked, idx) acknowledged strictly before them.

    One running maximum over both sides by time, acknowledgements at the same instant after the read.
    """
    w = writes.select(key, F.col("acked").alias("at"), F.lit(1).alias("kind"), F.col("idx").alias("known"), F.lit(None).cast(dict(reads.dtypes)["op"]).alias("op"), F.lit(None).cast("long").alias("idx"))
    r = reads.select(key, F.col("invoked").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("known"), "op", F.col("idx").cast("long").alias("idx"))
    need = F.max("known").over(Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return w.unionByName(r).withColumn("need", need).where("kind = 0 and idx < need").select(key, "op", "idx", "need")


def session_kv(commands: DataFrame) -> DataFrame:
    """(key, value): last writes in log order, of commands (client, seq, idx, key, value) whose seq exceeds all their
    client's before; a late lower one is ignored."""
    top = F.max("seq").over(Window.partitionBy("client").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    live = commands.withColumn("top", top).where("top is null or seq > top")
    return live.groupBy("key").agg(F.max_by("value", "idx").alias("value"), F.max("idx").alias("idx"))


def freshest_replicas(samples: DataFrame, by: list[str]) -> DataFrame:
    """The live, ready node with the highest applied index for each group; the first node wins ties."""
    cols = [c for c in samples.columns if c not in by]
    best = F.max_by(F.struct(*cols), F.struct("applied", -F.col("node")))
    return samples.where("alive and ready").groupBy(*by).agg(best.alias("r")).select(*by, *(F.col(f"r.{c}") for c in cols))


def owners(claims: DataFrame) -> DataFrame:
    """(key, range_id, node) that answers for each key, of claims (key, range_id, node, generation, applied, frozen).

    Of each range only claims of its newest generation count, of those the most applied; of several ranges one that is
    not frozen, then the smaller id.
    """
    newest = F.max("generation").over(Window.partitionBy("key", "range_id"))
    c = claims.withColumn("top", newest).where("generation = top")
    per = c.groupBy("key", "range_id").agg(F.max_by(F.struct("node", "frozen"), F.struct("applied", -F.col("node"))).alias("r"))
    best = F.max_by(F.struct("range_id", F.col("r.node").alias("node")), F.struct(~F.col("r.frozen"), -F.col("range_id")))
    return per.groupBy("key").agg(best.alias("b")).select("key", "b.range_id", "b.node")


def persistent_suspects(suspects: DataFrame) -> DataFrame:
    """Suspicions (audit, key, owner) raised for the same key and owner at two consecutive audits."""
    prev = Window.partitionBy("key").orderBy("audit")
    s = suspects.withColumns({"before": F.lag("owner").over(prev), "at": F.lag("audit").over(prev)})
    return s.where("before = owner and at = audit - 1").select("audit", "key", "owner")


def model_mismatches(observed: DataFrame, model: DataFrame) -> DataFrame:
    """Snapshot reads (key, read_ts, value) that differ from the model's (null-safe); keys that the model lacks are skipped."""
    m = model.select("key", "read_ts", F.col("value").alias("expected"))
    return observed.join(m, ["key", "read_ts"]).where(~F.col("value").eqNullSafe(F.col("expected")))


def hop_checksums(hops: DataFrame) -> DataFrame:
    """(run, checksum): an order-sensitive digest of each run's hops (run, seq, node, token, hop)."""
    from tessera.functions.columns import rolling_digest

    line = F.concat_ws(":", "node", "token", "hop")
    ordered = hops.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("h")))).alias("l"))
    return ordered.select("run", rolling_digest(F.transform("l", lambda x: x["h"])).alias("checksum"))
