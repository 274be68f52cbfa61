"""Key ranges: routing, tiling, statistics, placement and replay of their commands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import contains
from tessera.operators.folds import Decided, attempts, fold_rows, nothing

TARGET_REPLICAS, SPLIT_KEYS, MERGE_KEYS, MAX_COMMANDS = 3, 24, 6, 2


def route_keys(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key, range_id, generation): the range that holds each key.

    Ranges are a catalogue of at most some hundred rows and are broadcast; route_many takes any number.
    """
    r = ranges.select(F.col("id").alias("range_id"), "start", "end", "generation")
    return keys.join(F.broadcast(r), contains(F.col("start"), F.col("end"), F.col("key"))).select("key", "range_id", "generation")


def route_many(keys: DataFrame, ranges: DataFrame, buckets: int = 64) -> DataFrame:
    """route_keys for catalogues too large to broadcast: the last start at or before the key, then its end.

    Both sides go through one range-partitioned running last value, in `buckets` stretches of the key space; a
    stretch's carried-in range comes from the stretches' own last starts.
    """
    r = ranges.select(F.col("start").alias("k"), F.lit(0).alias("kind"), F.struct("id", "start", "end", "generation").alias("r"), F.lit(None).cast(dict(keys.dtypes)["key"]).alias("key"))
    q = keys.select(F.col("key").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast(r.schema["r"].dataType).alias("r"), "key")
    both = r.unionByName(q)
    edge = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    cut = both.join(F.broadcast(edge)).withColumn("b", F.when(F.col("k").isNull(), -1).otherwise(F.least(F.lit(buckets), F.greatest(F.lit(-1), F.floor((F.col("k") - F.col("lo")) * buckets / (F.col("hi") - F.col("lo") + 1))))))
    near = F.last("r", ignorenulls=True).over(Window.partitionBy("b").orderBy(F.col("k").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0))
    ends = cut.where("kind = 0").groupBy("b").agg(F.max_by("r", F.coalesce("k", F.lit(-(2**62)))).alias("e"))
    carried = ends.withColumnRenamed("b", "eb")
    have = cut.withColumn("near", near).where("kind = 1")
    lost = have.where("near is null").select("b").distinct().join(F.broadcast(carried), F.col("eb") < F.col("b")).groupBy("b").agg(F.max_by("e", "eb").alias("e"))
    out = have.join(F.broadcast(lost), "b", "left").withColumn("near", F.coalesce("near", "e"))
    return out.where(contains(F.col("near.start"), F.col("near.end"), F.col("key"))).select("key", F.col("near.id").alias("range_id"), F.col("near.generation").alias("generation"))


def coverage_violations(ranges: DataFrame) -> DataFrame:
    """(id, problem) of every range, in start order, that breaks the tiling of the key space.

    The first must have an open start, each must begin where the one before ends, none may be empty and only the
    last may have an open end. Ranges are a catalogue: one window over all of them is intended.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("start").asc_nulls_first(), "id")
    r = ranges.withColumns({"n": F.row_number().over(order), "prev": F.lag("end").over(order), "of": F.count("*").over(Window.partitionBy(F.lit(0)))})
    problem = (
        F.when((F.col("n") == 1) & F.col("start").isNotNull(), "does not begin open")
        .when((F.col("n") > 1) & F.col("prev").isNull(), "follows an open end")
        .when((F.col("n") > 1) & (F.col("start").isNull() | (F.col("start") < F.col("prev"))), "overlap")
        .when((F.col("n") > 1) & (F.col("start") > F.col("prev")), "gap")
        .when(F.col("start") >= F.col("end"), "empty")
        .when((F.col("n") == F.col("of")) & F.col("end").isNotNull(), "does not end open")
    )
    return r.withColumn("problem", problem).where("problem is not null").select("id", "problem")


def adjacent_ranges(ranges: DataFrame) -> DataFrame:
    """(left_id, right_id): ranges of which one begins where the other ends."""
    a = ranges.where("`end` is not null").select(F.col("id").alias("left_id"), F.col("end").alias("at"))
    b = ranges.select(F.col("id").alias("right_id"), F.col("start").alias("at"))
    return a.join(b, "at").select("left_id", "right_id")


def range_medians(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, n_keys, median): the key at sorted position n div 2, null for fewer than two keys."""
    routed = route_keys(keys.select("key").distinct(), ranges)
    place = F.row_number().over(Window.partitionBy("range_id").orderBy("key")) - 1
    n = F.count("*").over(Window.partitionBy("range_id"))
    at = routed.withColumns({"place": place, "n_keys": n})
    return at.groupBy("range_id", "n_keys").agg(F.max(F.when((F.col("place") == F.floor(F.col("n_keys") / 2)) & (F.col("n_keys") > 1), F.col("key"))).alias("median"))


def meta_buckets(ranges: DataFrame, per_bucket: int = 4) -> DataFrame:
    """(id, bucket): ranges in start order, so many to a bucket of the second-level index, from 1."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("start").asc_nulls_first())) - 1
    return ranges.select("id", (F.floor(place / per_bucket) + 1).alias("bucket"))


def split_at(rows: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """The rows below and from a key on."""
    return rows.where(F.col("key") < F.lit(at)), rows.where(F.col("key") >= F.lit(at))


def absorb(left: DataFrame, right: DataFrame) -> DataFrame:
    """The union of two spans' rows; of a key in both the higher commit_ts stays."""
    both = left.unionByName(right)
    cols = [c for c in both.columns if c != "key"]
    return both.groupBy("key").agg(F.max_by(F.struct(*cols), "commit_ts").alias("r")).select("key", *(F.col(f"r.{c}") for c in cols))


def newest_descriptors(cached: DataFrame) -> DataFrame:
    """What a client's cache holds after inserting descriptors: each range's highest generation."""
    cols = [c for c in cached.columns if c != "id"]
    return cached.groupBy("id").agg(F.max_by(F.struct(*cols), "generation").alias("r")).select("id", *(F.col(f"r.{c}") for c in cols))


def live_nodes(nodes: DataFrame, now, dead_after) -> DataFrame:
    """Nodes heard of within dead_after, by id."""
    return nodes.where(F.lit(now) - F.col("last_seen") <= F.lit(dead_after)).orderBy("id")


def placement_decisions(replicas: DataFrame, live: DataFrame, max_commands: int = MAX_COMMANDS) -> DataFrame:
    """(range_id, command, target): the first commands, in start order, that improve the placement.

    For each range the first that applies: replace a dead voter (by the smallest live node without a replica),
    reach the target number of replicas, split at SPLIT_KEYS keys, merge with the right neighbour if both have at
    most MERGE_KEYS keys, the same replicas and the same lease holder.
    """
    alive = F.broadcast(live.agg(F.array_sort(F.collect_set(F.col("id").cast("int"))).alias("alive")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("start").asc_nulls_first())
    r = replicas.join(alive).withColumns({"replicas": F.col("replicas").cast("array<int>")})
    r = r.withColumns({"next_keys": F.lead("n_keys").over(order), "next_replicas": F.lead("replicas").over(order), "next_lease": F.lead("lease_holder").over(order)})
    spare = F.try_element_at(F.array_except("alive", "replicas"), F.lit(1))
    dead = F.try_element_at(F.array_except("replicas", "alive"), F.lit(1))
    r = r.withColumns({"spare": spare, "dead": dead})
    command = (
        F.when(F.col("dead").isNotNull() & (F.size("replicas") > 1) & F.col("spare").isNotNull(), F.struct(F.lit("replace").alias("command"), F.col("spare").cast("long").alias("target")))
        .when((F.size("replicas") < TARGET_REPLICAS) & F.col("spare").isNotNull(), F.struct(F.lit("add").alias("command"), F.col("spare").cast("long").alias("target")))
        .when(F.col("n_keys") >= SPLIT_KEYS, F.struct(F.lit("split").alias("command"), F.col("range_id").alias("target")))
        .when((F.col("n_keys") <= MERGE_KEYS) & (F.col("next_keys") <= MERGE_KEYS) & (F.col("replicas") == F.col("next_replicas")) & (F.col("lease_holder") == F.col("next_lease")), F.struct(F.lit("merge").alias("command"), F.col("range_id").alias("target")))
    )
    due = r.withColumn("c", command).where("c is not null")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("start").asc_nulls_first()))
    return due.withColumn("rank", rank).where(F.col("rank") <= max_commands).select("range_id", "c.command", "c.target")


def keys_outside(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (key, range_id) that lie outside the span of the range that holds them."""
    r = ranges.select(F.col("id").alias("range_id"), "start", "end")
    return keys.join(F.broadcast(r), "range_id").where(~contains(F.col("start"), F.col("end"), F.col("key"))).select("key", "range_id")


COMMAND = "group long, log_index long, op string, range_id long, other long, generation long, at long, replicas array<int>, learners array<int>, node long, time long, value long"


class _Topology:
    """One group's ranges, node health and range reports; `apply` says whether a command's conditions held."""

    def __init__(self) -> None:
        self.ranges: dict[int, dict] = {}
        self.health: dict[int, int] = {}
        self.reports: dict[int, dict] = {}
        self.next_id = 1

    def add(self, start, end, replicas, learners) -> None:
        self.ranges[self.next_id] = {"start": start, "end": end, "generation": 1, "replicas": sorted(replicas), "learners": sorted(learners), "frozen": False, "lease": (0, 0, 0)}
        self.next_id += 1

    def known(self, c) -> dict | None:
        """The command's range, if its generation is the one expected (0: any)."""
        r = self.ranges.get(c["range_id"])
        return r if r is not None and c["generation"] in (0, r["generation"]) else None

    def apply(self, c: dict) -> bool:
        step = getattr(self, f"on_{c['op']}", None)
        return bool(step and step(c))

    def on_bootstrap(self, c) -> bool:
        if self.ranges:
            return False
        self.add(None, None, c["replicas"], c["learners"])
        return True

    def on_split(self, c) -> bool:
        r, at = self.known(c), c["at"]
        if r is None or r["frozen"] or at is None or (r["start"] is not None and at <= r["start"]) or (r["end"] is not None and at >= r["end"]):
            return False
        self.add(at, r["end"], r["replicas"], r["learners"])
        r["end"] = at
        r["generation"] += 1
        return True

    def on_begin_merge(self, c) -> bool:
        left, right = self.known(c), self.ranges.get(c["other"])
        if left is None or right is None or left["end"] is None or left["end"] != right["start"] or left["frozen"] or right["frozen"]:
            return False
        if left["replicas"] != right["replicas"] or left["lease"][0] == 0 or left["lease"][0] != right["lease"][0]:
            return False
        right["frozen"] = True
        right["generation"] += 1
        return True

    def on_abort_merge(self, c) -> bool:
        right = self.ranges.get(c["other"])
        if right is None or not right["frozen"]:
            return False
        right["frozen"] = False
        right["generation"] += 1
        return True

    def on_finish_merge(self, c) -> bool:
        left, right = self.ranges.get(c["range_id"]), self.ranges.get(c["other"])
        if left is None or right is None or not right["frozen"] or left["end"] != right["start"]:
            return False
        left["end"] = right["end"]
        left["generation"] += 1
        del self.ranges[c["other"]]
        self.reports.pop(c["other"], None)
        return True

    def on_change_replicas(self, c) -> bool:
        r, new = self.known(c), sorted(c["replicas"])
        if r is None or not new:
            return False
        both = len(set(new) & set(r["replicas"]))
        if 2 * both <= len(r["replicas"]) or 2 * both <= len(new):
            return False
        r["replicas"], r["learners"] = new, sorted(c["learners"])
        r["generation"] += 1
        if r["lease"][0] not in new:
            r["lease"] = (0, 0, 0)
        return True

    def on_grant_lease(self, c) -> bool:
        """Published only: no new generation, and none that begins before the one known."""
        r = self.ranges.get(c["range_id"])
        if r is None or c["time"] < r["lease"][1]:
            return False
        r["lease"] = (c["node"], c["time"], c["value"])
        return True

    def on_node_heartbeat(self, c) -> bool:
        self.health[c["node"]] = max(self.health.get(c["node"], 0), c["time"])
        return True

    def on_report_size(self, c) -> bool:
        if c["range_id"] not in self.ranges:
            return False
        self.reports.setdefault(c["range_id"], {"caught_up": set()}).update(keys=c["value"], median=c["at"], reported_at=c["time"])
        return True

    def on_report_catchup(self, c) -> bool:
        r = self.ranges.get(c["range_id"])
        if r is None or c["node"] not in (*r["replicas"], *r["learners"]):
            return False
        self.reports.setdefault(c["range_id"], {"caught_up": set()})["caught_up"].add(c["node"])
        return True

    def on_set_descriptor(self, c) -> bool:
        r = self.ranges.get(c["range_id"])
        if r is None:
            return False
        r["end"] = c["at"]
        r["generation"] += 1
        return True


def _commands(pdf: pd.DataFrame) -> list[dict]:
    """A group's commands in log order, nulls as None, 0 or no members."""
    out = []
    for c in pdf.sort_values("log_index").to_dict("records"):
        for k in ("range_id", "other", "generation", "node", "time", "value"):
            c[k] = 0 if pd.isna(c[k]) else int(c[k])
        c["at"] = None if pd.isna(c["at"]) else int(c["at"])
        for k in ("replicas", "learners"):
            c[k] = [] if c[k] is None else [int(n) for n in c[k]]
        out.append(c)
    return out


def replay_topology(commands: DataFrame) -> DataFrame:
    """(group, log_index, op, accepted) of topology commands (COMMAND) folded in log order.

    Each command depends on all before it, so a group is one fold. Rejected commands change nothing.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = _Topology()
        return pd.DataFrame([(c["group"], c["log_index"], c["op"], state.apply(c)) for c in _commands(pdf)], columns=["group", "log_index", "op", "accepted"])

    return commands.groupBy("group").applyInPandas(fold, "group long, log_index long, op string, accepted boolean")


def final_topology(commands: DataFrame) -> DataFrame:
    """(group, id, start, end, generation, replicas, learners, frozen, lease_holder, n_keys, caught_up) after all commands."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = _Topology()
        rows = _commands(pdf)
        for c in rows:
            state.apply(c)
        out = []
        for i, r in sorted(state.ranges.items()):
            seen = state.reports.get(i, {})
            out.append((rows[0]["group"], i, r["start"], r["end"], r["generation"], r["replicas"], r["learners"], r["frozen"], r["lease"][0], seen.get("keys"), sorted(seen.get("caught_up", ()))))
        names = ["group", "id", "start", "end", "generation", "replicas", "learners", "frozen", "lease_holder", "n_keys", "caught_up"]
        frame = pd.DataFrame(out, columns=names)
        for k in ("start", "end", "n_keys"):
            frame[k] = frame[k].astype("Int64")
        return frame

    return commands.groupBy("group").applyInPandas(fold, "group long, id long, start long, end long, generation long, replicas array<int>, learners array<int>, frozen boolean, lease_holder long, n_keys long, caught_up array<int>")


def replay_range(commands: DataFrame, clock_bound: int = 2) -> DataFrame:
    """(range_id, log_index, op, outcome) of one range's own log, folded in order, a range a group.

    Commands are (range_id, log_index, op, at, end, generation, node, time, expiry, op_id, source, target, amount). init opens a span
    [at, end) with its accounts at `amount` each once used; split cuts the span at `at` and lets the keys beyond go; merge takes over a right
    neighbour that begins where the span ends; freeze stops transfers; set_descriptor takes a generation that
    is not lower; a lease by a new holder must begin twice the clock bound after the old one's expiry. transfer: a retry
    of an op_id returns what was decided, else uninitialised, frozen, wrong_range (a key outside or another generation),
    insufficient_funds or applied; only the last two are remembered, and those no longer than until the op_id's last attempt.
    """

    names = ["range_id", "log_index", "op", "at", "end", "generation", "node", "time", "expiry", "op_id", "source", "target", "amount"]
    counts = ("generation", "node", "time", "expiry", "amount")
    moves = F.col("op") == "transfer"
    counted = attempts(commands.select(names), "range_id", F.when(moves, F.col("op_id")), F.when(moves, None).otherwise(F.col("log_index")))

    def make(_):
        s = {"ready": False, "start": None, "end": None, "generation": 1, "frozen": False, "lease": (0, 0, 0), "opening": 0}
        balance: dict[int, int] = {}
        decided = Decided()
        inside = lambda k: (s["start"] is None or k >= s["start"]) and (s["end"] is None or k < s["end"])

        def transfer(c) -> str:
            known = decided.known(c["op_id"], c["attempts"])
            if known is not None:
                return known
            if not s["ready"]:
                return "uninitialised"
            if s["frozen"]:
                return "frozen"
            if not (inside(c["source"]) and inside(c["target"])) or c["generation"] != s["generation"]:
                return "wrong_range"
            have = balance.get(c["source"], s["opening"])
            if have < c["amount"]:
                return decided.decide(c["op_id"], "insufficient_funds")
            balance[c["source"]] = have - c["amount"]
            balance[c["target"]] = balance.get(c["target"], s["opening"]) + c["amount"]
            return decided.decide(c["op_id"], "applied")

        def change(c) -> bool:
            op, at = c["op"], c["at"]
            if op == "init" and not s["ready"]:
                s.update(ready=True, start=at, end=c["end"], opening=c["amount"], generation=max(1, c["generation"]))
            elif op == "split" and s["ready"] and not s["frozen"] and at is not None and (s["start"] is None or at > s["start"]) and (s["end"] is None or at < s["end"]):
                s.update(end=at, generation=max(s["generation"], c["generation"]))
                for k in [k for k in balance if k >= at]:
                    del balance[k]
            elif op == "merge" and not s["frozen"] and at == s["end"]:
                s.update(end=c["end"], generation=max(s["generation"], c["generation"]))
            elif op == "freeze":
                s["frozen"] = True
            elif op == "set_descriptor" and c["generation"] >= s["generation"]:
                s["generation"] = c["generation"]
            elif op == "grant_lease" and (c["node"] == s["lease"][0] or c["time"] >= s["lease"][2] + 2 * clock_bound or s["lease"][0] == 0):
                s["lease"] = (c["node"], c["time"], c["expiry"])
            else:
                return False
            return True

        def step(*values):
            c = dict(zip((*names, "attempts"), values, strict=True))
            for k in counts:
                c[k] = c[k] or 0
            return c["range_id"], c["log_index"], c["op"], transfer(c) if c["op"] == "transfer" else "applied" if change(c) else "ignored"

        return step, nothing

    return fold_rows(counted, "range_id", ["log_index", "op_id"], make, "range_id long, log_index long, op string, outcome string")
