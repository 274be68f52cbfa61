"""Isolation checking: version orders, dependency edges, cycles, anomalies and verdicts."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_rows

#: Dependency types in the order in which parallel edges are tried, levels, and what each forbids.
EDGE_ORDER = {"ww": 0, "wr": 1, "rw": 2, "rt": 3}
LEVELS = ("read-uncommitted", "read-committed", "snapshot-isolation", "serializable", "strict-serializable")
ALWAYS = ("duplicate-element", "version-order-conflict")
FORBIDS = {
    "read-uncommitted": ("G0",),
    "read-committed": ("G0", "G1a", "G1b", "G1c"),
    "snapshot-isolation": ("G0", "G1a", "G1b", "G1c", "G-single"),
    "serializable": ("G0", "G1a", "G1b", "G1c", "G-single", "G2-item"),
    "strict-serializable": ("G0", "G1a", "G1b", "G1c", "G-single", "G2-item", "real-time-violation"),
}
H = "history_id"
#: The type of rows that give a transaction's time instead of an edge.
SPAN = "span"
#: So many real-time edges of a component are kept at once.
KEPT = 1 << 18


def serial_model(mops: DataFrame) -> DataFrame:
    """mops with `observed` for reads: the key's list so far, own earlier appends included."""
    seen = F.collect_list("element").over(Window.partitionBy(H, "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return mops.withColumn("observed", F.when(F.col("type") == "read", seen))


def writers(mops: DataFrame) -> DataFrame:
    """(history_id, key, element, txn_id): the first transaction that appended the element, aborted ones too."""
    return mops.where("type = 'append'").groupBy(H, "key", "element").agg(F.min_by("txn_id", "pos").alias("txn_id"))


def duplicate_elements(mops: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Elements that two transactions appended: the first, and the first other one."""
    first = (by or writers(mops)).withColumnRenamed("txn_id", "first_txn")
    a = mops.where("type = 'append'").join(first, [H, "key", "element"]).where("txn_id <> first_txn")
    return a.groupBy(H, "key", "element", "first_txn").agg(F.min_by("txn_id", "pos").alias("other_txn"))


def version_orders(mops: DataFrame) -> DataFrame:
    """(history_id, key, elements, conflicted): the first longest read of a key; conflicted if some read is no prefix of it."""
    reads = mops.where("type = 'read'").select(H, "key", "pos", "observed")
    longest = reads.groupBy(H, "key").agg(F.max_by("observed", F.struct(F.size("observed"), -F.col("pos"))).alias("elements"))
    bad = F.col("observed") != F.slice("elements", F.lit(1), F.size("observed"))
    return reads.join(longest, [H, "key"]).groupBy(H, "key").agg(F.first("elements").alias("elements"), F.bool_or(bad).alias("conflicted"))


def aborted_reads(mops: DataFrame, history: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """G1a: (history_id, reader, writer, key, element) of reads that hold an element of another, aborted transaction."""
    seen = mops.where("type = 'read'").select(H, F.col("txn_id").alias("reader"), "key", F.explode("observed").alias("element")).distinct()
    bad = history.where("outcome = 'aborted'").select(H, F.col("txn_id").alias("writer"))
    w = (by or writers(mops)).withColumnRenamed("txn_id", "writer").join(bad, [H, "writer"])
    return seen.join(w, [H, "key", "element"]).where("reader <> writer").select(H, "reader", "writer", "key", "element")


def intermediate_reads(mops: DataFrame, history: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """G1b: reads whose last element is not the last that its committed writer appended to the key."""
    last = mops.where("type = 'append'").groupBy(H, F.col("txn_id").alias("writer"), "key").agg(F.max_by("element", "pos").alias("final"))
    seen = mops.where("type = 'read' and size(observed) > 0").select(H, F.col("txn_id").alias("reader"), "key", F.element_at("observed", -1).alias("element")).distinct()
    good = history.where("outcome = 'committed'").select(H, F.col("txn_id").alias("writer"))
    w = (by or writers(mops)).withColumnRenamed("txn_id", "writer").join(good, [H, "writer"])
    j = seen.join(w, [H, "key", "element"]).join(last, [H, "writer", "key"])
    return j.where("reader <> writer and element <> final").select(H, "reader", "writer", "key", "element")


def _placed(orders: DataFrame) -> DataFrame:
    return orders.where("not conflicted").select(H, "key", F.posexplode("elements").alias("at", "element"))


def edges_ww(mops: DataFrame, orders: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """Writers of consecutive versions. Version orders and writers may be given, as to the other functions of edges."""
    orders, by = orders or version_orders(mops), by or writers(mops)
    w = _placed(orders).join(by, [H, "key", "element"])
    nxt = F.lead("txn_id").over(Window.partitionBy(H, "key").orderBy("at"))
    near = F.lead("at").over(Window.partitionBy(H, "key").orderBy("at"))
    e = w.withColumns({"dst": nxt, "next": near}).where("next = at + 1 and txn_id <> dst")
    return e.select(H, F.col("txn_id").alias("src"), "dst", F.lit("ww").alias("type"), "key").distinct()


def _good_reads(mops: DataFrame, orders: DataFrame) -> DataFrame:
    return mops.where("type = 'read'").join(orders.where("not conflicted").select(H, "key"), [H, "key"])


def edges_wr(mops: DataFrame, orders: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """The writer of a read's last element, to the reader."""
    orders, by = orders or version_orders(mops), by or writers(mops)
    r = _good_reads(mops, orders).where("size(observed) > 0").select(H, F.col("txn_id").alias("dst"), "key", F.element_at("observed", -1).alias("element"))
    w = by.withColumnRenamed("txn_id", "src")
    return r.join(w, [H, "key", "element"]).where("src <> dst").select(H, "src", "dst", F.lit("wr").alias("type"), "key").distinct()


def edges_rw(mops: DataFrame, orders: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """A reader of n elements, to the writer of the version at index n."""
    orders, by = orders or version_orders(mops), by or writers(mops)
    r = _good_reads(mops, orders).select(H, F.col("txn_id").alias("src"), "key", F.size("observed").alias("at"))
    w = _placed(orders).join(by.withColumnRenamed("txn_id", "dst"), [H, "key", "element"])
    return r.join(w, [H, "key", "at"]).where("src <> dst").select(H, "src", "dst", F.lit("rw").alias("type"), "key").distinct()


def edges_rt(history: DataFrame, reduced: bool = False) -> DataFrame:
    """Committed pairs of which one completed before the other was invoked, within each history.

    All pairs by default. `reduced` keeps a -> b only if no committed c lies wholly between: cycles exist in the one
    graph just if they do in the other, with few edges for each transaction.
    """
    c = history.where("outcome = 'committed'").select(H, "txn_id", "invoked", "completed")
    a = c.select(H, F.col("txn_id").alias("src"), F.col("completed").alias("a_end"))
    b = c.select(H, F.col("txn_id").alias("dst"), F.col("invoked").alias("b_start"))
    if reduced:
        # b follows a directly if a ends no earlier than the latest start of those that ended before b began
        ends = c.select(H, F.col("completed").alias("at"), F.lit(0).alias("kind"), F.col("invoked").alias("s"), F.lit(None).cast("long").alias("dst"))
        starts = c.select(H, F.col("invoked").alias("at"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("s"), F.col("txn_id").alias("dst"))
        latest = F.max("s").over(Window.partitionBy(H).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
        b = ends.unionByName(starts).withColumn("latest", latest).where("kind = -1").select(H, "dst", F.col("at").alias("b_start"), "latest")
        return a.join(b, H).where("a_end < b_start and a_end >= latest and src <> dst").select(H, "src", "dst", F.lit("rt").alias("type"), F.lit(-1).cast("long").alias("key"))
    return a.join(b, H).where("a_end < b_start and src <> dst").select(H, "src", "dst", F.lit("rt").alias("type"), F.lit(-1).cast("long").alias("key"))


def edges(mops: DataFrame, history: DataFrame, strict: bool = False) -> DataFrame:
    out = edges_ww(mops).unionByName(edges_wr(mops)).unionByName(edges_rw(mops))
    return out.unionByName(edges_rt(history)) if strict else out


def spans(history: DataFrame) -> DataFrame:
    """Rows beside edges that stand for all real-time edges: src a committed transaction, dst its beginning, key its end."""
    return history.where("outcome = 'committed'").select(H, F.col("txn_id").alias("src"), F.col("invoked").alias("dst"), F.lit(SPAN).alias("type"), F.col("completed").alias("key"))


def strong_components(adjacent: dict[int, list]) -> list[list[int]]:
    """Components of over one node, by Kosaraju's two passes; sorted."""
    nodes = sorted(set(adjacent) | {e[0] for out in adjacent.values() for e in out})
    back: dict[int, list[int]] = {n: [] for n in nodes}
    for n, out in adjacent.items():
        for e in out:
            back[e[0]].append(n)
    seen: set[int] = set()
    finish: list[int] = []
    for root in nodes:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(adjacent.get(root, ())))]
        while stack:
            node, it = stack[-1]
            for e in it:
                if e[0] not in seen:
                    seen.add(e[0])
                    stack.append((e[0], iter(adjacent.get(e[0], ()))))
                    break
            else:
                finish.append(node)
                stack.pop()
    done: set[int] = set()
    out = []
    for root in reversed(finish):
        if root in done:
            continue
        part, todo = [], [root]
        done.add(root)
        while todo:
            n = todo.pop()
            part.append(n)
            for m in back[n]:
                if m not in done:
                    done.add(m)
                    todo.append(m)
        if len(part) > 1:
            out.append(sorted(part))
    return sorted(out)


def shortest_cycle(part: list[int], adjacent: dict[int, list]) -> tuple[list[int], list[str]]:
    """A shortest cycle in a component, its transactions and the types of the edges between them.

    Breadth-first from each member in ascending order, edges in the order (to, type, key): the first edge that
    reaches a node labels it. The earliest start wins among equals.
    """
    inside = set(part)
    best: tuple[list[int], list[str]] | None = None
    for root in part:
        came: dict[int, tuple[int, str]] = {}
        queue, depth = deque([root]), {root: 0}
        found = None
        while queue and found is None:
            n = queue.popleft()
            if best is not None and depth[n] + 1 >= len(best[0]):
                break
            for to, _, _, kind in adjacent.get(n, ()):
                if to == root:
                    found = (n, kind)
                    break
                if to in inside and to not in depth:
                    depth[to] = depth[n] + 1
                    came[to] = (n, kind)
                    queue.append(to)
        if found is not None:
            n, kind = found
            txns, kinds = [n], [kind]
            while n != root:
                n, k = came[n]
                txns.append(n)
                kinds.append(k)
            txns.reverse()
            kinds.reverse()
            if best is None or len(txns) < len(best[0]):
                best = (txns, kinds)
            if len(best[0]) == 2:
                break
    assert best is not None
    return best


def classify(kinds: list[str]) -> str:
    n = {k: kinds.count(k) for k in EDGE_ORDER}
    if n["rt"]:
        return "real-time-violation"
    if n["rw"] > 1:
        return "G2-item"
    if n["rw"] == 1:
        return "G-single"
    return "G1c" if n["wr"] else "G0"


def _graph(rows: list[tuple]) -> dict[int, list]:
    """Edges (to, order of type, key, type) of each transaction, from rows (src, dst, type, key)."""
    adjacent: dict[int, list] = {}
    for s, d, t, k in rows:
        adjacent.setdefault(s, []).append((d, EDGE_ORDER[t], k, t))
    for out in adjacent.values():
        out.sort()
    return adjacent


class Timed:
    """A graph with the real-time edges that transactions' times imply, without a list of them.

    `direct` has those only that no other transaction lies wholly between, few for each transaction: components are the
    same. `get` gives a node's edges inside a component, all of them, made when asked for.
    """

    def __init__(self, adjacent: dict[int, list], times: dict[int, tuple[int, int]]):
        self.adjacent, self.times, self.part = adjacent, times, []
        self.made: dict[int, list] = {}
        self.room = 0

    def inside(self, part: list[int]) -> None:
        """The component that `get` answers for. Edges made once are kept, as searches ask for them from every root, up to KEPT of them."""
        self.part, self.made, self.room = part, {}, KEPT

    def direct(self) -> dict[int, list]:
        out = {n: list(e) for n, e in self.adjacent.items()}
        ends = sorted((end, start, n) for n, (start, end) in self.times.items())
        at, latest, passed = 0, None, [e[0] for e in ends]
        for n, (start, _) in sorted(self.times.items(), key=lambda x: x[1][0]):
            while at < len(ends) and ends[at][0] < start:
                latest = ends[at][1] if latest is None else max(latest, ends[at][1])
                at += 1
            if latest is not None:
                for _, _, before in ends[bisect_left(passed, latest, 0, at) : at]:
                    if before != n:
                        out.setdefault(before, []).append((n, EDGE_ORDER["rt"], -1, "rt"))
        return out

    def get(self, n: int, default=()) -> list:
        if n in self.made:
            return self.made[n]
        end = self.times[n][1] if n in self.times else None
        later = [(m, EDGE_ORDER["rt"], -1, "rt") for m in self.part if end is not None and m != n and m in self.times and end < self.times[m][0]]
        out = sorted([*self.adjacent.get(n, default), *later], key=lambda e: e[:3])
        if len(out) <= self.room:
            self.made[n] = out
            self.room -= len(out)
        return out


def _by_history(edge_rows: DataFrame, answer: Callable[[int, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The answer of each history's edges (src, dst, type, key): many histories a task and an Arrow batch."""

    def make(history):
        found: list[tuple] = []

        def step(_, *edge):
            found.append(edge)

        return step, lambda: answer(history, found)

    return fold_rows(edge_rows.select(H, "src", "dst", "type", "key"), H, [], make, schema)


def components(edge_rows: DataFrame) -> DataFrame:
    """(history_id, component, txn_id) of strongly connected components of over one transaction."""

    def answer(history: int, found: list[tuple]) -> list[tuple]:
        parts = strong_components(_graph([e for e in found if e[2] != SPAN]))
        return [(history, p[0], t) for p in parts for t in p]

    return _by_history(edge_rows, answer, f"{H} long, component long, txn_id long")


def cycle_witnesses(edge_rows: DataFrame) -> DataFrame:
    """(history_id, component, anomaly, txns, types): one shortest cycle of each component. Rows of `spans` count as all real-time edges."""

    def answer(history: int, found: list[tuple]) -> list[tuple]:
        adjacent = _graph([e for e in found if e[2] != SPAN])
        times = {n: (start, end) for n, start, t, end in found if t == SPAN}
        graph = Timed(adjacent, times) if times else None
        rows = []
        for p in strong_components(adjacent if graph is None else graph.direct()):
            if graph is not None:
                graph.inside(p)
            txns, kinds = shortest_cycle(p, adjacent if graph is None else graph)
            rows.append((history, p[0], classify(kinds), txns, kinds))
        return rows

    return _by_history(edge_rows, answer, f"{H} long, component long, anomaly string, txns array<bigint>, types array<string>")


def forbidden(spark: SparkSession) -> DataFrame:
    """(level, anomaly) of every pair that a level forbids."""
    return spark.createDataFrame([(lv, a) for lv in LEVELS for a in (*ALWAYS, *FORBIDS[lv])], "level string, anomaly string")


def anomalies(mops: DataFrame, history: DataFrame, strict: bool = False) -> DataFrame:
    """(history_id, anomaly), each once, that the histories show.

    What all checks need, micro-operations, version orders and writers, is written once and read by each. Real-time edges are never listed.
    """
    from tessera.sources.files import written

    mops = written(mops)
    orders, by = written(version_orders(mops)), written(writers(mops))
    dependent = edges_ww(mops, orders, by).unionByName(edges_wr(mops, orders, by)).unionByName(edges_rw(mops, orders, by))
    direct = [
        duplicate_elements(mops, by).select(H, F.lit("duplicate-element").alias("anomaly")),
        orders.where("conflicted").select(H, F.lit("version-order-conflict").alias("anomaly")),
        aborted_reads(mops, history, by).select(H, F.lit("G1a").alias("anomaly")),
        intermediate_reads(mops, history, by).select(H, F.lit("G1b").alias("anomaly")),
        cycle_witnesses(dependent.unionByName(spans(history)) if strict else dependent).select(H, "anomaly"),
    ]
    out = direct[0]
    for d in direct[1:]:
        out = out.unionByName(d)
    return out.distinct()


def verdicts(mops: DataFrame, history: DataFrame, level: str = "serializable") -> DataFrame:
    """(history_id, valid, anomalies): a history is valid if it shows no anomaly that the level forbids.

    One witness stands for each component, as in `cycle_witnesses`; real-time edges count at the strict level only.
    """
    found = anomalies(mops, history, level == "strict-serializable")
    bad = F.col("anomaly").isin(*ALWAYS, *FORBIDS[level])
    seen = found.groupBy(H).agg(F.array_sort(F.collect_set("anomaly")).alias("anomalies"), F.bool_or(bad).alias("bad"))
    every = history.select(H).distinct()
    return every.join(seen, H, "left").select(H, (~F.coalesce("bad", F.lit(False))).alias("valid"), F.coalesce("anomalies", F.array().cast("array<string>")).alias("anomalies"))


def write_skew_pairs(mops: DataFrame, history: DataFrame) -> DataFrame:
    """(history_id, a, b): committed transactions of which each read a key that the other appended to, overlapping in time."""
    c = history.where("outcome = 'committed'").select(H, "txn_id", "invoked", "completed")
    r = mops.where("type = 'read'").select(H, "txn_id", "key").distinct().join(c, [H, "txn_id"])
    w = mops.where("type = 'append'").select(H, F.col("txn_id").alias("other"), "key").distinct()
    o = c.select(H, F.col("txn_id").alias("other"), F.col("invoked").alias("o_start"), F.col("completed").alias("o_end"))
    cross = r.join(w, [H, "key"]).where("txn_id <> other").join(o, [H, "other"]).where("invoked <= o_end and o_start <= completed")
    cross = cross.select(H, "txn_id", "other").distinct()
    back = cross.select(H, F.col("other").alias("txn_id"), F.col("txn_id").alias("other"))
    return cross.intersect(back).where("txn_id < other").select(H, F.col("txn_id").alias("a"), F.col("other").alias("b"))


def compare_verdicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(history_id, result): agree, naming (same verdict, no common class) or disagree."""
    b = theirs.select(H, F.col("valid").alias("t_valid"), F.col("anomalies").alias("t_anomalies"))
    named = F.col("valid") | F.arrays_overlap("anomalies", "t_anomalies")
    result = F.when(F.col("valid") != F.col("t_valid"), "disagree").when(named, "agree").otherwise("naming")
    return ours.join(b, H).select(H, result.alias("result"))
