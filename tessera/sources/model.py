"""The model's relations as fixed projections of the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = 7
TXN_BASE = 1_000_000
STATUSES = ("pending", "staging", "committed", "aborted")


class Model:
    """Relations over the Parquet tables of one folder; each property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def last_ts(self) -> DataFrame:
        """One row (max_ts): the last commit timestamp."""
        return self.events.agg((F.max("event_id") + 1).alias("max_ts"))

    @property
    def users(self) -> DataFrame:
        """One row a key, with the last commit timestamp of all."""
        top = F.broadcast(self.last_ts)
        return self.events.select(F.col("user_id").alias("key")).distinct().join(top)

    @property
    def versions(self) -> DataFrame:
        """(key, commit_ts, tombstone, value), unique on commit_ts."""
        return self.events.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("commit_ts"), (F.col("event_type") == "error").alias("tombstone"), "value")

    @property
    def kv_ops(self) -> DataFrame:
        """(seq, op, key, value, level): the same history as storage operations spread over levels."""
        op = F.when(F.col("event_type") == "error", "del").otherwise("put")
        return self.events.select((F.col("event_id") + 1).alias("seq"), op.alias("op"), F.col("user_id").alias("key"), "value", (F.col("event_id") % LEVELS).alias("level"))

    @property
    def intents(self) -> DataFrame:
        """(key, txn, epoch, start_ts, value): one provisional write for every fifth key."""
        return self.users.where("key % 5 = 0").select("key", (F.col("key") + TXN_BASE).alias("txn"), F.lit(1).alias("epoch"), F.expr("max_ts div 2").alias("start_ts"), F.lit(-1.0).alias("value"))

    @property
    def txn_records(self) -> DataFrame:
        """(txn, key, epoch, status, commit_ts): no record for every seventh intent."""
        status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("key") % 4 + 1).cast("int"))
        rows = self.users.where("key % 5 = 0 and key % 35 <> 0").withColumn("status", status)
        commit = F.when(F.col("status") == "committed", F.col("max_ts") + F.col("key")).otherwise(F.lit(0).cast("long"))
        return rows.select((F.col("key") + TXN_BASE).alias("txn"), "key", F.lit(1).alias("epoch"), "status", commit.alias("commit_ts"))

    @property
    def reads(self) -> DataFrame:
        """(key, read_ts, reader, uncertainty_limit): four snapshots of every key."""
        at = F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), F.expr("max_ts div 4"), F.expr("max_ts div 2"), F.col("max_ts")))).alias("read_ts")
        reader = F.when(F.col("key") % 10 == 0, F.col("key") + TXN_BASE).otherwise(F.lit(0).cast("long")).alias("reader")
        return self.users.select("key", at, reader).withColumn("uncertainty_limit", F.col("read_ts") + 50)

    @property
    def sst_files(self) -> DataFrame:
        """(level, number, file_size, smallest, largest): a file for each hundred operations."""
        f = self.events.groupBy(F.expr("event_id div 100").alias("number")).agg(F.sum(F.length("props")).alias("file_size"), F.min("user_id").alias("smallest"), F.max("user_id").alias("largest"))
        return f.select((F.col("number") % LEVELS).alias("level"), "number", "file_size", "smallest", "largest")

    @property
    def ranges(self) -> DataFrame:
        """(id, start, end, generation): 25 ranges that tile the keys; null ends are unbounded."""
        width = F.broadcast(self.events.agg(F.expr("(max(user_id) + 25) div 25").alias("w")))
        n = self.table("nation").select(F.col("n_nationkey").cast("long").alias("id")).join(width)
        return n.select(
            "id",
            F.when(F.col("id") > 0, F.col("id") * F.col("w")).alias("start"),
            F.when(F.col("id") < 24, (F.col("id") + 1) * F.col("w")).alias("end"),
            (F.col("id") % 3 + 1).alias("generation"),
        )

    @property
    def broken_ranges(self) -> DataFrame:
        """The ranges with some starts moved by one, so that they leave gaps."""
        moved = F.when(F.col("id") % 11 == 5, F.col("start") + 1).otherwise(F.col("start"))
        return self.ranges.withColumn("start", moved)

    @property
    def replicas(self) -> DataFrame:
        """(range_id, replicas, n_keys, lease_holder): three replicas a range on five nodes, node 4 dead for some."""
        keys = self.events.select(F.col("user_id").alias("key")).distinct()
        from tessera.operators.topology import route_keys

        n = route_keys(keys, self.ranges).groupBy(F.col("range_id")).agg(F.count("*").alias("n_keys"))
        r = self.ranges.join(n, F.col("id") == F.col("range_id"), "left")
        nodes = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (F.col("id") + i) % 5 + 1)
        return r.select(F.col("id").alias("range_id"), "start", "end", "generation", F.array_sort(nodes).alias("replicas"), F.coalesce("n_keys", F.lit(0).cast("long")).alias("n_keys"), (F.col("id") % 5 + 1).alias("lease_holder"))

    @property
    def raft_entries(self) -> DataFrame:
        """(node, idx, term, data) of three nodes; node 3 is cut off and differs here and there."""
        nodes = F.explode(F.array(*(F.lit(n) for n in (1, 2, 3)))).alias("node")
        top = F.broadcast(self.last_ts)
        e = self.events.join(top).select(nodes, (F.col("event_id") + 1).alias("idx"), F.expr("1 + event_id div 100").alias("term"), F.col("event_type").alias("data"), "event_id", "max_ts")
        e = e.where("node < 3 or idx <= max_ts * 9 div 10")
        return e.select("node", "idx", "term", F.when((F.col("node") == 3) & (F.col("event_id") % 997 == 0), "forged").otherwise(F.col("data")).alias("data"))

    @property
    def raft_progress(self) -> DataFrame:
        """(leader, peer, match): what the leader knows of its peers."""
        scale = F.explode(F.array(*(F.struct(F.lit(p).alias("peer"), F.lit(s).alias("pct")) for p, s in ((1, 100), (2, 90), (3, 70))))).alias("x")
        return self.last_ts.select(F.lit(1).alias("leader"), scale, "max_ts").select("leader", F.col("x.peer").alias("peer"), F.expr("max_ts * x.pct div 100").alias("match"))

    @property
    def mops_raw(self) -> DataFrame:
        """(history_id, txn_id, pos, type, key, element): micro-operations before any observation."""
        kind = F.when(F.col("event_type").isin("click", "purchase"), "append").otherwise("read")
        e = self.events.select("event_id", F.expr("event_id div 200").alias("history_id"), F.expr("event_id div 4").alias("txn_id"), F.col("event_id").alias("pos"), kind.alias("type"), (F.col("user_id") % 5).alias("key"))
        return e.select("history_id", "txn_id", "pos", "type", "key", F.when(F.col("type") == "append", F.col("event_id") + 1).alias("element"))

    @property
    def history(self) -> DataFrame:
        """(history_id, txn_id, process, invoked, completed, outcome): the first of some histories' transactions aborted."""
        t = self.events.groupBy(F.expr("event_id div 200").alias("history_id"), F.expr("event_id div 4").alias("txn_id")).agg(F.min("event_id").alias("invoked"), F.max("event_id").alias("completed"))
        aborted = (F.col("history_id") % 4 == 2) & (F.col("txn_id") == F.col("history_id") * 50)
        return t.select("history_id", "txn_id", (F.col("txn_id") % 4).alias("process"), "invoked", "completed", F.when(aborted, "aborted").otherwise("committed").alias("outcome"))

    @property
    def mops(self) -> DataFrame:
        """mops_raw with `observed`: serial-model lists, spoiled in some histories."""
        from tessera.operators.isolation import serial_model

        m = serial_model(self.mops_raw)
        n = F.size("observed")
        lost = (F.col("history_id") % 4 == 1) & (F.col("pos") % 13 == 0) & (n > 0)
        turned = (F.col("history_id") % 4 == 3) & (F.col("pos") % 17 == 0)
        return m.withColumn("observed", F.when(lost, F.slice("observed", F.lit(1), n - 1)).when(turned, F.reverse("observed")).otherwise(F.col("observed")))

    @property
    def waits(self) -> DataFrame:
        """(waiter, blocker): each key's transaction waits for one other."""
        n = F.broadcast(self.events.agg(F.count_distinct("user_id").alias("n")))
        return self.events.select(F.col("user_id").alias("waiter")).distinct().join(n).select("waiter", F.expr("(waiter * 3 + 1) % n").alias("blocker"))

    @property
    def trace(self) -> DataFrame:
        """(id, caused_by, node, kind): causes within a few ids back, a root every ten."""
        cause = F.when(F.col("id") % 10 != 1, F.greatest(F.lit(1).cast("long"), F.col("id") - 1 - F.col("id") % 3))
        return self.events.select((F.col("event_id") + 1).alias("id"), (F.col("user_id") % 5).alias("node"), F.col("event_type").alias("kind")).select("id", cause.alias("caused_by"), "node", "kind")

    @property
    def fleet_runs(self) -> DataFrame:
        """(seed, workload, violated, invariant, signature, node_nanos) of simulation runs."""
        k = F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k")
        e = self.events.select("event_id", "event_type", "value", k)
        nanos = F.floor(F.col("value") * 1000000).cast("long")
        return e.select(F.col("event_id").alias("seed"), F.col("event_type").alias("workload"), (F.col("k") % 10 == 0).alias("violated"), F.concat(F.lit("INV-"), (F.col("k") % 7).cast("string")).alias("invariant"), F.concat(F.lit("sig-"), (F.col("k") % 3).cast("string"), F.lit("-"), F.col("event_type")).alias("signature"), nanos.alias("node_nanos"))

    @property
    def accounts(self) -> DataFrame:
        """(account, balance): a hundred each."""
        return self.table("customer").select(F.col("c_custkey").alias("account"), F.lit(100).cast("long").alias("balance"))

    @property
    def transfers(self) -> DataFrame:
        """(log_index, op_id, source, target, amount), every fiftieth repeated later in the log."""
        n = F.broadcast(self.table("customer").agg(F.count("*").alias("n")))
        t = self.table("orders").join(n).select(F.col("o_orderkey").alias("op_id"), F.col("o_custkey").alias("source"), F.expr("(o_custkey * 7 + 1) % n").alias("target"), (F.col("o_orderkey") % 21).alias("amount"))
        again = F.explode(F.when(F.col("op_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("retry")
        return t.select((F.col("op_id") * 2).alias("at"), "op_id", "source", "target", "amount", again).select((F.col("at") + F.col("retry") * 101).alias("log_index"), "op_id", "source", "target", "amount")


#: The same relations for DuckDB; a query gets those that it names, directly or through others.
SQL: dict[str, str] = {
    "last_ts": "select max(event_id) + 1 as max_ts from events",
    "users": "select distinct user_id as key, (select max_ts from last_ts) as max_ts from events",
    "versions": "select user_id as key, event_id + 1 as commit_ts, event_type = 'error' as tombstone, value from events",
    "kv_ops": "select event_id + 1 as seq, case when event_type = 'error' then 'del' else 'put' end as op, user_id as key, value, event_id % 7 as level from events",
    "intents": "select key, key + 1000000 as txn, 1 as epoch, max_ts // 2 as start_ts, -1.0::double as value from users where key % 5 = 0",
    "txn_records": "select key + 1000000 as txn, key, 1 as epoch, (['pending', 'staging', 'committed', 'aborted'])[key % 4 + 1] as status, case when key % 4 = 2 then max_ts + key else 0 end as commit_ts from users where key % 5 = 0 and key % 35 <> 0",
    "reads": "select key, read_ts, case when key % 10 = 0 then key + 1000000 else 0 end as reader, read_ts + 50 as uncertainty_limit from (select key, unnest(list_distinct([1, max_ts // 4, max_ts // 2, max_ts])) as read_ts from users)",
    "sst_files": "select number % 7 as level, number, sum(length(props))::bigint as file_size, min(user_id) as smallest, max(user_id) as largest from (select *, event_id // 100 as number from events) group by number",
    "ranges": "select id, case when id > 0 then id * w end as start, case when id < 24 then (id + 1) * w end as \"end\", id % 3 + 1 as generation from (select n_nationkey::bigint as id from nation), (select (max(user_id) + 25) // 25 as w from events)",
    "broken_ranges": "select id, case when id % 11 = 5 then start + 1 else start end as start, \"end\", generation from ranges",
    "routed": "select key, id as range_id, generation from (select distinct user_id as key from events) join ranges on (start is null or key >= start) and (\"end\" is null or key < \"end\")",
    "replicas": "select id as range_id, start, \"end\", generation, list_sort([id % 5 + 1, (id + 1) % 5 + 1, (id + 2) % 5 + 1]) as replicas, coalesce(n_keys, 0) as n_keys, id % 5 + 1 as lease_holder from ranges left join (select range_id, count(*) as n_keys from routed group by range_id) on id = range_id",
    "raft_entries": "select node, event_id + 1 as idx, 1 + event_id // 100 as term, case when node = 3 and event_id % 997 = 0 then 'forged' else event_type end as data from events, (select unnest([1, 2, 3]) as node), last_ts where node < 3 or event_id + 1 <= max_ts * 9 // 10",
    "raft_progress": "select 1 as leader, peer, max_ts * pct // 100 as match from last_ts, (values (1, 100), (2, 90), (3, 70)) as v(peer, pct)",
    "mops_raw": "select event_id // 200 as history_id, event_id // 4 as txn_id, event_id as pos, case when event_type in ('click', 'purchase') then 'append' else 'read' end as type, user_id % 5 as key, case when event_type in ('click', 'purchase') then event_id + 1 end as element from events",
    "history": "select history_id, txn_id, txn_id % 4 as process, invoked, completed, case when history_id % 4 = 2 and txn_id = history_id * 50 then 'aborted' else 'committed' end as outcome from (select event_id // 200 as history_id, event_id // 4 as txn_id, min(event_id) as invoked, max(event_id) as completed from events group by all)",
    "modelled": "select history_id, txn_id, pos, type, key, element, case when type = 'read' then coalesce(list(element) filter (where element is not null) over (partition by history_id, key order by pos rows between unbounded preceding and current row), []) end as seen from mops_raw",
    "mops": "select history_id, txn_id, pos, type, key, element, case when history_id % 4 = 1 and pos % 13 = 0 and len(seen) > 0 then seen[:len(seen) - 1] when history_id % 4 = 3 and pos % 17 = 0 then list_reverse(seen) else seen end as observed from modelled",
    "waits": "select distinct user_id as waiter, (user_id * 3 + 1) % (select count(distinct user_id) from events) as blocker from events",
    "trace": "select event_id + 1 as id, case when (event_id + 1) % 10 <> 1 then greatest(1, event_id - (event_id + 1) % 3) end as caused_by, user_id % 5 as node, event_type as kind from events",
    "fleet_runs": "select event_id as seed, event_type as workload, k % 10 = 0 as violated, 'INV-' || (k % 7) as invariant, 'sig-' || (k % 3) || '-' || event_type as signature, floor(value * 1000000)::bigint as node_nanos from (select *, regexp_extract(props, '(\\d+)', 1)::bigint as k from events)",
    "accounts": "select c_custkey as account, 100::bigint as balance from customer",
    "transfers": "select op_id * 2 + retry * 101 as log_index, op_id, source, target, amount from (select o_orderkey as op_id, o_custkey as source, (o_custkey * 7 + 1) % (select count(*) from customer) as target, o_orderkey % 21 as amount, unnest(case when o_orderkey % 50 = 0 then [0, 1] else [0] end) as retry from orders)",
    # relations derived from others, as the operators derive them
    "writers": "select history_id, key, element, arg_min(txn_id, pos) as txn_id from mops where type = 'append' group by history_id, key, element",
    "last_appends": "select history_id, txn_id, key, arg_max(element, pos) as element from mops where type = 'append' group by all",
    "longest": "select history_id, key, arg_max(observed, len(observed) * 1000000000::bigint - pos) as elements from mops where type = 'read' group by all",
    "orders_of": "select history_id, key, elements, bad > 0 as conflicted from longest join (select history_id, key, sum(case when observed <> elements[:len(observed)] then 1 else 0 end) as bad from mops join longest using (history_id, key) where type = 'read' group by all) using (history_id, key)",
    "placed": "select history_id, key, unnest(elements) as element, generate_subscripts(elements, 1) as pos from orders_of where not conflicted",
    "ww": "select distinct a.history_id, wa.txn_id as src, wb.txn_id as dst, 'ww' as type, a.key from placed a join placed b on a.history_id = b.history_id and a.key = b.key and b.pos = a.pos + 1 join writers wa on wa.history_id = a.history_id and wa.key = a.key and wa.element = a.element join writers wb on wb.history_id = b.history_id and wb.key = b.key and wb.element = b.element where wa.txn_id <> wb.txn_id",
    "good_reads": "select m.history_id, m.txn_id, m.key, m.observed from mops m join orders_of o using (history_id, key) where type = 'read' and not conflicted",
    "wr": "select distinct r.history_id, w.txn_id as src, r.txn_id as dst, 'wr' as type, r.key from good_reads r join writers w on w.history_id = r.history_id and w.key = r.key and w.element = r.observed[len(r.observed)] where w.txn_id <> r.txn_id",
    "rw": "select distinct r.history_id, r.txn_id as src, w.txn_id as dst, 'rw' as type, r.key from good_reads r join placed p on p.history_id = r.history_id and p.key = r.key and p.pos = len(r.observed) + 1 join writers w on w.history_id = p.history_id and w.key = p.key and w.element = p.element where w.txn_id <> r.txn_id",
}


def with_relations(body: str) -> str:
    """The SQL with a definition in front of every model relation that it needs."""
    need: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in SQL:
            if name != own and name not in need and re.search(rf"(?:\bfrom|\bjoin|,)\s*\(?\s*{name}\b", text):
                visit(SQL[name], name)
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    defs = ",\n".join(f"{n} as ({SQL[n]})" for n in need)
    rest = body.lstrip()
    for head in ("with recursive ", "with "):
        if rest.lower().startswith(head):
            return f"{head}{defs},\n{rest[len(head) :]}"
    return f"with {defs}\n{body}"
