"""Queries over storage, versions, topology and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import logs, storage, topology, versions
from tessera.plans.catalog import query
from tessera.sources.model import Model


@query(
    "snapshot_read",
    """select r.key, r.read_ts, v.key is not null and not v.tombstone as found, case when not v.tombstone then v.value end as value, coalesce(v.commit_ts, 0) as commit_ts
from (select distinct key, read_ts from reads) r asof left join versions v on r.key = v.key and r.read_ts >= v.commit_ts""",
)
def snapshot_read(m: Model) -> DataFrame:
    return versions.committed_value(m.versions, m.reads)


_INTENT_SQL = """with now_ as (select r.*, n.commit_ts as n_ts, n.tombstone as n_dead, n.value as n_value from reads r asof left join versions n on r.key = n.key and r.read_ts >= n.commit_ts),
both_ as (select n.*, l.commit_ts as l_ts from now_ n asof left join versions l on n.key = l.key and n.uncertainty_limit >= l.commit_ts),
j as (select b.*, i.txn, i.start_ts, i.value as i_value, case when i.txn <> reader and i.start_ts <= read_ts then 'blocked' when uncertainty_limit > read_ts and l_ts > read_ts then 'uncertain' when i.txn = reader then 'own' when n_ts is not null and not n_dead then 'found' else 'not_found' end as o
  from both_ b left join intents i on b.key = i.key)
select key, read_ts, reader, case when o = 'own' then 'found' else o end as outcome, case o when 'own' then i_value when 'found' then n_value end as value,
  case o when 'uncertain' then l_ts when 'own' then 0 when 'blocked' then start_ts else coalesce(n_ts, 0) end as ts, case when o = 'blocked' then txn end as blocker from j"""


@query("snapshot_read_intents", _INTENT_SQL)
def snapshot_read_intents(m: Model) -> DataFrame:
    return versions.snapshot_read(m.versions, m.intents, m.reads)


@query("uncertain_reads", f"select key, read_ts, ts from ({_INTENT_SQL}) where outcome = 'uncertain'")
def uncertain_reads(m: Model) -> DataFrame:
    return versions.snapshot_read(m.versions, m.intents, m.reads).where("outcome = 'uncertain'").select("key", "read_ts", "ts")


@query("merge_on_read", "select key, value, seq from (select *, row_number() over (partition by key order by seq desc) as n from kv_ops) where n = 1 and op <> 'del'")
def merge_on_read(m: Model) -> DataFrame:
    ops = m.kv_ops
    return storage.merge_on_read(*(ops.where(F.col("level") == i) for i in range(7)))


@query("scan_range_limit", "select key, value, seq from (select *, row_number() over (partition by key order by seq desc) as n from kv_ops where key >= 20 and key < 90) where n = 1 and op <> 'del' order by key limit 25")
def scan_range_limit(m: Model) -> DataFrame:
    return storage.scan(m.kv_ops, 20, 90, 25)


@query("point_get", "select k.key, l.seq is not null as found, l.value from (select distinct user_id * 2 as key from events) k left join (select * from (select *, row_number() over (partition by key order by seq desc) as n from kv_ops where seq <= 5000) where n = 1 and op <> 'del') l on k.key = l.key")
def point_get(m: Model) -> DataFrame:
    return storage.point_get(m.kv_ops, m.events.select((F.col("user_id") * 2).alias("key")).distinct(), snapshot=5000)


@query("write_batch_sequences", "select key, op, value, 1000 + seq - 1 as seq from kv_ops")
def write_batch_sequences(m: Model) -> DataFrame:
    batch = m.kv_ops.withColumn("pos", F.col("seq") - 1)
    return storage.assign_sequences(batch.drop("seq"), 1000).select("key", "op", "value", "seq")


@query("compaction_output", "select key, seq, op, value from (select *, row_number() over (partition by key order by seq desc) as n from kv_ops where level in (0, 1)) where n = 1")
def compaction_output(m: Model) -> DataFrame:
    return storage.compaction_output(m.kv_ops.where("level in (0, 1)"), bottom=False)


@query("compaction_bottom", "select key, seq, op, value from (select *, row_number() over (partition by key order by seq desc) as n from kv_ops where level in (5, 6)) where n = 1 and op <> 'del'")
def compaction_bottom(m: Model) -> DataFrame:
    return storage.compaction_output(m.kv_ops.where("level in (5, 6)"), bottom=True)


@query(
    "compaction_pick",
    """with s as (select level, count(*) as files, sum(file_size) as bytes from sst_files group by level)
select case when coalesce((select files from s where level = 0), 0) >= 4 then 0 else coalesce((select level from s where level between 1 and 5 and bytes / (131072 * pow(10, level - 1)) > 1 order by bytes / (131072 * pow(10, level - 1)) desc, level limit 1), -1) end::bigint as level""",
)
def compaction_pick(m: Model) -> DataFrame:
    return storage.compaction_pick(m.sst_files)


@query("compaction_pick_deep", "with s as (select level, sum(file_size) as bytes from sst_files where level > 0 group by level) select coalesce((select level from s where level between 1 and 5 and bytes / (1024 * pow(10, level - 1)) > 1 order by bytes / (1024 * pow(10, level - 1)) desc, level limit 1), -1)::bigint as level")
def compaction_pick_deep(m: Model) -> DataFrame:
    return storage.compaction_pick(m.sst_files.where("level > 0"), base=1024)


@query(
    "compaction_inputs",
    """with own as (select * from sst_files where level = 2 order by smallest, number limit 1)
select f.level, f.number, f.file_size, f.smallest, f.largest from own f union all
select f.level, f.number, f.file_size, f.smallest, f.largest from sst_files f, own o where f.level = 3 and f.smallest <= o.largest and f.largest >= o.smallest""",
)
def compaction_inputs(m: Model) -> DataFrame:
    return storage.compaction_inputs(m.sst_files, 2)


@query("level_sizes", "select level, count(*) as files, sum(file_size)::bigint as bytes from sst_files group by level")
def level_sizes(m: Model) -> DataFrame:
    return storage.level_sizes(m.sst_files)


@query("files_overlapping", "select level, number, smallest, largest from sst_files where not (smallest > 2 or largest < 1)")
def files_overlapping(m: Model) -> DataFrame:
    return storage.files_overlapping(m.sst_files, 1, 2).select("level", "number", "smallest", "largest")


@query("orphan_files", "select number from sst_files where number % 6 = 0 or number % 5 <> 0 except select number from sst_files where number % 6 <> 1")
def orphan_files(m: Model) -> DataFrame:
    f = m.sst_files
    return storage.orphan_files(f.where("number % 6 = 0 or number % 5 <> 0").select("number"), f.where("number % 6 <> 1"))


@query("wal_valid_prefix", "select log, seq from (select event_id // 100 as log, event_id + 1 as seq, min(case when event_type = 'error' and user_id % 7 = 0 then event_id end) over (partition by event_id // 100) as bad, event_id from events) where bad is null or event_id < bad")
def wal_valid_prefix(m: Model) -> DataFrame:
    r = m.events.select(F.expr("event_id div 100").alias("log"), (F.col("event_id") + 1).alias("seq"), F.col("event_id").alias("pos"), (~((F.col("event_type") == "error") & (F.col("user_id") % 7 == 0))).alias("valid"))
    return storage.valid_prefix(r, within=["log"]).select("log", "seq")


_EDITS = "select event_id // 10 as edit_no, user_id % 7 as level, user_id as number, case when event_type in ('error', 'view') then 'del' else 'add' end as action, length(props) as file_size, event_id from events"


@query("manifest_state", f"with e as (select edit_no, level, number, action, max(file_size) as file_size from ({_EDITS}) group by all) select level, number, file_size from (select *, row_number() over (partition by level, number order by edit_no desc, action) as n from e) where n = 1 and action = 'add'")
def manifest_state(m: Model) -> DataFrame:
    action = F.when(F.col("event_type").isin("error", "view"), "del").otherwise("add")
    e = m.events.select(F.expr("event_id div 10").alias("edit_no"), (F.col("user_id") % 7).alias("level"), F.col("user_id").alias("number"), action.alias("action"), F.length("props").cast("long").alias("file_size"))
    return storage.manifest_state(e.groupBy("edit_no", "level", "number", "action").agg(F.max("file_size").alias("file_size")))


@query("log_truncation", "select event_id as record_no, event_id // 3 as idx from events a where not exists (select 1 from events t where t.event_id % 1500 = 1499 and t.event_id > a.event_id and a.event_id // 3 >= t.event_id // 4)")
def log_truncation(m: Model) -> DataFrame:
    a = m.events.select(F.col("event_id").alias("record_no"), F.expr("event_id div 3").alias("idx"))
    t = m.events.where("event_id % 1500 = 1499").select(F.col("event_id").alias("record_no"), F.expr("event_id div 4").alias("from_idx"))
    return storage.surviving_entries(a, t)


@query("bloom_never_misses", "select user_id as key, true as maybe from events where user_id % 2 = 0 group by user_id")
def bloom_never_misses(m: Model) -> DataFrame:
    keys = m.events.where("user_id % 2 = 0").select(F.col("user_id").alias("key")).distinct()
    return storage.bloom_maybe(keys, storage.bloom_bits(keys, 1 << 14), 1 << 14)


_GC = "with sp as (select max_ts // 2 as sp from last_ts), g as (select v.*, sp, row_number() over (partition by key, commit_ts <= sp order by commit_ts desc) as n from versions v, sp)"


@query("gc_removed", f"{_GC} select key, commit_ts from g where commit_ts <= sp and n > 1")
def gc_removed(m: Model) -> DataFrame:
    sp = m.last_ts.select(F.expr("max_ts div 2").alias("safepoint"))
    return versions.gc_split(m.versions, sp).where("not kept").select("key", "commit_ts")


@query("gc_kept", f"{_GC} select key, commit_ts, tombstone, value from g where commit_ts > sp or n = 1")
def gc_kept(m: Model) -> DataFrame:
    sp = m.last_ts.select(F.expr("max_ts div 2").alias("safepoint"))
    return versions.gc_split(m.versions, sp).where("kept").select("key", "commit_ts", "tombstone", "value")


@query("versions_of", "select key, count(*) as n, max(commit_ts) as newest, string_agg(commit_ts::varchar || case when tombstone then 'x' else '' end, ',' order by commit_ts desc) as chain from versions group by key")
def versions_of(m: Model) -> DataFrame:
    line = F.array_join(F.transform("chain", lambda v: F.concat(v["commit_ts"].cast("string"), F.when(v["tombstone"], "x").otherwise(""))), ",")
    return versions.versions_of(m.versions).select("key", "n", "newest", line.alias("chain"))


@query("keys_with_versions", "select distinct key from versions")
def keys_with_versions(m: Model) -> DataFrame:
    return m.versions.select("key").distinct()


@query("gc_safepoint", "select least((select max_ts * 9 // 10 from last_ts), (select max(commit_ts) from versions), (select min(start_ts) from intents), (select min(read_ts) from reads where read_ts > 1)) as safepoint")
def gc_safepoint(m: Model) -> DataFrame:
    closed = m.last_ts.select(F.expr("max_ts * 9 div 10").alias("ts"))
    return versions.safepoint(closed, m.versions.select(F.col("commit_ts").alias("ts")), m.intents.select(F.col("start_ts").alias("ts")), m.reads.where("read_ts > 1").select(F.col("read_ts").alias("ts")))


@query("version_order_violations", "with c as (select key, commit_ts, commit_ts + case when commit_ts % 53 = 0 then 40 else 0 end as pos from versions), d as (select *, lag(commit_ts) over (partition by key order by -pos, commit_ts) as previous from c) select key, commit_ts, previous from d where commit_ts >= previous")
def version_order_violations(m: Model) -> DataFrame:
    moved = F.col("commit_ts") + F.when(F.col("commit_ts") % 53 == 0, 40).otherwise(0)
    c = m.versions.select("key", "commit_ts", F.struct((-moved).alias("a"), F.col("commit_ts").alias("b")).alias("pos"))
    return versions.order_violations(c, "pos").select("key", "commit_ts", "previous")


@query("applied_versions", "select key, commit_ts, tombstone, value from versions union all select i.key, r.commit_ts, false, i.value from intents i join txn_records r on i.txn = r.txn where r.status = 'committed'")
def applied_versions(m: Model) -> DataFrame:
    return versions.apply_decisions(m.versions, m.intents, m.txn_records)[0]


@query("remaining_intents", "select key, txn, epoch, start_ts, value from intents where txn not in (select txn from txn_records where status in ('committed', 'aborted'))")
def remaining_intents(m: Model) -> DataFrame:
    return versions.apply_decisions(m.versions, m.intents, m.txn_records)[1].select("key", "txn", "epoch", "start_ts", "value")


_WRITES = "select 1000000 + user_id // 10 * 10 as txn, user_id as key, max(event_id) + 1 as commit_ts from events group by user_id"


@query("commit_all", f"with w as ({_WRITES}) select w.txn, bool_and(i.key is not null or v.key is not null and w.key % 4 <> 1) as ok from w left join intents i on w.txn = i.txn and w.key = i.key left join versions v on w.key = v.key and w.commit_ts = v.commit_ts group by w.txn")
def commit_all(m: Model) -> DataFrame:
    w = m.events.groupBy(F.col("user_id").alias("key")).agg((F.max("event_id") + 1).alias("commit_ts")).withColumn("txn", F.lit(1000000) + F.expr("key div 10 * 10"))
    return versions.commit_all(w, m.intents, m.versions.where("key % 4 <> 1"))


@query("put_intents", "with q as (select event_id as log_index, user_id as key, 2000000 + event_id % 9 as txn from events), f as (select q.*, first_value(q.txn) over (partition by q.key order by log_index) as first, i.txn as holder from q left join intents i on q.key = i.key) select log_index, key, txn, coalesce(holder, first) = txn as ok from f")
def put_intents(m: Model) -> DataFrame:
    q = m.events.select(F.col("event_id").alias("log_index"), F.col("user_id").alias("key"), (F.lit(2000000) + F.col("event_id") % 9).alias("txn"))
    return versions.put_intents(q, m.intents)


@query("lock_outcomes")
def lock_outcomes(m: Model) -> DataFrame:
    q = m.events.select(F.col("event_id").alias("log_index"), F.col("user_id").alias("key"), (F.col("event_id") % 11).alias("txn"), (F.col("event_id") % 11 * 3 % 7).alias("start_ts"), (F.col("event_type") == "view").alias("shared"))
    return versions.resolve_locks(q)


@query(
    "lock_wait_cycles",
    """with recursive walk as (select waiter, blocker as here from waits union select w.waiter, b.blocker from walk w join waits b on w.here = b.waiter),
loops as (select waiter from walk where here = waiter), least as (select l.waiter, min(k.here) as name from loops l join walk k using (waiter) group by l.waiter)
select l.waiter, count(*) as cycle_length from least l join least o on l.name = o.name group by l.waiter""",
)
def lock_wait_cycles(m: Model) -> DataFrame:
    return versions.wait_cycles(m.waits)


@query("route_keys", "select key, range_id, generation from routed")
def route_keys(m: Model) -> DataFrame:
    return topology.route_keys(m.users.select("key"), m.ranges)


@query("route_many_keys", "select key, range_id, generation from routed")
def route_many_keys(m: Model) -> DataFrame:
    return topology.route_many(m.users.select("key"), m.ranges)


_COVER = """with r as (select *, row_number() over (order by start nulls first, id) as n, lag("end") over (order by start nulls first, id) as prev, count(*) over () as c from {0})
select id, problem from (select id, case when n = 1 and start is not null then 'does not begin open' when n > 1 and prev is null then 'follows an open end' when n > 1 and (start is null or start < prev) then 'overlap' when n > 1 and start > prev then 'gap'
  when start >= "end" then 'empty' when n = c and "end" is not null then 'does not end open' end as problem from r) where problem is not null"""


@query("coverage_violations", _COVER.format("broken_ranges"))
def coverage_violations(m: Model) -> DataFrame:
    return topology.coverage_violations(m.broken_ranges)


@query("range_medians", "with p as (select range_id, key, row_number() over (partition by range_id order by key) - 1 as n, count(*) over (partition by range_id) as c from routed) select range_id, c as n_keys, max(case when n = c // 2 and c > 1 then key end) as median from p group by range_id, c")
def range_medians(m: Model) -> DataFrame:
    return topology.range_medians(m.users.select("key"), m.ranges)


@query("adjacent_ranges", 'select a.id as left_id, b.id as right_id from broken_ranges a join broken_ranges b on a."end" = b.start')
def adjacent_ranges(m: Model) -> DataFrame:
    return topology.adjacent_ranges(m.broken_ranges)


@query("meta_buckets", "select id, (row_number() over (order by start nulls first) - 1) // 4 + 1 as bucket from ranges")
def meta_buckets(m: Model) -> DataFrame:
    return topology.meta_buckets(m.ranges)


@query(
    "placement_decisions",
    """with x as (select *, lead(n_keys) over w as nk, lead(replicas) over w as nr, lead(lease_holder) over w as nl, list_sort(list_filter(replicas, lambda r: r = 4)) as dead, list_sort(list_filter([1, 2, 3, 5], lambda n: not list_contains(replicas, n))) as spare from replicas window w as (order by start nulls first)),
c as (select range_id, start, case when len(dead) > 0 and len(spare) > 0 then 'replace' when n_keys >= 24 then 'split' when n_keys <= 6 and nk <= 6 and replicas = nr and lease_holder = nl then 'merge' end as command, spare[1] as s from x)
select range_id, command, case when command = 'replace' then s else range_id end::bigint as target from c where command is not null order by start nulls first limit 2""",
)
def placement_decisions(m: Model) -> DataFrame:
    live = m.spark.createDataFrame([(1,), (2,), (3,), (5,)], "id long")
    return topology.placement_decisions(m.replicas, live)


@query("live_nodes", "select id, last_seen from (select user_id % 9 + 1 as id, max(event_id) as last_seen from events where user_id % 9 <> 3 or event_id < 500 group by all) where (select max(event_id) from events) - last_seen <= 400")
def live_nodes(m: Model) -> DataFrame:
    n = m.events.where("user_id % 9 <> 3 or event_id < 500").groupBy((F.col("user_id") % 9 + 1).alias("id")).agg(F.max("event_id").alias("last_seen"))
    top = F.broadcast(m.events.agg(F.max("event_id").alias("now")))
    return n.join(top).where("now - last_seen <= 400").select("id", "last_seen")


@query("split_partition", "select 'left' as side, key, commit_ts, tombstone, value from versions where key < 50 union all select 'right', key, commit_ts, tombstone, value from versions where key >= 50")
def split_partition(m: Model) -> DataFrame:
    a, b = topology.split_at(m.versions, 50)
    return a.select(F.lit("left").alias("side"), "*").unionByName(b.select(F.lit("right").alias("side"), "*"))


@query("merge_absorb", "select key, max(commit_ts) as commit_ts, arg_max(value, commit_ts) as value from versions where key < 60 and commit_ts % 2 = 0 or key >= 40 and commit_ts % 2 = 1 group by key")
def merge_absorb(m: Model) -> DataFrame:
    v = m.versions
    half = lambda r, odd: topology.absorb(v.where(f"{r} and commit_ts % 2 = {odd}").select("key", "commit_ts", "value"), v.where("false").select("key", "commit_ts", "value"))
    return topology.absorb(half("key < 60", 0), half("key >= 40", 1)).select("key", "commit_ts", "value")


@query("cached_descriptors", "select id, max(generation) as generation, arg_max(node, generation * 1000 + node) as node from (select user_id % 25 as id, event_id % 17 as generation, event_id % 5 as node from events) group by id")
def cached_descriptors(m: Model) -> DataFrame:
    c = m.events.select((F.col("user_id") % 25).alias("id"), (F.col("event_id") % 17).alias("g"), (F.col("event_id") % 5).alias("node")).withColumn("generation", F.struct("g", "node"))
    return topology.newest_descriptors(c).select("id", F.col("generation.g").alias("generation"), "node")


@query("misplaced_keys", 'select k.key, k.range_id from (select key, (range_id + case when key % 10 = 0 then 1 else 0 end) % 25 as range_id from routed) k join ranges r on r.id = k.range_id where not ((r.start is null or k.key >= r.start) and (r."end" is null or k.key < r."end"))')
def misplaced_keys(m: Model) -> DataFrame:
    held = topology.route_keys(m.users.select("key"), m.ranges).select("key", ((F.col("range_id") + F.when(F.col("key") % 10 == 0, 1).otherwise(0)) % 25).alias("range_id"))
    return topology.keys_outside(held, m.ranges)


def _topology_log(m: Model) -> DataFrame:
    """A made-up log of topology commands, two hundred a group."""
    e, i = F.col("event_id"), F.col("event_id") % 200
    op = F.when(i == 0, "bootstrap").otherwise(F.element_at(F.array(*map(F.lit, ("split", "grant_lease", "split", "begin_merge", "grant_lease", "finish_merge", "change_replicas", "report_size", "report_catchup", "node_heartbeat", "abort_merge", "grant_lease"))), (e % 12 + 1).cast("int")))
    nodes = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.expr("event_id div 36") % 2 + k) % 5 + 1)
    first = F.array(F.lit(1), F.lit(2), F.lit(3))
    return m.events.select(
        F.expr("event_id div 200").alias("group"),
        e.alias("log_index"),
        op.alias("op"),
        (F.col("user_id") % 6 + 1).alias("range_id"),
        (F.col("user_id") % 7 + 1).alias("other"),
        F.lit(0).cast("long").alias("generation"),
        F.col("user_id").alias("at"),
        F.when(i == 0, first).otherwise(nodes.cast("array<int>")).alias("replicas"),
        F.array(F.lit(4)).alias("learners"),
        F.lit(2).cast("long").alias("node"),
        e.alias("time"),
        (e + 50).alias("value"),
    )


@query("topology_replay")
def topology_replay(m: Model) -> DataFrame:
    return topology.replay_topology(_topology_log(m))


@query("final_topology")
def final_topology(m: Model) -> DataFrame:
    return topology.final_topology(_topology_log(m))


@query("range_replay")
def range_replay(m: Model) -> DataFrame:
    e, i = F.col("event_id"), F.expr("event_id div 25") % 40
    op = F.when(i == 0, "init").when(i % 13 == 5, "split").when(i % 17 == 9, "grant_lease").when(i == 30, "merge").when(i == 38, "freeze").otherwise("transfer")
    null = F.lit(None).cast("long")
    c = m.events.select(
        (e % 25).alias("range_id"), e.alias("log_index"), op.alias("op"), F.when(i == 0, null).otherwise(F.col("user_id")).alias("at"), null.alias("end"), F.lit(1).cast("long").alias("generation"),
        (F.col("user_id") % 3 + 1).alias("node"), e.alias("time"), (e + 100).alias("expiry"), (e - F.when(e % 7 == 3, 25).otherwise(0)).alias("op_id"), F.col("user_id").alias("source"), ((F.col("user_id") * 7) % 50).alias("target"), F.when(i == 0, 100).otherwise(e % 90).cast("long").alias("amount"),
    )
    return topology.replay_range(c)


@query("quorum_commit_index", "with s as (select leader, list_sort(list(match), 'DESC') as m from raft_progress group by leader), j as (select leader, list_sort(list(match) filter (where peer in (1, 3)), 'DESC') as m from raft_progress group by leader) select s.leader, s.m[2] as candidate, least(s.m[2], j.m[2]) as joint from s join j using (leader)")
def quorum_commit_index(m: Model) -> DataFrame:
    a = logs.quorum_commit(m.raft_progress, [1, 2, 3])
    b = logs.quorum_commit(m.raft_progress, [1, 2, 3], [1, 3]).withColumnRenamed("candidate", "joint")
    return a.join(b, "leader")


@query("advance_commit", "select 1 as leader, case when e.term = 1 + c.idx // 100 then c.idx else 7 end as \"commit\" from (select max_ts * 90 // 100 as idx from last_ts) c left join raft_entries e on e.node = 1 and e.idx = c.idx")
def advance_commit(m: Model) -> DataFrame:
    c = logs.quorum_commit(m.raft_progress, [1, 2, 3])
    state = c.select("leader", F.expr("1 + candidate div 100").alias("term"), F.lit(7).cast("long").alias("commit"))
    return logs.advance_commit(c, m.raft_entries, state)


@query("log_matching", "with p as (select a.node as a, b.node as b, a.idx, a.term = b.term as same, a.data is distinct from b.data as differ from raft_entries a join raft_entries b on a.idx = b.idx and a.node < b.node), l as (select a, b, max(case when same then idx end) as agreed from p group by all) select p.a, p.b, p.idx from p join l on p.a = l.a and p.b = l.b where (not same or differ) and idx <= agreed")
def log_matching(m: Model) -> DataFrame:
    return logs.log_mismatches(m.raft_entries)


@query("committed_divergence", "select idx, count(distinct data) as n from raft_entries group by idx having count(distinct data) > 1")
def committed_divergence(m: Model) -> DataFrame:
    return logs.diverging(m.raft_entries, ["idx"], "data")


@query("monotonic_regressions", "select node, tick, value, before from (select user_id % 5 as node, event_id as tick, event_id // 10 - event_id % 3 as value, max(event_id // 10 - event_id % 3) over (partition by user_id % 5 order by event_id rows between unbounded preceding and 1 preceding) as before from events) where value < before")
def monotonic_regressions(m: Model) -> DataFrame:
    s = m.events.select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("tick"), (F.expr("event_id div 10") - F.col("event_id") % 3).alias("value"))
    return logs.regressions(s, ["node"], "tick", "value")


@query("log_slice", "select node, idx, term, data from (select *, row_number() over (partition by node order by idx) as n, sum(length(data)) over (partition by node order by idx) as b from raft_entries where idx >= 300) where n <= 40 and (n = 1 or b <= 200)")
def log_slice(m: Model) -> DataFrame:
    return logs.log_slice(m.raft_entries, 300, 40, 200)


@query("conflict_by_term", "select node, coalesce(max(case when idx <= 900 and term <= 6 then idx end), 0) as idx from raft_entries group by node")
def conflict_by_term(m: Model) -> DataFrame:
    return logs.conflict_by_term(m.raft_entries, 900, 6)


@query("append_batches")
def append_batches(m: Model) -> DataFrame:
    b = m.events.select((F.col("user_id") % 3).alias("node"), F.col("event_id").alias("batch"), (F.expr("event_id div 40") % 6).alias("prev_idx"), F.lit(1).cast("long").alias("prev_term"), F.array(F.lit(1).cast("long"), F.expr("1 + event_id div 4000")).alias("terms"))
    return logs.apply_appends(b)


@query("causal_depth", "with recursive c as (select id, id as root, 0 as depth from trace where caused_by is null union all select t.id, c.root, c.depth + 1 from trace t join c on t.caused_by = c.id) select id, root, depth::bigint as depth from c")
def causal_depth(m: Model) -> DataFrame:
    return logs.causal_depth(m.trace)
