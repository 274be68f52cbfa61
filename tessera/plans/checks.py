"""Queries over audits, invariants and fleet reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import audits, invariants, logs, reports, versions
from tessera.plans.catalog import query
from tessera.plans.store import _COVER
from tessera.sources.model import Model


@query(
    "conservation_total",
    """with t as (select * from (select *, row_number() over (partition by op_id order by log_index) as n from transfers) where n = 1),
d as (select account, sum(d) as d from (select source as account, -amount as d from t union all select target, amount from t) group by account)
select count(balance) as accounts, sum(coalesce(balance, 0))::bigint as before, sum(coalesce(balance, 0) + coalesce(d, 0))::bigint as after from accounts full join d using (account)""",
)
def conservation_total(m: Model) -> DataFrame:
    return audits.conservation(m.accounts, m.transfers)


@query("first_attempts", "select log_index, op_id, source, target, amount from (select *, row_number() over (partition by op_id order by log_index) as n from transfers) where n = 1")
def first_attempts(m: Model) -> DataFrame:
    return audits.first_attempts(m.transfers)


@query("transfer_ledger")
def transfer_ledger(m: Model) -> DataFrame:
    part = lambda c: F.pmod(F.expr(f"{c} div 10"), F.lit(16))
    t = m.transfers.withColumns({"target": F.col("source") - F.col("source") % 10 + F.col("target") % 10}).withColumns({"part": part("source"), "target_part": part("target")})
    return audits.transfer_ledger(m.accounts.withColumn("part", part("account")), t)


@query("duplicate_operations", "select op_id, count(*) as n from transfers group by op_id having count(*) > 1")
def duplicate_operations(m: Model) -> DataFrame:
    return audits.multiples(m.transfers, ["op_id"])


@query("lost_operations", "select distinct op_id from transfers where op_id % 101 = 0 or source % 40 = 0")
def lost_operations(m: Model) -> DataFrame:
    return audits.lost_operations(m.transfers, m.transfers.where("op_id % 101 <> 0 and source % 40 <> 0"), ["op_id"])


@query("lost_elements", "with a as (select history_id, key, element from mops where type = 'append'), f as (select history_id, key, unnest(elements) as element from orders_of) select distinct a.history_id, a.key, a.element from a anti join f on a.history_id = f.history_id and a.key = f.key and a.element = f.element")
def lost_elements(m: Model) -> DataFrame:
    from tessera.operators.isolation import version_orders

    mo = m.mops
    final = version_orders(mo).select("history_id", "key", F.explode("elements").alias("element"))
    return audits.lost_operations(mo.where("type = 'append'"), final, ["history_id", "key", "element"])


@query("counter_promises", "select user_id % 3 as node, event_id as id from events where event_type = 'purchase' and event_id % 9 = 4")
def counter_promises(m: Model) -> DataFrame:
    e = m.events.select((F.col("user_id") % 3).alias("node"), F.col("event_id").alias("id"), "event_type")
    return e.where("event_type = 'purchase'").select("node", "id").join(e.where("id % 9 <> 4").select("node", "id"), ["node", "id"], "left_anti")


@query(
    "durability_audit",
    """with a as (select user_id as key, max(event_id) as want from events where event_type = 'purchase' group by user_id), h as (select node, user_id as key, max(event_id) as has from events, (select unnest([1, 2, 3]) as node) where (event_id + node) % 50 <> 0 group by all)
select a.key, n.node, a.want, h.has from a cross join (select unnest([1, 2, 3]) as node) n left join h on h.node = n.node and h.key = a.key where h.has is null or h.has < a.want""",
)
def durability_audit(m: Model) -> DataFrame:
    nodes = m.spark.createDataFrame([(1,), (2,), (3,)], "node int")
    acked = m.events.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"))
    held = m.events.select(F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("node"), F.col("user_id").alias("key"), F.col("event_id").alias("idx")).where("(idx + node) % 50 <> 0")
    return audits.durability(acked, held, nodes)


_READS = "select user_id as key, event_id as op, event_id as invoked, event_id - event_id % 40 as idx from events where event_type = 'view'"
_ACKS = "select user_id as key, event_id + 3 as acked, event_id as idx from events where event_type = 'purchase'"


@query("stale_reads", f"select r.key, r.op, r.idx, max(w.idx) as need from ({_READS}) r join ({_ACKS}) w on r.key = w.key and w.acked < r.invoked group by all having r.idx < max(w.idx)")
def stale_reads(m: Model) -> DataFrame:
    r = m.events.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("op"), F.col("event_id").alias("invoked"), (F.col("event_id") - F.col("event_id") % 40).alias("idx"))
    w = m.events.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), (F.col("event_id") + 3).alias("acked"), F.col("event_id").alias("idx"))
    return audits.stale_reads(r, w)


@query("session_deduped_kv", "with c as (select user_id % 7 as client, event_id // 3 - event_id % 4 as seq, event_id as idx, user_id as key, value from events), l as (select *, max(seq) over (partition by client order by idx rows between unbounded preceding and 1 preceding) as top from c) select key, arg_max(value, idx) as value, max(idx) as idx from l where top is null or seq > top group by key")
def session_deduped_kv(m: Model) -> DataFrame:
    c = m.events.select((F.col("user_id") % 7).alias("client"), (F.expr("event_id div 3") - F.col("event_id") % 4).alias("seq"), F.col("event_id").alias("idx"), F.col("user_id").alias("key"), "value")
    return audits.session_kv(c)


_CLAIMS = "select user_id as key, user_id % 4 + event_id % 2 as range_id, event_id % 3 as node, event_id // 2000 as generation, max(event_id) as applied, user_id % 4 + event_id % 2 = 2 as frozen from events group by all"


@query(
    "owner_resolution",
    f"""with c as ({_CLAIMS}), t as (select *, max(generation) over (partition by key, range_id) as top from c),
p as (select *, row_number() over (partition by key, range_id order by applied desc, node) as n from t where generation = top),
o as (select *, row_number() over (partition by key order by frozen, range_id) as r from p where n = 1) select key, range_id, node from o where r = 1""",
)
def owner_resolution(m: Model) -> DataFrame:
    keys = [F.col("user_id").alias("key"), (F.col("user_id") % 4 + F.col("event_id") % 2).alias("range_id"), (F.col("event_id") % 3).alias("node"), F.expr("event_id div 2000").alias("generation")]
    c = m.events.groupBy(*keys).agg(F.max("event_id").alias("applied")).withColumn("frozen", F.col("range_id") == 2)
    return audits.owners(c)


@query("freshest_replicas", "select range_id, node, applied from (select *, row_number() over (partition by range_id order by applied desc, node) as n from (select user_id % 25 as range_id, event_id % 5 as node, max(event_id // 100) as applied from events where event_id % 5 <> 2 group by all)) where n = 1")
def freshest_replicas(m: Model) -> DataFrame:
    s = m.events.groupBy((F.col("user_id") % 25).alias("range_id"), (F.col("event_id") % 5).alias("node")).agg(F.expr("max(event_id div 100)").alias("applied"))
    s = s.withColumns({"alive": F.col("node") != 2, "ready": F.lit(True)})
    return audits.freshest_replicas(s, ["range_id"]).select("range_id", "node", "applied")


_SUSPECTS = "select event_id // 500 as audit, user_id as key, min(event_id % 3) as owner from events where event_type = 'error' group by 1, 2"


@query("persistent_suspects", f"select audit, key, owner from (select *, lag(owner) over w as b, lag(audit) over w as a from ({_SUSPECTS}) window w as (partition by key order by audit)) where b = owner and a = audit - 1")
def persistent_suspects(m: Model) -> DataFrame:
    s = m.events.where("event_type = 'error'").groupBy(F.expr("event_id div 500").alias("audit"), F.col("user_id").alias("key")).agg(F.min(F.col("event_id") % 3).alias("owner"))
    return audits.persistent_suspects(s)


@query(
    "long_reader_model_check",
    """with sp as (select max_ts // 2 as sp from last_ts), g as (select v.*, row_number() over (partition by key, commit_ts <= sp order by commit_ts desc) as n, sp from versions v, sp), left_ as (select * from g where commit_ts > sp or n = 1),
r as (select distinct key, read_ts from reads)
select r.key, r.read_ts, case when not s.tombstone then s.value end as value, case when not m.tombstone then m.value end as expected from r asof left join left_ s on r.key = s.key and r.read_ts >= s.commit_ts asof left join versions m on r.key = m.key and r.read_ts >= m.commit_ts
where case when not s.tombstone then s.value end is distinct from case when not m.tombstone then m.value end""",
)
def long_reader_model_check(m: Model) -> DataFrame:
    sp = m.last_ts.select(F.expr("max_ts div 2").alias("safepoint"))
    left = versions.gc_split(m.versions, sp).where("kept").select("key", "commit_ts", "tombstone", "value")
    seen, model = (versions.committed_value(v, m.reads).select("key", "read_ts", "value") for v in (left, m.versions))
    return audits.model_mismatches(seen, model)


@query("hop_checksums")
def hop_checksums(m: Model) -> DataFrame:
    h = m.events.select(F.expr("event_id div 500").alias("run"), F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("node"), F.col("user_id").alias("token"), (F.col("event_id") % 7).alias("hop"))
    return audits.hop_checksums(h)


@query("one_writer_per_ts", "select commit_ts, count(distinct txn) as n from (select event_id - case when event_id % 97 = 0 then 1 else 0 end as commit_ts, event_id as txn from events) group by commit_ts having count(distinct txn) > 1")
def one_writer_per_ts(m: Model) -> DataFrame:
    t = m.events.select((F.col("event_id") - F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("commit_ts"), F.col("event_id").alias("txn"))
    return logs.diverging(t, ["commit_ts"], "txn")


@query("invariant_violations", """select 'MVCC-03' as id, key || ' ' || commit_ts as detail from (select key, commit_ts, lag(commit_ts) over (partition by key order by -(commit_ts + case when commit_ts % 53 = 0 then 40 else 0 end), commit_ts) as p from versions) where commit_ts >= p
union all select 'TXN-01', key || ' ' || txn from intents where txn not in (select txn from txn_records)
union all select 'RAFT-16', idx || ' ' || term from raft_entries group by idx, term having count(distinct data) > 1
union all select 'SHARD-01', id || ' ' || problem from (""" + _COVER.format("broken_ranges") + ")")
def invariant_violations(m: Model) -> DataFrame:
    moved = F.col("commit_ts") + F.when(F.col("commit_ts") % 53 == 0, 40).otherwise(0)
    chains = m.versions.select("key", "commit_ts", F.struct((-moved).alias("a"), F.col("commit_ts").alias("b")).alias("pos"))
    state = {"chains": chains, "intents": m.intents, "txn_records": m.txn_records, "raft_entries": m.raft_entries, "ranges": m.broken_ranges}
    return invariants.violations(state, ["MVCC-03", "TXN-01", "RAFT-16", "SHARD-01"])


@query("invariants_never_fired", "select * from (values ('RAFT-03'), ('MVCC-06')) as v(id)")
def invariants_never_fired(m: Model) -> DataFrame:
    fired = invariants.violations({"raft_entries": m.raft_entries, "intents": m.intents, "txn_records": m.txn_records}, ["RAFT-16", "TXN-01"])
    return invariants.never_fired(["RAFT-03", "RAFT-16", "MVCC-06", "TXN-01"], fired)


def _spec(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, writes and versions of a made-up set of transactions, some of them wrong."""
    status = F.element_at(F.array(*map(F.lit, ("committed", "aborted", "staging"))), (F.col("txn") % 3 + 1).cast("int"))
    e = m.events.select((F.expr("event_id div 5")).alias("txn"), F.col("user_id").alias("key"), "event_id")
    w = e.select("txn", "key").distinct()
    r = e.groupBy("txn").agg((F.max("event_id") + 1).alias("commit_ts"), F.array_sort(F.collect_set(F.when(F.col("event_id") % 41 != 0, F.col("key")))).alias("keys")).withColumn("status", status)
    made = e.where("event_id % 37 <> 0 and txn % 3 = 0 or event_id % 43 = 0").select("txn", "key").distinct().join(r.select("txn", "commit_ts"), "txn").select("txn", "key", (F.col("commit_ts") + F.when(F.col("key") % 47 == 0, 1).otherwise(0)).alias("commit_ts"))
    return r, w, made


_SPEC = """with e as (select event_id // 5 as txn, user_id as key, event_id from events), w as (select distinct txn, key from e),
r as (select txn, max(event_id) + 1 as commit_ts, coalesce(list(distinct key) filter (where event_id % 41 <> 0), []) as keys, (['committed', 'aborted', 'staging'])[txn % 3 + 1] as status from e group by txn),
made as (select d.txn, d.key, r.commit_ts + case when d.key % 47 = 0 then 1 else 0 end as commit_ts from (select distinct txn, key from e where event_id % 37 <> 0 and txn % 3 = 0 or event_id % 43 = 0) d join r on d.txn = r.txn)"""


@query("commit_atomicity", f"{_SPEC} select w.txn, w.key from w join r on w.txn = r.txn where status = 'committed' and not exists (select 1 from made where made.txn = w.txn and made.key = w.key)")
def commit_atomicity(m: Model) -> DataFrame:
    r, w, made = _spec(m)
    return invariants.partial_commits(r, w, made)


@query("incomplete_key_lists", f"{_SPEC} select distinct r.txn from r join w on r.txn = w.txn where status in ('staging', 'committed') and not list_contains(keys, w.key)")
def incomplete_key_lists(m: Model) -> DataFrame:
    r, w, _ = _spec(m)
    return invariants.key_lists_are_complete(r, w)


@query("aborted_traces", f"{_SPEC} select made.txn, made.key, made.commit_ts from made join r on made.txn = r.txn where status = 'aborted'")
def aborted_traces(m: Model) -> DataFrame:
    r, _, made = _spec(m)
    return invariants.aborted_traces(r, made)


@query("misdated_versions", f"{_SPEC} select made.txn, made.key, made.commit_ts, r.commit_ts as want from made join r on made.txn = r.txn where status = 'committed' and made.commit_ts <> r.commit_ts")
def misdated_versions(m: Model) -> DataFrame:
    r, _, made = _spec(m)
    return invariants.misdated_versions(r, made)


@query("fleet_summary", "select workload, count(*) as runs, count(*) filter (where violated) as failed, sum(node_nanos)::bigint as node_nanos, count(*) >= 20 and count(*) filter (where violated) > 0.9 * count(*) as broken from fleet_runs group by rollup (workload)")
def fleet_summary(m: Model) -> DataFrame:
    return reports.fleet_summary(m.fleet_runs)


@query("failure_classes", "with f as (select *, row_number() over (partition by workload, invariant, signature order by seed) as n from fleet_runs where violated) select workload, invariant, signature, count(*) as n, string_agg(seed::varchar, ',' order by seed) filter (where n <= 8) as seeds from f group by all")
def failure_classes(m: Model) -> DataFrame:
    c = reports.failure_classes(m.fleet_runs)
    return c.withColumn("seeds", F.array_join(F.transform("seeds", lambda s: s.cast("string")), ","))


_RULES = [(1, "error", "INV-0", "sig-1", "known crash"), (2, "error", "INV-0", "sig", "other crash"), (3, "view", "INV-3", "view", "slow view"), (4, "click", "INV-2", "nothing", "never")]


@query("known_classes", f"with r as (select * from (values {', '.join(map(str, _RULES))}) as v(rank, workload, invariant, part, cause)), c as (select distinct workload, invariant, signature from fleet_runs where violated) select c.workload, c.invariant, c.signature, arg_min(cause, rank) as cause from c left join r on c.workload = r.workload and c.invariant = r.invariant and contains(c.signature, r.part) group by all")
def known_classes(m: Model) -> DataFrame:
    rules = m.spark.createDataFrame(_RULES, "rank int, workload string, invariant string, part string, cause string")
    return reports.known_classes(reports.failure_classes(m.fleet_runs), rules)


@query("site_coverage", "with a as (select user_id as site, max(case when event_type = 'purchase' then event_id % 2 else 0 end) > 0 as hit from events group by user_id) select count(*) as sites, count(*) filter (where a.hit) as covered, 100 * count(*) filter (where a.hit) >= 95 * count(*) as enough from (select user_id as site from events union select max(user_id) + 1 from events) s left join a on s.site = a.site")
def site_coverage(m: Model) -> DataFrame:
    a = m.events.select(F.col("user_id").alias("site"), F.when(F.col("event_type") == "purchase", F.col("event_id") % 2).otherwise(0).alias("activations"))
    extra = m.events.agg((F.max("user_id") + 1).alias("site"))
    return reports.site_coverage(a, m.events.select(F.col("user_id").alias("site")).union(extra).distinct())


@query("mutation_score", "select count(*) filter (where k % 5 <> 0) as must_detect, count(*) filter (where k % 5 <> 0 and k % 7 <> 0) as caught, count(*) filter (where k % 5 = 0 and k % 7 = 0) as silent_controls, count(*) filter (where k % 7 <> 0 and k % 3 = 0) as invisible from (select user_id as k from events)")
def mutation_score(m: Model) -> DataFrame:
    k = F.col("user_id")
    return reports.mutation_score(m.events.select((k % 5 != 0).alias("must_detect"), (k % 7 != 0).alias("caught"), (k % 5 == 0).alias("control"), (k % 3 != 0).alias("client_visible")))


@query("ledger_tally", "select count(*) as entries, count(case when id % 3 <> 0 then id end) as seeded, count(*) filter (where id % 2 = 0 and id % 3 <> 0) as failed_before, count(*) filter (where id % 2 = 0 and id % 3 <> 0 and id % 5 <> 0) as verified from (select distinct user_id as id from events)")
def ledger_tally(m: Model) -> DataFrame:
    e = m.users.select(F.col("key").alias("id"))
    c = e.where("id % 3 <> 0").select("id", F.col("id").alias("seed"), (F.col("id") % 2 == 0).alias("failed_before"), (F.col("id") % 5 != 0).alias("passed_after"))
    return reports.ledger_tally(e, c)


@query(
    "minimal_fault_sets",
    """with f as (select user_id as set_id, list_sort(list(distinct event_id % 11)) as features from events where event_id % 3 = 0 group by user_id)
select set_id, array_to_string(features, ',') as features from f a where not exists (select 1 from f b where len(b.features) < len(a.features) and list_has_all(a.features, b.features))""",
)
def minimal_fault_sets(m: Model) -> DataFrame:
    f = m.events.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("set_id")).agg(F.array_sort(F.collect_set(F.col("event_id") % 11)).alias("features"))
    return reports.minimal_sets(f).select("set_id", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"))


@query(
    "symbol_verdicts",
    """with s as (select distinct user_id % 9 as object, event_type || user_id % 5 as symbol from events), e as (select * from (values (1, 'error0', 20), (2, 'view1', 5)) as v(object, symbol, expires)),
r as (select * from (values (1, '^error', 'forbidden'), (2, '[01]$', 'review'), (3, 'view', 'allowed')) as v(rank, pattern, verdict))
select s.object, s.symbol, case when e.expires >= 10 then 'excused' when e.expires is not null then 'expired_excuse' else coalesce((select arg_min(verdict, rank) from r where regexp_matches(s.symbol, r.pattern)), 'allowed') end as verdict from s left join e on s.object = e.object and s.symbol = e.symbol""",
)
def symbol_verdicts(m: Model) -> DataFrame:
    s = m.events.select((F.col("user_id") % 9).alias("object"), F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("symbol"), F.lit("U").alias("kind")).distinct()
    e = m.spark.createDataFrame([(1, "error0", 20), (2, "view1", 5)], "object long, symbol string, expires int")
    r = m.spark.createDataFrame([(1, "^error", "forbidden"), (2, "[01]$", "review"), (3, "view", "allowed")], "rank int, pattern string, verdict string")
    return reports.symbol_rules(s, e, r, 10)
