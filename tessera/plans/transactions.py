"""Queries over transactions and isolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import isolation, txn
from tessera.plans.catalog import query
from tessera.sources.files import history_text
from tessera.sources.model import Model


def _listed(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query("serial_model", "select history_id, txn_id, pos, key, array_to_string(seen, ',') as observed from modelled where type = 'read'")
def serial_model(m: Model) -> DataFrame:
    return isolation.serial_model(m.mops_raw).where("type = 'read'").select("history_id", "txn_id", "pos", "key", _listed("observed").alias("observed"))


@query("writer_index", "select history_id, key, element, txn_id from writers")
def writer_index(m: Model) -> DataFrame:
    return isolation.writers(m.mops)


@query("recovered_version_order", "select history_id, key, array_to_string(elements, ',') as elements, conflicted from orders_of")
def recovered_version_order(m: Model) -> DataFrame:
    return isolation.version_orders(m.mops).select("history_id", "key", _listed("elements").alias("elements"), "conflicted")


_DOUBLED = "select history_id, txn_id, pos, type, key, element - case when pos % 31 = 0 then pos % 4 else 0 end as element from mops_raw where type = 'append'"


@query(
    "duplicate_elements",
    f"""with a as ({_DOUBLED}), f as (select history_id, key, element, arg_min(txn_id, pos) as first_txn from a group by all)
select a.history_id, a.key, a.element, first_txn, arg_min(a.txn_id, a.pos) as other_txn from a join f on a.history_id = f.history_id and a.key = f.key and a.element = f.element where a.txn_id <> first_txn group by all""",
)
def duplicate_elements(m: Model) -> DataFrame:
    moved = F.col("element") - F.when(F.col("pos") % 31 == 0, F.col("pos") % 4).otherwise(0)
    return isolation.duplicate_elements(m.mops_raw.where("type = 'append'").withColumn("element", moved))


@query(
    "aborted_reads",
    "with s as (select distinct history_id, txn_id as reader, key, unnest(observed) as element from mops where type = 'read') select s.history_id, s.reader, w.txn_id as writer, s.key, s.element from s join writers w on s.history_id = w.history_id and s.key = w.key and s.element = w.element join history h on h.history_id = w.history_id and h.txn_id = w.txn_id where h.outcome = 'aborted' and s.reader <> w.txn_id",
)
def aborted_reads(m: Model) -> DataFrame:
    return isolation.aborted_reads(m.mops, m.history)


@query(
    "intermediate_reads",
    """with s as (select distinct history_id, txn_id as reader, key, observed[len(observed)] as element from mops where type = 'read' and len(observed) > 0)
select s.history_id, s.reader, w.txn_id as writer, s.key, s.element from s join writers w on s.history_id = w.history_id and s.key = w.key and s.element = w.element join history h on h.history_id = w.history_id and h.txn_id = w.txn_id
join last_appends l on l.history_id = w.history_id and l.txn_id = w.txn_id and l.key = w.key where h.outcome = 'committed' and s.reader <> w.txn_id and l.element <> s.element""",
)
def intermediate_reads(m: Model) -> DataFrame:
    return isolation.intermediate_reads(m.mops, m.history)


@query("edges_ww", "select history_id, src, dst, type, key from ww")
def edges_ww(m: Model) -> DataFrame:
    return isolation.edges_ww(m.mops)


@query("edges_wr", "select history_id, src, dst, type, key from wr")
def edges_wr(m: Model) -> DataFrame:
    return isolation.edges_wr(m.mops)


@query("edges_rw", "select history_id, src, dst, type, key from rw")
def edges_rw(m: Model) -> DataFrame:
    return isolation.edges_rw(m.mops)


@query("edges_rt", "select a.history_id, a.txn_id as src, b.txn_id as dst, 'rt' as type, -1::bigint as key from history a join history b on a.history_id = b.history_id where a.outcome = 'committed' and b.outcome = 'committed' and a.completed < b.invoked and a.txn_id <> b.txn_id")
def edges_rt(m: Model) -> DataFrame:
    return isolation.edges_rt(m.history)


@query(
    "edges_rt_reduced",
    """with c as (select * from history where outcome = 'committed') select a.history_id, a.txn_id as src, b.txn_id as dst, 'rt' as type, -1::bigint as key from c a join c b on a.history_id = b.history_id and a.completed < b.invoked and a.txn_id <> b.txn_id
where not exists (select 1 from c x where x.history_id = a.history_id and x.invoked > a.completed and x.completed < b.invoked)""",
)
def edges_rt_reduced(m: Model) -> DataFrame:
    return isolation.edges_rt(m.history, reduced=True)


@query("edge_counts", "select history_id, type, count(*) as n from (select * from ww union all select * from wr union all select * from rw) group by all")
def edge_counts(m: Model) -> DataFrame:
    return isolation.edges(m.mops, m.history).groupBy("history_id", "type").agg(F.count("*").alias("n"))


@query(
    "isolation_sccs",
    """with recursive e as (select distinct history_id, src, dst from (select history_id, src, dst from ww union all select history_id, src, dst from wr union all select history_id, src, dst from rw)),
reach as (select history_id, src, dst from e union select r.history_id, r.src, e.dst from reach r join e on r.history_id = e.history_id and r.dst = e.src),
mutual as (select a.history_id, a.src as txn_id, a.dst as other from reach a join reach b on a.history_id = b.history_id and a.src = b.dst and a.dst = b.src where a.src <> a.dst)
select history_id, least(txn_id, min(other)) as component, txn_id from mutual group by history_id, txn_id""",
)
def isolation_sccs(m: Model) -> DataFrame:
    return isolation.components(isolation.edges(m.mops, m.history))


@query("cycle_witnesses")
def cycle_witnesses(m: Model) -> DataFrame:
    return isolation.cycle_witnesses(isolation.edges(m.mops, m.history))


@query("isolation_verdicts")
def isolation_verdicts(m: Model) -> DataFrame:
    """The flagship: every history judged at the serializable level."""
    return isolation.verdicts(m.mops, m.history)


@query("snapshot_verdicts")
def snapshot_verdicts(m: Model) -> DataFrame:
    return isolation.verdicts(m.mops, m.history, "snapshot-isolation")


@query("strict_verdicts")
def strict_verdicts(m: Model) -> DataFrame:
    return isolation.verdicts(m.mops, m.history, "strict-serializable")


@query("verdict_agreement")
def verdict_agreement(m: Model) -> DataFrame:
    return isolation.compare_verdicts(isolation.verdicts(m.mops, m.history), isolation.verdicts(m.mops, m.history, "snapshot-isolation")).groupBy("result").agg(F.count("*").alias("n"))


@query("forbidden_anomalies", "select * from (values " + ", ".join(f"('{lv}', '{a}')" for lv in isolation.LEVELS for a in (*isolation.ALWAYS, *isolation.FORBIDS[lv])) + ") as v(level, anomaly)")
def forbidden_anomalies(m: Model) -> DataFrame:
    return isolation.forbidden(m.spark)


@query(
    "write_skew_pairs",
    """with r as (select distinct m.history_id, m.txn_id, m.key from mops m where type = 'read'), w as (select distinct history_id, txn_id, key from mops where type = 'append'),
x as (select distinct r.history_id, r.txn_id, w.txn_id as other from r join w on r.history_id = w.history_id and r.key = w.key and r.txn_id <> w.txn_id),
o as (select a.history_id, a.txn_id as a, b.txn_id as b from history a join history b on a.history_id = b.history_id and a.txn_id < b.txn_id where a.outcome = 'committed' and b.outcome = 'committed' and a.invoked - 6 <= b.completed and b.invoked - 6 <= a.completed)
select o.history_id, a, b from o join x on x.history_id = o.history_id and x.txn_id = a and x.other = b join x y on y.history_id = o.history_id and y.txn_id = b and y.other = a""",
)
def write_skew_pairs(m: Model) -> DataFrame:
    return isolation.write_skew_pairs(m.mops, m.history.withColumn("invoked", F.col("invoked") - 6))


@query(
    "history_lines",
    """select history_id, txn_id, count(*)::bigint * 0 + 2 as lines, sum(case when type = 'append' then 1 else 0 end)::bigint as appends from mops group by history_id, txn_id""",
)
def history_lines(m: Model) -> DataFrame:
    t = history_text(m.mops, m.history)
    appends = F.regexp_count("line", F.lit(":append")).cast("long")
    return t.groupBy("history_id", "txn_id").agg(F.count("*").alias("lines"), F.max(appends).alias("appends"))


_REQUESTS = "select 3000000 + event_id % 400 as txn, user_id as key, min(event_id) // 3 as start_ts from events where event_id % 3 = 0 group by 1, 2"


def _requests(m: Model) -> DataFrame:
    return m.events.where("event_id % 3 = 0").groupBy((F.lit(3000000) + F.col("event_id") % 400).alias("txn"), F.col("user_id").alias("key")).agg(F.expr("min(event_id) div 3").alias("start_ts"))


_PREWRITTEN = f"select q.txn, q.key, case when i.txn is not null and i.txn <> q.txn then 'locked' when n.newest > q.start_ts then 'conflict' else 'ok' end as result from ({_REQUESTS}) q left join intents i on q.key = i.key left join (select key, max(commit_ts) as newest from versions where key % 3 <> 0 group by key) n on q.key = n.key"


@query("prewrites", _PREWRITTEN)
def prewrites(m: Model) -> DataFrame:
    return txn.prewrites(_requests(m).withColumn("epoch", F.lit(1)), m.intents, m.versions.where("key % 3 <> 0"))


@query("intent_resolutions", "select q.txn, q.key, q.op, case when i.txn is null then 'not_found' when i.txn <> q.txn then 'rejected' when q.op = 'commit' and q.epoch <> i.epoch or q.op = 'rollback' and i.epoch > q.epoch then 'stale_epoch' else 'ok' end as result from (select key + 1000000 + case when key % 15 = 0 then 1 else 0 end as txn, key, key % 3 as epoch, case when key % 2 = 0 then 'commit' else 'rollback' end as op from users) q left join intents i on q.key = i.key")
def intent_resolutions(m: Model) -> DataFrame:
    q = m.users.select((F.col("key") + 1000000 + F.when(F.col("key") % 15 == 0, 1).otherwise(0)).alias("txn"), "key", (F.col("key") % 3).alias("epoch"), F.when(F.col("key") % 2 == 0, "commit").otherwise("rollback").alias("op"))
    return txn.resolutions(q, m.intents)


@query("record_lattice")
def record_lattice(m: Model) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("pending", "staging", "pending", "committed", "aborted"))), (F.col("event_id") % 5 + 1).cast("int"))
    w = m.events.select(F.col("event_id").alias("log_index"), (F.col("user_id") + 1000000).alias("txn"), (F.col("event_id") % 3).alias("epoch"), status.alias("status"), F.col("event_id").alias("commit_ts"), F.col("event_id").alias("heartbeat"), F.col("event_id").alias("pushed_to"), F.array(F.col("user_id")).alias("keys"))
    return txn.record_lattice(w)


@query("record_pushes", "select p.txn, case when r.status is null then 'aborted' when r.status in ('committed', 'aborted') then r.status when r.key % 3 <> 0 then 'aborted' else r.status end as status, case when r.status is null then 5000 when r.status in ('committed', 'aborted') or r.key % 3 <> 0 then 10 else 5000 end::bigint as pushed_to from (select key + 1000000 as txn from users) p left join txn_records r on p.txn = r.txn")
def record_pushes(m: Model) -> DataFrame:
    r = m.txn_records.select("txn", "status", F.lit(10).cast("long").alias("pushed_to"), F.lit(50).alias("ttl"), F.when(F.col("key") % 3 == 0, 990).otherwise(900).alias("heartbeat"))
    p = m.users.select((F.col("key") + 1000000).alias("txn"), F.lit(5000).cast("long").alias("push_to"))
    return txn.push_records(p, r, 1000)


_READSET = "select 4000000 + event_id % 300 as txn, user_id as key, max(event_id) as read_ts, max(event_id) + 30 as up_to from events where event_id % 4 = 1 group by 1, 2"
_REFRESHED = f"select r.txn, bool_and(a.commit_ts is not distinct from b.commit_ts) as ok from ({_READSET}) r asof left join versions a on r.key = a.key and r.read_ts >= a.commit_ts asof left join versions b on r.key = b.key and r.up_to >= b.commit_ts group by r.txn"


def _read_set(m: Model, base: int = 4000000) -> DataFrame:
    return m.events.where("event_id % 4 = 1").groupBy((F.lit(base) + F.col("event_id") % 300).alias("txn"), F.col("user_id").alias("key")).agg(F.max("event_id").alias("read_ts"), (F.max("event_id") + 30).alias("up_to"))


@query("read_refresh", _REFRESHED)
def read_refresh(m: Model) -> DataFrame:
    return txn.read_refresh(_read_set(m), m.versions)


@query("commit_verdicts", f"with p as (select txn, bool_and(result = 'ok') as written from ({_PREWRITTEN}) group by txn), f as (select txn - 1000000 as txn, ok from ({_REFRESHED})) select coalesce(p.txn, f.txn) as txn, case when coalesce(written, true) and coalesce(ok, true) then 'committed' else 'aborted' end as verdict from p full join f on p.txn = f.txn")
def commit_verdicts(m: Model) -> DataFrame:
    p = txn.prewrites(_requests(m).withColumn("epoch", F.lit(1)), m.intents, m.versions.where("key % 3 <> 0"))
    return txn.commit_verdicts(p, txn.read_refresh(_read_set(m, 3000000), m.versions))


@query(
    "staging_implicit_commit",
    """with s as (select txn, epoch, case when key % 3 = 0 then max_ts else 0 end as commit_ts, key, max_ts from txn_records join last_ts on true where status = 'staging'),
k as (select txn, epoch, commit_ts, unnest(case when key % 4 = 1 and key % 10 = 5 then [key, key + 5] else [key] end) as key from s)
select k.txn, bool_and(i.key is not null or v.key is not null and k.commit_ts <> 0) as committed from k left join intents i on k.txn = i.txn and k.epoch = i.epoch and k.key = i.key left join versions v on k.key = v.key and k.commit_ts = v.commit_ts group by k.txn""",
)
def staging_implicit_commit(m: Model) -> DataFrame:
    top = F.broadcast(m.last_ts)
    keys = F.when((F.col("key") % 4 == 1) & (F.col("key") % 10 == 5), F.array(F.col("key"), F.col("key") + 5)).otherwise(F.array("key"))
    r = m.txn_records.join(top).select("txn", "epoch", "status", F.when(F.col("key") % 3 == 0, F.col("max_ts")).otherwise(F.lit(0).cast("long")).alias("commit_ts"), keys.alias("keys"))
    return txn.implicit_commits(r, m.intents, m.versions)


@query("resolved_blockers", "select i.key, i.txn, case when r.status is null or r.status = 'aborted' then 'roll_back' when r.status = 'committed' then 'commit' else 'wait' end as action from intents i left join txn_records r on i.txn = r.txn")
def resolved_blockers(m: Model) -> DataFrame:
    return txn.resolved_blockers(m.intents, m.txn_records)


@query("orphaned_intents", "select i.key, i.txn, r.status from intents i left join txn_records r on i.txn = r.txn where r.status is null or r.status not in ('committed', 'aborted')")
def orphaned_intents(m: Model) -> DataFrame:
    return txn.orphaned_intents(m.intents, m.txn_records)


@query("intents_without_record", "select key, txn from intents where txn not in (select txn from txn_records)")
def intents_without_record(m: Model) -> DataFrame:
    return m.intents.join(m.txn_records.select("txn"), "txn", "left_anti").select("key", "txn")


@query("best_records", "with c as (select txn, status, epoch, key from txn_records union all select txn, 'pending', 7, key from txn_records) select txn, status, epoch, key from (select *, row_number() over (partition by txn order by case when status in ('committed', 'aborted') then 1 else 0 end desc, epoch desc) as n from c) where n = 1")
def best_records(m: Model) -> DataFrame:
    r = m.txn_records.select("txn", "status", "epoch", "key")
    return txn.best_records(r.unionByName(r.withColumns({"status": F.lit("pending"), "epoch": F.lit(7)})))


@query("audited_values", "with n as (select key, arg_max(tombstone, commit_ts) as dead, arg_max(value, commit_ts) as value from versions group by key), d as (select i.key, i.value from intents i join txn_records r on i.txn = r.txn where r.status = 'committed') select n.key, case when d.key is not null then d.value when not dead then n.value end as value from n left join d on n.key = d.key")
def audited_values(m: Model) -> DataFrame:
    return txn.audited_values(m.versions, m.intents, m.txn_records)


@query("exported_span", "select key, commit_ts, tombstone, value from versions where key >= 30 and key < 70")
def exported_span(m: Model) -> DataFrame:
    return txn.export_span(m.versions, 30, 70)


@query("oracle_reservations", "select part, log_index, last - n + 1 as first, last from (select user_id as part, event_id as log_index, event_id % 5 + 1 as n, sum(event_id % 5 + 1) over (partition by user_id order by event_id)::bigint as last from events)")
def oracle_reservations(m: Model) -> DataFrame:
    return txn.oracle_reservations(m.events.select(F.col("user_id").alias("part"), F.col("event_id").alias("log_index"), (F.col("event_id") % 5 + 1).alias("n")))


@query("hlc_series", "select node, seq, max(wall - i) over (partition by node order by seq) + i as ts from (select user_id % 5 as node, event_id as seq, event_id // 4 as wall, row_number() over (partition by user_id % 5 order by event_id) as i from events)")
def hlc_series(m: Model) -> DataFrame:
    return txn.hybrid_clock(m.events.select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("seq"), F.expr("event_id div 4").alias("wall")))


@query("terminal_status_changes", "select txn, tick, before, status from (select user_id as txn, event_id as tick, case event_type when 'error' then 'aborted' when 'purchase' then 'committed' else 'pending' end as status, lag(case event_type when 'error' then 'aborted' when 'purchase' then 'committed' else 'pending' end) over (partition by user_id order by event_id) as before from events) where before in ('committed', 'aborted') and before <> status")
def terminal_status_changes(m: Model) -> DataFrame:
    from pyspark.sql import Window

    status = F.when(F.col("event_type") == "error", "aborted").when(F.col("event_type") == "purchase", "committed").otherwise("pending")
    s = m.events.select(F.col("user_id").alias("txn"), F.col("event_id").alias("tick"), status.alias("status"))
    s = s.withColumn("before", F.lag("status").over(Window.partitionBy("txn").orderBy("tick")))
    return s.where("before in ('committed', 'aborted') and before <> status").select("txn", "tick", "before", "status")
