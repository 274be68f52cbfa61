"""A query an invariant: samples of state made from the events table, breaches planted by remainders, and the check of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import invariants
from tessera.plans.catalog import query
from tessera.sources.model import Model

#: relation -> SQL over events, in DuckDB's words; `spark_sql` turns what differs.
RELATIONS = {
    "raft_state": """select event_id // 5 as tick, event_id % 5 + 1 as node, event_id % 17 <> 3 as alive, case when event_id % 5 = event_id // 200 % 5 or event_id % 211 = 0 then 'leader' else 'follower' end as role,
  1 + event_id // 200 as term, event_id // 10 - case when event_id % 97 = 0 then 3 else 0 end as commit, event_id // 10 as applied, event_id // 10 + 2 - case when event_id % 89 = 0 then 5 else 0 end as last_index,
  case when event_id % 101 = 7 then event_id // 10 + 5 else 1 end as first_index, case when event_id % 103 = 5 then event_id // 10 + 1 else 0 end as snapshot_index, event_id % 19 = 0 as corrupted,
  1 + event_id // 200 - case when event_id % 83 = 0 then 1 else 0 end + case when event_id % 79 = 0 then 2 else 0 end as durable_term, 1 + event_id // 200 % 5 + case when event_id % 107 = 0 then 1 else 0 end as durable_vote,
  event_id // 10 - case when event_id % 109 = 0 then 2 else 0 end as durable_commit, case when event_id % 5 = event_id // 200 % 5 or event_id % 113 = 0 then event_id + 50 else 0 end as lease_expiry, event_id as now, 20 + event_id % 3 as uncertainty from events""",
    "commits": "select event_id as tick, event_id // 3 as idx, 1 + event_id // 300 as term, 'd' || (event_id // 3) || case when event_id % 59 = 0 then 'x' else '' end as data, 1 + event_id // 300 as commit_term from events",
    "elections": "select event_id as tick, user_id % 5 + 1 as node, 1 + event_id // 300 + 1 as term, event_id // 3 - 6 as snapshot_index from events where event_id % 300 = 299",
    "entries": "select n as node, event_id // 3 as idx, 1 + event_id // 300 as term, 'd' || (event_id // 3) || case when event_id % 61 = 0 and n = 2 then 'y' else '' end as data from events, (select 1 as n union all select 2 union all select 3 union all select 4 union all select 5) as v where event_id % 3 = 0",
    "leader_log": "select event_id % 5 + 1 as node, event_id // 10 as idx, 1 + event_id // 200 - case when event_id % 31 = 0 then 1 else 0 end as term from events where event_id % 10 < 5",
    "linear_reads": "select user_id as key, event_id as op, event_id as invoked, event_id // 2 as idx from events where event_id % 3 = 0",
    "acked_writes": "select user_id as key, event_id as acked, event_id // 2 - case when event_id % 7 = 1 then -40 else 3 end as idx from events where event_id % 3 = 1",
    "snapshot_reads": "select user_id as key, event_id as read_ts, case when event_id % 5 > 0 then event_type end as value from events",
    "model_reads": "select user_id as key, event_id as read_ts, case when event_id % 5 > 0 then event_type || case when event_id % 71 = 3 then '?' else '' end end as value from events",
    "safepoints": "select event_id as tick, event_id // 2 + case when event_id % 67 = 0 then 9 else 0 end as safepoint, event_id // 2 + event_id % 4 as floor from events",
    "chains": "select user_id as key, event_id as commit_ts from events where event_id % 73 <> 5",
    "model_versions": "select user_id as key, event_id as commit_ts from events",
    "waits": "select distinct user_id as waiter, (user_id * 3 + 1) % (select count(distinct user_id) from events) as blocker from events",
    "txns": "select user_id as txn, user_id * 7 % 31 as start_ts, case when user_id % 13 = 0 then 'aborted' when user_id % 11 = 0 then 'committed' else 'pending' end as status from events group by user_id",
    "locks": "select event_id % 97 as key, user_id * 2 as txn from events where event_id % 5 = 0",
    "ranges": "select k as id, case when k > 0 then k * 10 end as start, case when k < 9 then k * 10 + 10 end as stop from (select distinct user_id % 10 as k from events) as d",
    "held_keys": "select distinct user_id as key, case when user_id < 100 then (user_id + case when user_id % 29 = 3 then 10 else 0 end) // 10 else 9 end as range_id from events where user_id % 10 < 9 or user_id < 90",
    "leases": "select event_id as tick, user_id % 6 as range_id, user_id % 4 as holder, event_id as start, event_id + 2 + event_id % 9 as expiry, event_id + 1 as now, 1 as uncertainty from events union all select event_id, user_id % 6, user_id % 4 + 1, event_id + 1, event_id + 4, event_id + 1, 1 from events where event_id % 211 = 0",
    "nodes": "select event_id % 5 + 1 as node, event_id % 5 <> 2 as alive from events",
    "holders": "select distinct event_id // 9 as idx, user_id % 3 + 1 as node from events",
    "due": "select distinct event_id // 9 as idx, [1, 2, 3] as voters from events",
    "configs": "select event_id // 5 as tick, event_id % 5 + 1 as node, event_id // 10 as commit, [3, 1, 4 + event_id // 1000 + case when event_id % 43 = 0 then 1 else 0 end] as voters from events",
    "config_entries": "select distinct event_id // 1000 * 100 as idx, [1, 4 + event_id // 1000, 3] as voters from events",
    "placed_ranges": "select k as id, k * 10 as start, k * 10 + 10 as stop, k % 3 = 1 as frozen, [k // 2, 90, 91 + k // 50] as replicas from (select distinct user_id as k from events) as d where k % 17 > 0",
    "range_samples": "select event_id as tick, user_id % 8 as id, event_id // 100 as start, event_id // 100 + 5 + case when event_id % 173 = 0 then 1 else 0 end as stop, event_id // 100 + 1 - case when event_id % 179 = 0 then 1 else 0 end as generation, [event_id // 100, 7] as replicas from events",
    "meta": "select k as id, k // 4 + 1 + case when k = 6 then 1 else 0 end as bucket from (select distinct user_id % 10 as k from events) as d where k <> 3",
    "digests": "select user_id % 6 as range_id, event_id // 40 as applied, 'h' || (event_id // 40) || case when event_id % 127 = 0 then '!' else '' end as digest from events",
    "peers": "select event_id // 5 as range_id, event_id % 5 as node, case when event_id % 5 = 0 then 'leader' else 'follower' end as role, event_id // 5 % 3 = 0 as quiesced, event_id % 7 > 0 as alive, event_id // 5 - case when event_id % 41 = 0 then 1 else 0 end as applied from events",
    "lease_reads": "select user_id % 6 as range_id, event_id as op, event_id as invoked, event_id // 2 as idx from events where event_id % 4 = 0",
    "done_reads": "select user_id % 6 as range_id, event_id as acked, event_id // 2 - case when event_id % 137 = 1 then -60 else 9 end as idx from events where event_id % 4 = 1",
    "record_samples": "select event_id as tick, user_id // 3 as txn, user_id % 2 as range_id, 1 as node, event_id as applied, case when event_id % 1000 < 300 then 'pending' when user_id // 3 % 2 = 0 or event_id % 139 = 0 then 'committed' else 'aborted' end as status from events",
    "txn_outcomes": "select event_id as txn, case when event_id % 3 < 2 then 'committed' else 'aborted' end as status, event_id + case when event_id % 149 = 0 then 9 else 0 end as start_ts, event_id + 4 - case when event_id % 151 = 7 then 1 else 0 end as commit_ts from events",
    "oracle_samples": "select event_id as tick, user_id % 3 as node, event_id // 10 - case when event_id % 157 = 0 then 2 else 0 end as high_water from events",
    "remote_waits": "select distinct user_id % 50 as waiter, (user_id % 50 * 7 + 3) % 50 as blocker from events",
    "promised": "select user_id % 4 as node, event_id as id from events where event_id % 2 = 0",
    "held": "select user_id % 4 as node, event_id as id from events where event_id % 2 = 0 and (event_id % 163 > 0 or user_id % 4 = 1) or user_id % 4 = 2 and event_id % 5 = 1",
    "applied": "select user_id % 4 as node, event_id as id from events where event_id % 167 > 0",
    "acked": "select event_id as id from events where event_id % 3 = 0",
}


def spark_sql(sql: str) -> str:
    return sql.replace("//", "div").replace(" from events", " from {events}").replace("[", "array(").replace("]", ")")


def relation(m: Model, name: str) -> DataFrame:
    return m.spark.sql(spark_sql(RELATIONS[name]), events=m.events)


_BACK = "select {by}, tick from (select *, max({v}) over (partition by {by} order by tick rows between unbounded preceding and 1 preceding) as before from {rel}) where {v} < before"
_CYCLES = """walk as (select waiter, blocker as here from {0} union select w.waiter, b.blocker from walk w join {0} b on w.here = b.waiter),
loops as (select waiter from walk where here = waiter), least as (select l.waiter, min(k.here) as name from loops l join walk k using (waiter) group by l.waiter)
select l.waiter || ' ' || count(*) from least l join least o on l.name = o.name group by l.waiter"""

#: invariant -> (the check's relation names, as the state here has them; SQL of the details)
CHECKS: dict[str, tuple[dict[str, str], str]] = {
    "RAFT-01": ({"raft_state": "raft_state"}, "select term || ' ' || count(distinct node) from raft_state where role = 'leader' and alive group by term having count(distinct node) > 1"),
    "RAFT-02": (
        {"raft_state": "raft_state"},
        "select tick || ' ' || node from (select *, lag(last_index) over w as pl, lag(term) over w as pt, lag(role) over w as pr from raft_state window w as (partition by node order by tick)) where role = 'leader' and pr = 'leader' and term = pt and last_index < pl",
    ),
    "RAFT-03": (
        {"raft_entries": "entries"},
        "select p.a || ' ' || p.b || ' ' || p.idx from (select x.node as a, y.node as b, x.idx, x.term = y.term as same, x.data <> y.data as differ from entries x join entries y on x.idx = y.idx and x.node < y.node) p, (select x.node as a, y.node as b, max(x.idx) as agreed from entries x join entries y on x.idx = y.idx and x.node < y.node and x.term = y.term group by all) l where p.a = l.a and p.b = l.b and (not same or differ) and idx <= agreed",
    ),
    "RAFT-04": (
        {"elections": "elections", "commits": "commits", "raft_entries": "entries"},
        "select e.node || ' ' || e.term || ' ' || c.idx from elections e join commits c on c.commit_term < e.term and c.tick < e.tick and c.idx > e.snapshot_index where not exists (select 1 from entries x where x.node = e.node and x.idx = c.idx and x.term = c.term and x.data = c.data)",
    ),
    "RAFT-05": ({"commits": "commits"}, "select idx || ' ' || count(distinct data) from commits group by idx having count(distinct data) > 1"),
    "RAFT-06": (
        {"raft_state": "raft_state"},
        f"select tick || ' ' || node from ({_BACK.format(by='node', v='durable_term', rel='(select * from raft_state where not corrupted)')} union all select node, tick from raft_state where not corrupted and term < durable_term)",
    ),
    "RAFT-07": ({"raft_state": "raft_state"}, "select node || ' ' || durable_term from raft_state where durable_vote > 0 group by node, durable_term having count(distinct durable_vote) > 1"),
    "RAFT-08": ({"raft_state": "raft_state"}, f"select tick || ' ' || node from ({_BACK.format(by='node', v='durable_commit', rel='raft_state')})"),
    "RAFT-09": (
        {"commits": "due", "holders": "holders", "raft_state": "nodes"},
        "select idx || ' ' || got || ' 3' from (select d.idx, count(*) filter (where h.node is not null or n in (select node from nodes where not alive)) as got from due d cross join (values (1), (2), (3)) v(n) left join holders h on h.idx = d.idx and h.node = n group by d.idx) where 2 * got <= 3",
    ),
    "RAFT-10": (
        {"raft_state": "raft_state", "raft_entries": "leader_log"},
        "select r.tick || ' ' || r.node || ' ' || r.commit from (select *, lag(commit) over w as pc, lag(role) over w as pr, lag(term) over w as pt from raft_state window w as (partition by node order by tick)) r join leader_log e on e.node = r.node and e.idx = r.commit where r.role = 'leader' and pr = 'leader' and r.term = pt and r.commit > pc and e.term <> r.term",
    ),
    "RAFT-11": ({"raft_state": "raft_state"}, "select tick || ' ' || node from raft_state where snapshot_index > applied or first_index > applied + 1"),
    "RAFT-12": ({"raft_state": "configs", "config_entries": "config_entries"}, "select tick || ' ' || node from configs c join config_entries e on e.idx = (select max(x.idx) from config_entries x where x.idx <= c.commit) where list_sort(c.voters) <> list_sort(e.voters)"),
    "RAFT-13": ({"raft_state": "raft_state"}, "select tick || ' ' || count(distinct node) from raft_state where lease_expiry > now group by tick having count(distinct node) > 1 and min(lease_expiry - now) > max(uncertainty)"),
    "RAFT-14": ({"linear_reads": "linear_reads", "acked_writes": "acked_writes"}, "select r.key || ' ' || r.op from linear_reads r where r.idx < (select max(w.idx) from acked_writes w where w.key = r.key and w.acked < r.invoked)"),
    "MVCC-01": ({"snapshot_reads": "snapshot_reads", "model_reads": "model_reads"}, "select s.key || ' ' || s.read_ts from snapshot_reads s join model_reads r on s.key = r.key and s.read_ts = r.read_ts where s.value is distinct from r.value"),
    "MVCC-02": ({"safepoints": "safepoints"}, "select tick || ' ' || safepoint || ' ' || floor from safepoints where safepoint > floor"),
    "MVCC-04": ({"model_versions": "model_versions", "chains": "chains"}, "select key || ' ' || commit_ts from model_versions v where not exists (select 1 from chains c where c.key = v.key and c.commit_ts = v.commit_ts)"),
    "MVCC-06": ({"waits": "waits"}, _CYCLES.format("waits")),
    "MVCC-07": ({"waits": "waits", "txns": "txns"}, "select w.waiter || ' ' || w.blocker from waits w join txns a on a.txn = w.waiter join txns b on b.txn = w.blocker where a.start_ts < b.start_ts or a.start_ts = b.start_ts and a.txn < b.txn"),
    "MVCC-08": ({"locks": "locks", "txns": "txns"}, "select l.key || ' ' || l.txn || ' ' || coalesce(status, '-') from locks l left join txns t on l.txn = t.txn where status is null or status in ('committed', 'aborted')"),
    "SHARD-02": ({"held_keys": "held_keys", "ranges": "ranges"}, "select key || ' ' || range_id from held_keys h join ranges r on r.id = h.range_id where not ((start is null or key >= start) and (stop is null or key < stop))"),
    "SHARD-03": ({"placed_ranges": "placed_ranges"}, "select r.id::varchar from placed_ranges r left join placed_ranges l on l.stop = r.start where r.frozen and (l.id is null or list_sort(l.replicas) <> list_sort(r.replicas))"),
    "SHARD-04": (
        {"leases": "leases"},
        """select tick || ' ' || range_id || ' overlap' from leases where start <= now and now < expiry group by tick, range_id having count(distinct holder) > 1
union all select tick || ' ' || range_id || ' hand-over' from (select *, lag(holder) over w as ph, lag(expiry) over w as pe from leases window w as (partition by range_id order by tick, start)) where holder <> ph and start < pe + 2 * uncertainty""",
    ),
    "SHARD-05": (
        {"range_samples": "range_samples"},
        "select tick || ' ' || id from (select *, lag(generation) over w as g, lag(start) over w as ps, lag(stop) over w as pe, lag(list_sort(replicas)) over w as pr from range_samples window w as (partition by id order by tick)) where generation < g or generation = g and (start <> ps or stop <> pe or list_sort(replicas) <> pr)",
    ),
    "SHARD-07": ({"ranges": "ranges", "meta": "meta"}, "select coalesce(w.id, m.id)::varchar from (select id, (row_number() over (order by start nulls first) - 1) // 4 + 1 as bucket from ranges) w full join meta m on w.id = m.id where w.id is null or m.id is null or w.bucket <> m.bucket"),
    "SHARD-08": ({"peers": "peers"}, "select p.range_id || ' ' || p.node from peers p join peers l on l.range_id = p.range_id and l.quiesced and l.role = 'leader' where p.alive and p.applied < l.applied"),
    "SHARD-09": ({"digests": "digests"}, "select range_id || ' ' || applied from digests group by range_id, applied having count(distinct digest) > 1"),
    "SHARD-CLIENT": ({"lease_reads": "lease_reads", "done_reads": "done_reads"}, "select r.range_id || ' ' || r.op from lease_reads r where r.idx < (select max(w.idx) from done_reads w where w.range_id = r.range_id and w.acked < r.invoked)"),
    "TXN-02": (
        {"record_samples": "record_samples"},
        "select tick || ' ' || txn from (select *, lag(status) over w as p, lag(applied) over w as pa from record_samples window w as (partition by txn, range_id, node order by tick)) where p in ('committed', 'aborted') and p <> status and applied >= pa",
    ),
    "TXN-03": ({"txn_outcomes": "txn_outcomes"}, "select txn::varchar from txn_outcomes where status = 'committed' and commit_ts <= start_ts"),
    "TXN-09": (
        {"txn_outcomes": "txn_outcomes", "oracle_samples": "oracle_samples"},
        f"select 'twice ' || commit_ts from txn_outcomes where status = 'committed' group by commit_ts having count(distinct txn) > 1 union all select 'back ' || tick || ' ' || node from ({_BACK.format(by='node', v='high_water', rel='oracle_samples')})",
    ),
    "TXN-12": ({"remote_waits": "remote_waits"}, _CYCLES.format("remote_waits")),
    "CTR-01": ({"promised": "promised", "held": "held"}, "select p.node::varchar from (select node, count(*) as p from promised group by node) p left join (select node, count(*) as h from held group by node) h on p.node = h.node where p > coalesce(h, 0)"),
    "CTR-02": ({"promised": "promised", "applied": "applied"}, "select node || ' ' || id from promised p where not exists (select 1 from applied a where a.node = p.node and a.id = p.id)"),
    "CTR-03": ({"acked": "acked", "applied": "applied"}, "select id::varchar from acked where id not in (select id from applied)"),
}


def _register(name: str, relations: dict[str, str], details: str) -> None:
    given = ", ".join(f"{r} as ({RELATIONS[r]})" for r in dict.fromkeys(relations.values()))
    walk = details.startswith("walk as")
    before, last = (details.rsplit("\nselect ", 1)[0] + ", ", "select " + details.rsplit("\nselect ", 1)[1]) if walk else ("", details)
    sql = f"with recursive {given}, {before}found(detail) as ({last}) select detail from found"

    @query(f"invariant_{name.lower().replace('-', '_')}", f"select '{name}' as id, detail from ({sql})")
    def run(m: Model) -> DataFrame:
        state = {own: relation(m, r).withColumnRenamed("stop", "end") for own, r in relations.items()}
        return invariants.violations(state, [name])


for _name, (_relations, _details) in CHECKS.items():
    _register(_name, _relations, _details)
