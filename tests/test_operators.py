"""Folds, sources, streaming and the rules that tables at hand don't show."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import audits, logs, reports, storage, topology, txn, versions
from tessera.sources import files


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scan_hides_deleted_keys_and_respects_the_snapshot(spark):
    ops = spark.createDataFrame([(1, "put", "a", 1), (2, "put", "b", 2), (3, "del", "a", 0), (4, "put", "c", 3), (5, "put", "a", 9)], "seq long, op string, key string, value int")
    assert values(storage.scan(ops), "key", "value") == [("a", 9), ("b", 2), ("c", 3)]
    assert values(storage.scan(ops, snapshot=4), "key", "value") == [("b", 2), ("c", 3)]
    assert values(storage.scan(ops, "b", "c"), "key", "value") == [("b", 2)]
    assert values(storage.scan(ops, limit=1), "key", "value") == [("a", 9)]
    assert storage.scan(ops.where("false")).count() == 0


READS = "key string, read_ts long, reader long, uncertainty_limit long"


def test_snapshot_read_rules_in_order(spark):
    v = spark.createDataFrame([("k", 10, False, "a"), ("k", 20, True, ""), ("u", 15, False, "n")], "key string, commit_ts long, tombstone boolean, value string")
    i = spark.createDataFrame([("k", 7, 1, 12, "mine"), ("own", 8, 1, 1, "o")], "key string, txn long, epoch int, start_ts long, value string")
    ask = lambda *rows, **kw: {(r["key"], r["read_ts"], r["reader"]): (r["outcome"], r["value"], r["ts"]) for r in versions.snapshot_read(v, i, spark.createDataFrame(list(rows), READS), **kw).collect()}
    got = ask(("k", 11, 0, 11), ("k", 13, 0, 13), ("k", 13, 7, 13), ("k", 13, 7, 25), ("own", 5, 8, 5), ("own", 0, 0, 0), ("u", 14, 0, 15), ("u", 15, 0, 15), ("k", 9, 0, 9))
    assert got[("k", 11, 0)] == ("found", "a", 10)
    assert got[("k", 13, 0)][0] == "blocked"
    # an own write does not spare a restart: whichever of the two reads of reader 7 was kept says so
    assert ask(("k", 13, 7, 25))[("k", 13, 7)] == ("uncertain", None, 20)
    assert ask(("k", 13, 7, 13))[("k", 13, 7)] == ("found", "mine", 0)
    assert ask(("k", 13, 7, 25), own_first=True)[("k", 13, 7)] == ("found", "mine", 13)
    assert got[("own", 5, 8)] == ("found", "o", 0)
    assert got[("own", 0, 0)] == ("not_found", None, 0)
    assert got[("u", 14, 0)] == ("uncertain", None, 15)
    assert got[("u", 15, 0)] == ("found", "n", 15)
    assert got[("k", 9, 0)] == ("not_found", None, 0)


def test_gc_keeps_a_boundary_tombstone(spark):
    v = spark.createDataFrame([("k", 1, False), ("k", 5, True), ("k", 9, False)], "key string, commit_ts long, tombstone boolean")
    kept = versions.gc_split(v, spark.createDataFrame([(6,)], "safepoint long")).where("kept")
    assert values(kept, "commit_ts") == [(5,), (9,)]


def test_locks(spark):
    q = spark.createDataFrame([(1, "k", 1, 10, False), (2, "k", 1, 10, True), (3, "k", 2, 5, False), (4, "k", 3, 20, True), (5, "j", 2, 5, True), (6, "j", 3, 20, True)], "log_index long, key string, txn long, start_ts long, shared boolean")
    got = dict(values(versions.resolve_locks(q), "log_index", "outcome"))
    assert got == {1: "granted", 2: "already_held", 3: "wound", 4: "wait", 5: "granted", 6: "granted"}


def test_wait_cycles_of_any_length(spark):
    ring = [(i, (i + 1) % 41) for i in range(41)]
    tail = [(100, 101), (101, 7), (200, 201), (201, 202), (300, 300), (400, 401), (401, 400), (402, 400)]
    got = dict(values(versions.wait_cycles(spark.createDataFrame(ring + tail, "waiter long, blocker long")), "waiter", "cycle_length"))
    assert got == {i: 41 for i in range(41)} | {300: 1, 400: 2, 401: 2}
    assert versions.wait_cycles(spark.createDataFrame(tail[:4], "waiter long, blocker long")).count() == 0
    assert versions.wait_cycles(spark.createDataFrame([(1, 1)], "waiter long, blocker long")).count() == 1
    assert versions.wait_cycles(spark.createDataFrame([], "waiter long, blocker long")).count() == 0


def test_record_lattice(spark):
    w = [
        (1, 7, 0, "pending", 0, 1, 0, [1]),
        (2, 7, 1, "staging", 9, 2, 0, [1, 2]),
        (3, 7, 0, "pending", 0, 3, 0, []),
        (4, 7, 1, "committed", 9, 3, 0, []),
        (5, 7, 1, "committed", 9, 3, 0, []),
        (6, 7, 1, "aborted", 0, 3, 0, []),
    ]
    rows = spark.createDataFrame(w, "log_index long, txn long, epoch long, status string, commit_ts long, heartbeat long, pushed_to long, keys array<bigint>")
    got = {r["log_index"]: (r["result"], r["status"]) for r in txn.record_lattice(rows).collect()}
    assert got == {1: ("ok", "pending"), 2: ("ok", "staging"), 3: ("stale_epoch", "staging"), 4: ("ok", "committed"), 5: ("ok", "committed"), 6: ("terminal", "committed")}


def test_pushes_create_aborted_records(spark):
    r = spark.createDataFrame([(1, "pending", 3, 10, 100), (2, "pending", 3, 10, 5), (3, "committed", 3, 0, 0)], "txn long, status string, pushed_to long, ttl long, heartbeat long")
    p = spark.createDataFrame([(t, 50) for t in (1, 2, 3, 4)], "txn long, push_to long")
    assert values(txn.push_records(p, r, 105), "txn", "status", "pushed_to") == [(1, "pending", 50), (2, "aborted", 3), (3, "committed", 3), (4, "aborted", 50)]


TRANSFERS = "part long, target_part long, log_index long, op_id long, source long, target long, amount long"


def test_transfers_fold_in_order_and_conserve(spark):
    a = spark.createDataFrame([(0, 1, 10), (0, 2, 0)], "part long, account long, balance long")
    t = spark.createDataFrame([(0, 0, 1, 100, 1, 2, 7), (0, 0, 2, 101, 1, 2, 7), (0, 0, 3, 100, 1, 2, 7), (0, 1, 4, 102, 1, 9, 1), (0, 0, 5, 103, 2, 1, 7), (0, 0, 6, 104, 1, 2, 10)], TRANSFERS)
    got = dict(values(audits.transfer_ledger(a, t), "log_index", "outcome"))
    assert got == {1: "ok", 2: "insufficient_funds", 3: "ok", 4: "wrong_range", 5: "ok", 6: "ok"}
    total = audits.conservation(a.select("account", "balance"), t.select("log_index", "op_id", "source", "target", "amount").where("op_id <> 102")).first()
    assert total["before"] == total["after"] == 10


def command(log_index, op, range_id=0, other=0, generation=0, at=None, replicas=(), learners=(), node=0, time=0, value=0):
    return (1, log_index, op, range_id, other, generation, at, list(replicas), list(learners), node, time, value)


def test_topology_replay(spark):
    rows = [
        (False, command(1, "split", 1, at=50)),
        (True, command(2, "bootstrap", replicas=[3, 1, 2], learners=[4])),
        (False, command(3, "bootstrap", replicas=[1])),
        (True, command(4, "split", 1, generation=1, at=50)),
        (False, command(5, "split", 1, generation=1, at=20)),
        (False, command(6, "split", 1, generation=2, at=50)),
        (False, command(7, "begin_merge", 1, 2)),
        (True, command(8, "grant_lease", 1, node=2, time=10, value=20)),
        (False, command(9, "grant_lease", 1, node=3, time=9, value=20)),
        (True, command(10, "grant_lease", 2, node=2, time=10, value=20)),
        (True, command(11, "begin_merge", 1, 2, generation=2)),
        (False, command(12, "split", 2, at=70)),
        (True, command(13, "abort_merge", other=2)),
        (False, command(14, "finish_merge", 1, 2)),
        (True, command(15, "change_replicas", 2, replicas=[1, 2, 4])),
        (False, command(16, "begin_merge", 1, 2)),
        (False, command(17, "change_replicas", 2, replicas=[5, 6, 7])),
        (True, command(18, "change_replicas", 2, replicas=[1, 2, 3])),
        (True, command(19, "report_size", 1, at=25, value=30)),
        (False, command(20, "report_size", 9)),
        (True, command(21, "report_catchup", 1, node=4)),
        (False, command(22, "report_catchup", 1, node=9)),
        (True, command(23, "node_heartbeat", node=7, time=5)),
        (True, command(24, "begin_merge", 1, 2)),
        (True, command(25, "finish_merge", 1, 2)),
        (True, command(26, "split", 1, at=90)),
        (True, command(27, "change_replicas", 1, replicas=[1, 3])),
        (False, command(28, "no_such_thing", 1)),
    ]
    df = spark.createDataFrame([r for _, r in rows], topology.COMMAND).repartition(3)
    assert [a for _, a in values(topology.replay_topology(df), "log_index", "accepted")] == [ok for ok, _ in rows]
    last = topology.final_topology(df).orderBy("id").collect()
    assert [(r["id"], r["start"], r["end"], r["frozen"], r["lease_holder"]) for r in last] == [(1, None, 90, False, 0), (3, 90, None, False, 0)]
    assert last[0]["replicas"] == [1, 3] and last[0]["caught_up"] == [4] and last[0]["n_keys"] == 30


def test_range_replay(spark):
    schema = "range_id long, log_index long, op string, at long, end long, generation long, node long, time long, expiry long, op_id long, source long, target long, amount long"
    t = lambda i, op_id, a, b, n, g=1: (1, i, "transfer", None, None, g, 0, 0, 0, op_id, a, b, n)
    c = lambda i, op, at=None, end=None, g=0, node=0, time=0, expiry=0, n=0: (1, i, op, at, end, g, node, time, expiry, None, None, None, n)
    rows = [
        ("uninitialised", t(1, 1, 5, 6, 1)),
        ("applied", c(2, "init", 0, 100, 1, n=10)),
        ("ignored", c(3, "init", 0, 9, 1, n=10)),
        ("applied", t(4, 1, 5, 6, 7)),
        ("insufficient_funds", t(5, 2, 5, 6, 7)),
        ("applied", t(6, 1, 5, 6, 7)),
        ("wrong_range", t(7, 3, 5, 100, 1)),
        ("wrong_range", t(8, 3, 5, 6, 1, g=2)),
        ("applied", c(9, "split", 50, g=2)),
        ("wrong_range", t(10, 4, 5, 60, 1, g=2)),
        ("applied", c(11, "merge", 50, 70, 3)),
        ("ignored", c(12, "merge", 50, 90, 3)),
        ("applied", t(13, 4, 6, 60, 17, g=3)),
        ("applied", c(14, "grant_lease", node=1, time=5, expiry=10)),
        ("ignored", c(15, "grant_lease", node=2, time=13, expiry=20)),
        ("applied", c(16, "grant_lease", node=2, time=14, expiry=20)),
        ("ignored", c(17, "set_descriptor", g=2)),
        ("applied", c(18, "freeze")),
        ("frozen", t(19, 9, 5, 6, 1, g=3)),
        ("insufficient_funds", t(20, 2, 5, 6, 7)),
    ]
    got = values(topology.replay_range(spark.createDataFrame([r for _, r in rows], schema)), "log_index", "outcome")
    assert [o for _, o in got] == [o for o, _ in rows]


def test_append_batches_cut_conflicts(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, [1, 1, 1]), (1, 2, 2, 1, [2]), (1, 3, 9, 1, [2]), (1, 4, 3, 1, [3]), (1, 5, 0, 0, [1])], "node long, batch long, prev_idx long, prev_term long, terms array<bigint>")
    assert values(logs.apply_appends(b), "batch", "accepted", "last_idx") == [(1, True, 3), (2, True, 3), (3, False, 3), (4, False, 3), (5, True, 3)]


def test_routing_agrees(spark):
    r = spark.createDataFrame([(i, None if i == 0 else i * 10, None if i == 9 else i * 10 + 10, 1) for i in range(10)], "id long, start long, end long, generation long")
    keys = spark.createDataFrame([(k,) for k in range(-20, 140, 7)], "key long")
    assert values(topology.route_keys(keys, r), "key", "range_id") == values(topology.route_many(keys, r, 5), "key", "range_id")


def test_sorted_files_come_back(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("key"), F.col("id").alias("value"))
    files.write_sorted(df, str(tmp_path / "run"), partitions=3)
    got = files.read_sorted(spark, str(tmp_path / "run"))
    assert values(got, "key", "value") == values(df, "key", "value")


def test_text_sources(spark, tmp_path):
    trace = spark.createDataFrame([(1, None, 2, "send", 5, {"to": 3})], files.TRACE_SCHEMA)
    files.write_jsonl(trace, str(tmp_path / "trace"))
    assert files.read_trace(spark, str(tmp_path / "trace")).collect() == trace.collect()
    drill = "DRILL|s|m|yes|yes|3|1|by|X-1|no|no|n"
    lines = spark.createDataFrame([(drill,), ("noise",), ("DRILL|short",)], "value string")
    assert files.parse_drills(lines).first()["mutation"] == "m" and files.parse_drills(lines).count() == 1
    doc = spark.createDataFrame([("# Title\n\n### AB-12 broken\nstatus: fixed\nseed = 4\n\ntext\n### AB-13 x\nstatus: open\n",)], "value string")
    assert values(files.parse_ledger(doc), "id", "field", "text") == [("AB-12", "seed", "4"), ("AB-12", "status", "fixed"), ("AB-13", "status", "open")]
    seeds = spark.createDataFrame([("reproduce = suite_a 12",), ("no",)], "value string")
    assert values(files.parse_reproduction(seeds), "suite", "seed") == [("suite_a", 12)]


def test_run_files_leave_sidecars_aside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seed": 1, "workload": "w", "violated": false}\n')
    (tmp_path / "a.buggify.jsonl").write_text('{"id": "s1", "name": "n", "activations": 2}\n')
    assert files.read_runs(spark, str(tmp_path)).count() == 1
    assert files.read_sites(spark, str(tmp_path)).first()["activations"] == 2


def test_minimal_sets_with_an_empty_one(spark):
    f = spark.createDataFrame([(1, [1, 2]), (2, [2]), (3, [3, 4])], "set_id long, features array<int>")
    assert values(reports.minimal_sets(f), "set_id") == [(2,), (3,)]
    assert values(reports.minimal_sets(f.union(spark.createDataFrame([(4, [])], f.schema))), "set_id") == [(4,)]


@pytest.mark.parametrize("batches", [1, 3])
def test_streamed_transfers_equal_the_batch_fold(spark, tmp_path, batches):
    from tessera.streaming.machines import transfer_machine

    rows = [(i % 2, i % 2, i, i if i % 5 else i - i % 10, i % 2 + 2 * (i % 3), i % 2 + 2 * ((i + 1) % 3), i % 13) for i in range(60)]
    per = len(rows) // batches
    for b in range(batches):
        spark.createDataFrame(rows[b * per : (b + 1) * per], TRANSFERS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TRANSFERS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = transfer_machine(stream, 10).writeStream.format("memory").queryName(f"out{batches}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = values(spark.table(f"out{batches}"), "part", "op_id", "outcome")
    accounts = spark.createDataFrame([(a % 2, a, 10) for a in range(6)], "part long, account long, balance long")
    want = values(audits.transfer_ledger(accounts, spark.createDataFrame(rows, TRANSFERS)), "part", "op_id", "outcome")
    assert got == want


def test_streamed_retries_pass_once(spark, tmp_path):
    from tessera.streaming.machines import closed_counts, first_attempts

    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) as at, id % 10 as op_id, 'x' as event_type from range(30)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, op_id long, event_type string").parquet(str(tmp_path / "in"))
    q = first_attempts(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 10
    q = closed_counts(stream, "at", "10 minutes", "1 minute").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["n"] for r in spark.table("closed").collect()} == {10}
