"""Steps whose work may grow no faster than their input: the same rows as plain loops, and none of the plans that grew faster."""

import random
import re

from tessera.operators import audits, invariants, isolation, logs, topology


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def details(df):
    return sorted(r["detail"] for r in df.collect())


def test_configs_meet_only_their_last_entry(spark):
    rng = random.Random(3)
    entries = [(i, [1, i % 7]) for i in (-70000, 5, 6, 65535, 65536, 200000, 900000)]
    state = [(t, t % 3, rng.choice([-80000, -70000, 0, 4, 5, 65536, 70000, 131072, 199999, 899999, 2000000]), [rng.randint(0, 6), 1]) for t in range(300)]
    state += state[:20] + [(1000, 1, None, [1, 2]), (1001, 1, 5, [9, 9]), (1001, 1, 900000, [9, 9])]
    want = []
    for tick, node, commit, voters in state:
        at = [v for i, v in entries if commit is not None and i <= commit]
        if at and sorted(at[-1]) != sorted(voters):
            want.append(f"{tick} {node}")
    s = {
        "raft_state": spark.createDataFrame(state, "tick long, node long, commit long, voters array<long>"),
        "config_entries": spark.createDataFrame(entries, "idx long, voters array<long>"),
    }
    got = invariants.configs_follow_commits(s)
    assert details(got) == sorted(want)
    assert "idx#" not in "".join(x for x in plan(got).splitlines() if "Join" in x and "<=" in x)


def test_elections_meet_only_their_commits(spark):
    rng = random.Random(4)
    commits = [(i // 3 + rng.randint(-2, 2), 1 + i // 60, f"d{rng.randint(0, 1)}", rng.choice([i, i + rng.randint(-200, 200), None]), 1 + i // 60) for i in range(900)]
    elections = [(rng.randint(0, 1000), n % 3, rng.randint(1, 18), rng.randint(-5, 320)) for n in range(60)]
    entries = sorted({(n, i, t, d) for i, t, d, _, _ in commits for n in range(3) if rng.random() < 0.7})
    want = [f"{n} {lt} {i}" for tick, n, lt, snap in elections for i, t, d, ct, cterm in commits if ct is not None and cterm < lt and ct < tick and i > snap and (n, i, t, d) not in set(entries)]
    s = {
        "elections": spark.createDataFrame(elections, "tick long, node long, term long, snapshot_index long"),
        "commits": spark.createDataFrame(commits, "idx long, term long, data string, tick long, commit_term long"),
        "raft_entries": spark.createDataFrame(entries, "node long, idx long, term long, data string"),
    }
    got = invariants.leaders_are_complete(s)
    assert want and details(got) == sorted(want)
    assert not [x for x in plan(got).splitlines() if "Join Inner" in x and re.search(r"c_tick#\d+L < tick#", x) and " = " not in x]


def test_last_entry_at_each_point(spark):
    points, entries = spark.range(0, 400).selectExpr("id as at"), spark.createDataFrame([(i,) for i in (7, 8, 100, 250)], "idx long")
    want = [(p, max(i for i in (7, 8, 100, 250) if i <= p)) for p in range(7, 400)]
    assert sorted(map(tuple, logs.last_at(points, entries, 16).collect())) == want


def test_ledger_holds_no_whole_part(spark):
    rng = random.Random(5)
    accounts = [(a, 20, a // 10 % 3) for a in range(60)]
    moves, ops = [], [i // 2 if i % 4 == 1 else i for i in range(400)]
    for i, op in enumerate(ops):
        a = rng.randint(0, 62)
        moves.append((i, op, a, a - a % 10 + rng.randint(0, 9), a // 10 % 3, rng.choice([a // 10 % 3] * 9 + [7]), rng.randint(0, 20)))
    balance, decided, want = {a: b for a, b, _ in accounts}, {}, []
    for i, op, a, b, part, to, n in moves:
        out = decided.get((part, op))
        if out is None:
            if part != to or a not in balance or b not in balance:
                out = "wrong_range"
            elif balance[a] < n:
                out = decided[part, op] = "insufficient_funds"
            else:
                balance[a] -= n
                balance[b] += n
                out = decided[part, op] = "ok"
        want.append((part, i, op, out))
    got = audits.transfer_ledger(spark.createDataFrame(accounts, "account long, balance long, part long"), spark.createDataFrame(moves, "log_index long, op_id long, source long, target long, part long, target_part long, amount long"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[3] for w in want}) == 3
    assert "InPandas" not in plan(got)


def test_appends_hold_no_whole_node(spark):
    rng = random.Random(6)
    batches = [(n, b, rng.randint(0, 6), rng.randint(1, 2), [rng.randint(1, 2) for _ in range(rng.randint(0, 4))]) for b in range(300) for n in range(2)]
    all_logs, want = {0: [], 1: []}, []
    for n, b, prev, term, terms in batches:
        log = all_logs[n]
        ok = prev <= len(log) and (prev == 0 or log[prev - 1] == term)
        if ok:
            same = next((i for i, t in enumerate(terms) if prev + i >= len(log) or log[prev + i] != t), None)
            if same is not None:
                log[prev + same :] = terms[same:]
        want.append((n, b, ok, len(log)))
    got = logs.apply_appends(spark.createDataFrame(batches, "node long, batch long, prev_idx long, prev_term long, terms array<long>"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[2] for w in want} == {True, False}
    assert "InPandas" not in plan(got)


def test_ranges_hold_no_whole_log(spark):
    """Retries, more than one of an operation too, meet what was decided, and an undecided one is tried anew."""
    t = lambda i, op_id, n, g=1: (1, i, "transfer", None, None, g, 0, 0, 0, op_id, 5, 6, n)
    rows = [("uninitialised", t(1, 1, 3)), ("applied", (1, 2, "init", 0, 100, 1, None, None, None, None, None, None, 10))]
    rows += [("applied", t(3, 1, 3)), ("insufficient_funds", t(4, 2, 8)), ("applied", t(5, 1, 3)), ("wrong_range", t(6, 3, 7, 2)), ("applied", t(7, 3, 7)), ("insufficient_funds", t(8, 2, 0)), ("applied", t(9, 1, 3)), ("insufficient_funds", t(10, 4, 1))]
    schema = "range_id long, log_index long, op string, at long, end long, generation long, node long, time long, expiry long, op_id long, source long, target long, amount long"
    got = topology.replay_range(spark.createDataFrame([r for _, r in rows], schema))
    assert [r["outcome"] for r in got.orderBy("log_index").collect()] == [w for w, _ in rows]
    assert "InPandas" not in plan(got)


def test_histories_share_batches_and_keep_their_tasks(spark):
    """Many small histories: the search is no frame a history, and adaptive execution doesn't put all into one task."""
    edges = [(h, a, b, "ww", 0) for h in range(200) for a, b in ((h, h + 1), (h + 1, h)) if h % 3 or a < b]
    df = spark.createDataFrame(edges, "history_id long, src long, dst long, type string, key long")
    want = sorted((h, h, "G0", [h, h + 1], ["ww", "ww"]) for h in range(200) if h % 3)
    for found in (isolation.cycle_witnesses(df), isolation.components(df)):
        assert "InPandas" not in plan(found)
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, isolation.cycle_witnesses(df).collect())) == want


def test_real_time_edges_are_made_once_a_component(monkeypatch):
    graph = isolation.Timed({1: [(2, 0, 0, "ww")]}, {n: (2 * n, 2 * n + 1) for n in range(6)})
    graph.inside([1, 2, 4])
    assert graph.get(1) == [(2, 0, 0, "ww"), (2, 3, -1, "rt"), (4, 3, -1, "rt")] and graph.get(1) is graph.get(1)
    graph.inside([1, 5])
    assert graph.get(1) == [(2, 0, 0, "ww"), (5, 3, -1, "rt")]
    monkeypatch.setattr(isolation, "KEPT", 1)
    graph.inside([1, 2, 4])
    assert graph.get(1) == graph.get(1) and graph.get(1) is not graph.get(1)
