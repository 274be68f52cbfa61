"""Each invariant passes a sound state and reports one planted fault, so none is vacuous."""

import pytest

from tessera.operators import invariants

STATE = "tick long, node long, alive boolean, role string, term long, commit long, applied long, last_index long, first_index long, snapshot_index long, corrupted boolean, durable_term long, durable_vote long, durable_commit long, lease_expiry long, now long, uncertainty long, voters array<bigint>, learners array<bigint>"
FIELDS = [f.split()[0] for f in STATE.split(", ")]
SOUND = {"tick": 1, "node": 1, "alive": True, "role": "follower", "term": 1, "commit": 2, "applied": 2, "last_index": 3, "first_index": 1, "snapshot_index": 0, "corrupted": False, "durable_term": 1, "durable_vote": 1, "durable_commit": 2, "lease_expiry": 0, "now": 5, "uncertainty": 2, "voters": [1, 2, 3], "learners": [9]}


def state(*changes):
    return STATE, [tuple((SOUND | c)[f] for f in FIELDS) for c in changes]


ENTRIES = "node long, idx long, term long, data string"
COMMITS = "tick long, idx long, term long, data string, commit_term long, voters array<bigint>"
CHAIN = "key string, pos long, commit_ts long"
READ, WRITE = "key string, op long, invoked long, idx long", "key string, acked long, idx long"
RANGE = "id long, start long, end long"
SAMPLE = "tick long, id long, start long, end long, generation long, replicas array<bigint>, learners array<bigint>, caught_up array<bigint>"
WAIT, TXN = "waiter long, blocker long", "txn long, start_ts long, status string"

#: id -> (sound relations, the same with a fault): relation name -> (schema, rows)
CASES = {
    "RAFT-01": ({"raft_state": state({"role": "leader"}, {"node": 2})}, {"raft_state": state({"role": "leader"}, {"node": 2, "role": "leader"})}),
    "RAFT-02": ({"raft_state": state({"role": "leader"}, {"tick": 2, "role": "leader", "last_index": 4})}, {"raft_state": state({"role": "leader"}, {"tick": 2, "role": "leader", "last_index": 2})}),
    "RAFT-03": ({"raft_entries": (ENTRIES, [(1, 1, 1, "a"), (2, 1, 1, "a")])}, {"raft_entries": (ENTRIES, [(1, 1, 1, "a"), (1, 2, 2, "x"), (2, 1, 1, "b"), (2, 2, 2, "x")])}),
    "RAFT-04": (
        {"elections": ("tick long, node long, term long, snapshot_index long", [(9, 2, 3, 0)]), "commits": (COMMITS, [(5, 1, 1, "a", 2, [1, 2, 3])]), "raft_entries": (ENTRIES, [(2, 1, 1, "a")])},
        {"elections": ("tick long, node long, term long, snapshot_index long", [(9, 2, 3, 0)]), "commits": (COMMITS, [(5, 1, 1, "a", 2, [1, 2, 3])]), "raft_entries": (ENTRIES, [(2, 1, 1, "b")])},
    ),
    "RAFT-05": ({"commits": (COMMITS, [(5, 1, 1, "a", 1, [1])])}, {"commits": (COMMITS, [(5, 1, 1, "a", 1, [1]), (6, 1, 1, "b", 1, [1])])}),
    "RAFT-06": ({"raft_state": state({}, {"tick": 2, "term": 2, "durable_term": 2})}, {"raft_state": state({"term": 3, "durable_term": 3}, {"tick": 2})}),
    "RAFT-07": ({"raft_state": state({}, {"tick": 2})}, {"raft_state": state({}, {"tick": 2, "durable_vote": 2})}),
    "RAFT-08": ({"raft_state": state({}, {"tick": 2})}, {"raft_state": state({}, {"tick": 2, "durable_commit": 1})}),
    "RAFT-09": (
        {"commits": (COMMITS, [(5, 1, 1, "a", 1, [1, 2, 3])]), "holders": ("idx long, node long", [(1, 1)]), "raft_state": state({"node": 2, "alive": False})},
        {"commits": (COMMITS, [(5, 1, 1, "a", 1, [1, 2, 3])]), "holders": ("idx long, node long", [(1, 1)]), "raft_state": state({"node": 2})},
    ),
    "RAFT-10": (
        {"raft_state": state({"role": "leader"}, {"tick": 2, "role": "leader", "commit": 3}), "raft_entries": (ENTRIES, [(1, 3, 1, "a")])},
        {"raft_state": state({"role": "leader", "term": 2}, {"tick": 2, "role": "leader", "term": 2, "commit": 3}), "raft_entries": (ENTRIES, [(1, 3, 1, "a")])},
    ),
    "RAFT-11": ({"raft_state": state({})}, {"raft_state": state({"snapshot_index": 3})}),
    "RAFT-12": ({"raft_state": state({}), "config_entries": ("idx long, voters array<bigint>", [(1, [3, 2, 1]), (9, [1])])}, {"raft_state": state({}), "config_entries": ("idx long, voters array<bigint>", [(1, [1, 2])])}),
    "RAFT-13": ({"raft_state": state({"lease_expiry": 50}, {"node": 2, "lease_expiry": 6})}, {"raft_state": state({"lease_expiry": 50}, {"node": 2, "lease_expiry": 40})}),
    "RAFT-14": ({"linear_reads": (READ, [("k", 1, 10, 5)]), "acked_writes": (WRITE, [("k", 10, 9)])}, {"linear_reads": (READ, [("k", 1, 10, 5)]), "acked_writes": (WRITE, [("k", 9, 9)])}),
    "RAFT-15": (
        {"matches": ("tick long, commit long, voters array<bigint>, match map<bigint, bigint>", [(1, 5, [1, 2, 3], {1: 9, 2: 5})])},
        {"matches": ("tick long, commit long, voters array<bigint>, match map<bigint, bigint>", [(1, 6, [1, 2, 3], {1: 9, 2: 5, 9: 9})])},
    ),
    "RAFT-16": ({"raft_entries": (ENTRIES, [(1, 1, 1, "a"), (2, 1, 1, "a"), (2, 1, 2, "b")])}, {"raft_entries": (ENTRIES, [(1, 1, 1, "a"), (2, 1, 1, "b")])}),
    "MVCC-01": (
        {"snapshot_reads": ("key string, read_ts long, value string", [("k", 1, None)]), "model_reads": ("key string, read_ts long, value string", [("k", 1, None)])},
        {"snapshot_reads": ("key string, read_ts long, value string", [("k", 1, None)]), "model_reads": ("key string, read_ts long, value string", [("k", 1, "x")])},
    ),
    "MVCC-02": ({"safepoints": ("tick long, safepoint long, floor long", [(1, 5, 5)])}, {"safepoints": ("tick long, safepoint long, floor long", [(1, 6, 5)])}),
    "MVCC-03": ({"chains": (CHAIN, [("k", 1, 9), ("k", 2, 4)])}, {"chains": (CHAIN, [("k", 1, 9), ("k", 2, 9)])}),
    "MVCC-04": ({"model_versions": (CHAIN, [("k", 1, 9)]), "chains": (CHAIN, [("k", 1, 9)])}, {"model_versions": (CHAIN, [("k", 1, 9)]), "chains": (CHAIN, [("k", 1, 8)])}),
    "MVCC-05": ({"suspects": ("audit long, key string, owner long", [(1, "k", 5), (3, "k", 5)])}, {"suspects": ("audit long, key string, owner long", [(1, "k", 5), (2, "k", 5)])}),
    "MVCC-06": ({"waits": (WAIT, [(1, 2), (2, 3)])}, {"waits": (WAIT, [(1, 2), (2, 1)])}),
    "MVCC-07": ({"waits": (WAIT, [(2, 1)]), "txns": (TXN, [(1, 5, "pending"), (2, 9, "pending")])}, {"waits": (WAIT, [(1, 2)]), "txns": (TXN, [(1, 5, "pending"), (2, 9, "pending")])}),
    "MVCC-08": ({"locks": ("key string, txn long", [("k", 1)]), "txns": (TXN, [(1, 5, "pending")])}, {"locks": ("key string, txn long", [("k", 1)]), "txns": (TXN, [(1, 5, "aborted")])}),
    "SHARD-01": ({"ranges": (RANGE, [(1, None, 5), (2, 5, None)])}, {"ranges": (RANGE, [(1, None, 5), (2, 6, None)])}),
    "SHARD-02": ({"held_keys": ("key long, range_id long", [(3, 1)]), "ranges": (RANGE, [(1, None, 5)])}, {"held_keys": ("key long, range_id long", [(5, 1)]), "ranges": (RANGE, [(1, None, 5)])}),
    "SHARD-03": (
        {"placed_ranges": ("id long, start long, end long, frozen boolean, replicas array<bigint>", [(1, None, 5, False, [1, 2]), (2, 5, None, True, [2, 1])])},
        {"placed_ranges": ("id long, start long, end long, frozen boolean, replicas array<bigint>", [(1, None, 5, False, [1, 3]), (2, 5, None, True, [2, 1])])},
    ),
    "SHARD-04": (
        {"leases": ("tick long, range_id long, holder long, start long, expiry long, now long, uncertainty long", [(1, 1, 1, 0, 10, 5, 2), (2, 1, 2, 14, 20, 15, 2)])},
        {"leases": ("tick long, range_id long, holder long, start long, expiry long, now long, uncertainty long", [(1, 1, 1, 0, 10, 5, 2), (2, 1, 2, 13, 20, 15, 2)])},
    ),
    "SHARD-05": ({"range_samples": (SAMPLE, [(1, 1, 0, 5, 1, [1], [], []), (2, 1, 0, 4, 2, [1], [], [])])}, {"range_samples": (SAMPLE, [(1, 1, 0, 5, 1, [1], [], []), (2, 1, 0, 4, 1, [1], [], [])])}),
    "SHARD-06": ({"range_samples": (SAMPLE, [(1, 1, 0, 5, 1, [1, 2], [3], [3]), (2, 1, 0, 5, 2, [1, 2, 3], [], [])])}, {"range_samples": (SAMPLE, [(1, 1, 0, 5, 1, [1, 2], [3], []), (2, 1, 0, 5, 2, [1, 2, 3], [], [])])}),
    "SHARD-07": ({"ranges": (RANGE, [(1, None, 5), (2, 5, None)]), "meta": ("id long, bucket long", [(1, 1), (2, 1)])}, {"ranges": (RANGE, [(1, None, 5), (2, 5, None)]), "meta": ("id long, bucket long", [(1, 1)])}),
    "SHARD-08": (
        {"peers": ("range_id long, node long, role string, quiesced boolean, alive boolean, applied long", [(1, 1, "leader", True, True, 5), (1, 2, "follower", True, True, 5)])},
        {"peers": ("range_id long, node long, role string, quiesced boolean, alive boolean, applied long", [(1, 1, "leader", True, True, 5), (1, 2, "follower", True, True, 4)])},
    ),
    "SHARD-09": ({"digests": ("range_id long, applied long, digest string", [(1, 5, "x"), (1, 5, "x")])}, {"digests": ("range_id long, applied long, digest string", [(1, 5, "x"), (1, 5, "y")])}),
    "SHARD-CLIENT": (
        {"lease_reads": ("range_id long, op long, invoked long, idx long", [(1, 1, 10, 5)]), "done_reads": ("range_id long, acked long, idx long", [(1, 10, 7)])},
        {"lease_reads": ("range_id long, op long, invoked long, idx long", [(1, 1, 10, 5)]), "done_reads": ("range_id long, acked long, idx long", [(1, 9, 7)])},
    ),
    "TXN-01": ({"intents": ("key string, txn long", [("k", 1)]), "txn_records": ("txn long", [(1,)])}, {"intents": ("key string, txn long", [("k", 1)]), "txn_records": ("txn long", [(2,)])}),
    "TXN-02": (
        {"record_samples": ("tick long, txn long, range_id long, node long, applied long, status string", [(1, 1, 1, 1, 5, "committed"), (2, 1, 1, 1, 6, "committed")])},
        {"record_samples": ("tick long, txn long, range_id long, node long, applied long, status string", [(1, 1, 1, 1, 5, "committed"), (2, 1, 1, 1, 6, "aborted")])},
    ),
    "TXN-03": ({"txn_outcomes": ("txn long, status string, start_ts long, commit_ts long", [(1, "committed", 4, 5)])}, {"txn_outcomes": ("txn long, status string, start_ts long, commit_ts long", [(1, "committed", 5, 5)])}),
    "TXN-04": ({"chains": (CHAIN, [("k", 1, 9), ("k", 2, 4)])}, {"chains": (CHAIN, [("k", 1, 3), ("k", 2, 4)])}),
    "TXN-09": (
        {"txn_outcomes": ("txn long, status string, start_ts long, commit_ts long", [(1, "committed", 4, 5), (2, "committed", 4, 6)]), "oracle_samples": ("tick long, node long, high_water long", [(1, 1, 5), (2, 1, 5)])},
        {"txn_outcomes": ("txn long, status string, start_ts long, commit_ts long", [(1, "committed", 4, 5), (2, "committed", 4, 5)]), "oracle_samples": ("tick long, node long, high_water long", [(1, 1, 5), (2, 1, 5)])},
    ),
    "TXN-11": (
        {"staging": ("txn long, epoch long, keys array<string>", [(1, 1, ["k"])]), "intents": ("key string, txn long, epoch long", [("k", 1, 1), ("z", 1, 0)])},
        {"staging": ("txn long, epoch long, keys array<string>", [(1, 1, ["k"])]), "intents": ("key string, txn long, epoch long", [("z", 1, 1)])},
    ),
    "TXN-12": ({"remote_waits": (WAIT, [(1, 2), (2, 3)])}, {"remote_waits": (WAIT, [(1, 2), (2, 3), (3, 1)])}),
    "CTR-01": ({"promised": ("node long, id long", [(1, 1)]), "held": ("node long, id long", [(1, 1)])}, {"promised": ("node long, id long", [(1, 1), (1, 2)]), "held": ("node long, id long", [(1, 1)])}),
    "CTR-02": ({"promised": ("node long, id long", [(1, 1)]), "applied": ("node long, id long", [(1, 1)])}, {"promised": ("node long, id long", [(1, 1)]), "applied": ("node long, id long", [(2, 1)])}),
    "CTR-03": ({"acked": ("id long", [(1,)]), "applied": ("node long, id long", [(1, 1)])}, {"acked": ("id long", [(2,)]), "applied": ("node long, id long", [(1, 1)])}),
}


def test_every_invariant_has_a_case():
    assert set(CASES) == set(invariants.registry)


@pytest.mark.parametrize("name", CASES)
def test_invariant(spark, name):
    sound, broken = ({k: spark.createDataFrame(rows, schema) for k, (schema, rows) in side.items()} for side in CASES[name])
    assert invariants.violations(sound, [name]).collect() == []
    found = invariants.violations(broken, [name]).collect()
    assert found and all(r["id"] == name and r["detail"] for r in found)


def test_specification_properties(spark):
    r = spark.createDataFrame([(1, "committed", 9, ["a", "b"]), (2, "aborted", 0, ["a"]), (3, "staging", 0, ["a"])], "txn long, status string, commit_ts long, keys array<string>")
    w = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "z")], "txn long, key string")
    made = spark.createDataFrame([(1, "a", 9), (1, "c", 8), (2, "a", 5)], "txn long, key string, commit_ts long")
    assert [x["txn"] for x in invariants.key_lists_are_complete(r, w).collect()] == [3]
    assert [(x["txn"], x["key"]) for x in invariants.partial_commits(r, w, made).collect()] == [(1, "b")]
    assert [x["txn"] for x in invariants.aborted_traces(r, made).collect()] == [2]
    assert [x["key"] for x in invariants.misdated_versions(r, made).collect()] == ["c"]
    seen = spark.createDataFrame([(1, 5), (1, 7)], "txn long, version_ts long")
    assert invariants.snapshot_breaches(seen, spark.createDataFrame([(1, 6)], "txn long, start_ts long")).count() == 1
    schema, rows = state({"commit": 9}, {"learners": [1]})
    s = spark.createDataFrame(rows, schema)
    assert invariants.commits_are_grounded(s).count() == 1 and invariants.learners_are_not_voters(s).count() == 1
    ranges = spark.createDataFrame([(1, None, 5), (2, 5, None)], RANGE)
    assert [x["id"] for x in invariants.spans_hold(ranges, 6, 8).collect()] == [2]
