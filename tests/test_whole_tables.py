"""Queries over all rows of a table larger than the one that the SQL is compared on."""

import pyarrow.parquet as pq
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.01"
catalog.load()


@pytest.fixture(scope="module")
def events():
    t = pq.read_table(f"{SF}/events.parquet", columns=["event_id", "user_id"])
    return sorted(zip(*(t[c].to_pylist() for c in ("event_id", "user_id")), strict=True))


def test_minimal_fault_sets_of_all_failing_events(spark, events):
    sets = {}
    for e, u in events:
        if e % 3 == 0:
            sets.setdefault(u, set()).add(e % 11)
    want = {u: ",".join(map(str, sorted(s))) for u, s in sets.items() if not any(t < s for t in sets.values())}
    got = {r["set_id"]: r["features"] for r in catalog.QUERIES["minimal_fault_sets"](spark, SF).collect()}
    assert got == want


def test_put_intents_answers_all_requests(spark, events):
    holder = {u: u + 1000000 for _, u in events if u % 5 == 0}
    want = {e: holder.setdefault(u, 2000000 + e % 9) == 2000000 + e % 9 for e, u in events}
    got = {r["log_index"]: r["ok"] for r in catalog.QUERIES["put_intents"](spark, SF).collect()}
    assert got == want


def test_wait_cycles_of_any_length(spark):
    from tessera.operators import versions

    waits = [(i, (i + 1) % 1000) for i in range(1000)] + [(2000 + i, 2001 + i) for i in range(50)] + [(5000, 0), (6000, 6001), (6001, 6000), (7000, 7000)]
    got = {r["waiter"]: r["cycle_length"] for r in versions.wait_cycles(spark.createDataFrame(waits, "waiter long, blocker long")).collect()}
    assert got == {**{i: 1000 for i in range(1000)}, 6000: 2, 6001: 2, 7000: 1}


def test_every_planted_breach_is_found():
    """The invariants that have a query of their own, and those of which another query has the check."""
    from tessera.operators import invariants
    from tessera.plans import states

    others = {"RAFT-15", "RAFT-16", "MVCC-03", "MVCC-05", "SHARD-01", "SHARD-06", "TXN-01", "TXN-04", "TXN-11"}
    assert set(states.CHECKS) | others == set(invariants.registry) and not set(states.CHECKS) & others
