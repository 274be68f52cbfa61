"""Known-bad histories are detected, named and rejected from the right level on; serial ones never are."""

import random

import pytest

from tessera.operators import isolation

MOPS = "history_id long, txn_id long, pos long, type string, key long, element long, observed array<bigint>"
TXNS = "history_id long, txn_id long, process long, invoked long, completed long, outcome string"


def build(spark, txns, times=None, outcomes=None):
    """txns: {id: [("a", key, element) | ("r", key, [seen])]}; all overlap unless times say otherwise."""
    mops, pos = [], 0
    for t, ops in txns.items():
        for kind, key, x in ops:
            mops.append((1, t, pos, "append" if kind == "a" else "read", key, x if kind == "a" else None, None if kind == "a" else x))
            pos += 1
    rows = [(1, t, t, *((times or {}).get(t, (0, 100))), (outcomes or {}).get(t, "committed")) for t in txns]
    return spark.createDataFrame(mops, MOPS), spark.createDataFrame(rows, TXNS)


CORPUS = {
    # name: (transactions, times, outcomes, anomaly, first level that rejects it)
    "dirty write": ({1: [("a", 1, 1), ("a", 2, 1)], 2: [("a", 1, 2), ("a", 2, 2)], 3: [("r", 1, [1, 2]), ("r", 2, [2, 1])]}, None, None, "G0", "read-uncommitted"),
    "aborted read": ({1: [("a", 1, 1)], 2: [("r", 1, [1])]}, None, {1: "aborted"}, "G1a", "read-committed"),
    "intermediate read": ({1: [("a", 1, 1), ("a", 1, 2)], 2: [("r", 1, [1])], 3: [("r", 1, [1, 2])]}, None, None, "G1b", "read-committed"),
    "circular flow": ({1: [("a", 1, 1), ("r", 2, [2])], 2: [("a", 2, 2), ("r", 1, [1])]}, None, None, "G1c", "read-committed"),
    "read skew": ({1: [("r", 1, []), ("r", 2, [2])], 2: [("a", 1, 1), ("a", 2, 2)], 3: [("r", 1, [1]), ("r", 2, [2])]}, None, None, "G-single", "snapshot-isolation"),
    "write skew": ({1: [("r", 2, []), ("a", 1, 1)], 2: [("r", 1, []), ("a", 2, 2)], 3: [("r", 1, [1]), ("r", 2, [2])]}, None, None, "G2-item", "serializable"),
    "no prefix": ({1: [("a", 1, 1)], 2: [("a", 1, 2)], 3: [("r", 1, [1, 2])], 4: [("r", 1, [2])]}, None, None, "version-order-conflict", "read-uncommitted"),
    "written twice": ({1: [("a", 1, 1)], 2: [("a", 1, 1)], 3: [("r", 1, [1])]}, None, None, "duplicate-element", "read-uncommitted"),
    "stale read": ({1: [("a", 1, 1)], 2: [("r", 1, [])], 3: [("r", 1, [1])]}, {1: (0, 10), 2: (20, 30), 3: (15, 60)}, None, "real-time-violation", "strict-serializable"),
    "nested": ({1: [("a", 1, 1), ("r", 2, [2])], 2: [("a", 2, 2), ("r", 1, [1]), ("r", 3, [])], 3: [("a", 3, 3), ("r", 1, [1])], 4: [("r", 3, [3])]}, None, None, "G1c", "read-committed"),
}


@pytest.mark.parametrize("name", CORPUS)
def test_corpus(spark, name):
    txns, times, outcomes, anomaly, level = CORPUS[name]
    mops, history = build(spark, txns, times, outcomes)
    assert anomaly in {r["anomaly"] for r in isolation.anomalies(mops, history, strict=True).collect()}
    rejects = [lv for lv in isolation.LEVELS if not isolation.verdicts(mops, history, lv).first()["valid"]]
    assert rejects == list(isolation.LEVELS[isolation.LEVELS.index(level) :])


def test_serial_histories_are_valid_at_every_level(spark):
    rng = random.Random(5)
    mops, history, pos = [], [], 0
    for h in range(20):
        lists, nxt = {}, 1
        for t in range(15):
            start = pos
            for _ in range(rng.randint(1, 4)):
                k = rng.randint(0, 3)
                if rng.random() < 0.5:
                    lists.setdefault(k, []).append(nxt)
                    mops.append((h, t, pos, "append", k, nxt, None))
                    nxt += 1
                else:
                    mops.append((h, t, pos, "read", k, None, list(lists.get(k, []))))
                pos += 1
            history.append((h, t, t % 3, start, pos, "committed"))
            pos += 1
    m, t = spark.createDataFrame(mops, MOPS), spark.createDataFrame(history, TXNS)
    for level in ("read-uncommitted", "serializable", "strict-serializable"):
        assert isolation.verdicts(m, t, level).where("not valid").count() == 0


def test_shortest_cycle_prefers_small_starts_and_labels_edges():
    adjacent = {1: [(2, 0, 0, "ww")], 2: [(3, 1, 0, "wr")], 3: [(1, 2, 0, "rw")]}
    assert isolation.strong_components(adjacent) == [[1, 2, 3]]
    txns, kinds = isolation.shortest_cycle([1, 2, 3], adjacent)
    assert (txns, kinds) == ([1, 2, 3], ["ww", "wr", "rw"])
    assert isolation.classify(kinds) == "G-single"


def test_reduced_real_time_edges_reach_the_same(spark):
    rng = random.Random(9)
    rows = []
    for t in range(40):
        a = rng.randint(0, 200)
        rows.append((1, t, 0, a, a + rng.randint(0, 30), "committed"))
    h = spark.createDataFrame(rows, TXNS)

    def closure(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["src"], set()).add(r["dst"])
        done = {}
        for s in out:
            seen, todo = set(), list(out[s])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += out.get(x, ())
            done[s] = seen
        return done

    full, few = isolation.edges_rt(h), isolation.edges_rt(h, reduced=True)
    assert few.count() < full.count()
    assert closure(full) == closure(few)


@pytest.mark.parametrize("seed", range(3))
def test_times_stand_for_all_real_time_edges(spark, seed):
    """Components and shortest cycles are those of the graph in which every real-time edge is listed."""
    rng = random.Random(seed)
    rows, edges = [], []
    for h in range(25):
        n = rng.randint(3, 25)
        for t in range(n):
            a = rng.randint(0, 60)
            rows.append((h, t, 0, a, a + rng.randint(0, 25), "committed" if rng.random() < 0.9 else "aborted"))
        for _ in range(rng.randint(1, n)):
            a, b = rng.sample(range(n), 2)
            edges.append((h, a, b, rng.choice(["ww", "wr", "rw"]), rng.randint(0, 3)))
    history = spark.createDataFrame(rows, TXNS)
    known = spark.createDataFrame(edges, "history_id long, src long, dst long, type string, key long").distinct()
    listed = isolation.cycle_witnesses(known.unionByName(isolation.edges_rt(history)))
    implied = isolation.cycle_witnesses(known.unionByName(isolation.spans(history)))
    want = sorted(map(repr, listed.collect()))
    assert want and sorted(map(repr, implied.collect())) == want
