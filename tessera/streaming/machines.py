"""Streaming forms: idempotent application, running totals and logs as state keyed by group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_attempts(ops: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """A stream of operations without retries: op_ids seen within the watermark's delay pass once."""
    return ops.withWatermark(at, delay).dropDuplicatesWithinWatermark(["op_id"])


def transfer_machine(transfers: DataFrame, opening: int) -> DataFrame:
    """(part, op_id, outcome) of a stream of transfers, each part's balances and decisions its state.

    The batch fold's rules: a retry returns the recorded outcome; a balance below the amount refuses. Accounts
    open with `opening`. Inside a micro-batch a part's transfers go in log order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accounts, amounts, ids, results = state.get if state.exists else ([], [], [], [])
        balance, decided = dict(zip(accounts, amounts, strict=True)), dict(zip(ids, results, strict=True))
        rows = pd.concat(list(batches)).sort_values("log_index")
        out = []
        for t in rows.itertuples():
            if t.op_id not in decided:
                have = balance.get(t.source, opening)
                if have < t.amount:
                    decided[t.op_id] = "insufficient_funds"
                else:
                    balance[t.source] = have - int(t.amount)
                    balance[t.target] = balance.get(t.target, opening) + int(t.amount)
                    decided[t.op_id] = "ok"
            out.append((int(key[0]), int(t.op_id), decided[t.op_id]))
        state.update((list(map(int, balance)), list(map(int, balance.values())), list(map(int, decided)), list(decided.values())))
        yield pd.DataFrame(out, columns=["part", "op_id", "outcome"])

    return transfers.groupBy("part").applyInPandasWithState(step, "part long, op_id long, outcome string", "accounts array<long>, amounts array<long>, ids array<long>, results array<string>", "append", GroupStateTimeout.NoTimeout)


def closed_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window, event_type, n) of a stream, final once the watermark has closed the window."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))
