"""Column expressions for keys, timestamps, sets and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the logical part of a packed hybrid timestamp and of a packed commit timestamp.
HLC_LOGICAL_BITS = 16
COMMIT_LOGICAL_BITS = 20


def contains(start: Column, end: Column, key: Column) -> Column:
    """Whether the half-open span holds the key; a null bound is open."""
    return (start.isNull() | (key >= start)) & (end.isNull() | (key < end))


def covers(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return contains(start, end, lo) & contains(start, end, hi)


def overlaps_closed(smallest: Column, largest: Column, lo: Column, hi: Column) -> Column:
    """Closed-bound overlap of a file's keys with [lo, hi]; a null bound is open."""
    return (hi.isNull() | (smallest <= hi)) & (lo.isNull() | (largest >= lo))


def pack_hlc(nanos: Column, logical: Column) -> Column:
    return F.shiftleft(nanos, HLC_LOGICAL_BITS).bitwiseOR(logical)


def hlc_nanos(ts: Column) -> Column:
    return F.shiftrightunsigned(ts, HLC_LOGICAL_BITS)


def hlc_logical(ts: Column) -> Column:
    return ts.bitwiseAND(F.lit((1 << HLC_LOGICAL_BITS) - 1))


def to_commit_ts(physical: Column, logical: Column) -> Column:
    return F.shiftleft(physical, COMMIT_LOGICAL_BITS).bitwiseOR(logical.bitwiseAND(F.lit((1 << COMMIT_LOGICAL_BITS) - 1)))


def from_commit_ts(ts: Column) -> Column:
    """The (physical, logical) struct of a packed commit timestamp; structs compare field by field."""
    return F.struct(F.shiftrightunsigned(ts, COMMIT_LOGICAL_BITS).alias("physical"), ts.bitwiseAND(F.lit((1 << COMMIT_LOGICAL_BITS) - 1)).cast("int").alias("logical"))


def uncertainty_interval(ts: Column, bound: Column) -> Column:
    """[ts - bound, ts + bound], never below 1 nor beyond the largest long."""
    top = F.lit(2**63 - 1)
    return F.struct(F.greatest(F.lit(1).cast("long"), ts - bound).alias("earliest"), F.when(ts > top - bound, top).otherwise(ts + bound).alias("latest"))


def expired(ttl: Column, heartbeat: Column, now: Column) -> Column:
    """A record's heartbeat ran out; zero ttl or heartbeat never does."""
    return (ttl != 0) & (heartbeat != 0) & (now > heartbeat + ttl)


def terminal(status: Column) -> Column:
    return status.isin("committed", "aborted")


def lease_valid(holder: Column, start: Column, expiry: Column, now: Column) -> Column:
    return (holder > 0) & (start <= now) & (now < expiry)


def lease_is_sound(lease: Column, uncertainty: Column, tick: Column, election_ticks: Column) -> Column:
    return (lease > uncertainty) & (lease + uncertainty < tick * election_ticks)


def is_older(start_ts: Column, txn: Column, other_ts: Column, other_txn: Column) -> Column:
    """Wound-wait order: the earlier start, then the smaller id."""
    return (start_ts < other_ts) | ((start_ts == other_ts) & (txn < other_txn))


def up_to_date(idx: Column, term: Column, last_idx: Column, last_term: Column) -> Column:
    return (term > last_term) | ((term == last_term) & (idx >= last_idx))


def has_quorum(acked: Column, voters: Column) -> Column:
    """A strict majority of the voters acked; an empty half of a joint configuration passes."""
    return (F.size(voters) == 0) | (2 * F.size(F.array_intersect(acked, voters)) > F.size(voters))


def joint_quorum(acked: Column, incoming: Column, outgoing: Column) -> Column:
    return has_quorum(acked, incoming) & has_quorum(acked, outgoing)


def level_target_bytes(level: Column, base: int = 128 << 10) -> Column:
    """The size that a level may reach: ten times the one above."""
    return (F.lit(base) * F.pow(F.lit(10), level - 1)).cast("long")


def key_name(i: Column, width: int = 0) -> Column:
    """k and the number, left-padded with zeros to a width."""
    digits = i.cast("string")
    return F.concat(F.lit("k"), F.lpad(digits, width, "0") if width else digits)


def rolling_digest(ordered: Column) -> Column:
    """A digest of an ordered array that changes with any element or their order: chained SHA-256."""
    return F.aggregate(ordered, F.lit(""), lambda acc, x: F.sha2(F.concat(acc, F.lit("|"), x.cast("string")), 256))
