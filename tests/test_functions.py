"""Codecs and column functions."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codecs, columns


def test_check_values():
    assert codecs.crc32c(b"123456789") == 0xE3069283
    assert codecs.fnv1a(b"a") == 0xAF63DC4C8601EC8C


@given(st.integers(0, 2**64 - 1), st.binary(max_size=5))
def test_varints_come_back(n, rest):
    assert codecs.read_varint(codecs.varint(n) + rest) == (n, len(codecs.varint(n)))


@given(st.tuples(st.binary(max_size=6), st.integers(0, 2**40)), st.tuples(st.binary(max_size=6), st.integers(0, 2**40)))
def test_data_keys_sort_by_key_then_newest(a, b):
    assert codecs.read_data_key(codecs.data_key(*a)) == a
    want = (a[0], -a[1]) < (b[0], -b[1])
    assert (codecs.data_key(*a) < codecs.data_key(*b)) == want


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame([(b"123456789", 5), (None, 5), (b"k", None)], "k binary, ts long")
    got = df.select(codecs.crc32c_udf("k").alias("c"), codecs.fnv1a_udf("k").alias("f"), codecs.data_key_udf("k", "ts").alias("d")).collect()
    assert got[0]["c"] == 0xE3069283 and got[1]["c"] is None and got[1]["f"] is None and got[2]["d"] is None
    assert bytes(got[0]["d"]) == codecs.data_key(b"123456789", 5)


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert value(columns.contains(lit(None).cast("int"), lit(5), lit(4))) is True
    assert value(columns.contains(lit(1), lit(5), lit(5))) is False
    packed = columns.pack_hlc(lit(77).cast("long"), lit(3).cast("long"))
    assert value(columns.hlc_nanos(packed)) == 77 and value(columns.hlc_logical(packed)) == 3
    assert value(columns.from_commit_ts(columns.to_commit_ts(lit(9).cast("long"), lit(4).cast("long")))).asDict() == {"physical": 9, "logical": 4}
    assert value(columns.uncertainty_interval(lit(5).cast("long"), lit(9).cast("long"))).asDict() == {"earliest": 1, "latest": 14}
    assert value(columns.level_target_bytes(lit(3))) == 131072 * 100
    assert value(columns.expired(lit(10), lit(100), lit(111))) is True and value(columns.expired(lit(0), lit(100), lit(111))) is False
    ints = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    assert value(columns.joint_quorum(ints(1, 2), ints(1, 2, 3), ints())) is True
    assert value(columns.joint_quorum(ints(1, 2), ints(1, 2, 3), ints(4, 5))) is False
    assert value(columns.is_older(lit(1), lit(9), lit(1), lit(8))) is False
    assert value(columns.up_to_date(lit(3), lit(2), lit(9), lit(1))) is True
    assert value(columns.lease_is_sound(lit(50), lit(5), lit(10), lit(10))) is True
    assert value(columns.key_name(lit(7), 4)) == "k0007"
    assert value(columns.rolling_digest(F.array(lit("a"), lit("b")))) != value(columns.rolling_digest(F.array(lit("b"), lit("a"))))
