import datetime as dt
import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import varint


def one(spark, column):
    return spark.range(1).select(K.to_hex(column)).first()[0]


@pytest.mark.parametrize("column, want", [
    (lambda: K.string_key(F.lit("hello")), "68656c6c6f"),
    (lambda: K.i64_key(F.lit(123)), "800000000000007b"),
    (lambda: K.i64_key(F.lit(-123)), "7fffffffffffff85"),
    (lambda: K.u64_key(F.lit(123)), "000000000000007b"),
    (lambda: K.u8_key(F.lit(7)), "07"),
    (lambda: K.bool_key(F.lit(True)), "01"),
    (lambda: K.bool_key(F.lit(False)), "00"),
    (lambda: K.float_key(F.lit(float("nan"))), "7fc00001"),
    (lambda: K.double_key(F.lit(float("nan"))), "7ff8000000000001"),
    (lambda: K.double_key(F.lit(-0.0)), "8000000000000000"),
    (lambda: K.uuid_key(F.lit("550e8400-e29b-41d4-a716-446655440000")), "550e8400e29b41d4a716446655440000"),
    (lambda: K.tuple_key(K.string_key(F.lit("a")), F.lit(None).cast("binary"), K.i64_key(F.lit(1))), "610000008000000000000001"),
    (lambda: K.first_key(K.string_key(F.lit("p"))), "7000"),
    (lambda: K.last_key(K.string_key(F.lit("p"))), "70ff"),
])
def test_golden(spark, column, want):
    assert one(spark, column()) == want


def test_python_and_column_encodings_agree(spark):
    when = dt.datetime(2024, 2, 3, 4, 5, 6, 789, tzinfo=dt.timezone.utc)
    gone = dt.timedelta(days=-3, seconds=5, microseconds=7)
    pairs = [("x é", K.string_key(F.lit("x é"))), (-5, K.i64_key(F.lit(-5))), (2.5, K.double_key(F.lit(2.5))), (-1e300, K.double_key(F.lit(-1e300))), (True, K.bool_key(F.lit(True))), (b"\x00\xff", K.bytes_key(F.lit(b"\x00\xff"))), (when, K.timestamp_key(F.lit(when))), (gone, K.interval_key(F.lit(gone)))]
    for value, column in pairs:
        assert one(spark, column) == K.encode(value).hex(), value
    assert K.encode(uuid.UUID(int=5)) == uuid.UUID(int=5).bytes
    assert K.encode_float32(1.5) == struct.pack(">I", 0x3FC00000 | 1 << 31) and K.encode_unsigned(258, 2) == b"\x01\x02"


def test_order_follows_values(spark):
    rng = random.Random(0)
    ints = sorted({rng.choice([rng.randint(-(2**63), 2**63 - 1), rng.randint(-9, 9)]) for _ in range(300)})
    floats = sorted({x for x in (rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300))} | {float("inf"), float("-inf"), 0.0, 5e-324, -5e-324})
    for values, coder in ((ints, K.i64_key), (floats, K.double_key)):
        df = spark.createDataFrame([(v,) for v in values], "v long" if coder is K.i64_key else "v double")
        assert [r[0] for r in df.orderBy(coder("v")).collect()] == values
    singles = [struct.unpack("f", struct.pack("f", x))[0] for x in (-3e38, -1.5, -1e-40, 0.0, 1e-40, 2.25, 3e38)]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in reversed(singles)], "v float").orderBy(K.float_key("v")).collect()] == singles


def test_nulls_and_errors(spark):
    row = spark.range(1).select(K.i64_key(F.lit(None)), K.double_key(F.lit(None)), K.string_key(F.lit(None)), K.bool_key(F.lit(None)), K.from_hex(F.lit(None))).first()
    assert all(x is None for x in row)
    assert bytes(spark.range(1).select(K.from_hex(F.lit("0aFf"))).first()[0]) == b"\x0a\xff"
    for bad in ("abc", "zz"):
        with pytest.raises(Exception, match="not hex"):
            spark.range(1).select(K.from_hex(F.lit(bad))).collect()
    with pytest.raises(Exception, match="not a UUID"):
        spark.range(1).select(K.uuid_key(F.lit("x"))).collect()
    for call in (K.tuple_key, K.encode):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        K.encode(object())


def test_fnv_and_varints(spark):
    def fnv(raw):
        h = 2166136261
        for b in raw:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    for raw in (b"", b"a", b"hello\x00\xff"):
        assert spark.range(1).select(K.fnv1a(F.lit(raw))).first()[0] == fnv(raw)
    for x in (0, 1, 127, 128, 300, 2**32 - 1, 2**64 - 1):
        assert varint.get(b"zz" + varint.put(x), 2) == (x, 2 + len(varint.put(x)))
    with pytest.raises(ValueError):
        varint.get(b"\x80")
    with pytest.raises(ValueError):
        varint.get(varint.put(2**33), bits=32)
    with pytest.raises(ValueError):
        varint.put(-1)
