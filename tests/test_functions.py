import hashlib
import math
import random
import struct
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import encoding, values
from tidemark.functions.expressions import Arith, Case, Coalesce, Concat, Const, Ref, assigned, compile_expression
from tidemark.functions.predicates import And, Col, In, Not, Or, after_key, to_case, to_filter

GOLDEN = [(None, "00"), (False, "0100"), (True, "0101"), (0, "020000000000000000"), (1, "020000000000000001"), (-1, "02ffffffffffffffff"), (1.5, "033ff8000000000000"), (-0.0, "030000000000000000"), (Decimal("268.92"), "04000000063236382e3932"), ("abc", "0500000003616263"), ("", "0500000000"), (b"\xde\xad", "0600000002dead"), (datetime(1970, 1, 1, tzinfo=timezone.utc), "070000000000000000")]


def test_golden_values():
    for value, want in GOLDEN:
        assert encoding.encode_value(value).hex() == want
    with pytest.raises(ValueError):
        encoding.encode_value(float("nan"))


def test_columns_encode_as_python(spark):
    floats = [0.0, -0.0, 1.5, -1.5, 1e300, 1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.pi, 0.1, 1 / 3, float("inf"), float("-inf"), 4.0, 0.9999999999999999, 1e22, None]
    got = spark.createDataFrame([(x,) for x in floats], "x double").select("x", encoding.encode_column(F.col("x"), T.DoubleType()).alias("b")).collect()
    for r in got:
        assert bytes(r.b) == encoding.encode_value(r.x), r.x
    rows = [(True, 7, Decimal("100.00"), "é", b"\x01", datetime(2026, 3, 2, 1, 2, 3, 45)), (False, -(2**63), Decimal("-0.50"), "", b"", datetime(1969, 12, 31)), (None,) * 6]
    schema = T.StructType([T.StructField(n, t) for n, t in (("b", T.BooleanType()), ("i", T.LongType()), ("d", T.DecimalType(12, 2)), ("s", T.StringType()), ("x", T.BinaryType()), ("t", T.TimestampType()))])
    df = spark.createDataFrame(rows, schema)
    for r in df.select(*df.columns, *[encoding.encode_column(F.col(f.name), f.dataType).alias("_" + f.name) for f in schema]).collect():
        for f in schema:
            assert bytes(r["_" + f.name]) == encoding.encode_value(r[f.name] if r[f.name] is None or f.name != "x" else bytes(r[f.name])), (f.name, r)


def test_equal_decimals_encode_equally():
    rng = random.Random(2)
    for _ in range(200):
        whole, rest = rng.randrange(1000), "".join(rng.choice("0123456789") for _ in range(rng.randrange(5)))
        sign = rng.choice(["", "-"])
        spelled = lambda: sign + "0" * rng.randrange(3) + str(whole) + (f".{rest}" if rest else rng.choice(["", "."])) + ("0" * rng.randrange(3) if rest else "")
        texts = {values.normalize_decimal(spelled()) for _ in range(6)}
        assert len(texts) == 1 and Decimal(texts.pop()) == Decimal(f"{sign}{whole}.{rest or 0}")
    assert values.normalize_decimal("-0.0") == "0"
    with pytest.raises(ValueError):
        values.normalize_decimal("1e5")


def brute_root(leaves):
    level = sorted(leaves)
    if not level:
        return hashlib.sha256(b"\x02").digest()
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if len(level[i : i + 2]) == 2 else level[i] for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65])
def test_merkle_root_in_blocks(spark, monkeypatch, n):
    monkeypatch.setattr(encoding, "BLOCK", 8)
    leaves = [hashlib.sha256(struct.pack(">I", i)).digest() for i in range(n)]
    df = spark.createDataFrame([(bytearray(x),) for x in leaves], "leaf binary")
    assert encoding.merkle_root(df) == brute_root(leaves)


def test_commit_ids_bind_everything():
    args = dict(repo=b"\1" * 16, parents=[b"a" * 32, b"b" * 32], change=b"c" * 32, schema=b"d" * 32, author="x", micros=5, message="m", external="r")
    base = encoding.commit_id(**args)
    assert encoding.commit_id(**{**args, "parents": args["parents"][::-1]}) == base
    for k, v in {"parents": [b"a" * 32], "author": "y", "micros": 6, "message": "n", "external": "", "change": b"e" * 32, "domain": b"other"}.items():
        assert encoding.commit_id(**{**args, k: v}) != base
    # Length prefixes keep neighbouring texts apart.
    assert encoding.commit_id(**{**args, "author": "xm", "message": ""}) != encoding.commit_id(**{**args, "author": "x", "message": "m"})


def test_wide_masks(spark):
    df = spark.createDataFrame([([],), ([3],), ([64],), ([1, 130],)], "c array<int>").select(encoding.mask_words(F.col("c"), 130).alias("m"))
    assert [bytes(r.m).hex() for r in df.collect()] == ["", f"{8:016x}", f"{0:016x}{1:016x}", f"{2:016x}{0:016x}{4:016x}"]


def test_filters_are_three_valued_and_case_two_valued(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int")
    keep = lambda p: sorted(r.k for r in df.where(to_filter(p)).collect())
    assert keep(Col("v") == 5) == [1] and keep(Col("v") != 5) == [3] and keep(Not(Col("v") == 5)) == [3]
    assert keep(Col("v").is_null()) == [2] and keep(In("v", ())) == [] and keep(And([])) == [1, 2, 3] and keep(Or([])) == []
    case = lambda p: [r.x for r in df.orderBy("k").select(to_case(p).alias("x")).collect()]
    assert case(Col("v") != 5) == [False, True, True] and case(Col("v") <= 4) == [False, True, False] and case(Col("v") < 4) == [False, False, False]
    assert case(In("v", (5, None))) == [True, True, False]
    with pytest.raises(TypeError):
        to_case(Col("v").like("x"))


def test_keyset_over_two_columns(spark):
    df = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert sorted(map(tuple, df.where(after_key(["a", "b"], {"a": 1, "b": 1})).collect())) == [(1, 2), (2, 0), (2, 1), (2, 2)]


def test_expressions(spark):
    df = spark.createDataFrame([(Decimal("89.50"), 7, -7, 1.1, "x", None), (Decimal("249.00"), 0, 5, 0.1, None, None)], "price decimal(12,2), i int, j int, f double, s string, n int")
    one = lambda e, t=None: [r.x for r in df.select((compile_expression(e, df.schema).column if t is None else assigned(e, df.schema, t)).alias("x")).collect()]
    assert one(Arith("*", Ref("price"), Const(Decimal("1.08"))), "price") == [Decimal("96.66"), Decimal("268.92")]
    assert one(Arith("/", Ref("j"), Const(2))) == [-3, 2] and one(Arith("/", Const(1), Ref("i"))) == [0, None]
    assert [float(x) for x in one(Arith("+", Ref("f"), Const(Decimal("0.2"))))] == [1.3, 0.3]
    assert [float(x) for x in one(Arith("/", Const(Decimal("1")), Const(3)))] == [0.333333333333] * 2
    assert one(Concat((Ref("s"), Const("-"), Ref("price")))) == ["x-89.5", None]
    assert one(Coalesce((Ref("s"), Const("y")))) == ["x", "y"] and one(Arith("+", Ref("n"), Const(1))) == [None, None]
    assert one(Case(((Col("i") > 3, Const("big")),))) == ["big", None]


def test_decimal_text(spark):
    got = spark.createDataFrame([(Decimal(x),) for x in ("100.00", "0.00", "-0.50", "1.10", "0.00000001")], "d decimal(20,8)").select(values.decimal_text(F.col("d")).alias("t")).collect()
    assert [r.t for r in got] == ["100", "0", "-0.5", "1.1", "0.00000001"]
