import json
import math
import random
import struct

from pyspark.sql import functions as F

from wardflow.functions.canonical_json import _plain, canonical_json, json_float, json_string


def test_float_text_is_the_shortest(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 1e-5, 123456789.125, 1e15, 1e16, 1e17, 123456789012345680.0, 2e23, 1e23, 8.41e21,
          2.0e-3, 9.5e-3, 5e-324, 4.35e-322, 2.2250738585072014e-308, 1.7976931348623157e308, 2.98e8, 9999999999999998.0,
          0.30000000000000004, 1 / 3, 2 / 3, 1e22, 4.4501477170144023e-308, 9.007199254740993e15, float("inf"), float("-inf")]
    xs += [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(3000)]
    xs += [round(r.uniform(-1e6, 1e6), r.randint(0, 6)) for _ in range(1500)] + [10.0 ** r.randint(-30, 30) * r.randint(1, 99) for _ in range(500)]
    xs = [x for x in xs if not math.isnan(x)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", json_float(F.col("x")).alias("t")).collect()}
    bad = [(x, got[i], json.dumps(x)) for i, x in enumerate(xs) if got[i] != json.dumps(x)]
    assert not bad, bad[:5]


def test_strings(spark):
    texts = ["", "plain", 'a"b\\c/', "\n\r\t\b\f\x00\x1f\x7f", "é ü ß ñ", "漢字", "😀 x 🏳️‍🌈", "퟿￿", "\U00010000\U0010ffff", " ", "{}[]:,"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", json_string(F.col("t")).alias("j")).collect()}
    assert [got[i] for i in range(len(texts))] == [json.dumps(t) for t in texts]


def test_rows_equal_json_dumps(spark):
    rows = [(1, "Zoë", 24.5, None, True, 7), (2, None, float("nan"), 3, False, -1), (-3, 'q"\\', 35000.0, -1, None, None),
            (2**62, "x", 1e-05, 0, True, 0)]
    names = ["visit_id", "department", "los", "n", "flag", "Ünit"]
    df = spark.createDataFrame(rows, "visit_id long, department string, los double, n int, flag boolean, `Ünit` int")
    got = [r.t for r in df.coalesce(1).select(canonical_json(df.schema, [*names, "n"]).alias("t")).collect()]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    want = [json.dumps({k: clean(v) for k, v in zip(names, r, strict=True)}, sort_keys=True, default=str) for r in rows]
    assert sorted(got) == sorted(want)


def test_no_python_worker(spark):
    from wardflow.operators.scoring import input_hash

    df = spark.createDataFrame([(1, "a", 0.5)], "a int, b string, c double")
    plan = df.select(input_hash(df, ["a", "b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_plain_decimals_take_the_engine_s_text(spark):
    """Every count of digits around the limit of 15, both signs, and the ends of the plain range."""
    rng = random.Random(8)
    values = [0.001, 0.002, 0.0020000000000000005, 0.0009999999999999999, 9999999.0, 9999999.999999998, 1e7, 2.0, 1.1, 120.0, 0.1 + 0.2, 173665.47 / 5000]
    for digits in range(1, 18):
        values += [float(f"{rng.randrange(10 ** (digits - 1), 10 ** digits)}e-{rng.randrange(max(0, digits - 7), digits + 3)}") for _ in range(60)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", json_float(F.col("x")).alias("text"), _plain(F.col("x")).alias("plain")).collect()
    assert [r["text"] for r in got] == [json.dumps(r["x"]) for r in got]
    told = {r["x"]: r["plain"] for r in got}
    assert told[173665.47 / 5000] and told[-120.0] and not told[1e7] and not told[0.1 + 0.2]
