"""Vector functions against numpy."""

import numpy as np
import pytest

from vecloom.functions import vectors as V

DIMS = [1, 2, 3, 7, 8, 15, 16, 31, 32, 63, 64, 127, 128, 255]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(123)
    rows = [(n, rng.uniform(-1, 1, d).astype(np.float32).tolist(), rng.uniform(-1, 1, d).astype(np.float32).tolist()) for n, d in enumerate(DIMS * 10)]
    return spark.createDataFrame(rows, "n int, a array<float>, b array<float>").cache()


def test_metrics(pairs):
    got = pairs.select("a", "b", V.l2_sq("a", "b").alias("l2"), V.dot("a", "b").alias("dot"), V.cosine_distance("a", "b").alias("cos"), V.inner_product_distance("a", "b").alias("ip"), V.euclidean("a", "b").alias("e"), V.dim("a").alias("d")).collect()
    for r in got:
        a, b = np.array(r.a, np.float64), np.array(r.b, np.float64)
        assert r.d == len(a)
        assert r.l2 == pytest.approx(((a - b) ** 2).sum(), rel=1e-9) and r.e == pytest.approx(np.linalg.norm(a - b))
        assert r.dot == pytest.approx(a @ b, abs=1e-9) and r.ip == pytest.approx(1 - a @ b, abs=1e-9)
        assert r.cos == pytest.approx(1 - a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-9)


def test_zero_vectors_and_unequal_lengths(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine_distance("a", "b").alias("x"), V.cosine_distance("a", "a").alias("y"), V.normalize("a").alias("z")).first()
    assert (r.x, r.y, r.z) == (1.0, 1.0, [0.0, 0.0])
    bad = spark.createDataFrame([([0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="length"):
        bad.select(V.l2_sq(V.check_dims("a", "b"), "b")).collect()


def test_nan_to_num(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 1.5],)], "v array<double>")
    assert df.select(V.nan_to_num("v").alias("v")).first().v == [0.0, V.MAX_FINITE["f32"], -V.MAX_FINITE["f32"], 1.5]
    assert df.select(V.nan_to_num("v", "f16").alias("v")).first().v == [0.0, 65504.0, -65504.0, 1.5]


def test_normalize_and_truncate(pairs):
    for r in pairs.select("a", V.normalize("a").alias("n"), V.truncate("a", 5).alias("t")).collect():
        a = np.array(r.a, np.float64)
        assert np.allclose(r.n, a / np.linalg.norm(a)) and r.t == r.a[:5]


def test_qi8_matches_dequantised(spark):
    rng = np.random.default_rng(123)

    def one(d):
        return (rng.integers(-128, 128, d).tolist(), float(rng.uniform(1e-4, 10)), int(rng.choice([-128, 127, rng.integers(-128, 128)])))

    rows = [(one(d), one(d)) for d in DIMS * 8] + [(([3, 3], 1.0, 3), ([1, 2], 0.5, 0))]
    df = spark.createDataFrame(rows, f"a {V.QI8}, b {V.QI8}")
    got = df.select(V.qi8_dequantize("a").alias("x"), V.qi8_dequantize("b").alias("y"), V.qi8_l2_sq("a", "b").alias("l2"), V.qi8_inner_product_distance("a", "b").alias("ip"), V.qi8_cosine_distance("a", "b").alias("c")).collect()
    for r in got:
        x, y = np.array(r.x), np.array(r.y)
        assert r.l2 == pytest.approx(((x - y) ** 2).sum(), rel=1e-6, abs=1e-6) and r.ip == pytest.approx(1 - x @ y, rel=1e-6, abs=1e-6)
        n = (x @ x) * (y @ y)
        assert r.c == pytest.approx(1.0 if n == 0 else 1 - x @ y / np.sqrt(n), abs=1e-6)


def test_quantise(pairs):
    for r in pairs.select("a", V.qi8_quantize("a").alias("q")).withColumn("back", V.qi8_dequantize("q")).collect():
        assert np.abs(np.array(r.back) - np.array(r.a)).max() <= r.q.scale * 0.51


def test_half_types(spark):
    values = [1.0, 1.0009765625, 65519.0, 70000.0, -3.14159, 1e-8, 0.0, float("inf")]
    df = spark.createDataFrame([(values,)], "v array<float>")
    r = df.select(V.to_f16("v").alias("h"), V.to_bf16("v").alias("b"), V.raw_bytes("v", "f16").alias("r")).first()
    with np.errstate(over="ignore"):
        half = np.array(values, np.float32).astype(np.float16)
    assert np.array_equal(np.array(r.h, np.float16), half) and bytes(r.r) == half.tobytes()
    got = np.array(r.b, np.float32)
    assert (got.view(np.uint32) & 0xFFFF == 0).all() and np.allclose(got[:-1], np.array(values[:-1], np.float32), rtol=2**-8)


def test_metric_names():
    assert V.metric_name("L2") == "l2_sq" and V.metric_name("ip") == "inner_product"
    with pytest.raises(ValueError):
        V.metric_name("nothing")
