"""Vector functions as column expressions over array columns; they define what the faster operators compute.

Sums are in double precision, element by element in order. `check_dims` fails a query whose vectors differ in length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest finite values of the element types.
MAX_FINITE = {"f32": 3.4028234663852886e38, "f16": 65504.0, "bf16": 3.3895313892515355e38}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def check_dims(a, b) -> Column:
    """a, or an error if the lengths of a and b differ; zip_with would pad the shorter with nulls."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))


def dim(v) -> Column:
    return F.size(_c(v))


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def euclidean(a, b) -> Column:
    return F.sqrt(l2_sq(a, b))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: _d(x) * _d(y)))


def norm_sq(a) -> Column:
    return _sum(F.transform(_c(a), lambda x: _d(x) * _d(x)))


def dot_and_norms(a, b) -> Column:
    """Struct of dot(a, b) and both squared norms."""
    return F.struct(dot(a, b).alias("dot"), norm_sq(a).alias("norm_a"), norm_sq(b).alias("norm_b"))


def inner_product_distance(a, b) -> Column:
    """1 - dot; negative for long vectors that agree."""
    return F.lit(1.0) - dot(a, b)


def _cosine(d: Column, na: Column, nb: Column) -> Column:
    zero = (na == 0) | (nb == 0)
    return F.when(zero, F.lit(1.0)).otherwise(F.lit(1.0) - d / F.sqrt(F.when(zero, F.lit(1.0)).otherwise(na * nb)))


def cosine_distance(a, b) -> Column:
    """1 - cosine, not clamped; 1 if either vector is zero."""
    return _cosine(dot(a, b), norm_sq(a), norm_sq(b))


def nan_to_num(v, dtype: str = "f32") -> Column:
    """NaN becomes 0, infinities the largest finite values of the element type."""
    most = MAX_FINITE[dtype]

    def fix(x: Column) -> Column:
        y = _d(x)
        return F.when(F.isnan(y), F.lit(0.0)).when(y > most, F.lit(most)).when(y < -most, F.lit(-most)).otherwise(y)

    return F.transform(_c(v), fix)


def normalize(v) -> Column:
    """The vector divided by its length; a zero vector stays."""
    n = F.sqrt(norm_sq(v))
    return F.when(n == 0, _c(v).cast("array<double>")).otherwise(F.transform(_c(v), lambda x: _d(x) / n))


def truncate(v, n: int) -> Column:
    """The first n elements."""
    return F.slice(_c(v), 1, n)


# --- 8-bit vectors with one scale and zero point each: element = (q - zero_point) * scale


QI8 = "struct<data:array<tinyint>,scale:float,zero_point:tinyint>"


def qi8_quantize(v) -> Column:
    """Affine 8-bit form of a vector: its range, widened to hold 0, is mapped onto -128 to 127."""
    v = _c(v)
    low = F.least(F.lit(0.0), _d(F.array_min(v)))
    high = F.greatest(F.lit(0.0), _d(F.array_max(v)))
    scale = F.when(high > low, (high - low) / 255.0).otherwise(F.lit(1.0))
    zero = F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.floor(F.lit(-128.0) - low / scale + 0.5)))
    data = F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.floor(_d(x) / scale + zero + 0.5))).cast("tinyint"))
    return F.struct(data.alias("data"), scale.cast("float").alias("scale"), zero.cast("tinyint").alias("zero_point"))


def qi8_dequantize(q) -> Column:
    q = _c(q)
    return F.transform(q["data"], lambda x: (_d(x) - _d(q["zero_point"])) * _d(q["scale"]))


def i8_sums(a, b) -> Column:
    """Struct of the integer sums of a*b, a, b, a*a, b*b."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)

    def long(x: Column) -> Column:
        return x.cast("long")

    a, b = _c(a), _c(b)
    return F.struct(
        total(F.zip_with(a, b, lambda x, y: long(x) * long(y))).alias("ab"),
        total(F.transform(a, long)).alias("a"),
        total(F.transform(b, long)).alias("b"),
        total(F.transform(a, lambda x: long(x) * long(x))).alias("aa"),
        total(F.transform(b, lambda x: long(x) * long(x))).alias("bb"),
    )


def qi8_dot_and_norms(a, b) -> Column:
    """dot and squared norms of two 8-bit vectors from integer sums, the zero points taken out algebraically."""
    a, b = _c(a), _c(b)
    s, n = i8_sums(a["data"], b["data"]), F.size(a["data"]).cast("long")
    za, zb = a["zero_point"].cast("long"), b["zero_point"].cast("long")
    sa, sb = _d(a["scale"]), _d(b["scale"])
    return F.struct(
        (_d(s["ab"] - za * s["b"] - zb * s["a"] + n * za * zb) * sa * sb).alias("dot"),
        (_d(s["aa"] - 2 * za * s["a"] + n * za * za) * sa * sa).alias("norm_a"),
        (_d(s["bb"] - 2 * zb * s["b"] + n * zb * zb) * sb * sb).alias("norm_b"),
    )


def qi8_l2_sq(a, b) -> Column:
    d = qi8_dot_and_norms(a, b)
    return d["norm_a"] + d["norm_b"] - 2 * d["dot"]


def qi8_inner_product_distance(a, b) -> Column:
    return F.lit(1.0) - qi8_dot_and_norms(a, b)["dot"]


def qi8_cosine_distance(a, b) -> Column:
    d = qi8_dot_and_norms(a, b)
    return _cosine(d["dot"], d["norm_a"], d["norm_b"])


# --- half types, kept as arrays of floats that hold rounded values


def round_f16(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return values.astype(np.float16).astype(np.float32)


def round_bf16(values: np.ndarray) -> np.ndarray:
    """Rounded half to even to the upper 16 bits of a float; NaN stays NaN."""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32)
    up = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(values), np.float32(np.nan), up.view(np.float32))


def _flat(v: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All elements of a column of arrays in a row, where each array ends, and which rows are null."""
    none = v.isna().to_numpy()
    full = [x for x, gone in zip(v, none) if not gone]
    sizes = np.zeros(len(v), np.int64)
    sizes[~none] = list(map(len, full))
    return np.concatenate(full) if full else np.zeros(0), np.cumsum(sizes), none


def _rounder(fn: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        values, ends, none = _flat(v)
        out = np.split(fn(values.astype(np.float32)), ends[:-1]) if len(v) else []
        return pd.Series([None if gone else x for x, gone in zip(out, none)], dtype=object)

    return run


def to_f16(v) -> Column:
    return _rounder(round_f16)(_c(v).cast("array<float>"))


def to_bf16(v) -> Column:
    return _rounder(round_bf16)(_c(v).cast("array<float>"))


def to_f32(v) -> Column:
    return _c(v).cast("array<float>")


CASTS: dict[str, Callable] = {"f32": to_f32, "f16": to_f16, "bf16": to_bf16}


def raw_bytes(v, dtype: str = "f32") -> Column:
    """Little-endian bytes of the elements; of an 8-bit vector its data only."""
    kinds = {"f32": "<f4", "f16": "<f2", "i8": "i1"}

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        values, ends, none = _flat(v)
        flat = (round_bf16(values.astype(np.float32)).view(np.uint32) >> 16).astype("<u2") if dtype == "bf16" else values.astype(kinds[dtype])
        whole, size = flat.tobytes(), flat.itemsize
        return pd.Series([None if gone else whole[a * size : b * size] for a, b, gone in zip([0, *ends[:-1].tolist()], ends.tolist(), none)], dtype=object)

    return run(_c(v))


# --- metrics by name


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2_sq": l2_sq, "cosine": cosine_distance, "inner_product": inner_product_distance, "euclidean": euclidean}
QI8_METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2_sq": qi8_l2_sq, "cosine": qi8_cosine_distance, "inner_product": qi8_inner_product_distance}
#: Other names of metrics.
ALIASES = {"l2": "l2_sq", "l2sq": "l2_sq", "ip": "inner_product", "cos": "cosine"}


def metric_name(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in METRICS:
        raise ValueError(f"no metric is named {name!r}")
    return name


def register_metric(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Adds a distance: build takes two array columns and returns a double column."""
    METRICS[name.lower()] = build


def distance(a, b, metric: str) -> Column:
    return METRICS[metric_name(metric)](_c(a), _c(b))
