"""Vector functions as column expressions on array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "ip", "l2")


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 - <a, b> for cosine (of unit vectors) and ip, the squared distance for l2."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return l2sq(a, b) if metric == "l2" else F.lit(1.0) - dot(a, b)


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def normalize_floor(v: Column, floor: float = 1e-12) -> Column:
    """v over the larger of its norm and ``floor``."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.transform(v, lambda x: x / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def int8_encode(v: Column, half_even: bool = True) -> Column:
    """struct(scale, q): q = v / scale rounded, within 127 either way; scale 1 for a zero vector."""
    top = F.array_max(F.transform(v, F.abs))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    near = F.rint if half_even else F.round
    q = F.transform(v, lambda x: F.least(F.greatest(near(x / scale), F.lit(-127.0)), F.lit(127.0)).cast("int"))
    return F.struct(scale.alias("scale"), q.alias("q"))


def int8_decode(code: Column) -> Column:
    return F.transform(code["q"], lambda x: x * code["scale"])


def bucketize(residual: Column, cutoffs: list[float]) -> Column:
    """For each value the number of cutoffs strictly below it."""
    limits = F.array(*[F.lit(float(c)) for c in cutoffs])
    return F.transform(residual, lambda r: F.size(F.filter(limits, lambda c: c < r)))


def masked_mean(rows: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors whose mask is 1, as a unit vector."""
    zero = F.array(*[F.lit(0.0)] * dim)
    kept = F.filter(F.arrays_zip(rows.alias("r"), mask.alias("m")), lambda p: p["m"] == 1)
    total = F.aggregate(kept, zero, lambda s, p: F.zip_with(s, p["r"].cast("array<double>"), lambda x, y: x + y))
    n = F.greatest(F.size(kept), F.lit(1))
    return normalize(F.transform(total, lambda x: x / n))


def parse_vector(text: Column, dim: int) -> Column:
    """JSON text to array<double>; another length or bad JSON raises."""
    v = F.from_json(text, "array<double>")
    return F.when((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull()), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} numbers in "), F.coalesce(text, F.lit("null")))).cast("array<double>"))
