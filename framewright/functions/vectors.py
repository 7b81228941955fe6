"""Column expressions over fixed-width vectors (array columns). Everything stays inside the JVM; elements are doubles.

Vectors are null-safe: a null vector gives null. Statistics are Python lists, which are small and become literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(vector) -> Column:
    return _col(vector).cast("array<double>")


def zscore(vector, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x - mean) / (std + epsilon); longer statistics are cut to the vector's width."""
    m, s = literal_vector(mean), literal_vector(std)
    return F.transform(doubles(vector), lambda x, i: (x - F.get(m, i)) / (F.get(s, i) + EPSILON))


def inverse_zscore(vector, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Dimensions without statistics pass through (mean 0, std 1)."""
    m, s = literal_vector(mean), literal_vector(std)
    return F.transform(doubles(vector), lambda x, i: F.coalesce(x * (F.get(s, i) + EPSILON) + F.get(m, i), x))


def quantile_scale(vector, q01: Sequence[float], q99: Sequence[float]) -> Column:
    """Map q01..q99 to -1..1 without clipping."""
    low, high = literal_vector(q01), literal_vector(q99)
    return F.transform(doubles(vector), lambda x, i: (x - F.get(low, i)) / (F.get(high, i) - F.get(low, i) + EPSILON) * 2 - 1)


def inverse_quantile_scale(vector, q01: Sequence[float], q99: Sequence[float]) -> Column:
    low, high = literal_vector(q01), literal_vector(q99)
    return F.transform(doubles(vector), lambda x, i: F.coalesce((x + 1) / 2 * (F.get(high, i) - F.get(low, i) + EPSILON) + F.get(low, i), x))


def floored_zscore(vector, mean: Sequence[float], std: Sequence[float], width: int) -> Column:
    """(x - mean) / max(std, epsilon), then padded by zeros."""
    m, s = literal_vector(mean), literal_vector(std)
    return pad(F.transform(doubles(vector), lambda x, i: (x - F.get(m, i)) / F.greatest(F.get(s, i), F.lit(EPSILON))), width)


def pad(vector, width: int) -> Column:
    """Right-pad by zeros; longer vectors stay as they are."""
    v = doubles(vector)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(v), F.lit(0))))


def truncate(vector, width: int) -> Column:
    return F.slice(_col(vector), 1, width)


def subsample(vector, stride: int) -> Column:
    return F.filter(_col(vector), lambda _, i: i % stride == 0)


def swap(vector, i: int, j: int) -> Column:
    v = _col(vector)
    return F.transform(v, lambda x, k: F.when(k == i, F.get(v, F.lit(j))).when(k == j, F.get(v, F.lit(i))).otherwise(x))


def bool_mask(*runs: int) -> list[bool]:
    """Runs of true (positive) and false (negative); 0 adds nothing."""
    return [run > 0 for run in runs for _ in range(abs(run))]


def delta(action, state, mask: Sequence[bool]) -> Column:
    """Subtract the state where the mask is true; dimensions past the mask are absolute."""
    s, m = doubles(state), F.array(*[F.lit(b) for b in mask])
    return F.transform(doubles(action), lambda a, i: F.when(F.coalesce(F.get(m, i), F.lit(False)), a - F.get(s, i)).otherwise(a))


def absolute(action, state, mask: Sequence[bool]) -> Column:
    s, m = doubles(state), F.array(*[F.lit(b) for b in mask])
    return F.transform(doubles(action), lambda a, i: F.when(F.coalesce(F.get(m, i), F.lit(False)), a + F.get(s, i)).otherwise(a))


def flip_signs(vector, signs: Sequence[int]) -> Column:
    s = literal_vector(signs)
    return F.transform(doubles(vector), lambda x, i: x * F.coalesce(F.get(s, i), F.lit(1.0)))


def max_abs_difference(a, b) -> Column:
    return F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def is_valid_vector(vector, width: int) -> Column:
    """The exact width, no null and all finite."""
    v = doubles(vector)
    return F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def bin256(x) -> Column:
    """256 equal bins over -1..1; below is -1, above and NaN is 255."""
    x = _col(x).cast("double")
    return F.when(F.isnan(x), F.lit(255)).otherwise(F.least(F.greatest(F.floor((x + 1) * 128), F.lit(-1)), F.lit(255))).cast("int")


def unbin(token, bins: int = 256) -> Column:
    return _col(token) / F.lit(float(bins)) * 2 - 1


def digits_to_token(digits, bases: Sequence[int]) -> Column:
    """Mixed radix, first digit least significant."""
    places, place = [], 1
    for base in bases:
        places.append(place)
        place *= base
    weights = F.array(*[F.lit(p).cast("long") for p in places])
    return F.aggregate(F.zip_with(_col(digits).cast("array<long>"), weights, lambda d, w: d * w), F.lit(0).cast("long"), lambda acc, x: acc + x)


def token_to_digits(token, bases: Sequence[int]) -> Column:
    out, place = [], 1
    for base in bases:
        out.append(F.floor(_col(token) / F.lit(place)) % base)
        place *= base
    return F.array(*[d.cast("long") for d in out])


def resample(vector, points: int) -> Column:
    """Linear interpolation of a sequence at evenly spread positions, ends included."""
    v = doubles(vector)
    n = F.size(v)

    def at(i):
        position = i * (n - 1) / F.lit(float(points - 1))
        low = F.floor(position).cast("int")
        high = F.least(low + 1, n - 1)
        return F.get(v, low) + (F.get(v, high) - F.get(v, low)) * (position - low)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def blend(old, new, keep: float) -> Column:
    """keep * old + (1 - keep) * new, element by element (moving averages of weights and of targets)."""
    return F.zip_with(doubles(old), doubles(new), lambda a, b: a * keep + b * (1 - keep))


def quaternion_to_axis_angle(q) -> Column:
    """(x, y, z, w) to a rotation vector; w is clipped to -1..1 and a zero rotation gives zeros."""
    v = doubles(q)
    w = clip(F.get(v, F.lit(3)), -1.0, 1.0)
    s = F.sqrt(1 - w * w)
    return F.when(s < 1e-9, literal_vector([0, 0, 0])).otherwise(F.transform(F.slice(v, 1, 3), lambda x: x * 2 * F.acos(w) / F.greatest(s, F.lit(1e-12))))


def unit_quaternion(q) -> Column:
    """Divided by its norm; null if the norm is 1e-8 or less."""
    v = doubles(q)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 1e-8, F.transform(v, lambda x: x / norm))


def autoregressive(innovations, rho: float) -> Column:
    """n[0] = e[0]; n[t] = rho * n[t - 1] + sqrt(1 - rho ** 2) * e[t]."""
    gain = (1 - rho * rho) ** 0.5
    start = F.array().cast("array<double>")
    return F.aggregate(doubles(innovations), start, lambda acc, e: F.concat(acc, F.array(F.when(F.size(acc) == 0, e).otherwise(F.coalesce(F.element_at(acc, -1), F.lit(0.0)) * rho + e * gain))))


def executed_action(action, state, q01: Sequence[float], q99: Sequence[float]) -> Column:
    """An executed action relative to the state it started from, scaled by quantiles."""
    return quantile_scale(delta(action, state, [True] * len(q01)), q01, q99)
