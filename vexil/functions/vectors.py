"""Vector expressions over ARRAY<FLOAT>; all sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = 4294967295


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, places: int) -> Column:
    """A double at so many places as round() of SQL engines gives it: halves of x 10^places away from zero, the sign of zero kept; F.round goes by decimal digits and has no -0.0."""
    x, m = _c(x), float(10**places)
    a = F.abs(x * F.lit(m))
    whole = F.rint(a)
    found = F.signum(x) * (whole + F.when(a - whole == 0.5, 1.0).otherwise(0.0)) / F.lit(m)
    return F.when(a == float("inf"), x).otherwise(found)


def doubles(v: Column | str) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return total(F.zip_with(_c(a), _c(b), square))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na <= 0) | (nb <= 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def finite_score(score: Column) -> Column:
    """NaN and infinities rank last."""
    return F.when(F.isnan(score) | score.isNull() | (F.abs(score) == float("inf")), F.lit(float("-inf"))).otherwise(score)


def normalise(v: Column | str, epsilon: float = 1e-12) -> Column:
    # the length is bound by a lambda of its own: within that of the elements it would be added up again for each of them
    n = F.array(F.greatest(norm(v), F.lit(epsilon)))
    return F.transform(n, lambda n: F.transform(_c(v), lambda x: x.cast("double") / n))[0]


def max_abs(v: Column | str) -> Column:
    return F.array_max(F.transform(_c(v), lambda x: F.abs(x.cast("double"))))


def int8_scale(v: Column | str) -> Column:
    """The step of symmetric int8 codes of one vector; 1 for a zero vector."""
    m = max_abs(v)
    return F.when(m == 0, F.lit(1.0)).otherwise(m / 127)


def tensor_scale(v: Column | str) -> Column:
    """An aggregate: the step of symmetric int8 codes of all vectors of a table (or group) together; 1 if all are zero."""
    m = F.max(max_abs(v))
    return F.when(m == 0, F.lit(1.0)).otherwise(m / 127)


def quantise_int8(v: Column | str, scale: Column | str | None = None) -> Column:
    """Codes in -127 .. 127, halves to even; by the vector's own scale, or a tensor's."""
    s = int8_scale(v) if scale is None else _c(scale)
    return F.transform(_c(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / s))).cast("tinyint"))


def dequantise_int8(codes: Column | str, scale: Column | str) -> Column:
    return F.transform(_c(codes), lambda q: q.cast("double") * _c(scale))


def stride(v: Column | str, step: int) -> Column:
    """Every step-th element, scaled to length 1."""
    return normalise(F.filter(_c(v), lambda x, i: i % step == 0))


def within_norm(v: Column | str, low: float = 0.999, high: float = 1.001) -> Column:
    return norm(v).between(low, high)


def has_dimension(v: Column | str, dim: int) -> Column:
    return F.coalesce(F.size(_c(v)) == dim, F.lit(False))


def all_finite(v: Column | str) -> Column:
    return F.forall(_c(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def parse_csv(text: Column | str, strict: bool = True) -> Column:
    """Comma-separated numbers as a vector. Strict: any empty or bad token gives null. Loose: line breaks and tabs separate too, and empty tokens are skipped."""
    if strict:
        tokens = F.transform(F.split(_c(text), ","), lambda x: F.trim(x).try_cast("float"))
        return F.when(F.exists(tokens, lambda x: x.isNull()), None).otherwise(tokens)
    parts = F.filter(F.split(_c(text), "[,\n\r\t]"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).try_cast("float"))


def to_csv(v: Column | str) -> Column:
    return F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ",")
