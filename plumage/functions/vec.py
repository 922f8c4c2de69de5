"""Column expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def bound(x: Column, body) -> Column:
    """body(x) with x computed once, not for each element that body's lambdas visit."""
    return F.element_at(F.transform(F.array(x), body), 1)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def scale(v, by) -> Column:
    return F.transform(_col(v), lambda x: x * by)


def signed_power(v, alpha: float = 0.5) -> Column:
    return F.transform(_col(v), lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(alpha)))


def unit(v, floor: float = 1e-10) -> Column:
    """v over its norm if that exceeds floor, else v as it is."""
    return bound(_col(v), lambda c: bound(norm(c), lambda n: F.when(n > floor, F.transform(c, lambda x: x / n)).otherwise(c)))


def masked(v, mask) -> Column:
    """v with the components off the mask set to zero."""
    return F.zip_with(_col(v), _col(mask), lambda x, m: F.when(m, x).otherwise(F.lit(0.0)))


def block_mask(k: int, d: int, use_weight: bool = True, use_mean: bool = True, use_var: bool = True, max_dim: int | None = None) -> Column:
    """Mask of k * (2d + 1) components in the interleaved layout [w, mean(d), var(d)] of each component; max_dim, unless
    null or 0, keeps the first so many of mean and var."""
    width, limit = 2 * d + 1, max_dim or d

    def keep(i: Column) -> Column:
        p = i % width
        mean, var = (p >= 1) & (p <= limit), (p > d) & (p <= d + limit)
        return ((p == 0) & F.lit(use_weight)) | (mean & F.lit(use_mean)) | (var & F.lit(use_var))

    return F.transform(F.sequence(F.lit(0), F.lit(k * width - 1)), keep)


def masked_power_unit(fv, mask) -> Column:
    """Zero off the mask, signed square root, then division by the norm or 1e-10, whichever is greater."""
    return _over(signed_power(masked(fv, mask)), norm, 1e-10)


def _over(v: Column, size, floor: float) -> Column:
    """v over size(v) or floor, whichever is greater."""
    return bound(v, lambda c: bound(F.greatest(size(c), F.lit(floor)), lambda n: F.transform(c, lambda x: x / n)))


def power_unit(fv) -> Column:
    """Signed square root, then division by the norm if that exceeds 1e-10."""
    return unit(signed_power(fv))


def root_l1(v, floor: float = 1e-7) -> Column:
    """Histogram descriptors: share of the L1 norm, square root, unit length; both norms at least `floor`."""
    share = _over(_col(v), lambda c: total(F.transform(c, lambda y: F.abs(y))), floor)
    return _over(F.transform(share, lambda x: F.sqrt(x)), norm, floor)


def decompose(a, b, k: int, d: int) -> Column:
    """Contribution of each component to the inner product of two vectors in the blocked layout [w(k) | mean | var]."""
    va, vb = _col(a), _col(b)

    def part(c: Column) -> Column:
        cut = lambda v, start: F.slice(v, start + c * d + 1, F.lit(d))
        w = F.element_at(va, c + 1) * F.element_at(vb, c + 1)
        return F.struct(
            c.alias("k"), w.alias("weight"), dot(cut(va, F.lit(k)), cut(vb, F.lit(k))).alias("mean"),
            dot(cut(va, F.lit(k + k * d)), cut(vb, F.lit(k + k * d))).alias("var"),
        )

    wrong = F.raise_error(F.lit(f"vectors must have {k} * (1 + 2 * {d}) components"))
    return F.when((F.size(va) != k * (1 + 2 * d)) | (F.size(vb) != F.size(va)), wrong).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), part))


def stats(v) -> Column:
    """dim, norm, least, greatest, mean, population standard deviation, share of exact zeros."""
    c = _col(v)
    n = F.size(c)
    mean = total(c) / n
    return F.struct(
        n.alias("dim"), norm(c).alias("l2_norm"), F.array_min(c).alias("least"), F.array_max(c).alias("greatest"), mean.alias("mean"),
        F.sqrt(bound(mean, lambda m: total(F.transform(c, lambda x: (x - m) * (x - m)))) / n).alias("std"),
        (F.size(F.filter(c, lambda x: x == 0)) / n).alias("sparsity"),
    )
