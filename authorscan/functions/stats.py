"""Column expressions for the per-document tests (P4, A7 tail).

* ``hc_term``: standardised excess of the i-th smallest of n p-values.
* ``chi2_even_sf``: survival of chi-square with 2n degrees of freedom,
  e^{-l} sum_{k<n} l^k / k! with l = T/2, summed in log space over the terms
  that matter (|k - l| <= 40 sqrt(l) + 40, the rest are below e^-800 of the
  largest term), so the work per document is O(sqrt(l)) and not O(n).
* ``hc_of_sorted`` / ``fisher_of`` / ``minp_of`` / ``bonf_of``: the same tests
  over an ``ARRAY<DOUBLE>`` of p-values, for use inside any ``agg`` when a
  document is known to be small (streaming micro-batches, user code).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hc_imax(n, gamma: float) -> Column:
    """Number of smallest p-values HC looks at: max(1, floor(gamma n + 0.5))."""
    return F.greatest(F.lit(1), F.floor(_c(n) * F.lit(float(gamma)) + F.lit(0.5)))


def hc_term(i, n, p, variant: str = "2004") -> Column:
    """sqrt(n) (i/n - p) / denom; denom sqrt(p(1-p)) (2004) or sqrt(u(1-u)), u=i/n (2008),
    floored at 1/(100 + n^2) so that p = 1 or i = n stay finite."""
    i, n, p = _c(i).cast("double"), _c(n).cast("double"), _c(p)
    u = i / n
    base = p * (1 - p) if variant == "2004" else u * (1 - u)
    denom = F.greatest(F.sqrt(base), F.lit(1.0) / (F.lit(100.0) + n * n))
    return F.sqrt(n) * (u - p) / denom


def ln_factorial(k) -> Column:
    """ln k! — exact sum for k < 20, Stirling series (error < 1e-15) above."""
    k = _c(k).cast("double")
    z = k + 1
    stirling = ((z - 0.5) * F.log(z) - z + F.lit(HALF_LN_2PI) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3))
                + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)))
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0),
                        lambda acc, j: acc + F.log(j.cast("double")))
    return F.when(k < 2, F.lit(0.0)).when(k < 20, exact).otherwise(stirling)


def chi2_even_sf(T, n, reach: float = 40.0) -> Column:
    """P[chi2_{2n} >= T] for integer n >= 1 (Fisher's combined p-value).

    Terms farther than ``reach`` standard deviations from the largest are below double precision of the sum and left out.
    """
    T, n = _c(T), _c(n).cast("long")
    lam = T / 2
    h = F.lit(float(reach)) * F.sqrt(lam) + F.lit(float(reach))
    kmax = F.least(n - 1, F.ceil(lam + h)).cast("long")
    kmin = F.greatest(F.lit(0), F.floor(kmax - 2 * h)).cast("long")
    t0 = kmin.cast("double") * F.log(lam) - lam - ln_factorial(kmin)
    steps = F.when(kmax > kmin, F.sequence(kmin + 1, kmax)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(t0.alias("t"), t0.alias("s"))

    def step(acc, k):
        t = acc["t"] + F.log(lam) - F.log(k.cast("double"))
        s = F.greatest(acc["s"], t) + F.log(1 + F.exp(-F.abs(acc["s"] - t)))
        return F.struct(t.alias("t"), s.alias("s"))

    total = F.aggregate(steps, start, step, lambda a: F.exp(a["s"]))
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def hc_of_sorted(ps, gamma: float, variant: str = "2004") -> Column:
    """HC and its threshold over a p-value array: ``struct(hc, threshold)``.

    The first maximiser (smallest i) gives the threshold.
    """
    s = F.array_sort(F.filter(_c(ps), lambda x: x.isNotNull()))
    n = F.size(s)
    imax = hc_imax(n, gamma)
    terms = F.transform(F.slice(s, 1, imax), lambda p, i: F.struct(
        hc_term(i + 1, n, p, variant).alias("hc"), (-(i + 1)).alias("ni"), p.alias("p")))
    best = F.array_max(terms)
    return F.when(n > 0, F.struct(best["hc"].alias("hc"), best["p"].alias("threshold")))


def fisher_of(ps) -> Column:
    v = F.filter(_c(ps), lambda x: x.isNotNull())
    T = F.aggregate(v, F.lit(0.0), lambda a, p: a - 2 * F.log(p))
    n = F.size(v)
    return F.when(n > 0, F.struct(T.alias("fisher"), chi2_even_sf(T, n).alias("fisher_pvalue")))


def minp_of(ps) -> Column:
    v = F.filter(_c(ps), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, -F.log(F.array_min(v)))


def bonf_of(ps) -> Column:
    v = F.filter(_c(ps), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.least(F.lit(1.0), F.size(v) * F.array_min(v)))
