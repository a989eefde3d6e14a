"""Numeric column functions shared by features, detectors and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.params import SEVERITIES


def d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def ratio(num, den, cap: float = 1e6) -> Column:
    """Bounded quotient: `cap` when only the denominator is zero, 0 when both are."""
    n, m = d(num), d(den)
    return F.when(m > 0, F.least(F.lit(float(cap)), n / m)).when(n > 0, F.lit(float(cap))).otherwise(0.0)


def exceedance(observed, threshold, saturation: float = 4.0) -> Column:
    """0.5 at the threshold, 1.0 at `saturation` times it, log-scaled between."""
    o, t = d(observed), d(threshold)
    q = o / t
    span = F.log(F.lit(max(float(saturation), 1.0001)))
    pos = F.log(F.greatest(q, F.lit(1e-9)))
    above = F.least(F.lit(1.0), 0.5 + 0.5 * F.least(F.lit(1.0), pos / span))
    return (
        F.when(t <= 0, F.when(o > 0, 1.0).otherwise(0.0))
        .when(o <= 0, 0.0)
        .when(pos <= 0, F.greatest(F.lit(0.0), 0.5 * q))
        .otherwise(above)
    )


def zscore(value, mean, stdev) -> Column:
    """Deviations from a baseline; relative change when the baseline is flat."""
    v, m, s = d(value), d(mean), d(stdev)
    return (
        F.when((s <= 1e-9) & (F.abs(m) <= 1e-9), 0.0)
        .when(s <= 1e-9, (v - m) / F.greatest(F.lit(1e-9), F.abs(m)))
        .otherwise((v - m) / s)
    )


def cv(mean, stdev) -> Column:
    """Coefficient of variation, 0 when the mean is not positive."""
    return F.when(d(mean) > 0, F.coalesce(d(stdev), F.lit(0.0)) / d(mean)).otherwise(0.0)


def periodicity(cv_col, n, support: int = 6) -> Column:
    regular = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), d(cv_col)))
    return F.when(d(n) > 0, regular * F.least(F.lit(1.0), d(n) / float(support))).otherwise(0.0)


def burstiness(mean, stdev, n) -> Column:
    m, s = d(mean), d(stdev)
    return F.when((d(n) < 2) | (s + m == 0), 0.0).otherwise((s - m) / (s + m))


def xlog2x(c) -> Column:
    """c * log2(c), 0 for counts of 0: the additive part of an entropy."""
    return F.when(d(c) > 0, d(c) * F.log2(d(c))).otherwise(0.0)


def entropy_from(total, sum_xlogx) -> Column:
    """Bits of entropy from N and the sum of c*log2(c)."""
    n = d(total)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - d(sum_xlogx) / n)).otherwise(0.0)


def normalised_entropy(bits, k) -> Column:
    return F.when(d(k) > 1, d(bits) / F.log2(d(k))).otherwise(0.0)


def severity_rank(sev: Column) -> Column:
    """0 for INFO up to 4 for CRITICAL."""
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), sev) - 1).cast("int")


def severity_name(rank: Column) -> Column:
    top = len(SEVERITIES) - 1
    idx = F.greatest(F.lit(0), F.least(F.lit(top), rank.cast("int")))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), idx + 1)


def escalate(sev: Column, steps: int = 1) -> Column:
    return severity_name(severity_rank(sev) + F.lit(steps))


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), d(x)))


def compact_number(v: Column) -> Column:
    """Three significant digits for large or tiny values, else two decimals, stripped.

    Halves go to the even digit, as in C formatting."""
    large = v
    for exp in range(3, 13):
        large = F.when((v >= 10.0**exp) & (v < 10.0 ** (exp + 1)), F.bround(v, 2 - exp)).otherwise(large)
    sci = F.format_string("%.2e", large)
    exp = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    strip = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    sci_text = F.concat(strip(F.regexp_replace(sci, r"e.*$", "")), F.regexp_replace(sci, r"^[^e]*", ""))
    short = F.when((exp < -4) | (exp >= 3), sci_text).when(
        exp == -4, strip(F.format_string("%.6f", v))
    ).otherwise(strip(F.format_string("%.5f", v)))
    plain = strip(F.format_string("%.2f", F.bround(v, 2)))
    return F.when((v >= 1000) | ((v != 0) & (F.abs(v) < 0.01)), short).otherwise(plain)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def all_finite(values: Column) -> Column:
    """Every value of a feature map is a finite number."""
    return F.forall(F.map_values(values), is_finite)


def require(values: Column, *names: str) -> Column:
    """The named entries of a feature map; a missing one is an error, never a zero."""
    return F.array(*[
        F.coalesce(
            F.try_element_at(values, F.lit(n)),
            F.raise_error(F.lit(f"feature vector is missing {n}")).cast("double"),
        )
        for n in names
    ])


def lookup(values: Column, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(float(default)))
