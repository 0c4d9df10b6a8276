"""Association measures as column expressions. a, b: marginal counts; c: pair count; total: of all pairs;
values: vocabulary size; delta: added to every pair count."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """0 over anything is 0; anything else over 0 is infinite with its sign."""
    return F.when(numerator == 0, 0.0).when(denominator == 0, F.signum(numerator) * F.lit(INFINITY)).otherwise(numerator / F.when(denominator != 0, denominator))


def ln(x: Column) -> Column:
    """ln with ln(0) = -inf."""
    return F.when(x == 0, F.lit(-INFINITY)).otherwise(F.ln(F.when(x > 0, x)))


def difference(x: Column, y: Column) -> Column:
    """x - y where equal infinities differ by 0."""
    return F.when(x == y, 0.0).otherwise(x - y)


def freq(count: Column, delta: float = 0.0, values: Column | None = None) -> Column:
    """Smoothed count: of a value if the vocabulary size is given, of a pair otherwise."""
    return count + (delta * values if values is not None else F.lit(float(delta)))


def prob_one(a: Column, total: Column, values: Column, delta: float = 0.0) -> Column:
    return safe_divide(freq(a, delta, values), total + delta * values * values)


def prob_pair(c: Column, total: Column, values: Column, delta: float = 0.0) -> Column:
    return safe_divide(freq(c, delta), total + delta * values * (values + 1) / 2)


def conditional_prob(pab: Column, pb: Column) -> Column:
    return safe_divide(pab, pb)


def pmi_s(pab: Column, pa: Column, pb: Column) -> Column:
    return ln(pab) - ln(pa) - ln(pb)


def pmi_d(pab: Column, pa: Column, pb: Column) -> Column:
    return -pmi_s(pab, pa, pb)


def npmi1_s(pab: Column, pa: Column, pb: Column) -> Column:
    """In [0, 1]; an unseen pair and a pair that holds all mass give 0."""
    top, below = ln(pa) + ln(pb), 2 * ln(pab)
    return F.when(pab == 0, 0.0).otherwise(safe_divide(top, below))


def npmi1_d(pab: Column, pa: Column, pb: Column) -> Column:
    return 1 - npmi1_s(pab, pa, pb)


def npmi2_s(pab: Column, pa: Column, pb: Column) -> Column:
    return -ln(npmi1_d(pab, pa, pb)) / math.log(2)


def npmi2_d(pab: Column, pa: Column, pb: Column) -> Column:
    return -ln(npmi1_s(pab, pa, pb)) / math.log(2)


#: Measures by name; each takes (pab, pa, pb).
MEASURES = {"PMIs": pmi_s, "PMId": pmi_d, "NPMI1s": npmi1_s, "NPMI1d": npmi1_d, "NPMI2s": npmi2_s, "NPMI2d": npmi2_d, "conditional_prob": lambda pab, pa, pb: conditional_prob(pab, pb)}
