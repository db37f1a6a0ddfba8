"""Column expressions that the verdicts are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two numbers are equal within this.
TOLERANCE = 1e-4

# Base weights by severity; a severity that isn't listed weighs 1; lighter weights than the least count as 0.
BASE_WEIGHTS = {"Critical": 1.5, "High": 1.25, "Medium": 1.0, "Low": 0.75, "Info": 0.5}
OTHER_WEIGHT = 1.0
LEAST_WEIGHT = 0.05


def half_even(x: Column, digits: int = 2) -> Column:
    """Round the scaled double half to even."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite; in Spark NaN is larger than any number, so comparisons need this first."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def breaches(op: Column, value: Column, threshold: Column) -> Column:
    """Whether value violates the rule; null for an unknown operator. Both must be finite."""
    near = F.abs(value - threshold) < F.lit(TOLERANCE)
    return (
        F.when(op == ">", value > threshold)
        .when(op == ">=", value >= threshold)
        .when(op == "<", value < threshold)
        .when(op == "<=", value <= threshold)
        .when(op == "=", near)
        .when(op == "!=", ~near)
    )


def weight(severity: Column, category: Column, scales: dict[str, float] | None = None) -> Column:
    """What one check weighs: the severity's base times the category's scale."""
    base = reduce(lambda c, kv: c.when(severity == kv[0], F.lit(kv[1])), list(BASE_WEIGHTS.items())[1:], F.when(severity == "Critical", F.lit(BASE_WEIGHTS["Critical"]))).otherwise(F.lit(OTHER_WEIGHT))
    scale = F.lit(1.0)
    for name, by in (scales or {}).items():
        scale = F.when(F.lower(category) == name.lower(), F.lit(by)).otherwise(scale)
    return F.when(base * scale < F.lit(LEAST_WEIGHT), F.lit(0.0)).otherwise(base * scale)


def score(violated: Column, checked: Column) -> Column:
    """1 - violated / checked within [0, 1]; 1 where nothing was weighed."""
    return F.when(checked <= 0, F.lit(1.0)).otherwise(clamp(F.lit(1.0) - violated / checked))


def domain_label(c: Column) -> Column:
    """Domains compare without case and surrounding blanks; null and blank are Unclassified."""
    trimmed = F.trim(c)
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit("unclassified")).otherwise(F.lower(trimmed))


def words_pattern(words: list[str]) -> str:
    """A linear pattern that any of the words matches, without case."""
    return "(?i)(" + "|".join(words) + ")"
