"""Compliance and health of whole reports, with what may stand in for what, and whether the assessment is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.expr import half_even

STATUSES = ("Passed", "Violated", "InsufficientEvidence", "Error", "NotEvaluated", "Unsupported")


def report_compliance(evaluations: DataFrame) -> DataFrame:
    """(report, category, score, passed, completed, level): one pass over evaluations (report, category, status).

    Rows of level 0 are categories with a completed check, of level 1 whole reports; a category that only has other statuses has no score
    and no row, since the absence of findings proves nothing.
    """
    level = F.grouping_id()
    passed, completed = F.count_if(F.col("status") == "Passed"), F.count_if(F.col("status").isin("Passed", "Violated"))
    sets = evaluations.groupingSets([["report", "category"], ["report"]], "report", "category")
    rows = sets.agg(passed.alias("passed"), completed.alias("completed"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES[2:]), level.alias("level"))
    score = half_even(F.when(F.col("completed") > 0, 100.0 * F.col("passed") / F.col("completed")))
    return rows.where("level = 1 or completed > 0").select("report", "category", score.alias("score"), "passed", "completed", *(s.lower() for s in STATUSES[2:]), F.col("level").cast("int").alias("level"))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def report_health(compliance: DataFrame, domains: DataFrame) -> DataFrame:
    """(report, health, evidence, coverage, adjusted, basis, complete) of each report of report_compliance.

    domains are (report, domain, health, checks) with health from 0 to 1. Health is that of the domains with checks, weighted by them; without any
    it falls back to the mean of the categories' scores, and without these to 0 without evidence. Coverage is the completed share of the
    evaluations that apply; complete says that there is evidence, that all applies and that nothing is missing, failed or unsure.
    """
    assessed = domains.where("checks > 0").groupBy("report").agg((F.sum(F.col("health") * F.col("checks")) / F.sum("checks") * 100.0).alias("by_domain"))
    level = F.col("level")
    at = lambda c: F.max(F.when(level == 1, F.col(c)))
    whole = compliance.groupBy("report").agg(F.avg(F.when(level == 0, F.col("score"))).alias("by_category"), at("completed").alias("completed"), *(at(s.lower()).alias(s.lower()) for s in STATUSES[2:]))
    rows = whole.join(assessed, "report", "left")
    health = half_even(F.coalesce("by_domain", "by_category", F.lit(0.0)))
    applies = F.col("completed") + F.col("insufficientevidence") + F.col("error") + F.col("notevaluated")
    coverage = F.when(applies > 0, _clamped(F.col("completed") / applies)).otherwise(F.lit(0.0))
    basis = F.when(F.col("by_domain").isNotNull(), "domains").when(F.col("by_category").isNotNull(), "categories").otherwise("none")
    nothing_else = (F.col("unsupported") == 0) & (F.col("insufficientevidence") == 0) & (F.col("error") == 0) & (F.col("notevaluated") == 0)
    return rows.select(
        "report", health.alias("health"), (basis != "none").alias("evidence"), half_even(coverage * 100.0).alias("coverage"), half_even(health * coverage).alias("adjusted"), basis.alias("basis"),
        ((basis != "none") & (applies > 0) & nothing_else & (coverage >= 1.0)).alias("complete"),
    )
