"""From checks and findings to domain, category and global scores, summaries and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.functions.expr import clamp, half_even, score, weight


def weighed(evaluations: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    return evaluations.where(F.col("status").isin("Passed", "Violated")).withColumn("weight", weight(F.col("severity"), F.col("category"), scales))


def _sums(by: str, evaluations: DataFrame, scales: dict[str, float] | None) -> DataFrame:
    """Partial aggregation to few rows first; weights are multiplied in after it."""
    counted = evaluations.where(F.col("status").isin("Passed", "Violated")).groupBy(by, "severity", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "Violated").alias("v"))
    w = weight(F.col("severity"), F.col("category"), scales)
    return counted.groupBy(by).agg(F.sum("n").alias("checks"), F.sum("v").alias("violations"), F.sum(F.col("n") * w).alias("check_weight"), F.sum(F.col("v") * w).alias("violation_weight"))


def domain_scores(evaluations: DataFrame, known: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    """Every known or checked domain. One without checks is not assessed: score and health 0, and a flag that says so."""
    rules = evaluations.where(F.col("status").isin("Passed", "Violated")).groupBy("domain").agg(F.countDistinct("rule_id").alias("rules_evaluated"))
    joined = known.join(_sums("domain", evaluations, scales), "domain", "full_outer").join(rules, "domain", "left").na.fill(0, ["checks", "violations", "rules_evaluated"]).na.fill(0.0, ["check_weight", "violation_weight"])
    none = F.col("checks") == 0
    s = F.when(none, F.lit(0.0)).otherwise(score(F.col("violation_weight"), F.col("check_weight")))
    passed = F.when(none, F.lit(0.0)).otherwise(clamp(1.0 - F.col("violations") / F.col("checks")))
    return joined.select("domain", "rules_evaluated", "checks", "violations", "check_weight", "violation_weight", s.alias("weighted_score"), passed.alias("pass_rate"), clamp(s).alias("health"), (~none).alias("assessed"))


def category_scores(evaluations: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    return _sums("category", evaluations, scales).select("category", "checks", "violations", half_even(100.0 * score(F.col("violation_weight"), F.col("check_weight"))).alias("compliance"))


def global_metrics(domains: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """Averages over assessed domains, weighted by their checks; null if none was assessed."""
    some = domains.where("assessed")
    mean = lambda c: F.sum(F.col(c) * F.col("checks")) / F.sum("checks")
    return some.agg(
        F.count(F.lit(1)).alias("assessed_domains"), F.sum("checks").alias("checks"),
        half_even(100.0 * mean("health")).alias("project_health"), half_even(100.0 * mean("pass_rate")).alias("maintainability"), half_even(mean("weighted_score"), 3).alias("compliance"),
        half_even(F.when(F.count(F.lit(1)) <= 1, F.lit(1.0)).otherwise(clamp(1.0 - F.stddev_pop("weighted_score") * F.lit(sensitivity))), 3).alias("resilience"),
    )


def whole_health(ordinal: Column) -> Column:
    """Health of a group of findings with the whole-number division kept."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.floor(F.sum(ordinal * 5) / F.greatest(F.lit(1), F.count(F.lit(1)))))).cast("long")


def layer_summary(findings: DataFrame) -> DataFrame:
    """Per category and layer: distinct files, violations, whole health."""
    return findings.groupBy("category", "domain").agg(F.countDistinct("file").alias("total_files"), F.count(F.lit(1)).alias("violations"), whole_health(F.col("ordinal")).alias("health"))


def severity_histogram(findings: DataFrame, by: str, labels: list[str]) -> DataFrame:
    """A column per severity, zero where there is none."""
    return findings.groupBy(by).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in labels))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def dashboard(findings: DataFrame) -> DataFrame:
    """Counts by domain, by category and by severity in one pass."""
    sets = [[F.col("domain")], [F.col("category")], [F.col("severity")]]
    return findings.groupingSets(sets, "domain", "category", "severity").agg(F.count(F.lit(1)).alias("n"))


def category_bands(categories: DataFrame, scores: DataFrame) -> DataFrame:
    """Every registered category with its band, or not assessed."""
    c = F.col("compliance")
    band = F.when(c.isNull(), "not assessed").when(c >= 90, "good").when(c >= 80, "fair").when(c >= 60, "weak").otherwise("poor")
    return categories.join(scores.select("category", "compliance"), "category", "left").select("category", "compliance", band.alias("band"))
