"""Facts meet rules: applicability, thresholds, three-valued status, statistics, and why a rule was not evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.functions.expr import breaches, clamp, finite, half_even

CHECKED = ("Passed", "Violated")


def resolved_metrics(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics under an unambiguous name: an exact spelling wins over one that differs by case; two of these cancel out."""
    other = [c for c in facts.columns if c not in ("metric_key", "metric_value")]
    exact = F.col("metric_key").isin(keys)
    named = facts.withColumn("name", F.lower("metric_key")).withColumn("exact", exact)
    grouped = named.groupBy(*other, "name").agg(F.count(F.lit(1)).alias("spellings"), F.max(F.when(F.col("exact"), F.struct("metric_key", "metric_value"))).alias("own"), F.max(F.struct("metric_key", "metric_value")).alias("any"))
    pick = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("spellings") == 1, F.col("any"))
    return grouped.withColumn("pick", pick).select(*other, "name", "spellings", F.col("pick.metric_value").alias("metric_value"), F.col("pick").isNotNull().alias("resolved"))


def effective_thresholds(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each rule's threshold: its own override, else its metric's, else the default. Names compare without case."""
    by_rule = overrides.where("kind = 'rule'").select(F.lower("name").alias("r_name"), F.col("value").alias("r_value"))
    by_metric = overrides.where("kind = 'metric'").select(F.lower("name").alias("m_name"), F.col("value").alias("m_value"))
    joined = rules.join(F.broadcast(by_rule), F.lower("rule_id") == F.col("r_name"), "left").join(F.broadcast(by_metric), F.lower("metric_key") == F.col("m_name"), "left")
    origin = F.when(F.col("r_value").isNotNull(), "rule").when(F.col("m_value").isNotNull(), "metric").otherwise("default")
    return joined.withColumn("origin", origin).withColumn("threshold", F.coalesce("r_value", "m_value", "threshold")).drop("r_name", "r_value", "m_name", "m_value")


def evaluate(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per fact metric and applicable rule, with its status.

    Non-finite numbers are Skipped; an incomplete fact is InsufficientEvidence before any comparison; a violation that
    can't be traced is InsufficientEvidence, while a pass needs no trace. A missing metric gives no row, never a pass.
    """
    active = rules.where("enabled AND unsupported IS NULL").select("rule_id", "category", F.col("scope").alias("r_scope"), F.lower("metric_key").alias("r_key"), "op", "threshold", "severity")
    met = facts.join(F.broadcast(active), (F.lower("metric_key") == F.col("r_key")) & (F.col("scope") == F.col("r_scope")))
    status = (
        F.when(~(finite(F.col("metric_value")) & finite(F.col("threshold"))), "Skipped")
        .when(F.col("incomplete"), "InsufficientEvidence")
        .when(~breaches(F.col("op"), F.col("metric_value"), F.col("threshold")), "Passed")
        .when(F.col("has_evidence"), "Violated")
        .otherwise("InsufficientEvidence")
    )
    return met.withColumn("status", status).drop("r_key", "r_scope")


def check_buckets(evaluations: DataFrame) -> DataFrame:
    """Only passes and violations are checks."""
    return evaluations.where(F.col("status").isin(*CHECKED)).groupBy("domain", "severity", "category").agg(F.count(F.lit(1)).alias("checks"))


def status_stats(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    checked = F.col("status").isin(*CHECKED)
    of = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    seen = evaluations.agg(F.count(F.lit(1)).alias("evaluations"), of("Passed"), of("Violated"), of("InsufficientEvidence"), of("Skipped"), F.countDistinct(F.when(checked, F.lower("rule_id"))).alias("rules_evaluated"))
    known = rules.agg(F.count(F.lit(1)).alias("rules_total"), F.count_if("enabled").alias("rules_enabled"), F.count_if(F.col("enabled") & F.col("unsupported").isNull()).alias("rules_applicable"))
    share = lambda a, b: F.when(F.col(b) > 0, clamp(100.0 * F.col(a) / F.col(b), 0.0, 100.0)).otherwise(F.lit(0.0))
    return seen.crossJoin(known).withColumn("coverage_pct", half_even(share("rules_evaluated", "rules_applicable"))).withColumn("capability_pct", half_even(share("rules_applicable", "rules_enabled")))


def not_evaluated(evaluations: DataFrame, rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Rules without a completed check, each with the first reason that holds."""
    done = evaluations.where(F.col("status").isin(*CHECKED)).select("rule_id").distinct()
    tried = evaluations.groupBy("rule_id").agg(F.bool_or(F.col("status") == "InsufficientEvidence").alias("insufficient"))
    keys = rules.select(F.lower("metric_key").alias("key")).distinct()  # as few as there are rules; what others measure is dropped before it is grouped
    emitted = facts.select(F.lower("metric_key").alias("key"), "scope").join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(F.collect_set("scope").alias("scopes"))
    left = rules.join(done, "rule_id", "left_anti").join(tried, "rule_id", "left").join(emitted, F.lower("metric_key") == F.col("key"), "left")
    reason = (
        F.when(~F.col("enabled"), "disabled by policy")
        .when(F.col("unsupported").isNotNull(), F.concat(F.lit("unsupported: "), F.col("unsupported")))
        .when(F.col("insufficient"), "insufficient evidence")
        .when(F.array_contains("scopes", F.col("scope")), "no valid comparison")
        .when(F.col("scopes").isNotNull(), "metric at another scope only")
        .otherwise("metric not emitted")
    )
    return left.select("rule_id", "metric_key", reason.alias("reason"))


def no_candidate_gate(summaries: DataFrame, expected: int) -> DataFrame:
    """Per rule: not applicable if complete summaries of every scope agree on zero candidates."""
    found = summaries.groupBy("rule_id").agg(F.bool_and("complete").alias("complete"), F.countDistinct("scope_id").alias("scopes"), F.count(F.lit(1)).alias("n_rows"), F.sum("candidates").alias("candidates"))
    gate = F.col("complete") & (F.col("scopes") == F.col("n_rows")) & (F.col("scopes") == expected) & (F.col("candidates") == 0)
    return found.withColumn("verdict", F.when(gate, "NotApplicable").otherwise("Applicable"))


def registry_errors(rules: DataFrame, ops: list[str], scopes: list[str], severities: list[str]) -> DataFrame:
    """One row per defect of the catalogue; none for a sound one."""
    n = rules.groupBy(F.lower("rule_id").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    checks = F.array(
        F.when(F.col("rule_id").isNull() | (F.trim("rule_id") == ""), "blank id"),
        F.when(F.col("copies") > 1, "duplicate id"),
        F.when(~F.col("op").isin(ops), "unknown operator"),
        F.when(~F.col("scope").isin(scopes), "unknown scope"),
        F.when(~F.col("severity").isin(severities), "unknown severity"),
        F.when(~finite(F.col("threshold")), "threshold is not finite"),
    )
    found = rules.join(n, F.lower("rule_id") == F.col("key"), "left").select("rule_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("defect"))
    return found.groupBy("rule_id", "defect").agg(F.count(F.lit(1)).alias("n"))


def registry_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Ids on one side only."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))
