"""Hand-computed cases of the rule engine and the scores."""

import math

import pytest
from govlens.functions import expr
from govlens.operators import rules, scores
from pyspark.sql import functions as F

RULE = "rule_id string, name string, category string, scope string, metric_key string, op string, threshold double, severity string, enabled boolean, unsupported string"
FACT = "project long, file long, domain string, scope string, has_evidence boolean, incomplete boolean, metric_key string, metric_value double"


def rule(spark, *rows):
    return spark.createDataFrame([(i, "n", c, s, m, op, t, sev, True, None) for i, c, s, m, op, t, sev in rows], RULE)


def fact(spark, *rows):
    return spark.createDataFrame([(1, 1, d, s, e, i, m, v) for d, s, e, i, m, v in rows], FACT)


@pytest.mark.parametrize("op,value,threshold,expected", [(">", 1.0, 2.0, False), (">", 3.0, 2.0, True), (">=", 1.0, 1.0, True), ("<", 0.4, 0.5, True), ("<=", 0.5, 0.5, True), ("=", 1.0, 1.00005, True), ("=", 1.0, 1.001, False), ("!=", 1.0, 1.001, True), ("?", 1.0, 1.0, None)])
def test_thresholds(spark, op, value, threshold, expected):
    assert spark.range(1).select(expr.breaches(F.lit(op), F.lit(value), F.lit(threshold))).first()[0] is expected


def test_rounding_and_weights(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    assert [row(expr.half_even(F.lit(x))) for x in (0.125, 0.575, 1.005, 2.345)] == [round(x * 100) / 100 for x in (0.125, 0.575, 1.005, 2.345)]
    assert [row(expr.weight(F.lit(s), F.lit("x"))) for s in ("Critical", "High", "Medium", "Low", "Info", "Blocker")] == [1.5, 1.25, 1.0, 0.75, 0.5, 1.0]
    assert row(expr.weight(F.lit("Info"), F.lit("PERFORMANCE"), {"performance": 0.05})) == 0.0
    assert [row(expr.score(F.lit(v), F.lit(c))) for v, c in ((0.0, 0.0), (0.0, 10.0), (5.0, 10.0), (10.0, 10.0), (20.0, 10.0))] == [1.0, 1.0, 0.5, 0.0, 0.0]
    assert [row(expr.finite(F.lit(x))) for x in (1.0, math.nan, math.inf, -math.inf)] == [True, False, False, False]
    assert [row(expr.domain_label(F.lit(x))) for x in (None, "  ", " Core ")] == ["unclassified", "unclassified", "core"]


def test_statuses(spark):
    r = rule(spark, ("R", "Security", "File", "M", ">", 0.0, "High"), ("P", "Security", "Project", "M", ">", 0.0, "High"), ("N", "Security", "File", "M", ">", math.nan, "High"))
    f = fact(spark, ("d", "File", True, False, "m", 0.0), ("d", "File", True, False, "M", 2.0), ("d", "File", False, False, "M", 2.0), ("d", "File", True, True, "M", 0.0), ("d", "File", True, False, "M", math.nan), ("d", "File", True, False, "M", math.inf), ("d", "File", True, False, "x", 9.0))
    found = rules.evaluate(f, r)
    assert sorted(x.status for x in found.where("rule_id = 'R'").collect()) == ["InsufficientEvidence"] * 2 + ["Passed", "Skipped", "Skipped", "Violated"]
    assert {x.status for x in found.where("rule_id = 'N'").collect()} == {"Skipped"} and not found.where("rule_id = 'P'").count()
    assert {(x.rule_id, x.reason) for x in rules.not_evaluated(found, r, f).collect()} == {("P", "metric at another scope only"), ("N", "no valid comparison")}
    stats = rules.status_stats(found, r).first()
    assert (stats.passed, stats.violated, stats.rules_evaluated, stats.coverage_pct) == (1, 1, 1, 33.33)
    assert rules.check_buckets(found).first().checks == 2


def test_overrides_and_ambiguous_keys(spark):
    r = rule(spark, ("R", "c", "File", "M", ">", 1.0, "Low"), ("S", "c", "File", "M", ">", 1.0, "Low"), ("T", "c", "File", "N", ">", 1.0, "Low"))
    o = spark.createDataFrame([("rule", "r", 3.0), ("metric", "m", 2.0)], "kind string, name string, value double")
    assert {x.rule_id: (x.threshold, x.origin) for x in rules.effective_thresholds(r, o).collect()} == {"R": (3.0, "rule"), "S": (2.0, "metric"), "T": (1.0, "default")}
    f = spark.createDataFrame([(1, "A", 1.0), (1, "a", 2.0), (1, "Cc", 3.0), (1, "cC", 4.0), (1, "D", 5.0)], "fact long, metric_key string, metric_value double")
    found = {x.name: (x.resolved, x.metric_value) for x in rules.resolved_metrics(f, ["A", "CC"]).collect()}
    assert found == {"a": (True, 1.0), "cc": (False, None), "d": (True, 5.0)}


def test_domain_and_global_scores(spark):
    r = rule(spark, ("R", "Security", "File", "M", ">", 0.0, "Medium"))
    found = rules.evaluate(fact(spark, ("d", "File", True, False, "M", 0.0), ("d", "File", True, False, "M", 2.0)), r)
    domains = scores.domain_scores(found, spark.createDataFrame([("idle",)], "domain string"))
    rows = {x.domain: x for x in domains.collect()}
    assert (rows["d"].weighted_score, rows["d"].health, rows["d"].assessed, rows["idle"].health, rows["idle"].assessed) == (0.5, 0.5, True, 0.0, False)
    total = scores.global_metrics(domains).first()
    assert (total.project_health, total.resilience, total.checks) == (50.0, 1.0, 2)
    assert scores.category_scores(found).first().compliance == 50.0
    two = spark.createDataFrame([("a", 1, 0.2, True), ("b", 9, 0.8, True)], "domain string, checks long, health double, assessed boolean").withColumn("pass_rate", F.col("health")).withColumn("weighted_score", F.col("health"))
    assert scores.global_metrics(two).first().project_health == 74.0
    assert scores.global_metrics(two.where("false")).first().project_health is None


def test_summaries(spark):
    rows = spark.createDataFrame([("c", "d", "High", 3, 1, "r"), ("c", "d", "Low", 1, 1, "r"), ("c", "e", "Info", 0, 2, "q")], "category string, domain string, severity string, ordinal int, file long, rule_id string")
    found = {(x.category, x.domain): (x.total_files, x.violations, x.health) for x in scores.layer_summary(rows).collect()}
    assert found == {("c", "d"): (1, 2, 90), ("c", "e"): (1, 1, 100)}
    assert scores.severity_histogram(rows, "domain", ["High", "Critical"]).where("domain = 'e'").first().high == 0
    assert scores.dashboard(rows).count() == 6
    gate = spark.createDataFrame([("x", True, 1, 0), ("x", True, 2, 0), ("y", True, 1, 0), ("y", False, 2, 0)], "rule_id string, complete boolean, scope_id int, candidates int")
    assert {x.rule_id: x.verdict for x in rules.no_candidate_gate(gate, 2).collect()} == {"x": "NotApplicable", "y": "Applicable"}
