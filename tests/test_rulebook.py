"""The rule book over single facts, with the results that its cases are specified to have."""

import re

import pytest
from govlens import rulebook
from govlens.catalog import SEVERITIES
from govlens.operators import contracts, profiles, security
from pyspark.sql import functions as F

BASE = dict(source="ComplexityEvaluator", target="t", category="Metrics", project="p", file="src/a.cs", line=18, evidence=None)
METRIC = "EstimatedCyclomaticComplexity"


def fact(metrics, metadata=None, **changed):
    row = BASE | changed
    return (1, *(row[c] for c in ("source", "target", "category", "project", "file", "line", "evidence")), metrics, metadata or {})


def statuses(spark, *facts, overrides=None):
    rules = rulebook.architecture_rules(spark)
    for rule, threshold in (overrides or {}).items():
        rules = rules.withColumn("threshold", F.when(F.col("rule_id") == rule, F.lit(threshold)).otherwise(F.col("threshold")))
    return contracts.evaluate(spark.createDataFrame(list(facts), contracts.FACT_SCHEMA), rules)


def one(spark, f, **more):
    return [(r.rule_id, r.status) for r in statuses(spark, f, **more).collect()]


@pytest.mark.parametrize(
    "metrics,metadata,changed,expected",
    [
        ({METRIC: 9.0}, {}, {}, "Passed"),
        ({METRIC: 11.0}, {}, {}, "InsufficientEvidence"),
        ({METRIC: 11.0}, {}, {"evidence": "if (a)"}, "Violated"),
        ({METRIC: 11.0}, {}, {"evidence": "if (a)", "line": None}, "InsufficientEvidence"),
        ({METRIC: 11.0}, {}, {"evidence": "if (a)", "file": " "}, "InsufficientEvidence"),
        ({METRIC: 11.0}, {"FilePath": "b.cs"}, {"evidence": "if (a)", "file": None}, "Violated"),
        ({METRIC: 11.0, "Other": 1.0}, {}, {"evidence": "if (a)"}, "InsufficientEvidence"),
        ({METRIC: 11.0, "Other": 1.0}, {f"Evidence.{METRIC}": "x", f"EvidenceLine.{METRIC}": "7"}, {}, "Violated"),
        ({METRIC: 11.0, "Other": 1.0}, {f"Evidence.{METRIC}": "x", f"EvidenceLine.{METRIC}": "none"}, {}, "InsufficientEvidence"),
        ({METRIC: 11.0, "Other": 1.0}, {f"CodeSnippet.{METRIC}": "x", f"EvidenceScope.{METRIC}": "filemetrics"}, {"line": None}, "Violated"),
        ({METRIC: 9.0}, {"AnalysisComplete": "FALSE"}, {}, "InsufficientEvidence"),
        ({METRIC: 11.0}, {"AnalysisStatus": "partial"}, {"evidence": "x"}, "InsufficientEvidence"),
        ({METRIC: float("nan")}, {}, {}, "Skipped"),
        ({METRIC: float("inf")}, {}, {"evidence": "x"}, "Skipped"),
        ({METRIC.lower(): 9.0}, {}, {}, "Passed"),
        ({METRIC.lower(): 9.0, METRIC.upper(): 9.0}, {}, {}, None),
        ({METRIC: 9.0, METRIC.upper(): 99.0}, {}, {}, "Passed"),
        ({METRIC: 9.0}, {"EvaluationScope": "Project"}, {}, None),
        ({METRIC: 9.0}, {"EvaluationScope": "file"}, {"category": "ArchitectureSummary"}, "Passed"),
        ({METRIC: 9.0}, {}, {"category": "architecturesummary"}, None),
        ({METRIC: 9.0}, {}, {"source": "OtherEvaluator"}, None),
        ({}, {}, {}, None),
    ],
)
def test_one_fact(spark, metrics, metadata, changed, expected):
    assert one(spark, fact(metrics, metadata, **changed)) == ([("BACK-R2", expected)] if expected else [])


def test_overridden_and_invalid_thresholds(spark):
    assert one(spark, fact({METRIC: 11.0}), overrides={"BACK-R2": 12.0}) == [("BACK-R2", "Passed")]
    assert one(spark, fact({METRIC: 11.0}), overrides={"BACK-R2": float("nan")}) == [("BACK-R2", "Skipped")]


def test_units(spark):
    god = dict(source="GodClassEvaluator", evidence="class", line=3)
    unit = {"MetricUnit.GodClassSeverity": "MinimumOfLineAndMethodLimitRatios"}
    assert one(spark, fact({"GodClassSeverity": 1.5}, unit, **god)) == [("DES-GOD001", "Violated")]
    assert one(spark, fact({"GodClassSeverity": 1.5}, {}, **god)) == [("DES-GOD001", "Skipped")]
    assert one(spark, fact({"GodClassSeverity": -1.0}, unit, **god)) == [("DES-GOD001", "Skipped")]
    assert one(spark, fact({"GodClassSeverity": 1.5}, unit, **god), overrides={"DES-GOD001": 0.5}) == [("DES-GOD001", "Skipped")]
    surface = fact({"PublicSurfaceRatio": 1.2}, {"MetricUnit.PublicSurfaceRatio": "RatioOfConfiguredMaximum"}, source="FacadePatternEvaluator", evidence="x")
    assert one(spark, surface) == [("DES-FAC002", "Violated")] and one(spark, surface, overrides={"DES-FAC002": 1.1}) == [("DES-FAC002", "Skipped")]


def test_findings_keep_metric_evidence(spark):
    meta = {f"Evidence.{METRIC}": " if (a)\n\n for (b) ", f"EvidenceLine.{METRIC}": "18", f"CodeSnippet.{METRIC}": "if", "Namespace": "N"}
    found = contracts.findings(statuses(spark, fact({METRIC: 12.345, "Other": 0.0}, meta, evidence="other", line=1))).first()
    assert (found.file, found.line, found.snippet, found.evidence, found.namespace) == ("src/a.cs", 18, "if", ["if (a)", "for (b)"], "N")
    assert found.message == f"[ComplexityEvaluator] Metric '{METRIC}' = 12.35, threshold = 10." and found.severity == "Medium"
    project = fact({"DependencyGraphDensity": 0.7}, {"EvaluationScope": "Project"}, source="dependencygraphevaluator", evidence="e")
    found = contracts.findings(statuses(spark, project)).first()
    assert (found.file, found.line, found.target, found.rule_id) == ("", None, "p", "BACK-R3")


def test_the_books(spark):
    rules = rulebook.ARCHITECTURE_RULES
    assert (len(rules), sum(r[8] is not None for r in rules), sum(r[9] for r in rules)) == (76, 48, 21)
    assert len({r[0] for r in rules}) == 76 and {r[7] for r in rules} <= set(SEVERITIES) and {r[5] for r in rules} == {"<", ">"}
    assert len(rulebook.SECURITY_RULES) == 42 and all(re.compile(r[4]) for r in rulebook.SECURITY_RULES)
    assert {r[0] for r in rules if r[0].startswith("FRONT")} == {x for ids in rulebook.FRONTENDS.values() for x in ids}
    scores = {r.rule_id: r.score for r in rulebook.security_rules(spark).collect()}
    assert scores["SEC-APP-001"] == 9.5 and scores["SEC-APP-002"] == 7.95 and len(scores) == 42
    assert [r.rule_id for r in rulebook.architecture_rules(spark, "X-").limit(1).collect()] == ["X-ARCH-R1"]


def profile(spark, *modules):
    schema = "repo int, module string, kind string, role string, frameworks array<string>, dependencies array<string>, layer string"
    return profiles.repository_profile(spark.createDataFrame([(1, str(i), *m) for i, m in enumerate(modules)], schema)).first()


def test_profiles(spark):
    web, library, front = ("WebApplication", "production", [], [], None), ("ClassLibrary", "production", [], [], None), ("FrontendApplication", "production", [], [], None)
    assert (profile(spark, web, library).domain, profile(spark, web, library).style) == ("Backend", "Modular Monolith")
    assert (profile(spark, web, front).domain, profile(spark, web, front).style) == ("FullStack", "Multi-Project Full-Stack")
    assert profile(spark, library, library).style == "Multi-Project Library" and profile(spark, library).nature == "Library"
    assert profile(spark, ("Executable", "production", [], ["RabbitMQ.Client"], None)).style == "Message-Driven Application"
    both = profile(spark, ("WebApplication", "production", ["ASP.NET Core"], ["MediatR", "Microsoft.EntityFrameworkCore"], "Domain"))
    assert (both.style, both.preset, both.nature) == ("CQRS", "clean", "Service")
    assert both.patterns == ["ASP.NET Web Architecture", "CQRS", "Repository Pattern", "Domain Driven Design"]
    assert (profile(spark, ("Test", "test", [], [], None)).domain, profile(spark, ("Unknown", "production", ["Unity"], [], None)).domain) == ("Test", "Game")
    files = spark.createDataFrame([(1, "a/Dockerfile"), (1, "a/Startup.cs"), (1, "b/Program.cs"), (2, "k/service.yaml"), (2, "x/main.py"), (3, "y")], "repo int, path string")
    found = {r.repo: (r.containerized, r.clustered, r.entry_point) for r in profiles.deployability(files).collect()}
    assert found == {1: (True, False, "b/Program.cs"), 2: (False, True, "x/main.py"), 3: (False, False, None)}


def test_signals_with_nulls(spark):
    hosts = spark.createDataFrame([("a", "Windows 7", None, None, None), ("b", None, True, True, True)], "host string, os_version string, firewall boolean, smb1 boolean, guest boolean")
    assert {(r.host, r.finding) for r in security.hardening_findings(hosts).collect()} == {("a", "end of life"), ("a", "firewall off"), ("b", "old file sharing"), ("b", "guest account")}
    rows = spark.createDataFrame([("d", None, None), ("d", " \nx", {}), ("d", "a\nsee line 4", {"target": " "}), ("d", "a\nline", {"target": "t"})], "detector string, evidence string, metadata map<string,string>")
    assert [(r.target, r.location) for r in security.target_of(rows).collect()] == [("d", None), ("d", None), ("a", "see line 4"), ("t", None)]
