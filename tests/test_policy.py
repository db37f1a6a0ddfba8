"""Policy documents, their composition and what they switch, and the health of reports, against values worked out by hand."""

import json

import pytest
from govlens import rulebook
from govlens.operators import policy, reports

BODY = {"Architecture": {"DesignPatterns": {"EnforceCommandPattern": True}}}


@pytest.mark.parametrize(
    "text, status, settings",
    [
        (json.dumps({"Policy": BODY}), "read", {"architecture:designpatterns:enforcecommandpattern": "true"}), (json.dumps({"architecturePolicy": BODY}), "read", {"architecture:designpatterns:enforcecommandpattern": "true"}),
        (json.dumps(BODY), "read", {"architecture:designpatterns:enforcecommandpattern": "true"}), ('{"Policy": {}, "ArchitecturePolicy": {}}', "two wrappers", {}), ('{"Policy": 1}', "empty wrapper", {}), ("[]", "no object", {}), ("", "not JSON", {}),
        (None, "not JSON", {}), ('{"a": "http://x, }", /* c */ "b": [1, "y",], // d\n "c": null, "n": 1.5,}', "read", {"a": "http://x, }", "b:0": "1", "b:1": "y", "c": None, "n": "1.5"}), ('{"A": 1, "a": 2}', "read", {"a": "2"}), ("{}", "read", {}),
    ],
)
def test_documents_are_read_leniently_or_refused(text, status, settings):
    assert policy.read_policy(text) == (status, list(settings.items()))


def test_a_vendor_may_stand_before_a_wrapper():
    assert policy.read_policy(json.dumps({"AcmePolicy": BODY}), "Acme")[1] == [("architecture:designpatterns:enforcecommandpattern", "true")]
    assert policy.read_policy(json.dumps({"AcmePolicy": {}, "Policy": {}}), "acme")[0] == "two wrappers"


DOCS = [
    ("s", "base.json", 0, '{"EnforceLayerBoundaries": true, "Naming": {"Enabled": true, "Max": 5}, "Allowed": {"Api": ["App", "Kit"]}, "DesignPatterns": {"EnforceBuilderPattern": true, "SuggestImmutability": false}}'),
    ("s", "team.json", 1, '{"Naming": {"Enabled": false}, "allowed": {"api": ["Core"]}}'), ("s", "broken.json", 2, "{"), ("s", "late.json", 1, '{"Architecture": {"EnforceLayerBoundaries": "False"}}'), ("t", "only.json", 0, '{"Security": {"Enabled": null}}'), ("u", "bad.json", 0, "[]"),
]


def test_documents_compose_by_precedence(spark):
    read = policy.policy_documents(spark.createDataFrame(DOCS, "scope string, path string, rank int, text string"))
    assert {(r.path, r.status) for r in read.collect()} == {("base.json", "read"), ("team.json", "read"), ("broken.json", "not JSON"), ("late.json", "read"), ("only.json", "read"), ("bad.json", "no object")}
    found = {(r.scope, r.key): (r.value, r.path) for r in policy.composed(read).collect()}
    assert found["s", "naming:enabled"] == ("false", "team.json") and found["s", "naming:max"] == ("5", "base.json") and found["s", "allowed:api:0"] == ("Core", "team.json") and found["s", "allowed:api:1"] == ("Kit", "base.json")
    assert found["s", "architecture:enforcelayerboundaries"] == ("False", "late.json") and found["s", "enforcelayerboundaries"] == ("true", "base.json") and found["s", "architecture:designpatterns:enforcebuilderpattern"] == ("true", "base.json")
    assert found["t", "security:enabled"] == (None, "only.json") and not [k for k in found if k[0] == "u"]
    rules = policy.enabled_rules(rulebook.architecture_rules(spark), policy.composed(read))
    rows = {(r.scope, r.rule_id): (r.enabled, r.missing) for r in rules.collect()}
    assert rows["s", "NAM-R1"] == (False, "naming:enabled") and rows["s", "ARCH-R2"] == (False, "architecture:enforcelayerboundaries") and rows["s", "DES-BLD001"] == (True, None) and rows["s", "DES-BLD002"] == (False, "architecture:designpatterns:suggestimmutability")
    assert rows["t", "ARCH-R10"] == (True, None) and rows["t", "NAM-R1"] == (True, None) and len(rows) == 2 * len(rulebook.ARCHITECTURE_RULES)


EVALUATIONS = [(1, "A", "Passed"), (1, "A", "Violated"), (1, "A", "Passed"), (1, "B", "Passed"), (1, "C", "NotEvaluated"), (2, "A", "Error"), (3, "A", "Passed"), (4, "A", "Passed"), (4, "B", "Unsupported"), (5, "A", "Violated")]
DOMAINS = [(3, "x", 0.5, 3), (3, "y", 1.0, 1), (3, "z", 0.0, 0), (1, "x", 1.0, 0), (9, "x", 1.0, 5)]


def test_health_falls_back_and_says_whether_it_is_whole(spark):
    found = reports.report_compliance(spark.createDataFrame(EVALUATIONS, "report long, category string, status string"))
    rows = {(r.report, r.category): (r.score, r.passed, r.completed) for r in found.collect()}
    assert rows == {
        (1, "A"): (66.67, 2, 3), (1, "B"): (100.0, 1, 1), (1, None): (75.0, 3, 4), (2, None): (None, 0, 0), (3, "A"): (100.0, 1, 1), (3, None): (100.0, 1, 1), (4, "A"): (100.0, 1, 1), (4, None): (100.0, 1, 1), (5, "A"): (0.0, 0, 1), (5, None): (0.0, 0, 1),
    }
    health = {r.report: tuple(r)[1:] for r in reports.report_health(found, spark.createDataFrame(DOMAINS, "report long, domain string, health double, checks long")).collect()}
    assert health == {
        1: (83.34, True, 80.0, 66.67, "categories", False), 2: (0.0, False, 0.0, 0.0, "none", False), 3: (62.5, True, 100.0, 62.5, "domains", True), 4: (100.0, True, 100.0, 100.0, "categories", False), 5: (0.0, True, 100.0, 0.0, "categories", True),
    }
