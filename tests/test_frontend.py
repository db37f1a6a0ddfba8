"""Components, hooks and scores of syntax trees, and the applicability of front-end rules, against values worked out by hand."""

import json

import pytest
from govlens import rulebook
from govlens.operators import frontend
from pyspark.sql import functions as F


def node(kind, *children, **more):
    return {"kind": kind, **more, "children": list(children)}


HOOK = node("CallExpression", name="useState")
TREES = [
    ("a.tsx", node("SourceFile", node("FunctionDeclaration", HOOK, node("IfStatement", HOOK, node("ArrowFunction", node("LogicalExpression", HOOK))), node("JsxElement", node("JsxSelfClosingElement")), name="View", typed=True), node("FunctionDeclaration", HOOK, name="helper"))),
    ("b.tsx", node("SourceFile", node("ArrowFunction", node("FunctionExpression", HOOK, name="Inner", typed=False), *[node("CaseClause")] * 12, name="Outer", typed="yes"))),
    ("c.ts", node("SourceFile", node("ClassDeclaration", name="C", typed=True, selector="app-card"), node("ClassDeclaration", name="D", typed=False, selector="[appTip]"), node("ClassDeclaration", name="E", typed=False, selector="card"))),
    ("d.ts", node("SourceFile", node("ClassDeclaration", name="F", selector="a > b"), {"kind": 7, "children": [HOOK]}, 5, None)),
]


@pytest.fixture(scope="module")
def found(spark):
    deep = '{"kind":"IfStatement","children":[' * 400 + "]}" * 400
    rows = [(p, json.dumps(t), 1) for p, t in TREES] + [("bad.ts", "{", 2), ("none.ts", None, 3), ("list.ts", "[1]", 4), ("deep.ts", deep, 5), ("deeper.ts", "[" * 200_000, 6)]
    return frontend.components(frontend.syntax_nodes(spark.createDataFrame(rows, "path string, text string, depth int"))).cache()


def test_components_by_hand(found):
    rows = {(r.path, r.name): (r.typed, r.complexity, r.hooks, r.misused, r.elements) for r in found.collect()}
    assert rows == {
        ("a.tsx", "View"): (True, 3, 3, 2, 2), ("b.tsx", "Outer"): (None, 13, 0, 0, 0), ("b.tsx", "Inner"): (False, 1, 1, 0, 0), ("c.ts", "C"): (True, 1, 0, 0, 0), ("c.ts", "D"): (False, 1, 0, 0, 0), ("c.ts", "E"): (False, 1, 0, 0, 0), ("d.ts", "F"): (None, 1, 0, 0, 0),
    }


def test_scores_are_withheld_without_whole_evidence(found):
    rows = {r.path: tuple(r)[1:] for r in frontend.frontend_scores(found, ["app"]).collect()}
    assert rows == {
        "a.tsx": (1, 3, 33.0, 100.0, 80.0, None), "b.tsx": (2, 1, 100.0, None, 0.0, None), "c.ts": (3, 0, None, 33.0, 100.0, 66.67), "d.ts": (1, 0, None, None, 100.0, None),
    }
    assert {r.path: r.selector_score for r in frontend.frontend_scores(found, []).collect()}["c.ts"] is None


@pytest.mark.parametrize(
    "families, complete, rule, verdict",
    [
        ([], True, "FRONT-R3", "NotApplicable"), ([], False, "FRONT-R3", "Unknown"), (["React"], True, "FRONT-R3", "Applicable"), (["React"], True, "FRONT-R1", "NotApplicable"), (["React"], False, "FRONT-R1", "Unknown"),
        (["Razor"], True, "FRONT-R11", "Applicable"), (["Angular"], True, "FRONT-R11", "NotApplicable"), (["Angular", "Blazor"], True, "FRONT-R8", "Applicable"), ([], True, "ARCH-R1", "Applicable"),
    ],
)
def test_rules_apply_unless_a_complete_discovery_says_no(spark, families, complete, rule, verdict):
    row = spark.createDataFrame([(families, complete)], "families array<string>, complete boolean")
    assert row.select(frontend.applicability(F.col("families"), F.col("complete"), F.lit(rule))).first()[0] == verdict


def test_every_front_end_rule_is_asked(spark):
    projects = spark.createDataFrame([(1, ["React", "Angular"], True)], "project long, families array<string>, complete boolean")
    rows = frontend.applicable_rules(projects, rulebook.architecture_rules(spark)).collect()
    assert {r.rule_id: (r.verdict, r.reason) for r in rows if r.rule_id in ("FRONT-R1", "FRONT-R8")} == {"FRONT-R1": ("Applicable", None), "FRONT-R8": ("NotApplicable", "found only Angular, React")} and len(rows) == 11
