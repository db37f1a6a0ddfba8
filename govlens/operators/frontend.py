"""Front-end code from ingested syntax trees: components, hooks and how complex they are, and which rules a project is asked."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens import rulebook
from govlens.functions.expr import half_even

# Kinds of nodes that branch, that open a function or class, and that a component's markup is made of.
BRANCHES = ("IfStatement", "ConditionalExpression", "ForStatement", "ForOfStatement", "WhileStatement", "CaseClause", "CatchClause", "LogicalExpression")
OPENS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunction", "ClassDeclaration")
MARKUP = ("JsxElement", "JsxSelfClosingElement")
SELECTOR = r"^([a-z][a-z0-9]*(-[a-z0-9]+)*|\[[A-Za-z][A-Za-z0-9]*\])$"

_NODE = "path string, place string, parent string, depth int, kind string, name string, component string, branched boolean, typed boolean, selector string"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _descend(path: str, text: str) -> Iterator[tuple]:
    """The nodes of one tree, parents first. A node is a JSON object with a kind, and perhaps children, a name, typed, a selector."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return
    todo = [(root, "0", None, 0, None, False)]
    while todo:
        node, place, parent, depth, component, branched = todo.pop()
        if not isinstance(node, dict) or not isinstance(node.get("kind"), str):
            continue
        kind, name, typed, selector = node["kind"], node.get("name"), node.get("typed"), node.get("selector")
        name = name if isinstance(name, str) else None
        if kind in OPENS and name and name[0].isupper():
            component, branched = place, False
        yield path, place, parent, depth, kind, name, component, branched, typed if isinstance(typed, bool) else None, selector if isinstance(selector, str) else None
        below = node.get("children")
        for i, child in reversed(list(enumerate(below if isinstance(below, list) else []))):
            todo.append((child, f"{place}.{i}", place, depth + 1, component, branched or kind in BRANCHES))


def syntax_nodes(trees: DataFrame) -> DataFrame:
    """(path, place, parent, depth, kind, name, component, branched, typed, selector) of all nodes of trees (path, text).

    component is the place of the nearest named component at or above a node, branched says that a branch lies between the two. What
    isn't an object with a kind is left out with all below it; text that is no JSON has no nodes.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"depth": pa.int32(), "branched": pa.bool_(), "typed": pa.bool_()}.get(n, pa.string())) for n in _NAMES])
        rows: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                for row in _descend(path, text or ""):
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return trees.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(nodes, _NODE)


def components(nodes: DataFrame) -> DataFrame:
    """(path, component, name, typed, selector, complexity, hooks, misused, elements) of each component.

    complexity counts its branches and one; a hook is a call of a name like useState, misused inside a branch.
    """
    hook = (F.col("kind") == "CallExpression") & F.col("name").rlike("^use[A-Z]")
    own = F.col("component") == F.col("place")
    first = lambda c: F.max(F.when(own, F.col(c)))
    return nodes.where("component is not null").groupBy("path", "component").agg(
        first("name").alias("name"), first("typed").alias("typed"), first("selector").alias("selector"), (F.count_if(F.col("kind").isin(*BRANCHES)) + 1).alias("complexity"),
        F.count_if(hook).alias("hooks"), F.count_if(hook & F.col("branched")).alias("misused"), F.count_if(F.col("kind").isin(*MARKUP)).alias("elements"),
    )


def frontend_scores(found: DataFrame, prefixes: list[str]) -> DataFrame:
    """(path, components, hooks, hook_discipline, typing, complexity, selectors) of each file with a component.

    A score is null where its evidence is missing or not whole: no hooks; a component whose typing isn't known; no selector, or one that
    is more than a name or an attribute. Hook discipline and typing are rounded half up, selectors half to even at two places; the most
    complex component decides.
    """
    share = lambda ok, of: F.when(of > 0, F.round(ok * 100.0 / of, 0))
    named = "^(" + "|".join(f"{p}-[a-z][a-z0-9]*(-[a-z0-9]+)*|\\[{p}[A-Z][A-Za-z0-9]*\\]" for p in prefixes) + ")$"
    selector = F.when(F.trim("selector") != "", F.col("selector"))
    counts = found.withColumn("selector", selector).groupBy("path").agg(
        F.count(F.lit(1)).alias("components"), F.sum("hooks").alias("hooks"), F.sum("misused").alias("misused"), F.count("typed").alias("known"), F.count_if("typed").alias("typed"), F.max("complexity").alias("most"),
        F.count("selector").alias("selectors"), F.count_if(F.col("selector").rlike(SELECTOR)).alias("simple"), F.count_if(F.col("selector").rlike(named)).alias("fitting"),
    )
    return counts.select(
        "path", "components", "hooks", share(F.col("hooks") - F.col("misused"), F.col("hooks")).alias("hook_discipline"), F.when(F.col("known") == F.col("components"), share(F.col("typed"), F.col("components"))).alias("typing"),
        F.greatest(F.lit(0), 100 - 10 * (F.col("most") - 1)).cast("double").alias("complexity"),
        F.when((F.col("selectors") > 0) & (F.col("simple") == F.col("selectors")) & F.lit(bool(prefixes)), half_even(F.col("fitting") * 100.0 / F.col("selectors"))).alias("selector_score"),
    )


def applicability(families: Column, complete: Column, rule_id: Column) -> Column:
    """Applicable, NotApplicable or Unknown: whether a front-end rule is asked of a project with these families.

    Only a complete discovery proves that a family isn't there. Rules that aren't for a front end are always applicable.
    """
    target = F.coalesce(*(F.when(rule_id.isin(*ids), family) for family, ids in rulebook.FRONTENDS.items()))
    there = F.when(target == "any", F.arrays_overlap(families, F.array(F.lit("React"), F.lit("Razor")))).otherwise(F.array_contains(families, target))
    return F.when(target.isNull() | there, "Applicable").when(complete, "NotApplicable").otherwise("Unknown")


def applicable_rules(projects: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, rule_id, verdict, reason) of projects (project, families, complete) for each front-end rule.

    The rules are a book of a few rows, sent to every task, so a project has as many rows as the book has front-end rules.
    """
    ids = [x for ids in rulebook.FRONTENDS.values() for x in ids]
    asked = projects.withColumn("rule_id", F.explode(F.array(*map(F.lit, ids)))).join(F.broadcast(rules.select("rule_id")), "rule_id", "left_semi")
    verdict = applicability(F.col("families"), F.col("complete"), F.col("rule_id"))
    reason = F.when(F.col("verdict") == "NotApplicable", F.when(F.size("families") == 0, "no front end found").otherwise(F.concat(F.lit("found only "), F.array_join(F.array_sort("families"), ", ")))).when(F.col("verdict") == "Unknown", "discovery incomplete")
    return asked.withColumn("verdict", verdict).select("project", "rule_id", "verdict", reason.alias("reason"))
