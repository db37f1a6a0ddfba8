"""Front-end queries: syntax trees written from orders, and which rules customers' projects are asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import rulebook
from govlens.operators import frontend
from govlens.plans.registry import query
from govlens.sources import tables

_FIRST = "concat('{\"kind\":\"FunctionDeclaration\",\"name\":\"', CASE WHEN o_orderkey % 9 = 0 THEN 'helper' ELSE concat('View', CAST(o_custkey AS STRING)) END, '\",\"typed\":', CASE o_orderkey % 7 WHEN 0 THEN 'false' WHEN 1 THEN '\"no\"' ELSE 'true' END, ',\"children\":[')"
_NEST = "repeat('{\"kind\":\"IfStatement\",\"children\":[{\"kind\":\"CallExpression\",\"name\":\"useState\"},', CAST(o_custkey % 5 AS INT)), '{\"kind\":\"JsxElement\",\"children\":[{\"kind\":\"JsxSelfClosingElement\"},7]}', repeat(']}', CAST(o_custkey % 5 AS INT))"
_CALLS = "repeat(',{\"kind\":\"CallExpression\",\"name\":\"useMemo\"}', CAST(o_orderkey % 4 AS INT)), ',{\"kind\":\"ArrowFunction\",\"children\":[{\"kind\":\"LogicalExpression\",\"children\":[{\"kind\":\"CallExpression\",\"name\":\"user\"}]}]}'"
_SECOND = "',{\"kind\":\"ClassDeclaration\",\"name\":\"Part\",\"typed\":true,\"selector\":\"', CASE o_orderkey % 5 WHEN 0 THEN 'app-part' WHEN 1 THEN '[appPart]' WHEN 2 THEN 'part' WHEN 3 THEN 'a b' ELSE '' END, '\",\"children\":[{\"kind\":\"CaseClause\"},{\"kind\":\"CaseClause\"}]}'"
_TREE = f"concat('{{\"kind\":\"SourceFile\",\"children\":[', {_FIRST}, {_NEST}, {_CALLS}, ']}}', {_SECOND}, ']', CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE '}}' END)"
_ROWS = f"CAST(o_orderkey AS STRING) AS path, {_TREE} AS text"
_SQL = f"""WITH RECURSIVE trees AS (SELECT {_ROWS} FROM orders),
nodes(path, node, place, parent, depth, component, branched) AS (
 SELECT path, CAST(text AS JSON), '0', CAST(NULL AS VARCHAR), 0, CAST(NULL AS VARCHAR), false FROM trees WHERE json_valid(text)
 UNION ALL
 SELECT path, child, place || '.' || i, place, depth + 1, CASE WHEN opens THEN place || '.' || i ELSE component END, CASE WHEN opens THEN false ELSE branched OR kind IN {frontend.BRANCHES} END FROM (
  SELECT *, child ->> '$.kind' IN {frontend.OPENS} AND regexp_matches(coalesce(child ->> '$.name', ''), '^[A-Z]') AS opens FROM (
   SELECT path, place, depth, component, branched, node ->> '$.kind' AS kind, unnest(CAST(node -> '$.children' AS JSON[])) AS child, unnest(generate_series(0, len(CAST(node -> '$.children' AS JSON[])) - 1)) AS i FROM nodes WHERE json_type(node -> '$.children') = 'ARRAY'))
  WHERE json_type(child) = 'OBJECT'),
flat AS (SELECT path, place, parent, depth, node ->> '$.kind' AS kind, node ->> '$.name' AS name, component, branched, CASE WHEN json_type(node -> '$.typed') = 'BOOLEAN' THEN CAST(node -> '$.typed' AS BOOLEAN) END AS typed, node ->> '$.selector' AS selector FROM nodes),
components AS (SELECT path, component, max(name) FILTER (place = component) AS name, bool_or(typed) FILTER (place = component) AS typed, max(selector) FILTER (place = component) AS selector, count(*) FILTER (kind IN {frontend.BRANCHES}) + 1 AS complexity,
 count(*) FILTER (kind = 'CallExpression' AND regexp_matches(name, '^use[A-Z]')) AS hooks, count(*) FILTER (kind = 'CallExpression' AND regexp_matches(name, '^use[A-Z]') AND branched) AS misused, count(*) FILTER (kind IN {frontend.MARKUP}) AS elements
 FROM flat WHERE component IS NOT NULL GROUP BY 1, 2),
sums AS (SELECT path, count(*) AS components, CAST(sum(hooks) AS BIGINT) AS hooks, sum(misused) AS misused, count(typed) AS known, count(*) FILTER (typed) AS typed, max(complexity) AS most, count(*) FILTER (trim(selector) <> '') AS selectors,
 count(*) FILTER (regexp_matches(selector, '{frontend.SELECTOR}')) AS simple, count(*) FILTER (regexp_matches(selector, '^(app-[a-z][a-z0-9]*(-[a-z0-9]+)*|\\[app[A-Z][A-Za-z0-9]*\\])$')) AS fitting FROM components GROUP BY 1)"""


def syntax_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested tree as JSON for each order; some are cut short."""
    return tables.read(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS path", f"{_TREE} AS text")


@query(_SQL + " SELECT path, component, name, typed, selector, complexity, hooks, misused, elements FROM components")
def frontend_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontend.components(frontend.syntax_nodes(syntax_trees(spark, sf_dir)))


@query(
    _SQL
    + """ SELECT path, components, hooks, CASE WHEN hooks > 0 THEN round(CAST((hooks - misused) * 100.0 AS DOUBLE) / hooks, 0) END AS hook_discipline, CASE WHEN known = components THEN round(CAST(typed * 100.0 AS DOUBLE) / components, 0) END AS typing,
 CAST(greatest(0, 100 - 10 * (most - 1)) AS DOUBLE) AS complexity, CASE WHEN selectors > 0 AND simple = selectors THEN round_even(CAST(fitting * 100.0 AS DOUBLE) / selectors * 100, 0) / 100 END AS selector_score FROM sums"""
)
def frontend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frontend.components(frontend.syntax_nodes(syntax_trees(spark, sf_dir)))
    return frontend.frontend_scores(found, ["app"])


_RULES = [(rule, family) for family, ids in rulebook.FRONTENDS.items() for rule in ids]
_FAMILY = "CASE o_orderstatus WHEN 'F' THEN 'React' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Angular' ELSE 'Razor' END WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Blazor' END END"


@query(
    f"""WITH seen AS (SELECT c_custkey, c_acctbal, {_FAMILY} AS family FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 11 = c_custkey % 11),
projects AS (SELECT c_custkey AS project, c_acctbal > 0 AS complete, coalesce(list_sort(list(DISTINCT family) FILTER (family IS NOT NULL)), []) AS families FROM seen GROUP BY 1, 2),
rules AS (SELECT * FROM (VALUES {', '.join(map(str, _RULES))}) AS r(rule_id, target)),
judged AS (SELECT *, CASE WHEN CASE target WHEN 'any' THEN list_contains(families, 'React') OR list_contains(families, 'Razor') ELSE list_contains(families, target) END THEN 'Applicable' WHEN complete THEN 'NotApplicable' ELSE 'Unknown' END AS verdict FROM projects, rules)
SELECT project, rule_id, verdict, CASE verdict WHEN 'NotApplicable' THEN CASE WHEN len(families) = 0 THEN 'no front end found' ELSE 'found only ' || array_to_string(families, ', ') END WHEN 'Unknown' THEN 'discovery incomplete' END AS reason FROM judged"""
)
def frontend_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = tables.read(spark, sf_dir, "customer"), tables.read(spark, sf_dir, "orders")
    seen = orders.select("o_custkey", "o_orderkey", F.expr(_FAMILY).alias("family"))
    found = customer.join(seen, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderkey") % 11 == F.col("c_custkey") % 11), "left")
    projects = found.groupBy(F.col("c_custkey").alias("project"), (F.col("c_acctbal") > 0).alias("complete")).agg(F.collect_set("family").alias("families"))
    return frontend.applicable_rules(projects, rulebook.architecture_rules(spark))
