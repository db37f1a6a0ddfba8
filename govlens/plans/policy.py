"""Policies of customers' projects and the health of reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import rulebook
from govlens.operators import policy, reports
from govlens.plans.registry import query
from govlens.sources import tables

#: Documents of each order's scope, the customer: (rank, path, text as SQL); what they say depends on the order.
_BODY = "concat('\"Naming\": {\"Enabled\": ', CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END, ', // http: a comment\n \"Most\": ', CAST(o_orderkey % 50 AS STRING), ',}, \"EnforceLayerBoundaries\": ', CASE WHEN o_orderkey % 4 = 0 THEN 'false' ELSE 'true' END, CASE WHEN o_orderkey % 7 = 0 THEN ', \"Architecture\": {\"EnforceLayerBoundaries\": true}' ELSE '' END, ', \"Layers\": [\"a', CAST(o_orderkey % 5 AS STRING), '\"', CASE WHEN o_orderkey % 2 = 0 THEN ', \"b\"' ELSE '' END, ']')"
_TEXT = f"CASE o_orderkey % 13 WHEN 1 THEN concat('{{\"Policy\": {{', {_BODY}, '}}}}') WHEN 2 THEN '{{\"Policy\": {{}}, \"ArchitecturePolicy\": {{}}}}' WHEN 3 THEN '[1]' WHEN 4 THEN '{{\"Naming\": ' WHEN 5 THEN '{{\"Policy\": 3}}' ELSE concat('/* a */ {{', {_BODY}, '}}') END"
_SQL = """WITH docs AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, 'doc' || o_orderkey AS path, CAST(o_orderkey % 6 AS INTEGER) AS rank, o_orderkey AS k,
 CASE o_orderkey % 13 WHEN 2 THEN 'two wrappers' WHEN 3 THEN 'no object' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'empty wrapper' ELSE 'read' END AS status FROM orders),
leaves AS (SELECT d.*, x.key, x.value FROM docs d, LATERAL (SELECT * FROM (VALUES ('naming:enabled', CASE WHEN k % 3 = 0 THEN 'false' ELSE 'true' END), ('naming:most', CAST(k % 50 AS VARCHAR)), ('enforcelayerboundaries', CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END),
 ('architecture:enforcelayerboundaries', CASE WHEN k % 7 = 0 THEN 'true' END), ('layers:0', 'a' || k % 5), ('layers:1', CASE WHEN k % 2 = 0 THEN 'b' END)) AS v(key, value)) x WHERE status = 'read' AND x.value IS NOT NULL),
own AS (SELECT scope, key, value, path FROM leaves QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY rank DESC, path DESC) = 1),
section AS (SELECT scope, 'architecture:' || regexp_replace(key, '^architecture:', '') AS key, value, path FROM own QUALIFY row_number() OVER (PARTITION BY scope, regexp_replace(key, '^architecture:', '') ORDER BY CASE WHEN key LIKE 'architecture:%' THEN 1 ELSE 0 END DESC) = 1),
composed AS (SELECT * FROM section UNION ALL SELECT * FROM own WHERE key NOT LIKE 'architecture:%')"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("scope"), F.concat(F.lit("doc"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 6).cast("int").alias("rank"), F.expr(_TEXT).alias("text"))
    return policy.policy_documents(rows)


@query(_SQL + " SELECT status, count(*) AS documents FROM docs GROUP BY 1")
def policy_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("status").agg(F.countDistinct("path").alias("documents"))


@query(_SQL + " SELECT scope, key, value, path FROM composed")
def composed_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.composed(_documents(spark, sf_dir))


_NEEDED = [(r[0], i, key) for r in rulebook.ARCHITECTURE_RULES for prefix, keys in policy.ENABLED_BY.items() if r[0] == prefix or (r[0].startswith(prefix) and (not prefix[-1].isdigit() or prefix.endswith("0"))) for i, key in enumerate(keys)]


@query(
    _SQL
    + f""", needs AS (SELECT * FROM (VALUES {', '.join(map(str, _NEEDED))}) AS n(rule_id, nth, key)), book AS (SELECT * FROM (VALUES {', '.join(f"('{r[0]}')" for r in rulebook.ARCHITECTURE_RULES)}) AS b(rule_id)),
off AS (SELECT c.scope, n.rule_id, min_by(n.key, n.nth) AS missing FROM needs n JOIN composed c ON c.key = n.key AND c.value = 'false' GROUP BY 1, 2)
SELECT s.scope, b.rule_id, missing IS NULL AS enabled, missing FROM (SELECT DISTINCT scope FROM composed) s CROSS JOIN book b LEFT JOIN off o ON o.scope = s.scope AND o.rule_id = b.rule_id"""
)
def rules_enabled_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.enabled_rules(rulebook.architecture_rules(spark), policy.composed(_documents(spark, sf_dir)))


_STATUS = "CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 2 THEN 'NotEvaluated' WHEN l_discount > 0.08 THEN CASE l_orderkey % 4 WHEN 0 THEN 'InsufficientEvidence' WHEN 1 THEN 'Passed' WHEN 2 THEN 'Error' ELSE 'Unsupported' END WHEN l_tax > 0.05 THEN 'Violated' ELSE 'Passed' END"
_EVALUATIONS = f"l_orderkey AS report, concat(l_returnflag, l_linestatus) AS category, {_STATUS} AS status"
_DOMAINS = "l_orderkey AS report, l_returnflag AS domain, CAST(1 - CAST(l_linenumber AS DOUBLE) / 8 AS DOUBLE) AS health, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS checks"
_GROUPED = f"""WITH e AS (SELECT {_EVALUATIONS} FROM lineitem), g AS (SELECT report, category, count(*) FILTER (status = 'Passed') AS passed, count(*) FILTER (status IN ('Passed', 'Violated')) AS completed, count(*) FILTER (status = 'InsufficientEvidence') AS insufficientevidence,
 count(*) FILTER (status = 'Error') AS error, count(*) FILTER (status = 'NotEvaluated') AS notevaluated, count(*) FILTER (status = 'Unsupported') AS unsupported, CAST(grouping(category) AS INTEGER) AS level FROM e GROUP BY GROUPING SETS ((report, category), (report))),
c AS (SELECT report, category, CASE WHEN completed > 0 THEN round_even(100.0::DOUBLE * passed / completed * 100, 0) / 100 END AS score, passed, completed, insufficientevidence, error, notevaluated, unsupported, level FROM g WHERE level = 1 OR completed > 0)"""


def _compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.read(spark, sf_dir, "lineitem")
    return reports.report_compliance(line.select(F.col("l_orderkey").alias("report"), F.concat("l_returnflag", "l_linestatus").alias("category"), F.expr(_STATUS).alias("status")))


@query(_GROUPED + " SELECT * FROM c")
def report_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compliance(spark, sf_dir)


@query(
    _GROUPED
    + f""", d AS (SELECT report, sum(health * checks) / sum(checks) * 100 AS by_domain FROM (SELECT {_DOMAINS} FROM lineitem) WHERE checks > 0 GROUP BY 1),
w AS (SELECT report, avg(score) FILTER (level = 0) AS by_category, max(completed) FILTER (level = 1) AS completed, max(insufficientevidence) FILTER (level = 1) AS i, max(error) FILTER (level = 1) AS e, max(notevaluated) FILTER (level = 1) AS n, max(unsupported) FILTER (level = 1) AS u FROM c GROUP BY 1),
h AS (SELECT w.*, by_domain, round_even(coalesce(by_domain, by_category, 0) * 100, 0) / 100 AS health, CASE WHEN completed + i + e + n > 0 THEN CAST(completed AS DOUBLE) / (completed + i + e + n) ELSE 0 END AS coverage FROM w LEFT JOIN d ON d.report = w.report)
SELECT report, health, by_domain IS NOT NULL OR by_category IS NOT NULL AS evidence, round_even(coverage * 100 * 100, 0) / 100 AS coverage, round_even(health * coverage * 100, 0) / 100 AS adjusted, CASE WHEN by_domain IS NOT NULL THEN 'domains' WHEN by_category IS NOT NULL THEN 'categories' ELSE 'none' END AS basis,
 (by_domain IS NOT NULL OR by_category IS NOT NULL) AND completed + i + e + n > 0 AND i + e + n + u = 0 AND coverage >= 1 AS complete FROM h"""
)
def report_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_returnflag").alias("domain"), F.expr("1 - CAST(l_linenumber AS DOUBLE) / 8").alias("health"), F.expr("CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END").alias("checks"))
    return reports.report_health(_compliance(spark, sf_dir), domains)
