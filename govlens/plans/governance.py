"""Rules, scores, summaries and history over the line items as facts and the orders as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import catalog
from govlens.operators import history, rules, scores
from govlens.plans.registry import query
from govlens.sources import tables

SCALES = {"Performance": 0.05, "Maintainability": 0.9}
LABELS = list(catalog.SEVERITIES)

_RULES = f"rules AS (SELECT * FROM {catalog.values_sql(catalog.RULES, catalog.RULE_SCHEMA, 'r')})"
_FACTS = """facts AS (SELECT l_orderkey AS project, l_suppkey AS file, l_returnflag || '-' || l_linestatus AS domain, 'File' AS scope, l_linenumber <= 5 AS has_evidence, l_linenumber = 7 AS incomplete, m.metric_key,
  CASE m.metric_key WHEN 'Discount' THEN l_discount WHEN 'Tax' THEN l_tax WHEN 'Quantity' THEN l_quantity ELSE l_extendedprice / l_quantity END AS metric_value
  FROM lineitem, (VALUES ('Discount'), ('Tax'), ('Quantity'), ('UnitPrice')) AS m(metric_key))"""
_VIOLATED = "CASE r.op WHEN '>' THEN metric_value > threshold WHEN '>=' THEN metric_value >= threshold WHEN '<' THEN metric_value < threshold WHEN '<=' THEN metric_value <= threshold WHEN '=' THEN abs(metric_value - threshold) < 1e-4 ELSE abs(metric_value - threshold) >= 1e-4 END"
_EVALS = f"""WITH {_RULES}, {_FACTS}, evals AS (SELECT f.*, r.rule_id, r.category, r.severity, CASE WHEN NOT (isfinite(metric_value) AND isfinite(threshold)) THEN 'Skipped' WHEN incomplete THEN 'InsufficientEvidence' WHEN NOT {_VIOLATED} THEN 'Passed' WHEN has_evidence THEN 'Violated' ELSE 'InsufficientEvidence' END AS status
  FROM facts f JOIN rules r ON lower(f.metric_key) = lower(r.metric_key) AND f.scope = r.scope WHERE r.enabled AND r.unsupported IS NULL),
checks AS (SELECT * FROM evals WHERE status IN ('Passed', 'Violated')),
sev AS (SELECT * FROM {catalog.values_sql(list(catalog.SEVERITIES.items()), 'severity string, ordinal int', 's')}),
findings AS (SELECT e.*, ordinal FROM evals e JOIN sev USING (severity) WHERE status = 'Violated')"""
_WEIGHT = "(CASE severity WHEN 'Critical' THEN 1.5::DOUBLE WHEN 'High' THEN 1.25::DOUBLE WHEN 'Medium' THEN 1.0::DOUBLE WHEN 'Low' THEN 0.75::DOUBLE WHEN 'Info' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE category WHEN 'Performance' THEN 0.05::DOUBLE WHEN 'Maintainability' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)"
_W = f"(CASE WHEN {_WEIGHT} < 0.05 THEN 0.0::DOUBLE ELSE {_WEIGHT} END)"
_R2 = "round_even(({0}) * 100, 0) / 100"
_R3 = "round_even(({0}) * 1000, 0) / 1000"


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(tables.facts(spark, sf_dir), catalog.rules(spark))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evals(spark, sf_dir).where("status = 'Violated'").join(F.broadcast(catalog.severities(spark)), "severity")


def _known(spark: SparkSession) -> DataFrame:
    return catalog.dimension(spark, [("N-O",), ("layer-without-checks",)], "domain string")


@query(f"{_EVALS} SELECT rule_id, domain, status, count(*) AS n, min(metric_value) AS lowest, max(metric_value) AS highest FROM evals GROUP BY ALL")
def rule_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evals(spark, sf_dir).groupBy("rule_id", "domain", "status").agg(F.count(F.lit(1)).alias("n"), F.min("metric_value").alias("lowest"), F.max("metric_value").alias("highest"))


@query(f"{_EVALS} SELECT domain, severity, category, count(*) AS checks FROM checks GROUP BY ALL")
def check_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check_buckets(_evals(spark, sf_dir))


@query(f"""{_EVALS}, a AS (SELECT count(*) AS evaluations, count(*) FILTER (status = 'Passed') AS passed, count(*) FILTER (status = 'Violated') AS violated, count(*) FILTER (status = 'InsufficientEvidence') AS insufficientevidence, count(*) FILTER (status = 'Skipped') AS skipped,
 count(DISTINCT CASE WHEN status IN ('Passed', 'Violated') THEN lower(rule_id) END) AS rules_evaluated FROM evals),
b AS (SELECT count(*) AS rules_total, count(*) FILTER (enabled) AS rules_enabled, count(*) FILTER (enabled AND unsupported IS NULL) AS rules_applicable FROM rules)
SELECT *, {_R2.format('100.0::DOUBLE * rules_evaluated / rules_applicable')} AS coverage_pct, {_R2.format('100.0::DOUBLE * rules_applicable / rules_enabled')} AS capability_pct FROM a, b""")
def rule_status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.status_stats(_evals(spark, sf_dir), catalog.rules(spark))


@query(f"""{_EVALS}, done AS (SELECT DISTINCT rule_id FROM checks), tried AS (SELECT rule_id, bool_or(status = 'InsufficientEvidence') AS insufficient FROM evals GROUP BY 1), scopes AS (SELECT DISTINCT lower(metric_key) AS key, scope FROM facts)
SELECT r.rule_id, r.metric_key, CASE WHEN NOT enabled THEN 'disabled by policy' WHEN unsupported IS NOT NULL THEN 'unsupported: ' || unsupported WHEN insufficient THEN 'insufficient evidence'
 WHEN EXISTS (SELECT 1 FROM scopes s WHERE s.key = lower(r.metric_key) AND s.scope = r.scope) THEN 'no valid comparison' WHEN EXISTS (SELECT 1 FROM scopes s WHERE s.key = lower(r.metric_key)) THEN 'metric at another scope only' ELSE 'metric not emitted' END AS reason
FROM rules r LEFT JOIN tried USING (rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM done)""")
def rules_not_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.not_evaluated(_evals(spark, sf_dir), catalog.rules(spark), tables.facts(spark, sf_dir))


@query(f"""WITH {_RULES}, o AS (SELECT * FROM {catalog.values_sql(catalog.OVERRIDES, 'kind string, name string, value double', 'o')}),
t AS (SELECT r.rule_id, r.metric_key, r.threshold AS d, (SELECT value FROM o WHERE kind = 'rule' AND lower(name) = lower(r.rule_id)) AS a, (SELECT value FROM o WHERE kind = 'metric' AND lower(name) = lower(r.metric_key)) AS b FROM rules r WHERE isfinite(r.threshold))
SELECT rule_id, metric_key, coalesce(a, b, d)::DOUBLE AS threshold, CASE WHEN a IS NOT NULL THEN 'rule' WHEN b IS NOT NULL THEN 'metric' ELSE 'default' END AS origin FROM t""")
def threshold_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = catalog.dimension(spark, catalog.OVERRIDES, "kind string, name string, value double")
    sound = catalog.rules(spark).where(~F.isnan("threshold"))
    return rules.effective_thresholds(sound, overrides).select("rule_id", "metric_key", "threshold", "origin")


_DOMAINS = f"""known AS (SELECT * FROM (VALUES ('N-O'), ('layer-without-checks')) AS k(domain)),
sums AS (SELECT domain, count(*) AS checks, count(*) FILTER (status = 'Violated') AS violations, count(DISTINCT rule_id) AS rules_evaluated, sum({_W}) AS check_weight, sum(CASE WHEN status = 'Violated' THEN {_W} ELSE 0.0::DOUBLE END) AS violation_weight FROM checks GROUP BY 1),
domains AS (SELECT domain, coalesce(rules_evaluated, 0) AS rules_evaluated, coalesce(checks, 0) AS checks, coalesce(violations, 0) AS violations, coalesce(check_weight, 0)::DOUBLE AS check_weight, coalesce(violation_weight, 0)::DOUBLE AS violation_weight,
 CASE WHEN checks IS NULL THEN 0.0::DOUBLE WHEN check_weight <= 0 THEN 1.0::DOUBLE ELSE greatest(0, least(1, 1 - violation_weight / check_weight)) END AS weighted_score, CASE WHEN checks IS NULL THEN 0.0::DOUBLE ELSE 1 - violations / checks END AS pass_rate, checks IS NOT NULL AS assessed FROM known FULL JOIN sums USING (domain))"""


@query(f"{_EVALS}, {_DOMAINS} SELECT domain, rules_evaluated, checks, violations, {_R2.format('check_weight')} AS check_weight, {_R2.format('violation_weight')} AS violation_weight, {_R3.format('weighted_score')} AS weighted_score, {_R3.format('pass_rate')} AS pass_rate, {_R3.format('weighted_score')} AS health, assessed FROM domains")
def weighted_domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.domain_scores(_evals(spark, sf_dir), _known(spark), SCALES)
    two, three = ("check_weight", "violation_weight"), ("weighted_score", "pass_rate", "health")
    return found.select(*(scores.half_even(F.col(c), 2 if c in two else 3).alias(c) if c in two + three else c for c in found.columns))


@query(f"{_EVALS} SELECT category, count(*) AS checks, count(*) FILTER (status = 'Violated') AS violations, {_R2.format(f'100.0::DOUBLE * (CASE WHEN sum({_W}) <= 0 THEN 1.0::DOUBLE ELSE 1 - sum(CASE WHEN status = $$Violated$$ THEN {_W} ELSE 0.0::DOUBLE END) / sum({_W}) END)')} AS compliance FROM checks GROUP BY 1")
def category_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.category_scores(_evals(spark, sf_dir), SCALES)


@query(f"""{_EVALS}, {_DOMAINS} SELECT count(*) AS assessed_domains, CAST(sum(checks) AS BIGINT) AS checks, {_R2.format('100 * sum(weighted_score * checks) / sum(checks)')} AS project_health, {_R2.format('100 * sum(pass_rate * checks) / sum(checks)')} AS maintainability, {_R3.format('sum(weighted_score * checks) / sum(checks)')} AS compliance FROM domains WHERE assessed""")
def global_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.global_metrics(scores.domain_scores(_evals(spark, sf_dir), _known(spark), SCALES)).drop("resilience")


@query(f"{_EVALS}, {_DOMAINS} SELECT {_R3.format('CASE WHEN count(*) <= 1 THEN 1.0::DOUBLE ELSE greatest(0, least(1, 1 - stddev_pop(weighted_score))) END')} AS resilience FROM domains WHERE assessed")
def resilience_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.global_metrics(scores.domain_scores(_evals(spark, sf_dir), _known(spark), SCALES)).select("resilience")


@query(f"{_EVALS} SELECT category, domain, count(DISTINCT file) AS total_files, count(*) AS violations, CAST(greatest(0, least(100, 100 - sum(ordinal * 5)::BIGINT // count(*))) AS BIGINT) AS health FROM findings GROUP BY 1, 2")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.layer_summary(_findings(spark, sf_dir))


@query(f"{_EVALS} SELECT domain, {', '.join(f'count(*) FILTER (severity = $${s}$$) AS {s.lower()}' for s in LABELS)} FROM findings GROUP BY 1")
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.severity_histogram(_findings(spark, sf_dir), "domain", LABELS)


@query(f"""{_EVALS} SELECT domain, rule_id, project, file, ordinal, metric_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ordinal DESC, metric_value DESC, project, file, rule_id) AS rank FROM findings) WHERE rank <= 10""")
def topk_findings_per_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scores.top_per_group(_findings(spark, sf_dir), ["domain"], [F.desc("ordinal"), F.desc("metric_value"), F.col("project"), F.col("file"), F.col("rule_id")], 10)
    return top.select("domain", "rule_id", "project", "file", "ordinal", "metric_value", "rank")


@query(f"{_EVALS}, n AS (SELECT category, rule_id, count(*) AS violations FROM findings GROUP BY 1, 2) SELECT category, rule_id, violations FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY violations DESC, rule_id) AS k FROM n) WHERE k = 1")
def top_rule_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _findings(spark, sf_dir).groupBy("category", "rule_id").agg(F.count(F.lit(1)).alias("violations"))
    return scores.top_per_group(n, ["category"], [F.desc("violations"), F.col("rule_id")], 1, "k").drop("k")


@query(f"{_EVALS} SELECT category, count(*) AS violations FROM findings GROUP BY 1 ORDER BY violations DESC, category LIMIT 1")
def most_affected_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("violations")).orderBy(F.desc("violations"), "category").limit(1)


@query(f"{_EVALS} SELECT domain, category, severity, count(*) AS n FROM findings GROUP BY GROUPING SETS ((domain), (category), (severity))")
def grouping_sets_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.dashboard(_findings(spark, sf_dir))


@query(f"""{_EVALS}, b AS (SELECT category, CASE WHEN sum({_W}) <= 0 THEN 100.0::DOUBLE ELSE {_R2.format(f'100.0::DOUBLE * (1 - sum(CASE WHEN status = $$Violated$$ THEN {_W} ELSE 0.0::DOUBLE END) / sum({_W}))')} END AS compliance FROM checks GROUP BY 1)
SELECT category, compliance, CASE WHEN compliance IS NULL THEN 'not assessed' WHEN compliance >= 90 THEN 'good' WHEN compliance >= 80 THEN 'fair' WHEN compliance >= 60 THEN 'weak' ELSE 'poor' END AS band
FROM (VALUES ('Security'), ('Maintainability'), ('Performance'), ('Architecture'), ('Naming'), ('Persistence')) AS c(category) LEFT JOIN b USING (category)""")
def category_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = catalog.dimension(spark, [(c,) for c in ("Security", "Maintainability", "Performance", "Architecture", "Naming", "Persistence")], "category string")
    return scores.category_bands(registered, scores.category_scores(_evals(spark, sf_dir), SCALES))


@query(f"{_EVALS} SELECT rule_id, count(*) AS n_rows, {_R2.format(f'sum(CASE WHEN status = $$Violated$$ THEN {_W} ELSE 0.0::DOUBLE END)')} AS impact, {_R3.format(f'greatest(0, 1 - sum(CASE WHEN status = $$Violated$$ THEN {_W} ELSE 0.0::DOUBLE END) / greatest(1, count(*)))')} AS compliance FROM checks GROUP BY 1")
def legacy_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    impact = F.sum(F.when(F.col("status") == "Violated", F.col("weight")).otherwise(F.lit(0.0)))
    n = F.count(F.lit(1))
    rows = scores.weighed(_evals(spark, sf_dir), SCALES)
    return rows.groupBy("rule_id").agg(n.alias("n_rows"), scores.half_even(impact).alias("impact"), scores.half_even(F.greatest(F.lit(0.0), 1.0 - impact / F.greatest(F.lit(1), n)), 3).alias("compliance"))


@query(f"""{_EVALS}, now AS (SELECT DISTINCT rule_id, category, CASE WHEN file % 5 = 0 THEN NULL ELSE upper(domain[1:1]) END AS d, file, project || '/' || file AS target FROM findings WHERE domain[3:3] = 'O'),
was AS (SELECT DISTINCT rule_id, category, CASE WHEN file % 5 = 0 THEN NULL ELSE lower(domain[1:1]) END AS d, CASE WHEN file % 3 > 0 THEN file END AS file, project || '/' || file AS target FROM findings WHERE domain[3:3] = 'F')
SELECT rule_id, category, d AS domain, file AS source_path, target FROM now n WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.file IS NOT NULL AND w.rule_id = n.rule_id AND w.category = n.category AND lower(w.d) IS NOT DISTINCT FROM lower(n.d) AND w.file = n.file)
AND NOT EXISTS (SELECT 1 FROM was w WHERE w.file IS NULL AND w.rule_id = n.rule_id AND w.category = n.category AND lower(w.d) IS NOT DISTINCT FROM lower(n.d) AND w.target = n.target)""")
def new_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    label = lambda f: F.when(F.col("file") % 5 != 0, f(F.substring("domain", 1, 1)))
    now = found.where(F.substring("domain", 3, 1) == "O").select("rule_id", "category", label(F.upper).alias("domain"), F.col("file").alias("source_path"), F.concat_ws("/", "project", "file").alias("target")).distinct()
    was = found.where(F.substring("domain", 3, 1) == "F").select("rule_id", "category", label(F.lower).alias("domain"), F.when(F.col("file") % 3 > 0, F.col("file")).alias("source_path"), F.concat_ws("/", "project", "file").alias("target")).distinct()
    return history.new_findings(now, was)


@query("SELECT o_orderkey AS report_id, o_custkey AS project, lag(o_orderkey) OVER w AS previous_id, lag(o_totalprice) OVER w AS previous_total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def previous_report_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.previous_reports(tables.reports(spark, sf_dir)).select("report_id", "project", "previous_id", "previous_total")


@query("SELECT o_custkey AS project, o_orderkey AS report_id, o_totalprice AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.top_per_group(tables.reports(spark, sf_dir), ["project"], [F.desc("scanned_at"), F.desc("report_id")], 1, "k").select("project", "report_id", "total")


@query("""SELECT rule_id, complete, scopes, n_rows, CAST(candidates AS BIGINT) AS candidates, CASE WHEN complete AND scopes = n_rows AND scopes = 5 AND candidates = 0 THEN 'NotApplicable' ELSE 'Applicable' END AS verdict FROM (
SELECT s_nationkey AS rule_id, bool_and(s_acctbal > -900) AS complete, count(DISTINCT s_suppkey % 5) AS scopes, count(*) AS n_rows, sum(CASE WHEN s_acctbal > 9500 THEN 1 ELSE 0 END) AS candidates FROM supplier GROUP BY 1)""")
def no_candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("rule_id"), (F.col("s_acctbal") > -900).alias("complete"), (F.col("s_suppkey") % 5).alias("scope_id"), F.when(F.col("s_acctbal") > 9500, 1).otherwise(0).alias("candidates"))
    return rules.no_candidate_gate(rows, 5)


@query("""WITH f AS (SELECT o_orderkey AS fact, unnest([('Total', o_totalprice), ('total', o_totalprice + 1), ('Age', o_custkey::DOUBLE), ('AGE', CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE END), ('Status', 1.0::DOUBLE)]) AS m FROM orders),
g AS (SELECT fact, lower(m[1]) AS name, count(*) AS spellings, max(CASE WHEN m[1] IN ('Total') THEN m[2] END) AS own, bool_or(m[1] = 'Total') AS exact, max(m[2]) AS any_value FROM f WHERE m[2] IS NOT NULL GROUP BY 1, 2)
SELECT name, spellings, count(*) AS n_facts, count(*) FILTER (exact OR spellings = 1) AS n_resolved, max(CASE WHEN exact THEN own WHEN spellings = 1 THEN any_value END) AS highest FROM g GROUP BY 1, 2""")
def ambiguous_metric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reports(spark, sf_dir).selectExpr("report_id as fact", "stack(5, 'Total', total, 'total', total + 1, 'Age', cast(project as double), 'AGE', if(project % 2 = 0, 1.0D, null), 'Status', 1.0D) as (metric_key, metric_value)").where("metric_value IS NOT NULL")
    found = rules.resolved_metrics(rows, ["Total"])
    return found.groupBy("name", "spellings").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("resolved").alias("n_resolved"), F.max("metric_value").alias("highest"))


_BROKEN = [*catalog.RULES[:3], ("g-price-1", "again", "Security", "File", "Discount", ">", 1.0, "High", True, None), (" ", "no id", "Security", "Module", "Tax", "~", 1.0, "Severe", True, None), catalog.RULES[9]]


@query(f"""WITH r AS (SELECT * FROM {catalog.values_sql(_BROKEN, catalog.RULE_SCHEMA, 'r')}), n AS (SELECT lower(rule_id) AS key, count(*) AS copies FROM r GROUP BY 1),
d AS (SELECT rule_id, unnest(list_filter([CASE WHEN trim(rule_id) = '' THEN 'blank id' END, CASE WHEN copies > 1 THEN 'duplicate id' END, CASE WHEN op NOT IN ('>', '>=', '<', '<=', '=', '!=') THEN 'unknown operator' END, CASE WHEN scope NOT IN ('File', 'Project') THEN 'unknown scope' END,
 CASE WHEN severity NOT IN ({", ".join(f"'{s}'" for s in LABELS)}) THEN 'unknown severity' END, CASE WHEN NOT isfinite(threshold) THEN 'threshold is not finite' END], lambda x: x IS NOT NULL)) AS defect FROM r JOIN n ON lower(rule_id) = key)
SELECT rule_id, defect, count(*) AS n FROM d GROUP BY ALL""")
def registry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.registry_errors(catalog.dimension(spark, _BROKEN, catalog.RULE_SCHEMA), [">", ">=", "<", "<=", "=", "!="], ["File", "Project"], LABELS)


@query("SELECT DISTINCT r_name AS rule_id, 'missing' AS side FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'ZZ' AS rule_id, 'unexpected' AS side")
def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.read(spark, sf_dir, "region").select(F.col("r_name").alias("rule_id"), "r_regionkey")
    actual = names.where("r_regionkey >= 2").select("rule_id").unionByName(catalog.dimension(spark, [("ZZ",)], "rule_id string"))
    return rules.registry_diff(names.select("rule_id"), actual)


@query(f"SELECT domain, severity, category, rule_id, {_W} AS weight, count(*) AS n FROM checks GROUP BY ALL".join([f"{_EVALS} ", ""]))
def check_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores.weighed(_evals(spark, sf_dir), SCALES)
    return rows.groupBy("domain", "severity", "category", "rule_id", "weight").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_EVALS} SELECT project, rule_id, count(*) AS violations, max(ordinal) AS worst FROM findings GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY worst DESC, violations DESC, project, rule_id LIMIT 50")
def worst_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _findings(spark, sf_dir).groupBy("project", "rule_id").agg(F.count(F.lit(1)).alias("violations"), F.max("ordinal").alias("worst"))
    return n.where("violations >= 2").orderBy(F.desc("worst"), F.desc("violations"), "project", "rule_id").limit(50)


