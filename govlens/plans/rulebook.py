"""The rule books over measured facts, profiles of repositories, and the signal evaluators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import catalog, rulebook
from govlens.operators import contracts, profiles, security
from govlens.plans.registry import query
from govlens.sources import tables

_BOOK = f"rules AS (SELECT * FROM {catalog.values_sql(rulebook.ARCHITECTURE_RULES, rulebook.RULE_SCHEMA, 'r')})"

#: Stored measurements stand in for the evaluators' facts: (kind, evaluator, scope, metric, unit, value of a part).
KINDS = [
    (0, "ComplexityEvaluator", "File", "EstimatedCyclomaticComplexity", None, "p_size"),
    (1, "MaintainabilityEvaluator", "File", "MaintainabilityScore", None, "100 - p_size"),
    (2, "GodClassEvaluator", "File", "GodClassSeverity", "MinimumOfLineAndMethodLimitRatios", "CAST(p_size AS DOUBLE) / 25"),
    (3, "FacadePatternEvaluator", "File", "PublicSurfaceRatio", "RatioOfConfiguredMaximum", "CAST(p_size AS DOUBLE) / 40"),
    (4, "NamingEvaluator", "File", "TypeNamingCompliance", None, "100 - CAST(p_size AS DOUBLE) / 2"),
    (5, "PerformanceEvaluator", "File", "BlockingIOCount", None, "p_size % 3"),
    (6, "DependencyGraphEvaluator", "Project", "DependencyGraphDensity", None, "CAST(p_size AS DOUBLE) / 50"),
    (7, "ArchitecturalEvaluator", "Project", "LayerIsolationCompliance", None, "60 + p_size"),
    (8, "CircularDependencyEvaluator", "Project", "CircularDependencyCount", None, "p_size % 2"),
    (9, "RazorEvaluator", "File", "ComplexityScore", None, "p_size * 2"),
    (10, "ReactEvaluator", "File", "HookDisciplineScore", None, "60 + p_size"),
    (11, "OtherEvaluator", "File", "EstimatedCyclomaticComplexity", None, "p_size"),
]
_VALUE = "CAST(CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN {v}" for k, _, _, _, _, v in KINDS) + " END AS DOUBLE)"
_KIND_SCHEMA = "kind int, source string, scope string, metric string, unit string"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts of twelve evaluators, with spellings, scopes, units, evidence and completeness that differ."""
    k = F.col("p_partkey")
    kinds = F.broadcast(catalog.dimension(spark, [r[:5] for r in KINDS], _KIND_SCHEMA))
    rows = tables.read(spark, sf_dir, "part").withColumn("kind", (k % 12).cast("int")).withColumn("value", F.expr(_VALUE)).join(kinds, "kind")
    metric = F.col("metric")
    key = F.when(k % 5 == 0, F.lower(metric)).otherwise(metric)
    metrics = F.when(k % 35 == 0, F.create_map(F.lower(metric), "value", F.upper(metric), "value")).otherwise(F.create_map(key, "value"))
    entry = lambda name, value, on: F.when(on, F.struct(F.lit(name).alias("k") if isinstance(name, str) else name.alias("k"), value.alias("v")))
    of = lambda name: F.concat(F.lit(f"{name}."), metric)
    summary = (F.col("scope") == "Project") & (k % 4 == 0)
    entries = F.array_compact(
        F.array(
            entry("EvaluationScope", F.col("scope"), ~summary), entry("AnalysisComplete", F.lit("False"), k % 9 == 0), entry("AnalysisStatus", F.lit("Partial"), k % 13 == 0),
            entry(of("Evidence"), F.concat(F.lit("first "), "p_name", F.lit("\n\n second ")), k % 3 > 0), entry(of("EvidenceLine"), (k % 50).cast("string"), k % 2 == 0),
            entry(of("MetricUnit"), F.col("unit"), F.col("unit").isNotNull() & (k % 7 > 0)), entry("FilePath", F.concat(F.lit("src/g"), k), k % 16 == 0),
        )
    )
    return rows.select(
        k.alias("fact_id"), "source", F.col("p_brand").alias("target"), F.when(summary, "ArchitectureSummary").otherwise("Metrics").alias("category"), F.col("p_type").alias("project"),
        F.when(k % 8 > 0, F.concat(F.lit("src/f"), k)).alias("file"), (k % 10).cast("int").alias("line"), F.when(k % 6 == 1, F.col("p_name")).alias("evidence"), metrics.alias("metrics"),
        F.map_from_entries(entries).alias("metadata"),
    )


_VIOLATED = "CASE r.op WHEN '>' THEN value > threshold ELSE value < threshold END"
_MEASURED = f"""{_BOOK}, kinds AS (SELECT * FROM {catalog.values_sql([r[:5] for r in KINDS], _KIND_SCHEMA, 'k')}),
f AS (SELECT p_partkey AS k, p_name, p_brand, p_type, {_VALUE} AS value, kinds.* FROM part JOIN kinds ON kind = p_partkey % 12 WHERE p_partkey % 35 <> 0),
g AS (SELECT *, k % 3 > 0 AS own, k % 6 = 1 AS generic, CASE WHEN k % 8 > 0 THEN 'src/f' || k WHEN k % 16 = 0 THEN 'src/g' || k END AS path, k % 9 <> 0 AS complete FROM f),
evals AS (SELECT g.*, r.rule_id, r.name, r.severity, r.category, r.threshold, CASE WHEN g.unit IS NOT NULL AND (k % 7 = 0 OR r.metric_key <> g.metric) THEN 'Skipped' WHEN NOT complete OR k % 13 = 0 THEN 'InsufficientEvidence'
 WHEN NOT ({_VIOLATED}) THEN 'Passed' WHEN (own OR generic) AND CASE WHEN g.scope = 'Project' THEN complete ELSE path IS NOT NULL AND CASE WHEN k % 2 = 0 AND k % 50 > 0 THEN own ELSE generic AND k % 10 > 0 END END THEN 'Violated'
 ELSE 'InsufficientEvidence' END AS status FROM g JOIN rules r ON r.metric_key = g.metric AND r.scope = g.scope AND list_contains(string_split(lower(r.producers), '/'), lower(g.source)))"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.evaluate(measured(spark, sf_dir), rulebook.architecture_rules(spark))


@query(f"WITH {_BOOK} SELECT category, scope, severity, producers IS NOT NULL AS measured, count(*) AS n, count(*) FILTER (gated) AS gated FROM rules GROUP BY ALL")
def rulebook_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rulebook.architecture_rules(spark)
    return rules.groupBy("category", "scope", "severity", F.col("producers").isNotNull().alias("measured")).agg(F.count(F.lit(1)).alias("n"), F.count_if("gated").alias("gated"))


@query(f"""WITH {_BOOK}, c AS (SELECT count(*) - count(DISTINCT lower(rule_id)) AS "duplicate id", count(*) FILTER (trim(name) = '') AS "blank name",
 count(*) FILTER (severity NOT IN {tuple(catalog.SEVERITIES)}) AS "unknown severity", count(*) FILTER (scope NOT IN ('Project', 'File')) AS "unknown scope", count(*) FILTER (NOT isfinite(threshold)) AS "threshold is not finite",
 count(*) FILTER (producers IS NULL) AS "no producer", count(*) FILTER (gated AND producers IS NULL) AS "candidates without a producer" FROM rules) UNPIVOT c ON COLUMNS(*) INTO NAME "check" VALUE n""")
def rulebook_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.book_defects(rulebook.architecture_rules(spark), list(catalog.SEVERITIES))


@query(f"WITH {_MEASURED} SELECT rule_id, source, status, count(*) AS n, sum(value) AS total FROM evals GROUP BY ALL")
def rulebook_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evaluated(spark, sf_dir)
    return found.groupBy("rule_id", "source", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("metric_value").alias("total"))


def _two_digits(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.2f', round({x}, 2)), '0+$', ''), '[.]$', '')"


@query(f"""WITH {_MEASURED} SELECT k AS fact_id, rule_id, category, severity, '[' || source || '] Metric ''' || metric || ''' = ' || {_two_digits('value')} || ', threshold = ' || {_two_digits('threshold')} || '.' AS message,
 CASE WHEN scope = 'Project' THEN '' ELSE path END AS file, CASE WHEN scope = 'Project' THEN p_type ELSE p_brand END AS target, CASE WHEN scope = 'File' THEN CAST(CASE WHEN k % 2 = 0 THEN k % 50 ELSE k % 10 END AS INTEGER) END AS line,
 CASE WHEN own THEN 'first ' || p_name || '|second' ELSE p_name END AS evidence FROM evals WHERE status = 'Violated'""")
def rulebook_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.findings(_evaluated(spark, sf_dir))
    return found.select("fact_id", "rule_id", "category", "severity", "message", "file", "target", "line", F.array_join("evidence", "|").alias("evidence"))


@query(f"WITH {_MEASURED} SELECT rule_id, producers IS NULL AS unsupported FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM evals WHERE status IN ('Passed', 'Violated')) ORDER BY lower(rule_id)")
def rulebook_not_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _evaluated(spark, sf_dir).where(F.col("status").isin("Passed", "Violated")).select("rule_id").distinct()
    left = rulebook.architecture_rules(spark).join(done, "rule_id", "left_anti")
    return left.select("rule_id", F.col("producers").isNull().alias("unsupported")).orderBy(F.lower("rule_id"))


@query(f"WITH {_MEASURED} SELECT name, severity, count(*) AS n, CAST(dense_rank() OVER (ORDER BY CASE severity {' '.join(f'WHEN {s!r} THEN {o}' for s, o in catalog.SEVERITIES.items())} END DESC) AS INTEGER) AS position FROM evals WHERE status = 'Violated' GROUP BY 1, 2")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in their order: worst first, then by name without case."""
    found = contracts.findings(_evaluated(spark, sf_dir)).groupBy("name", "severity").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.broadcast(catalog.severities(spark))
    present = found.select("severity").distinct().join(ranked, "severity").groupBy().agg(F.array_sort(F.collect_set("ordinal")).alias("present"))  # six at most
    place = F.size(F.filter("present", lambda x: x > F.col("ordinal"))) + 1
    out = found.join(ranked, "severity").join(F.broadcast(present)).withColumn("position", place.cast("int"))
    return out.orderBy(F.desc("ordinal"), F.lower("name")).select("name", "severity", "n", "position")


_DOCUMENTED = "SELECT s_nationkey AS repo, s_suppkey % 3 > 0 OR s_nationkey % 2 = 0 AS nothing, s_suppkey % 11 > 0 AS complete, s_suppkey % 5 = 0 AND s_nationkey % 2 = 1 AS measured FROM supplier"


@query(f"WITH d AS ({_DOCUMENTED}) SELECT repo, count(*) AS scans, bool_and(nothing AND complete AND NOT measured) AS not_applicable FROM d GROUP BY 1")
def documentation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "supplier").selectExpr(*_DOCUMENTED.removeprefix("SELECT ").removesuffix(" FROM supplier").split(", "))
    entries = F.array_compact(F.array(F.when(F.col("measured"), F.struct(F.lit("DocumentationCoverage").alias("k"), F.lit(1.0).alias("v")))))
    status = F.when(F.col("nothing"), "NoApplicableDeclarations").otherwise("Completed")
    facts = rows.select(
        "repo", F.lit("documentationevaluator").alias("source"), F.lit("c").alias("category"), F.map_from_entries(entries).alias("metrics"),
        F.create_map(F.lit("EvaluationScope"), F.lit("project"), F.lit("EvaluatorExecutionStatus"), status, F.lit("AnalysisComplete"), F.col("complete").cast("string")).alias("metadata"),
    )
    return contracts.documentation_gates(facts, ["repo"])


@query(f"""WITH {_BOOK}, off AS (SELECT DISTINCT source FROM {catalog.values_sql([r[:5] for r in KINDS], _KIND_SCHEMA, 'k')} WHERE kind IN (SELECT p_partkey % 12 FROM part WHERE p_size = 50))
SELECT rule_id FROM rules WHERE EXISTS (SELECT 1 FROM off WHERE list_contains(string_split(lower(producers), '/'), lower(source)))""")
def rules_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tables.read(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("fact_id")).join(measured(spark, sf_dir).drop("metadata"), "fact_id")
    facts = facts.withColumn("metadata", F.create_map(F.lit("EvaluatorExecutionStatus"), F.lit("DisabledByPolicy")))
    return contracts.switched_off(facts, rulebook.architecture_rules(spark))


_LAYERED = [("repo/src", "Domain"), ("repo/src/app/", "Application"), ("tools/docs", "Presentation"), ("lib/src7", "Api")]


@query(f"""WITH m AS (SELECT lower(rtrim(module_path, '/')) AS module, layer FROM {catalog.values_sql(_LAYERED, 'module_path string, layer string', 'm')}),
p AS (SELECT doc_id, lower('Repo/' || (['src', 'src/App', 'docs', 'x'])[doc_id % 4 + 1] || '/' || source || '/f') AS path FROM documents),
a AS (SELECT doc_id, max_by(layer, length(module)) AS inside FROM p JOIN m ON path = module OR starts_with(path, module || '/') GROUP BY 1),
b AS (SELECT doc_id, max_by(layer, length(module)) AS named FROM p JOIN m ON list_contains(string_split(path, '/'), string_split(module, '/')[-1]) GROUP BY 1)
SELECT coalesce(inside, named, 'Unclassified') AS layer, count(*) AS n FROM p LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) GROUP BY 1""")
def layer_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("src", "src/App", "docs", "x"))), (F.col("doc_id") % 4 + 1).cast("int"))
    paths = tables.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Repo/"), folder, F.lit("/"), "source", F.lit("/f")).alias("path"))
    return contracts.layer_of(paths, catalog.dimension(spark, _LAYERED, "module_path string, layer string")).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


# SQL without look-around counts what must not follow apart.
_LOOKING = {
    "SEC-COMP-004": "regexp_matches(e, '(^|[^0-9])[0-9]{13,19}([^0-9]|$)')",
    "SEC-INF-002": "len(regexp_extract_all(e, '(?i)http://')) > len(regexp_extract_all(e, '(?i)http://(localhost|127\\.0\\.0\\.1)'))",
    "SEC-NET-003": "(regexp_matches(e, '(?i)ftp|telnet|smbv1') OR len(regexp_extract_all(e, '(?i)http://')) > len(regexp_extract_all(e, '(?i)http://(localhost|127\\.0\\.0\\.1)')))",
}


def _matches(rule: tuple) -> str:
    return _LOOKING.get(rule[0]) or "regexp_matches(e, '" + rule[4].replace("'", "''") + "')"


_SECURITY = ", ".join(f"CASE WHEN {_matches(r)} THEN '{r[0]}' END" for r in rulebook.SECURITY_RULES)
_SECURITY_BOOK = catalog.values_sql([(r[0], r[2], r[3], round((lo + hi) / 2, 2)) for r in rulebook.SECURITY_RULES for s, lo, hi in rulebook.SCORES if s == r[3]], "rule_id string, category string, severity string, score double", "b")


@query(f"""WITH e AS (SELECT text AS e FROM conversations WHERE text IS NOT NULL UNION ALL SELECT url FROM pages WHERE url IS NOT NULL),
h AS (SELECT unnest(list_filter([{_SECURITY}], lambda x: x IS NOT NULL)) AS rule_id FROM e) SELECT b.rule_id, b.category, b.severity, b.score, count(*) AS n FROM h JOIN {_SECURITY_BOOK} ON h.rule_id = b.rule_id GROUP BY ALL""")
def security_rulebook_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = tables.read(spark, sf_dir, "conversations").select(F.col("text").alias("e")).unionByName(tables.read(spark, sf_dir, "pages").select(F.col("url").alias("e")))
    patterns = [(r[0], r[4], 0) for r in rulebook.SECURITY_RULES]
    hits = security.pattern_hits(evidence, "e", patterns, []).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(rulebook.security_rules(spark)), "rule_id").select("rule_id", "category", "severity", "score", "n")


_MODULES = """SELECT s_nationkey AS repo, s_suppkey AS module, ['WebApplication', 'ClassLibrary', 'ClassLibrary', 'FrontendApplication', 'Executable', 'DesktopApplication', 'Unknown'][(s_suppkey * 5 + s_nationkey) % 7 + 1] AS kind,
 CASE WHEN s_nationkey % 8 = 7 OR s_suppkey % 5 = 4 THEN CASE WHEN s_nationkey % 3 = 0 THEN 'support' ELSE 'test' END ELSE 'production' END AS role,
 [['Blazor'], ['ASP.NET Core'], [], ['Angular', 'Spring Boot'], ['Unity']][s_suppkey % 5 + 1] AS frameworks,
 [['MediatR', 'Microsoft.EntityFrameworkCore'], ['RabbitMQ.Client'], [], ['Microsoft.Extensions.DependencyInjection'], ['xunit']][(s_suppkey + s_nationkey) % 5 + 1] AS dependencies,
 ['Api', 'Domain', 'Infrastructure', NULL][s_nationkey % 4 + 1] AS layer FROM supplier"""


def modules_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as modules of their nation's repository."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    pick = lambda values, at: F.get(F.array(*(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for v in values)), at.cast("int"))
    kinds = ["WebApplication", "ClassLibrary", "ClassLibrary", "FrontendApplication", "Executable", "DesktopApplication", "Unknown"]
    packages = [["MediatR", "Microsoft.EntityFrameworkCore"], ["RabbitMQ.Client"], [], ["Microsoft.Extensions.DependencyInjection"], ["xunit"]]
    other = (n % 8 == 7) | (s % 5 == 4)
    return tables.read(spark, sf_dir, "supplier").select(
        n.alias("repo"), s.alias("module"), pick(kinds, (s * 5 + n) % 7).alias("kind"), F.when(other, F.when(n % 3 == 0, "support").otherwise("test")).otherwise("production").alias("role"),
        pick([["Blazor"], ["ASP.NET Core"], [], ["Angular", "Spring Boot"], ["Unity"]], s % 5).alias("frameworks"), pick(packages, (s + n) % 5).alias("dependencies"),
        pick(["Api", "Domain", "Infrastructure", None], n % 4).alias("layer"),
    )


_PROFILE = f"""m AS ({_MODULES}), o AS (SELECT repo, list_sort(coalesce(list(DISTINCT kind) FILTER (role = 'production' AND kind <> 'Unknown'), [])) AS kinds, count(*) FILTER (role = 'production') AS n_production,
 count(*) FILTER (role = 'support') AS n_support, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'production' AND kind = 'WebApplication') AS n_web,
 count(*) FILTER (role = 'production' AND kind IN ('WebApplication', 'Executable')) AS n_service, coalesce(bool_or(role = 'production' AND kind = 'WebApplication' AND list_contains(frameworks, 'Blazor')), false) AS web_blazor,
 coalesce(bool_or(role = 'production' AND list_contains(frameworks, 'Blazor')), false) AS any_blazor, list_distinct(flatten(list(frameworks))) AS fw, list_distinct(flatten(list(dependencies))) AS dp, any_value(layer) AS layer FROM m GROUP BY repo),
d AS (SELECT *, CASE WHEN list_contains(kinds, 'WebApplication') AND list_contains(kinds, 'FrontendApplication') OR n_web > 1 AND web_blazor THEN 'FullStack'
 WHEN list_contains(kinds, 'WebApplication') AND len(list_filter(kinds, lambda x: x NOT IN ('WebApplication', 'ClassLibrary'))) = 0 THEN CASE WHEN any_blazor THEN 'FullStack' ELSE 'Backend' END
 WHEN list_contains(kinds, 'FrontendApplication') AND len(list_filter(kinds, lambda x: x NOT IN ('FrontendApplication', 'ClassLibrary'))) = 0 THEN 'Frontend'
 WHEN list_contains(kinds, 'DesktopApplication') AND len(list_filter(kinds, lambda x: x NOT IN ('DesktopApplication', 'ClassLibrary'))) = 0 THEN 'Desktop' WHEN len(kinds) > 1 THEN 'Mixed'
 WHEN len(kinds) = 1 THEN CASE kinds[1] WHEN 'ClassLibrary' THEN 'Library' WHEN 'Executable' THEN 'Application' ELSE 'Unknown' END WHEN n_production = 0 AND n_support > 0 THEN 'Library' WHEN n_production = 0 AND n_test > 0 THEN 'Test'
 WHEN (list_contains(fw, 'Blazor') OR list_contains(fw, 'Unity')) AND list_contains(fw, 'ASP.NET Core') THEN 'FullStack' WHEN list_contains(fw, 'Unity') THEN 'Game' WHEN list_contains(fw, 'Blazor') THEN 'Frontend' ELSE 'Unknown' END AS domain FROM o),
s AS (SELECT *, CASE WHEN domain = 'Library' THEN CASE WHEN n_production > 1 THEN 'Multi-Project Library' ELSE 'Library' END WHEN domain = 'Mixed' THEN 'Multi-Project / Mixed'
 WHEN list_contains(dp, 'MediatR') THEN 'CQRS' WHEN domain = 'FullStack' AND n_production > 1 THEN 'Multi-Project Full-Stack' WHEN n_service = 1 AND n_production > 1 THEN 'Modular Monolith'
 WHEN list_contains(dp, 'RabbitMQ.Client') AND n_service > 1 THEN 'Message-Driven Multi-Service' WHEN list_contains(dp, 'RabbitMQ.Client') THEN 'Message-Driven Application'
 WHEN domain IN ('Backend', 'FullStack') AND layer = 'Api' THEN 'MVC' ELSE 'Layered' END AS style,
 list_filter([CASE WHEN list_contains(fw, 'Angular') THEN 'Angular Modular Architecture' END, CASE WHEN list_contains(fw, 'Spring Boot') THEN 'Spring Layered Architecture' END, CASE WHEN list_contains(fw, 'ASP.NET Core') THEN 'ASP.NET Web Architecture' END,
 CASE WHEN list_contains(dp, 'MediatR') THEN 'CQRS' END, CASE WHEN list_contains(dp, 'MediatR') THEN 'Repository Pattern' END, CASE WHEN list_contains(dp, 'RabbitMQ.Client') THEN 'Event Driven Architecture' END,
 CASE WHEN list_contains(dp, 'Microsoft.Extensions.DependencyInjection') THEN 'Dependency Injection' END, CASE WHEN n_production > 1 THEN 'Modular Architecture' END, CASE WHEN layer = 'Domain' THEN 'Domain Driven Design' END], lambda x: x IS NOT NULL) AS patterns,
 CASE WHEN n_production > 1 THEN 'MultiProject' WHEN n_production = 0 AND n_support > 0 THEN 'Library' WHEN n_production = 0 AND n_test > 0 THEN 'TestSuite' ELSE coalesce(CASE kinds[1] WHEN 'ClassLibrary' THEN 'Library' WHEN 'WebApplication' THEN 'Service'
 WHEN 'FrontendApplication' THEN 'FrontendApp' WHEN 'DesktopApplication' THEN 'DesktopApp' WHEN 'Executable' THEN 'Application' END, 'Generic') END AS nature FROM d)"""


@query(f"""WITH {_PROFILE} SELECT repo, domain, style, array_to_string(patterns, ', ') AS patterns, nature, CASE WHEN layer = 'Domain' OR style = 'Clean' THEN 'clean' ELSE 'layered' END AS preset,
 round(((CASE WHEN len(fw) > 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END) + (CASE WHEN domain <> 'Unknown' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END) + (CASE WHEN layer IS NOT NULL THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END) + 0.75::DOUBLE
 + (CASE WHEN n_production > 0 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END)) / 5, 4) AS confidence FROM s""")
def repository_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.repository_profile(modules_of(spark, sf_dir)).withColumn("patterns", F.array_join("patterns", ", "))


_LAYERS = "['Domain', 'Application', 'Infrastructure', 'Api', 'Presentation', 'Contracts', 'Other', '']"
_BOUNDARIES = ", ".join(f"('{p}', '{s}', {a or '[]::VARCHAR[]'}, {f or '[]::VARCHAR[]'})" for p, s, a, f in profiles.BOUNDARIES)


@query(f"""WITH e AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'clean' ELSE 'layered' END AS preset, {_LAYERS}[l_partkey % 8 + 1] AS source_layer, {_LAYERS}[l_suppkey % 8 + 1] AS target_layer FROM lineitem),
d AS (SELECT e.*, CASE WHEN e.source_layer = '' OR target_layer = '' THEN 'Unclassified' WHEN e.source_layer = target_layer THEN 'SameLayer' WHEN b.source_layer IS NULL THEN 'Unclassified' WHEN list_contains(forbidden, target_layer) THEN 'Forbidden'
 WHEN len(allowed) = 0 THEN 'Unclassified' WHEN list_contains(allowed, target_layer) THEN 'Allowed' ELSE 'Forbidden' END AS decision
 FROM e LEFT JOIN (VALUES {_BOUNDARIES}) AS b(preset, source_layer, allowed, forbidden) ON b.preset = e.preset AND b.source_layer = e.source_layer)
SELECT preset, source_layer, decision, count(*) AS n FROM d GROUP BY ALL""")
def boundary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = F.array(*map(F.lit, ("Domain", "Application", "Infrastructure", "Api", "Presentation", "Contracts", "Other", "")))
    at = lambda c: F.get(layers, (F.col(c) % 8).cast("int"))
    edges = tables.read(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 2 == 0, "clean").otherwise("layered").alias("preset"), at("l_partkey").alias("source_layer"), at("l_suppkey").alias("target_layer"))
    pairs = edges.groupBy("preset", "source_layer", "target_layer").agg(F.count(F.lit(1)).alias("n"))
    found = profiles.boundary_decisions(pairs, spark.createDataFrame(profiles.BOUNDARIES, profiles.BOUNDARY_SCHEMA))
    return found.groupBy("preset", "source_layer", "decision").agg(F.sum("n").alias("n"))


def _flags(*cases: tuple[str, str, int]) -> str:
    listed = ", ".join(f"CASE WHEN {c} THEN struct_pack(finding := '{n}', ordinal := {o}) END" for n, c, o in cases)
    return f"unnest(list_filter([{listed}], lambda x: x IS NOT NULL), recursive := true)"


@query("WITH h AS (SELECT s_suppkey AS host, CASE WHEN s_suppkey % 4 = 0 THEN 'Windows 7 SP1' ELSE 'Windows 11' END AS v, s_suppkey % 3 > 0 AS firewall, s_suppkey % 5 = 0 AS smb1, s_suppkey % 7 = 0 AS guest FROM supplier) SELECT host, "
       + _flags(("end of life", "contains(v, 'Windows 7')", 3), ("firewall off", "NOT firewall", 3), ("old file sharing", "smb1", 4), ("guest account", "guest", 2)) + " FROM h")
def hardening_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = tables.read(spark, sf_dir, "supplier").select(s.alias("host"), F.when(s % 4 == 0, "Windows 7 SP1").otherwise("Windows 11").alias("os_version"), (s % 3 > 0).alias("firewall"), (s % 5 == 0).alias("smb1"), (s % 7 == 0).alias("guest"))
    return security.hardening_findings(rows)


@query("WITH p AS (SELECT event_id AS host, ['nc.exe', 'PowerShell.exe', 'app.exe'][event_id % 3 + 1] AS name, value * 10 AS mb, CASE WHEN event_id % 4 = 0 THEN 'client_secret' ELSE 'PATH' END AS variable FROM events) SELECT host, name, "
       + _flags(("suspicious process", "lower(name) = 'nc.exe' OR lower(name) = 'powershell.exe' AND mb > 500", 3), ("secret in environment", "contains(upper(variable), 'SECRET')", 4)) + " FROM p")
def process_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    name = F.get(F.array(F.lit("nc.exe"), F.lit("PowerShell.exe"), F.lit("app.exe")), (k % 3).cast("int"))
    rows = tables.read(spark, sf_dir, "events").select(k.alias("host"), name.alias("name"), (F.col("value") * 10).alias("memory_mb"), F.when(k % 4 == 0, "client_secret").otherwise("PATH").alias("variable"))
    return security.process_findings(rows)


@query("WITH c AS (SELECT c_custkey AS resource, ['bucket', 'principal', 'network'][c_custkey % 3 + 1] AS kind, c_custkey % 2 = 0 AS a, c_custkey % 5 = 0 AS b FROM customer) SELECT resource, "
       + _flags(("public bucket", "kind = 'bucket' AND a", 3), ("unencrypted bucket", "kind = 'bucket' AND NOT b", 4), ("no second factor", "kind = 'principal' AND NOT a", 3), ("admin role", "kind = 'principal' AND b", 2),
                ("open to the world", "kind = 'network' AND a", 4)) + " FROM c")
def cloud_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a, b = k % 2 == 0, k % 5 == 0
    kind = F.get(F.array(F.lit("bucket"), F.lit("principal"), F.lit("network")), (k % 3).cast("int"))
    return security.cloud_findings(tables.read(spark, sf_dir, "customer").select(k.alias("resource"), kind.alias("kind"), a.alias("public"), b.alias("encrypted"), a.alias("mfa"), b.alias("admin"), a.alias("open_to_world")))


_ALGORITHMS = ["AES-256", "SHA256", "SHA512", "RSA-2048", "ECDSA-P256", "DES", "TripleDES", "MD5", "SHA1"]


@query(f"WITH a AS (SELECT s_suppkey AS host, {_ALGORITHMS}[s_suppkey % 9 + 1] AS algorithm, s_suppkey % 9 >= 5 AS weak, CASE WHEN s_suppkey % 4 = 0 THEN 'failed' ELSE '' END AS error FROM supplier) SELECT host, algorithm, "
       + _flags(("weak algorithm", "weak", 3), ("scan error", "error <> ''", 1)) + " FROM a")
def crypto_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    algorithm = F.get(F.array(*map(F.lit, _ALGORITHMS)), (s % 9).cast("int"))
    return security.crypto_findings(tables.read(spark, sf_dir, "supplier").select(s.alias("host"), algorithm.alias("algorithm"), (s % 9 >= 5).alias("weak"), F.when(s % 4 == 0, "failed").otherwise("").alias("error")))


@query("WITH f AS (SELECT o_orderkey AS path, o_orderkey % 6 > 0 AS present, o_orderkey % 2 = 0 AS s, o_orderkey % 3 = 0 AS r, o_orderkey % 5 = 0 AS w, o_orderkey % 7 = 0 AS c, o_totalprice * 300 AS size, CASE WHEN o_orderkey % 11 = 0 THEN 'denied' ELSE ' ' END AS error FROM orders) SELECT path, "
       + _flags(("sensitive and readable", "s AND r", 4), ("writable by all", "w", 3), ("holds secrets", "c", 4), ("very large", "size > 100000000", 1), ("scan error", "trim(error) <> ''", 1)) + " FROM f WHERE present")
def file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = tables.read(spark, sf_dir, "orders").select(
        k.alias("path"), (k % 6 > 0).alias("present"), (k % 2 == 0).alias("sensitive"), (k % 3 == 0).alias("world_readable"), (k % 5 == 0).alias("world_writable"), (k % 7 == 0).alias("secrets"),
        (F.col("o_totalprice") * 300).alias("size"), F.when(k % 11 == 0, "denied").otherwise(" ").alias("error"),
    )
    return security.file_findings(rows)


@query("WITH w AS (SELECT s_suppkey AS service, s_suppkey % 2 = 0 AS https, ['None', 'Transport', 'Message'][s_suppkey % 3 + 1] AS mode, s_suppkey % 5 = 0 AS anonymous, ['Basic128', 'Basic256Sha256', 'TripleDes', 'Default'][s_suppkey % 4 + 1] AS suite, s_suppkey % 7 = 0 AS metadata,"
       " ['basicHttpBinding', 'wsHttpBinding'][(s_suppkey // 3) % 2 + 1] AS binding FROM supplier) SELECT service, "
       + _flags(("no transport security", "NOT https AND mode = 'None'", 4), ("anonymous clients", "anonymous", 3), ("weak suite", "suite IN ('Basic128', 'TripleDes', 'Basic128Rsa15')", 3), ("metadata exposed", "metadata", 1),
                ("basic binding in clear text", "NOT https AND contains(binding, 'basicHttpBinding')", 4)) + " FROM w")
def service_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = tables.read(spark, sf_dir, "supplier").select(
        s.alias("service"), (s % 2 == 0).alias("https"), pick(["None", "Transport", "Message"], s % 3).alias("mode"), (s % 5 == 0).alias("anonymous"),
        pick(["Basic128", "Basic256Sha256", "TripleDes", "Default"], s % 4).alias("suite"), (s % 7 == 0).alias("metadata"), pick(["basicHttpBinding", "wsHttpBinding"], F.floor(s / 3) % 2).alias("binding"),
    )
    return security.service_findings(rows)


@query("""WITH s AS (SELECT event_id, 'd' || event_type AS detector, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN ' first ' || chr(10) || 'x' || chr(10) || 'at Line 3' ELSE 'only' || event_id END AS evidence, CASE WHEN event_id % 5 = 0 THEN 'T' || user_id END AS named FROM events)
SELECT event_id, coalesce(named, CASE WHEN evidence IS NULL THEN detector WHEN event_id % 4 = 1 THEN 'first' ELSE evidence END) AS target, CASE WHEN named IS NULL AND event_id % 4 = 1 THEN 'at Line 3' END AS location FROM s""")
def finding_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    evidence = F.when(k % 4 == 0, None).when(k % 4 == 1, F.lit(" first \nx\nat Line 3")).otherwise(F.concat(F.lit("only"), k))
    metadata = F.when(k % 5 == 0, F.create_map(F.lit("target"), F.concat(F.lit("T"), F.col("user_id")))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    rows = tables.read(spark, sf_dir, "events").select(k, F.concat(F.lit("d"), "event_type").alias("detector"), evidence.alias("evidence"), metadata.alias("metadata"))
    return security.target_of(rows).select("event_id", "target", "location")
