"""Ledger queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govlens import catalog, rulebook
from govlens.operators import contracts, ledger
from govlens.plans import rulebook as book
from govlens.plans.governance import _R2
from govlens.plans.registry import query
from govlens.sources import tables

_SEVERITY = "CASE severity " + " ".join(f"WHEN '{s}' THEN {o}" for s, o in catalog.SEVERITIES.items()) + " END"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.findings(book._evaluated(spark, sf_dir))


@query(f"""WITH {book._MEASURED} SELECT rule_id, CAST(sum(1 + {_SEVERITY}) AS BIGINT) AS impact FROM evals WHERE status = 'Violated' GROUP BY 1 ORDER BY impact DESC, rule_id LIMIT 10""")
def top_impact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir).join(F.broadcast(catalog.severities(spark)), "severity")
    return found.groupBy("rule_id").agg(F.sum(F.col("ordinal") + 1).alias("impact")).orderBy(F.desc("impact"), "rule_id").limit(10)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_signal_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_of(tables.read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH p AS (SELECT doc_id, text, string_split(text, '. ') AS parts FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, substr(text, length(array_to_string(parts[1:i], '. ')) + 3, 160) AS ahead FROM (SELECT doc_id, text, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM p))
SELECT doc_id, count(*) AS windows, count(*) FILTER (contains(ahead, ', ')) AS with_comma, CAST(sum(length(ahead)) AS BIGINT) AS characters FROM w GROUP BY 1""")
def look_ahead_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.explode(ledger.look_ahead(F.col("text"), ". ", 160)).alias("ahead"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.contains("ahead", F.lit(", "))).alias("with_comma"), F.sum(F.length("ahead")).alias("characters"))


_BY_MODE = "SELECT event_type, CASE WHEN value < 50 THEN upper(event_type) ELSE event_type END AS domain, value, ts FROM events"


@query(f"""WITH d AS ({_BY_MODE} UNION ALL SELECT 'x', d.n, 1.0, NULL FROM (VALUES ('Cloud'), ('CRYPTO'), ('network'), ('TLS'), ('Dependency')) AS d(n))
SELECT domain, CASE WHEN lower(domain) IN {rulebook.LIVE_DOMAINS} THEN 'Live' ELSE 'Static' END AS mode, count(*) AS n FROM d GROUP BY 1, 2""")
def domain_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tables.read(spark, sf_dir, "events").select(F.when(F.col("value") < 50, F.upper("event_type")).otherwise(F.col("event_type")).alias("domain"))
    known = catalog.dimension(spark, [(x,) for x in ("Cloud", "CRYPTO", "network", "TLS", "Dependency")], "domain string")
    mode = F.when(F.lower("domain").isin(*rulebook.LIVE_DOMAINS), "Live").otherwise("Static")
    return seen.unionByName(known).groupBy("domain", mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT event_type AS category, count(*) AS n, max(ts) AS latest, sum(value) AS total, count(*) FILTER (value > 100) AS failed FROM events GROUP BY 1)
SELECT category, n, latest, failed, round_even(100.0::DOUBLE * (n - failed) / n * 100, 0) / 100 AS compliance, CAST(row_number() OVER (ORDER BY round_even(100.0::DOUBLE * (n - failed) / n * 100, 0) / 100, category) AS INTEGER) AS position FROM s""")
def domains_by_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security domains, least compliant first, with their latest signal."""
    n, failed = F.count(F.lit(1)), F.count_if(F.col("value") > 100)
    rate = F.rint(100.0 * (n - failed) / n * 100) / 100
    found = tables.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(n.alias("n"), F.max("ts").alias("latest"), failed.alias("failed"), rate.alias("compliance"))
    place = F.row_number().over(Window.orderBy("compliance", "category"))  # one row a domain
    return found.withColumn("position", place)


@query("""WITH l AS (SELECT p_brand AS layer, list_sort(list(DISTINCT f)) AS files, min(confidence) AS confidence FROM (SELECT p_brand, unnest([p_type, p_name]) AS f, p_size / 100.0::DOUBLE AS confidence FROM part) GROUP BY 1)
SELECT layer, len(files) AS n_files, files[1] AS first_file, confidence FROM l""")
def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "part").select(F.col("p_brand").alias("layer"), F.array("p_type", "p_name").alias("files"), (F.col("p_size") / 100.0).alias("confidence"))
    return ledger.merged_layers(rows).select("layer", F.size("files").cast("long").alias("n_files"), F.get("files", F.lit(0)).alias("first_file"), "confidence")


@query("""SELECT c_mktsegment AS evaluator, count(*) AS facts, sum(CASE WHEN isfinite(v) THEN round(v) ELSE 0 END) AS total FROM
(SELECT c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 10 = 1 THEN 'Infinity'::DOUBLE ELSE c_acctbal END AS v FROM customer) GROUP BY 1""")
def finite_metric_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 10
    value = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    rows = tables.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("evaluator"), value.alias("v"))
    return rows.groupBy("evaluator").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.when(contracts.finite(F.col("v")), F.round("v")).otherwise(F.lit(0.0))).alias("total"))


@query(f"""WITH {book._MEASURED} SELECT rule_id, count(*) AS n FROM evals WHERE status = 'Violated' AND scope = 'File' AND starts_with(lower(path), 'src/f1') GROUP BY 1""")
def findings_under_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).where(F.startswith(F.lower("file"), F.lit("src/f1"))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {book._MEASURED}, b AS (SELECT lower(rule_id) AS id, category AS looked_up FROM rules) SELECT coalesce(looked_up, 'Unknown') AS category, count(*) AS findings, count(DISTINCT e.rule_id) AS rules, max({_SEVERITY}) AS worst
FROM evals e LEFT JOIN b ON lower(e.rule_id) = id WHERE status = 'Violated' GROUP BY 1""")
def findings_by_rule_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = rulebook.architecture_rules(spark).select(F.lower("rule_id").alias("id"), F.col("category").alias("looked_up"))
    met = _findings(spark, sf_dir).drop("category").join(F.broadcast(known), F.lower("rule_id") == F.col("id"), "left").join(F.broadcast(catalog.severities(spark)), "severity")
    return met.groupBy(F.coalesce("looked_up", F.lit("Unknown")).alias("category")).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("rule_id").alias("rules"), F.max("ordinal").alias("worst"))


@query("""WITH m AS (SELECT s_suppkey AS module, s_suppkey % 7 = 0 AS is_test, s_suppkey % 11 = 0 AS is_support, CASE WHEN s_suppkey % 13 = 0 THEN 'TestSupport' ELSE 'Code' END AS type, CASE WHEN s_suppkey % 17 = 0 THEN 'test' END AS kind FROM supplier),
t AS (SELECT module FROM m WHERE is_test OR is_support OR lower(type) IN ('test', 'testsupport') OR lower(coalesce(kind, '')) IN ('test', 'testsupport')),
e AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 100 + 1 AS target, CASE WHEN l_linenumber = 7 THEN 'TEST' ELSE 'Production' END AS scope FROM lineitem)
SELECT source, count(*) AS edges, count(*) FILTER (lower(scope) = 'test' OR source IN (SELECT module FROM t) OR target IN (SELECT module FROM t)) AS test_edges FROM e GROUP BY 1""")
def dependency_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    modules = tables.read(spark, sf_dir, "supplier").select(
        s.alias("module"), (s % 7 == 0).alias("is_test"), (s % 11 == 0).alias("is_support"), F.when(s % 13 == 0, "TestSupport").otherwise("Code").alias("type"), F.when(s % 17 == 0, "test").alias("kind")
    )
    scope = F.when(F.col("l_linenumber") == 7, "TEST").otherwise("Production")
    edges = tables.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100 + 1).alias("target"), scope.alias("scope")).distinct()
    return ledger.dependency_scope(edges, modules).groupBy("source").agg(F.count(F.lit(1)).alias("edges"), F.count_if("is_test").alias("test_edges"))


_FOLDERS = ["src", "Sources", "webapp", "lib64", "docs"]


@query(f"SELECT {_FOLDERS}[doc_id % 5 + 1] AS folder, regexp_matches(lower({_FOLDERS}[doc_id % 5 + 1]), '{'|'.join(ledger.SOURCE_HINTS)}') AS looks_like_source, count(*) AS n FROM documents GROUP BY ALL")
def source_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.get(F.array(*map(F.lit, _FOLDERS)), (F.col("doc_id") % 5).cast("int"))
    rows = tables.read(spark, sf_dir, "documents").select(folder.alias("folder"))
    return rows.groupBy("folder", F.lower("folder").rlike("|".join(ledger.SOURCE_HINTS)).alias("looks_like_source")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT 'src/m' || s_nationkey || '/p' || s_suppkey || '.csproj' AS project, s_suppkey, s_nationkey FROM supplier),
r AS (SELECT project, CASE s_suppkey % 4 WHEN 0 THEN '../m' || s_nationkey || '/./p' || s_suppkey || '.CSPROJ' WHEN 1 THEN '..' || chr(92) || 'm' || s_nationkey || chr(92) || 'x' || chr(92) || '..' || chr(92) || 'p' || s_suppkey || '.csproj' WHEN 2 THEN '../../../up.csproj' ELSE '../none.csproj' END AS include,
 CASE WHEN s_suppkey % 4 < 2 THEN project END AS resolved FROM p) SELECT * FROM r""")
def project_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    rows = tables.read(spark, sf_dir, "supplier").withColumn("project", F.concat(F.lit("src/m"), n, F.lit("/p"), s, F.lit(".csproj")))
    include = (
        F.when(s % 4 == 0, F.concat(F.lit("../m"), n, F.lit("/./p"), s, F.lit(".CSPROJ"))).when(s % 4 == 1, F.concat(F.lit("..\\m"), n, F.lit("\\x\\..\\p"), s, F.lit(".csproj")))
        .when(s % 4 == 2, "../../../up.csproj").otherwise("../none.csproj")
    )
    return ledger.resolved_references(rows.select("project", include.alias("include")), rows.select("project"))


@query("""WITH t AS (SELECT p_size AS project, CASE WHEN p_partkey % 3 = 0 THEN 'interface' ELSE 'class' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'I' ELSE '' END || replace(p_brand, '#', '') AS name, CASE WHEN p_partkey % 2 = 0 THEN ': I' || replace(p_brand, '#', '') END AS header FROM part),
c AS (SELECT project, name, header, EXISTS (SELECT 1 FROM t i WHERE i.kind = 'interface' AND i.project = c.project AND i.name = 'I' || c.name) AS declared FROM t c WHERE kind = 'class')
SELECT project, name, count(*) AS n, bool_and(declared) AS declared, count(*) FILTER (declared AND header IS NOT NULL) AS implementing FROM c GROUP BY 1, 2""")
def interface_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, brand = F.col("p_partkey"), F.replace("p_brand", F.lit("#"), F.lit(""))
    kind = F.when(k % 3 == 0, "interface").otherwise("class")
    types = tables.read(spark, sf_dir, "part").select(
        F.col("p_size").alias("project"), kind.alias("kind"), F.concat(F.when(k % 3 == 0, "I").otherwise(""), brand).alias("name"), F.when(k % 2 == 0, F.concat(F.lit(": I"), brand)).alias("header")
    )
    return ledger.implementations(types).groupBy("project", "name").agg(F.count(F.lit(1)).alias("n"), F.bool_and("declared").alias("declared"), F.count_if("implements").alias("implementing"))


_EVALUATORS = [("Complexity", ["C#", "Java"], [], False), ("React", [], ["React"], False), ("Repository", [], [], True), ("Naming", ["C#", "Python"], ["Razor"], False)]
_EVALUATOR_SCHEMA = "evaluator string, languages array<string>, frameworks array<string>, whole boolean"
_SCOPED = ", ".join(f"('{e}', {a or '[]::VARCHAR[]'}, {f or '[]::VARCHAR[]'}, {w})" for e, a, f, w in _EVALUATORS)


@query(f"""WITH p AS (SELECT s_name AS project, ['C#', 'Java', 'Python', 'Go'][s_suppkey % 4 + 1] AS language, CASE WHEN s_suppkey % 3 = 0 THEN ['React'] WHEN s_suppkey % 5 = 0 THEN ['Razor', 'React'] ELSE [] END AS fw FROM supplier),
e AS (SELECT * FROM (VALUES {_SCOPED}) AS e(evaluator, languages, frameworks, whole)) SELECT evaluator, project FROM e JOIN p ON NOT whole AND (list_contains(languages, language) OR list_has_any(frameworks, fw)) UNION ALL SELECT evaluator, NULL FROM e WHERE whole""")
def evaluator_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    frameworks = F.when(s % 3 == 0, F.array(F.lit("React"))).when(s % 5 == 0, F.array(F.lit("Razor"), F.lit("React"))).otherwise(none)
    language = F.get(F.array(*map(F.lit, ("C#", "Java", "Python", "Go"))), (s % 4).cast("int"))
    projects = tables.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"), language.alias("language"), frameworks.alias("project_frameworks"))
    return ledger.scopes(spark.createDataFrame(_EVALUATORS, _EVALUATOR_SCHEMA), projects)


@query("SELECT event_id, 'events' AS section, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'events', 'limit', '5' FROM events")
def policy_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('// policy\n{ /* limits, all */ "events": { "k": '), F.get_json_object("props", "$.k"), F.lit(', // one\n "limit": 5, }, }'))
    documents = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("path"), body.alias("text"))
    return ledger.policy_settings(documents).withColumnRenamed("path", "event_id")


@query("SELECT o_orderkey AS result_id, o_custkey AS report, o_orderpriority AS severity, o_totalprice AS score FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def critical_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty results of the highest severity with the highest score."""
    rows = tables.reports(spark, sf_dir).where("priority = '1-URGENT'").orderBy(F.desc("total"), "report_id").limit(50)
    return rows.select(F.col("report_id").alias("result_id"), F.col("project").alias("report"), F.col("priority").alias("severity"), F.col("total").alias("score"))


@query(f"""WITH r AS (SELECT c_custkey AS report, c_name AS name FROM customer), s AS (SELECT o_custkey AS report, count(*) AS results, min(o_orderkey) AS first_result, {_R2.format('avg(o_totalprice)')} AS mean FROM orders GROUP BY 1)
SELECT report, name, coalesce(results, 0) AS results, first_result, mean FROM r LEFT JOIN s USING (report)""")
def reports_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = tables.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("report")).agg(
        F.count(F.lit(1)).alias("results"), F.min("o_orderkey").alias("first_result"), (F.rint(F.avg("o_totalprice") * 100) / 100).alias("mean")
    )
    reports = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report"), F.col("c_name").alias("name"))
    return reports.join(results, "report", "left").withColumn("results", F.coalesce("results", F.lit(0)))


@query(f"SELECT * FROM {catalog.values_sql(ledger.CRYPTO, 'algorithm string, weak boolean', 'c')}")
def crypto_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dimension(spark, ledger.CRYPTO, "algorithm string, weak boolean")


@query("SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_type FROM part WHERE p_size > 25)")
def dependency_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.read(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("name")).union(tables.read(spark, sf_dir, "customer").select("c_mktsegment"))
    return names.union(part.where("p_size > 25").select("p_type")).distinct()


_BOTH = [(*r[:1], r[1], r[2], r[7]) for r in rulebook.ARCHITECTURE_RULES] + [r[:4] for r in rulebook.SECURITY_RULES]


@query(f"SELECT CASE WHEN regexp_matches(id, '^(SEC|ISO)-') THEN 'security' ELSE 'architecture' END AS ledger, severity, count(*) AS n FROM {catalog.values_sql(_BOTH, 'id string, name string, category string, severity string', 'b')} GROUP BY 1, 2")
def unified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rule books as one ledger, in which each lacks some of the other's columns."""
    both = ledger.unified(architecture=rulebook.architecture_rules(spark), security=rulebook.security_rules(spark).withColumnRenamed("title", "name"))
    return both.groupBy("ledger", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded history, newest first."""
    return tables.read(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query(f"""WITH {book._PROFILE} SELECT repo, 'ContextDetector' AS source, 'Project' AS scope, CAST(n_production AS DOUBLE) AS modules, domain || '/' || style || '/' || nature AS summary FROM s""")
def context_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's context as one fact with metrics and metadata, read again from its maps."""
    modules = book.modules_of(spark, sf_dir)
    context = book.profiles.repository_profile(modules)
    counts = modules.groupBy("repo").agg(F.count_if(F.col("role") == "production").cast("double").alias("n"))
    facts = context.join(counts, "repo").select(
        "repo", F.lit("ContextDetector").alias("source"), F.create_map(F.lit("ModuleCount"), "n").alias("metrics"),
        F.create_map(F.lit("EvaluationScope"), F.lit("Project"), F.lit("Domain"), "domain", F.lit("Style"), "style", F.lit("Nature"), "nature").alias("metadata"), F.lit("Context").alias("category"),
    )
    summary = F.concat_ws("/", contracts.meta("Domain"), contracts.meta("Style"), contracts.meta("Nature"))
    return facts.select("repo", "source", contracts.fact_scope().alias("scope"), F.try_element_at("metrics", F.lit("ModuleCount")).alias("modules"), summary.alias("summary"))
