"""Graph, security, lexical and inventory queries, and batch twins of the event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import catalog
from govlens.functions.expr import half_even
from govlens.operators import graph, history, lexical, security
from govlens.operators.written import written
from govlens.plans.registry import query
from govlens.sources import tables

_R2 = "round_even(({0}) * 100, 0) / 100"
_EDGES = """edges AS (SELECT c_nationkey AS source, a.r_name AS source_layer, s_nationkey AS target, b.r_name AS target_layer, count(*) AS observed
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation na ON na.n_nationkey = c_nationkey JOIN region a ON a.r_regionkey = na.n_regionkey JOIN nation nb ON nb.n_nationkey = s_nationkey JOIN region b ON b.r_regionkey = nb.n_regionkey GROUP BY ALL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed pairs: every layer may use the next one; the last layer by name has no policy."""
    names = tables.read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    after = names.select((F.col("r_regionkey") - 1).alias("r_regionkey"), F.col("r_name").alias("target_layer"))
    return names.join(after, "r_regionkey").select(F.col("r_name").alias("source_layer"), "target_layer")


@query(f"""WITH {_EDGES}, pairs AS (SELECT a.r_name AS source_layer, b.r_name AS target_layer FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1),
v AS (SELECT e.*, CASE WHEN e.source_layer = e.target_layer THEN 'Allowed' WHEN e.source_layer NOT IN (SELECT source_layer FROM pairs) THEN 'Unclassified' WHEN p.target_layer IS NOT NULL THEN 'Allowed' ELSE 'Forbidden' END AS verdict FROM edges e LEFT JOIN pairs p ON p.source_layer = e.source_layer AND p.target_layer = e.target_layer)
SELECT source, source_layer, target, target_layer, observed, verdict FROM v""")
def edge_policy_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.classify_edges(tables.edges(spark, sf_dir), _pairs(spark, sf_dir))
    return found.select("source", "source_layer", "target", "target_layer", "observed", "verdict")


@query(f"""WITH {_EDGES}, pairs AS (SELECT a.r_name AS source_layer, b.r_name AS target_layer FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1),
v AS (SELECT e.source_layer, CASE WHEN e.source_layer = e.target_layer OR p.target_layer IS NOT NULL THEN 1 ELSE 0 END AS ok FROM edges e LEFT JOIN pairs p ON p.source_layer = e.source_layer AND p.target_layer = e.target_layer WHERE e.source_layer = e.target_layer OR e.source_layer IN (SELECT source_layer FROM pairs))
SELECT source_layer, count(*) AS total, CAST(sum(ok) AS BIGINT) AS allowed, {_R2.format('100.0::DOUBLE * sum(ok) / count(*)')} AS isolation FROM v GROUP BY 1""")
def layer_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.classify_edges(tables.edges(spark, sf_dir), _pairs(spark, sf_dir)).where("verdict <> 'Unclassified'")
    ok = F.count_if(F.col("verdict") == "Allowed")
    return found.groupBy("source_layer").agg(F.count(F.lit(1)).alias("total"), ok.alias("allowed"), half_even(100.0 * ok / F.count(F.lit(1))).alias("isolation"))


@query(f"""WITH {_EDGES}, d AS (SELECT count(*) AS n_edges FROM (SELECT DISTINCT source, target FROM edges WHERE source <> target)), n AS (SELECT count(*) AS n_nodes FROM (SELECT source FROM edges UNION SELECT target FROM edges))
SELECT n_edges, n_nodes, CASE WHEN n_nodes > 1 THEN round_even(n_edges / (n_nodes * (n_nodes - 1)) * 10000, 0) / 10000 ELSE 0.0::DOUBLE END AS density FROM d, n""")
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.density(tables.edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT source_layer, count(DISTINCT target_layer) AS targets, count(DISTINCT (source, target)) AS relations FROM edges WHERE source_layer <> target_layer GROUP BY 1 HAVING count(DISTINCT target_layer) > 3")
def layer_fanout_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_out(tables.edges(spark, sf_dir), 3)


@query(f"""WITH {_EDGES}, o AS (SELECT source AS node, count(DISTINCT target) AS out_degree, sum(observed) AS out_observed FROM edges GROUP BY 1), i AS (SELECT target AS node, count(DISTINCT source) AS in_degree, sum(observed) AS in_observed FROM edges GROUP BY 1)
SELECT node, coalesce(out_degree, 0) AS out_degree, CAST(coalesce(out_observed, 0) AS BIGINT) AS out_observed, coalesce(in_degree, 0) AS in_degree, CAST(coalesce(in_observed, 0) AS BIGINT) AS in_observed FROM o FULL JOIN i USING (node)""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(tables.edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, e AS (SELECT DISTINCT source::BIGINT AS s, target::BIGINT AS t FROM edges)
SELECT s AS a, NULL::BIGINT AS b, NULL::BIGINT AS c FROM e WHERE s = t UNION ALL SELECT x.s, x.t, NULL FROM e x JOIN e y ON x.t = y.s AND y.t = x.s WHERE x.s < x.t
UNION ALL SELECT x.s, x.t, y.t FROM e x JOIN e y ON x.t = y.s JOIN e z ON y.t = z.s AND z.t = x.s WHERE x.s < x.t AND x.s < y.t AND x.t <> y.t""")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.short_cycles(tables.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 0, 0 UNION SELECT target, depth + 1 FROM walk JOIN edges ON source = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(tables.edges(spark, sf_dir).select("source", "target").distinct())  # each step of the walk reads them again
    walk = """WITH RECURSIVE walk(node, depth) AS
 (SELECT 0, 0 UNION ALL SELECT DISTINCT target, depth + 1 FROM walk JOIN {edges} ON source = node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM walk GROUP BY 1"""
    return spark.sql(walk, edges=edges)


@query(f"WITH {_EDGES} SELECT source, source_layer, target, target_layer, observed FROM edges WHERE source = 3 OR target = 3")
def edge_ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego_network(tables.edges(spark, sf_dir), 3).select("source", "source_layer", "target", "target_layer", "observed")


@query(f"""WITH {_EDGES}, l AS (SELECT source, array_to_string(list_sort(list(DISTINCT target_layer)), ' · ') AS layers FROM edges GROUP BY 1) SELECT source, layers, row_number() OVER (ORDER BY CASE WHEN layers = '' THEN 1 ELSE 0 END, lower(layers), source) AS position FROM l""")
def component_layer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layer_labels(tables.edges(spark, sf_dir))


_PATH = "'repo/' || (['src', 'src/app', 'test', 'node_modules/lib', 'obj/debug', 'docs'])[doc_id % 6 + 1] || '/' || source || '/f' || doc_id || '.' || lang"
_MODULES = [("repo", "root"), ("repo/src", "core"), ("repo/src/app", "app"), ("repo/src/app/src1", "one"), ("repo/src/app2", "sibling"), ("repo/docs", "docs"), ("lib", "outside")]


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), m AS (SELECT * FROM {catalog.values_sql(_MODULES, 'module_path string, module_name string', 'm')})
SELECT doc_id, path, max_by(module_path, length(module_path)) AS owner FROM p LEFT JOIN m ON path = module_path OR starts_with(path, module_path || '/') GROUP BY 1, 2""")
def module_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = catalog.dimension(spark, _MODULES, "module_path string, module_name string")
    return graph.owners(tables.files(spark, sf_dir).select("doc_id", "path"), modules)


@query(f"WITH m AS (SELECT * FROM {catalog.values_sql(_MODULES, 'module_path string, module_name string', 'm')} WHERE module_path <> 'repo') SELECT module_path, module_name FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE starts_with(a.module_path, b.module_path || '/'))")
def nested_root_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outermost(catalog.dimension(spark, _MODULES, "module_path string, module_name string").where("module_path <> 'repo'"))


_OF_PATH = f"""p AS (SELECT list_filter(string_split(lower(replace({_PATH}, chr(92), '/')), '/'), lambda x: x <> '') AS parts FROM documents),
r AS (SELECT parts, list_filter(parts, lambda x: list_contains({list(lexical.EXCLUDED)}, x))[1] AS hit FROM p),
q AS (SELECT parts, CASE WHEN hit = 'generated' THEN 'GeneratedCode' WHEN hit IN ('thirdparty', 'third-party', 'vendor') THEN 'VendoredCode' WHEN hit IS NOT NULL THEN 'BuildOrDependencyCache' END AS reason FROM r)"""


@query(f"""WITH {_OF_PATH}
SELECT reason, CASE reason WHEN 'GeneratedCode' THEN 'Generated' WHEN 'VendoredCode' THEN 'Vendored' WHEN 'BuildOrDependencyCache' THEN 'DependencyOrBuildCache'
 ELSE CASE WHEN list_has_any(parts, {list(lexical.TESTS)}) THEN 'Test' WHEN list_has_any(parts, {list(lexical.EXAMPLES)}) THEN 'Example' ELSE 'FirstParty' END END AS ownership, count(*) AS n FROM q GROUP BY 1, 2""")
def exclusion_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return tables.files(spark, sf_dir).groupBy(lexical.exclusion_reason(path).alias("reason"), lexical.ownership(path).alias("ownership")).agg(F.count(F.lit(1)).alias("n"))


_PATTERNS = [("secret", "(secret|token|api_key)", 4), ("long-number", "[0-9]{13,19}", 3), ("address", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 2), ("mail", "[A-Za-z0-9._]+@[A-Za-z0-9.]+", 2), ("license", "Licensed under", 0), ("shouting", "[A-Z]{4,}!!", 1)]
_HITS = f"""hits AS (SELECT doc_id, source AS category, unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN struct_pack(rule_id := '{i}', ordinal := {s}) END" for i, p, s in _PATTERNS)}], lambda x: x IS NOT NULL), recursive := true) FROM documents)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.pattern_hits(tables.files(spark, sf_dir).withColumnRenamed("module", "category"), "text", _PATTERNS, ["doc_id", "category"])


@query(f"WITH {_HITS} SELECT doc_id, category, rule_id, ordinal FROM hits")
def regex_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


@query(f"WITH {_HITS} SELECT rule_id, ordinal, count(*) AS n, count(DISTINCT category) AS categories FROM hits GROUP BY 1, 2")
def regex_rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("rule_id", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("categories"))


_SIGNALS = """signals AS (SELECT event_id, ts, user_id, lower(event_type) AS category, value AS score, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
findings AS (SELECT event_id, category, unnest(list_filter([CASE WHEN category = 'error' AND score > 150 THEN struct_pack(finding := 'costly error', ordinal := 4) END, CASE WHEN score > 200 THEN struct_pack(finding := 'high score', ordinal := 3) END,
 CASE WHEN k % 10 = 7 THEN struct_pack(finding := 'odd key', ordinal := 2) END, CASE WHEN score < 0.5 THEN struct_pack(finding := 'tiny score', ordinal := 1) END, CASE WHEN category = 'view' AND k < 3 THEN struct_pack(finding := 'rare view', ordinal := 0) END], lambda x: x IS NOT NULL), recursive := true) FROM signals)"""


def _signal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, k = F.col("category"), F.col("score"), F.col("k")
    predicates = [("costly error", (c == "error") & (s > 150), 4), ("high score", s > 200, 3), ("odd key", k % 10 == 7, 2), ("tiny score", s < 0.5, 1), ("rare view", (c == "view") & (k < 3), 0)]
    return security.heuristics(tables.signals(spark, sf_dir), predicates, ["event_id", "category"])


_SECURITY_DOMAINS = ["view", "click", "error", "purchase", "signup", "network"]
_COMPLIANCE = f"""{_SIGNALS}, d AS (SELECT * FROM (VALUES {", ".join(f"('{d}')" for d in _SECURITY_DOMAINS)}) AS d(category)), f AS (SELECT category, count(*) AS total, count(*) FILTER (ordinal >= 2) AS failed, max(ordinal) AS max_severity FROM findings GROUP BY 1),
compliance AS (SELECT category, coalesce(total, 0) AS total, coalesce(failed, 0) AS failed, coalesce(max_severity, 0) AS max_severity, CASE WHEN total IS NULL THEN 100.0::DOUBLE ELSE {_R2.format('100.0::DOUBLE * (total - failed) / total')} END AS rate, coalesce(failed, 0) = 0 AS compliant FROM d LEFT JOIN f USING (category))"""


@query(f"WITH {_SIGNALS} SELECT event_id, category, finding, ordinal FROM findings")
def signal_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal_findings(spark, sf_dir)


def _compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.domain_compliance(_signal_findings(spark, sf_dir), catalog.dimension(spark, [(d,) for d in _SECURITY_DOMAINS], "category string"))


@query(f"WITH {_COMPLIANCE} SELECT * FROM compliance")
def domain_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compliance(spark, sf_dir)


@query(f"""WITH {_COMPLIANCE} SELECT count(*) AS domains, CAST(sum(total) AS BIGINT) AS total, CAST(sum(failed) AS BIGINT) AS failed, {_R2.format('avg(rate)')} AS compliance, max(max_severity) AS max_severity, (['Information', 'Low', 'Moderate', 'High', 'Severe'])[max(max_severity) + 1] AS risk, bool_and(compliant) AS all_compliant FROM compliance""")
def scan_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.scan_risk(_compliance(spark, sf_dir), catalog.RISKS)


@query(f"""WITH {_SIGNALS}, r AS (SELECT count(*)::DOUBLE AS total, (count(*) FILTER (ordinal = 4))::DOUBLE AS critical, (count(*) FILTER (ordinal = 3))::DOUBLE AS high, (count(*) FILTER (ordinal = 2))::DOUBLE AS medium, count(DISTINCT category)::DOUBLE AS domains, max(ordinal)::DOUBLE AS worst, {_R2.format('avg(ordinal)')} AS average FROM findings)
UNPIVOT r ON COLUMNS(*) INTO NAME key VALUE value""")
def governance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.governance_rollup(_signal_findings(spark, sf_dir))


@query("SELECT * FROM (VALUES ('critical findings', 4), ('many high findings', 3), ('low average or no data', 2)) AS t(finding, ordinal)")
def governance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.governance_findings(security.governance_rollup(_signal_findings(spark, sf_dir)))


_TLS = "SELECT s_suppkey AS host, (['Ssl3', 'Tls', 'Tls12', 'Tls13'])[s_suppkey % 4 + 1] AS protocol, CASE s_suppkey % 5 WHEN 0 THEN 'TLS_RSA_WITH_3DES' WHEN 1 THEN 'aes_gcm' WHEN 2 THEN 'rc4-sha' WHEN 3 THEN 'chacha20' END AS cipher, CASE WHEN s_suppkey % 6 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (s_suppkey % 60 - 10) END AS expires, CASE WHEN s_suppkey % 7 = 0 THEN 1024 ELSE 4096 END AS key_bits, CASE WHEN s_suppkey % 9 = 0 THEN 'timeout' END AS error FROM supplier"


@query(f"""WITH t AS ({_TLS}) SELECT host, unnest(list_filter([CASE WHEN protocol IN ('Ssl2', 'Ssl3') THEN struct_pack(finding := 'broken protocol', ordinal := 4) END, CASE WHEN protocol IN ('Tls', 'Tls10', 'Tls11') THEN struct_pack(finding := 'old protocol', ordinal := 3) END, CASE WHEN regexp_matches(upper(cipher), 'NULL|EXPORT|RC4|MD5|DES') THEN struct_pack(finding := 'weak cipher', ordinal := 4) END,
 CASE WHEN expires IS NULL THEN struct_pack(finding := 'no certificate', ordinal := 3) END, CASE WHEN expires <= TIMESTAMP '2024-01-01' THEN struct_pack(finding := 'expired', ordinal := 4) END, CASE WHEN expires > TIMESTAMP '2024-01-01' AND expires <= TIMESTAMP '2024-01-31' THEN struct_pack(finding := 'expires soon', ordinal := 2) END,
 CASE WHEN key_bits < 2048 THEN struct_pack(finding := 'short key', ordinal := 3) END, CASE WHEN error IS NOT NULL THEN struct_pack(finding := 'probe error', ordinal := 1) END], lambda x: x IS NOT NULL), recursive := true) FROM t""")
def tls_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = tables.read(spark, sf_dir, "supplier").select(
        k.alias("host"), F.element_at(F.array(*map(F.lit, ("Ssl3", "Tls", "Tls12", "Tls13"))), (k % 4 + 1).cast("int")).alias("protocol"),
        F.when(k % 5 == 0, "TLS_RSA_WITH_3DES").when(k % 5 == 1, "aes_gcm").when(k % 5 == 2, "rc4-sha").when(k % 5 == 3, "chacha20").alias("cipher"),
        F.when(k % 6 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60 - 10).cast("int"))).cast("timestamp").alias("expires"), F.when(k % 7 == 0, 1024).otherwise(4096).alias("key_bits"), F.when(k % 9 == 0, "timeout").alias("error"),
    )
    return security.tls_findings(rows, "2024-01-01 00:00:00")


@query("""WITH p AS (SELECT event_id AS host, (ARRAY[80, 5432, 443, 23, 8080])[k % 5 + 1] AS port, k % 3 = 0 AS is_open, CAST(floor(score * 5) AS BIGINT) AS latency_ms, CASE WHEN k = 11 THEN 'refused' END AS error FROM (SELECT event_id, value AS score, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
SELECT host, port, unnest(list_filter([CASE WHEN is_open AND port IN (21, 23, 445, 3389, 5432, 27017) THEN struct_pack(finding := 'critical port', ordinal := 4) END, CASE WHEN is_open AND latency_ms > 500 THEN struct_pack(finding := 'slow port', ordinal := 2) END, CASE WHEN error IS NOT NULL THEN struct_pack(finding := 'probe error', ordinal := 1) END], lambda x: x IS NOT NULL), recursive := true) FROM p""")
def port_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = tables.signals(spark, sf_dir).select(F.col("event_id").alias("host"), F.element_at(F.array(*map(F.lit, (80, 5432, 443, 23, 8080))), k % 5 + 1).alias("port"), (k % 3 == 0).alias("is_open"), F.floor(F.col("score") * 5).alias("latency_ms"), F.when(k == 11, "refused").alias("error"))
    return security.port_findings(rows)


_DECISIONS = "([?!]|( |^)(for|if|or|on|les|ou|der|de)( |,))"


@query(f"""WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '{_DECISIONS}')) AS decisions, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents)
SELECT doc_id, decisions, n_lines, {_R2.format('greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - decisions * 2.0::DOUBLE - greatest(0, n_lines - 500) * 0.02::DOUBLE))')} AS score FROM m""")
def document_maintainability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.maintainability(tables.files(spark, sf_dir), _DECISIONS).select("doc_id", "decisions", "n_lines", "score")


@query(f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), f AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
c AS (SELECT host, count(*) AS routes, count(*) FILTER (regexp_matches(path, '[A-Z]')) AS upper, count(*) FILTER (regexp_matches(path, '[^/]') AND ends_with(path, '/')) AS slashed, count(*) FILTER (len(list_distinct(parts)) < len(parts)) AS repeated, count(*) FILTER (NOT regexp_matches(path, '/(en|fr|de|es)/')) AS unversioned FROM f GROUP BY 1)
SELECT *, {_R2.format('0.35::DOUBLE * greatest(0, 100 - 100.0::DOUBLE * upper / routes) + 0.15::DOUBLE * greatest(0, 100 - 100.0::DOUBLE * slashed / routes) + 0.15::DOUBLE * greatest(0, 100 - 100.0::DOUBLE * repeated / routes) + 0.20::DOUBLE * greatest(0, 100 - 100.0::DOUBLE * unversioned / routes) + 15.0::DOUBLE')} AS score FROM c""")
def route_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.route_consistency(tables.read(spark, sf_dir, "pages"))


def _step(c: str, cuts: tuple[int, int, int]) -> str:
    return f"CASE WHEN {c} <= {cuts[0]} THEN 100.0::DOUBLE WHEN {c} <= {cuts[1]} THEN 75.0::DOUBLE WHEN {c} <= {cuts[2]} THEN 50.0::DOUBLE ELSE 25.0::DOUBLE END"


@query(f"""WITH c AS (SELECT page_id, {", ".join(f"len(regexp_extract_all(html, '<{t}[ >]')) AS {n}" for t, n in (("p", "paragraphs"), ("a", "links"), ("b", "bold"), ("script", "scripts")))}, length(html) AS size FROM pages),
s AS (SELECT *, {_step("paragraphs", (5, 15, 40))} AS complexity, CASE WHEN scripts = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - 15.0::DOUBLE * scripts) END AS separation, {_step("links", (6, 12, 24))} AS composition FROM c)
SELECT *, {_R2.format('0.5::DOUBLE * complexity + 0.3::DOUBLE * separation + 0.2::DOUBLE * composition')} AS index FROM s""")
def markup_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.markup_scores(tables.read(spark, sf_dir, "pages"))


_CONVENTIONS = [("type", "^[A-Z]+ [A-Z]+$|^ECONOMY$"), ("constant", "^Brand#1[0-9]$"), ("variable", "^[a-z].*[a-z]$"), ("file", "^part")]


@query(f"""WITH n AS (SELECT p_size AS module, unnest([struct_pack(kind := 'type', name := p_type), struct_pack(kind := 'constant', name := p_brand), struct_pack(kind := 'variable', name := p_name)], recursive := true) FROM part),
s AS (SELECT module, kind, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (CASE kind {" ".join(f"WHEN '{k}' THEN regexp_matches(name, '{p}')" for k, p in _CONVENTIONS)} END) / count(*) AS share FROM n GROUP BY 1, 2)
SELECT module, CAST(sum(n) AS BIGINT) AS names, {_R2.format("sum(share * w) / sum(w)")} AS compliance FROM (SELECT *, CASE kind WHEN 'type' THEN 0.25::DOUBLE WHEN 'variable' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS w FROM s) GROUP BY 1""")
def naming_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.read(spark, sf_dir, "part").selectExpr("p_size as module", "stack(3, 'type', p_type, 'constant', p_brand, 'variable', p_name) as (kind, name)")
    return lexical.naming_compliance(names, _CONVENTIONS, "module")


@query(f"""SELECT conv_id, count(*) AS n_lines, {_R2.format("(0.5::DOUBLE * (100.0::DOUBLE * count(*) FILTER (regexp_matches(text, '[:=|]')) / count(*))) + (0.25::DOUBLE * (100.0::DOUBLE * count(*) FILTER (regexp_matches(text, '^[A-ZÀ-Þ]')) / count(*))) + (0.25::DOUBLE * (100.0::DOUBLE * count(*) FILTER (length(text) <= 400) / count(*)))")} AS score FROM conversations GROUP BY 1""")
def logging_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.logging_quality(tables.read(spark, sf_dir, "conversations"), "conv_id")


@query(f"""SELECT source AS module, count(*) AS n_files, CAST(sum(len(regexp_extract_all(text, '(todo|[?!]|###)'))) AS BIGINT) AS marks, {_R2.format("1000.0::DOUBLE * sum(len(regexp_extract_all(text, '(todo|[?!]|###)'))) / sum(length(text))")} AS per_thousand FROM documents GROUP BY 1""")
def todo_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.files(spark, sf_dir).select("module", lexical.count_of(F.col("text"), "(todo|[?!]|###)").alias("m"), F.length("text").alias("n"))
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"), F.sum("m").alias("marks"), half_even(1000.0 * F.sum("m") / F.sum("n")).alias("per_thousand"))


@query("SELECT m.module, a.artifact FROM (SELECT DISTINCT source AS module FROM documents) m, (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) AS a(artifact) WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = m.module AND d.lang = a.artifact)")
def required_artifacts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir)
    required = catalog.dimension(spark, [(x,) for x in ("en", "fr", "de", "es", "it")], "artifact string")
    return files.select("module").distinct().join(F.broadcast(required)).join(files.select("module", F.col("lang").alias("artifact")), ["module", "artifact"], "left_anti")


@query("SELECT conv_id, count(*) AS declared, count(*) FILTER (before = 'user') AS documented FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = 'assistant' GROUP BY 1")
def doc_coverage_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.preceded(tables.read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "assistant", "user")


_VERSION = "CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'latest' WHEN 2 THEN '^' || k WHEN 3 THEN k || '.x' WHEN 4 THEN 'git+ssh' WHEN 5 THEN ' ' WHEN 6 THEN '~1' ELSE k || '.0.1' END"


@query(f"""WITH s AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), v AS (SELECT event_type, {_VERSION} AS version FROM s)
SELECT event_type, count(*) AS declared, count(*) FILTER (version IS NULL OR trim(version) = '' OR lower(trim(version)) = 'latest' OR regexp_matches(trim(version), '^[~^><=]') OR regexp_matches(trim(version), '[*x]') OR regexp_matches(trim(version), '^(git|http|file|link|workspace):')) AS unpinned FROM v GROUP BY 1""")
def manifest_unpinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = tables.read(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("name", "k"))
    versions = entries.withColumn("k", F.col("k").cast("int")).withColumn("version", F.expr(_VERSION))
    return versions.groupBy("event_type").agg(F.count(F.lit(1)).alias("declared"), F.count_if(lexical.unpinned(F.col("version"))).alias("unpinned"))


_EDITED, _REMOVED = 13, 17


@query(f"""WITH e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), c AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id AS log_id, count(*) AS entries, count(*) FILTER (before = {_REMOVED}) AS broken_links, count(*) FILTER (k = {_EDITED}) AS changed, count(*) FILTER (before = {_REMOVED} OR k = {_EDITED}) = 0 AS intact
FROM c WHERE k IS DISTINCT FROM {_REMOVED} GROUP BY 1""")
def audit_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored logs of which entries with one number were edited after hashing and those with another removed."""
    rows = tables.signals(spark, sf_dir).select(
        F.col("user_id").alias("log_id"), F.col("event_id").alias("sequence"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("k").cast("string").alias("probe_id"),
        F.col("category").alias("target"), F.lit("probe").alias("action"), F.lit("ok").alias("outcome"), F.when(F.col("k") % 2 == 0, F.col("props")).alias("detail"),
    )
    kept = history.chain(rows).where(~F.col("probe_id").eqNullSafe(str(_REMOVED)))
    edited = kept.withColumn("outcome", F.when(F.col("probe_id") == str(_EDITED), F.lit("edited")).otherwise(F.col("outcome")))
    return history.verify_chain(edited)


@query("""WITH w AS (SELECT user_id, min(ts) + INTERVAL 1 DAY AS lo, max(ts) - INTERVAL 1 DAY AS hi FROM events GROUP BY 1) SELECT e.user_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events e JOIN w USING (user_id) WHERE ts BETWEEN lo AND hi GROUP BY 1""")
def authorized_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.signals(spark, sf_dir).select("event_id", "ts", "user_id")
    windows = rows.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("lo"), (F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("hi"))
    return history.within(rows, windows, "ts", "lo", "hi", ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("SELECT n_name AS target, p.probe FROM nation, (VALUES ('port'), ('tls'), ('http')) AS p(probe) WHERE NOT (p.probe = 'http' AND n_regionkey = 0)")
def target_probe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = catalog.dimension(spark, [(p,) for p in ("port", "tls", "http")], "probe string")
    nation = tables.read(spark, sf_dir, "nation").select(F.col("n_name").alias("target"), "n_regionkey")
    return nation.join(F.broadcast(probes), ~((F.col("probe") == "http") & (F.col("n_regionkey") == 0))).select("target", "probe")


@query(f"SELECT c_nationkey AS module, {_R2.format('avg((c_acctbal + c_custkey + c_nationkey) / 3)')} AS mean_confidence, coalesce(median(c_acctbal), 0) AS median_score FROM customer GROUP BY 1")
def median_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "customer")
    return rows.groupBy(F.col("c_nationkey").alias("module")).agg(half_even(F.avg((F.col("c_acctbal") + F.col("c_custkey") + F.col("c_nationkey")) / 3)).alias("mean_confidence"), F.coalesce(F.median("c_acctbal"), F.lit(0.0)).alias("median_score"))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE (lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%' OR lower(p_type) LIKE '%1%' OR len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), '1'))) > 0) AND p_size >= 25")
def findings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "part").where("p_size >= 25").withColumn("evidence", F.split("p_name", " "))
    return lexical.search(rows, "1", ["p_name", "p_brand", "p_type"], ["evidence"]).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""WITH l AS (SELECT l_orderkey, list(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, len(q) AS n, CASE WHEN len(list_filter(q, lambda x: x <= 1)) = 0 THEN round(100.0::DOUBLE * len(list_filter(q, lambda x: x > 25)) / len(q)) END AS share FROM l""")
def array_ratio_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    valid, share = F.forall("q", lambda x: x > 1), F.round(100.0 * F.size(F.filter("q", lambda x: x > 25)) / F.size("q"))
    return rows.select("l_orderkey", F.size("q").cast("long").alias("n"), lexical.all_or_nothing(F.col("q"), valid, share).alias("share"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS opened, event_type, count(*) AS n, max(value) AS highest FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))
    return found.select(F.col("w.start").alias("opened"), "event_type", "n", "highest")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 6 HOUR AS closed, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")
