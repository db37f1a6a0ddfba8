"""Context detection, applicability, conventions, rule matching and scope checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import catalog
from govlens.operators import context
from govlens.plans.registry import query
from govlens.sources import tables

_ORDER = [("Spanish", "es"), ("German", "de"), ("French", "fr"), ("English", "en")]


@query(f"""WITH f AS (SELECT CASE WHEN doc_id % 7 = 0 THEN source ELSE source || '-' || lang END AS module, lang AS ext FROM documents)
SELECT module, CASE {" ".join(f"WHEN bool_or(ext = '{e}') THEN '{n}'" for n, e in _ORDER)} ELSE 'Unknown' END AS language, count(DISTINCT ext) AS languages, count(*) AS n_files FROM f GROUP BY 1""")
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir).withColumn("module", F.when(F.col("doc_id") % 7 == 0, F.col("module")).otherwise(F.concat_ws("-", "module", "lang")))
    return context.detect_language(files, "module", _ORDER)


_HINTS = [("lavender", "Domain"), ("blue", "Domain"), ("green", "Infrastructure"), ("red", "Presentation"), ("part", "Application"), ("economy", "Domain"), ("small", "Presentation"), ("standard", "Infrastructure"), ("brand", "Application")]


@query(f"""WITH h AS (SELECT * FROM {catalog.values_sql(_HINTS, 'word string, layer string', 'h')}), w AS (SELECT p_partkey AS id, unnest(string_split_regex(lower(p_type || ' ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END), '[^a-z]+')) AS word FROM part)
SELECT id, count(DISTINCT layer) AS candidates, min(layer) AS layer, CASE WHEN count(DISTINCT layer) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM w JOIN h USING (word) GROUP BY 1""")
def detected_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")).alias("name"))
    return context.detect_layers(names, catalog.dimension(spark, _HINTS, "word string, layer string"))


_CONVENTIONS = [(None, None, "any"), ("EN", None, "english"), ("fr", None, "french"), ("en", "src1", "english-one"), (None, "src2", "two")]
_CONVENTION_SCHEMA = "c_language string, c_framework string, convention string"


@query(f"""WITH c AS (SELECT * FROM {catalog.values_sql(_CONVENTIONS, _CONVENTION_SCHEMA, 'c')}), m AS (SELECT doc_id AS id, lang AS language, source AS framework, convention, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN c_framework IS NOT NULL THEN 0 WHEN c_language IS NOT NULL THEN 1 ELSE 2 END, convention) AS k
 FROM documents JOIN c ON (c_language IS NULL OR lower(c_language) = lower(lang)) AND (c_framework IS NULL OR lower(c_framework) = lower(source))) SELECT id, language, framework, convention FROM m WHERE k = 1""")
def naming_convention_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("framework"))
    return context.convention_for(items, catalog.dimension(spark, _CONVENTIONS, _CONVENTION_SCHEMA))


_CONTRACTS = [("length", False, ["src0", "src1", "src2", "src3"], None), ("quality", False, ["src0", "src9"], "en"), ("old", True, ["src0"], None)]


@query("""WITH f AS (SELECT source AS producer, lang AS language, doc_id % 4 AS declarations, unnest(['length', 'quality', 'old', 'other']) AS metric_key FROM documents),
v AS (SELECT metric_key, CASE WHEN metric_key = 'old' THEN 'unsupported rule' WHEN metric_key = 'length' AND producer NOT IN ('src0', 'src1', 'src2', 'src3') OR metric_key = 'quality' AND producer NOT IN ('src0', 'src9') THEN 'producer not allowed' WHEN metric_key = 'quality' AND language <> 'en' THEN 'other language' WHEN declarations = 0 THEN 'no declarations' ELSE 'applicable' END AS verdict FROM f WHERE metric_key <> 'other')
SELECT metric_key, verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def fact_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    facts = docs.select(F.col("source").alias("producer"), F.col("lang").alias("language"), (F.col("doc_id") % 4).alias("declarations"), F.explode(F.array(*map(F.lit, ("length", "quality", "old", "other")))).alias("metric_key"))
    contracts = catalog.dimension(spark, _CONTRACTS, "metric_key string, unsupported boolean, producers array<string>, only_language string")
    return context.fact_applicability(facts, contracts).groupBy("metric_key", "verdict").agg(F.count(F.lit(1)).alias("n"))


_SECURITY_RULES = [
    {"rule_id": "E-1", "category": "Error", "ordinal": 4, "pattern": "7[0-9]}", "min_score": 9.0, "max_score": 10.0},
    {"rule_id": "E-2", "category": "error", "ordinal": 2, "artifacts": ['"K": 1']},
    {"rule_id": "V-1", "category": "view", "ordinal": 1, "tags": ["k"], "pattern": "never"},
    {"rule_id": "C-1", "category": "click", "ordinal": 3, "tags": ["absent"], "artifacts": ["99"]},
]


@query("""WITH s AS (SELECT event_id, lower(event_type) AS category, props AS evidence FROM events) SELECT event_id, unnest(list_filter([CASE WHEN category = 'error' AND regexp_matches(evidence, '7[0-9]}') THEN struct_pack(rule_id := 'E-1', ordinal := 4, score := 9.5::DOUBLE) END, CASE WHEN category = 'error' AND contains(lower(evidence), '"k": 1') THEN struct_pack(rule_id := 'E-2', ordinal := 2, score := 4.0::DOUBLE) END,
 CASE WHEN category = 'view' THEN struct_pack(rule_id := 'V-1', ordinal := 1, score := 2.0::DOUBLE) END, CASE WHEN category = 'click' AND contains(evidence, '99') THEN struct_pack(rule_id := 'C-1', ordinal := 3, score := 7.0::DOUBLE) END], lambda x: x IS NOT NULL), recursive := true) FROM s""")
def signal_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.signals(spark, sf_dir).select("event_id", "category", F.col("props").alias("evidence"), F.from_json("props", "map<string,string>").alias("metadata"))
    return context.match_signals(rows, _SECURITY_RULES, ["event_id"])


@query("""WITH d AS (SELECT conv_id, count(*) AS declared, string_agg(CASE WHEN turn % 3 > 0 THEN role || '; ' || (turn % 4) ELSE ' ' END, ';' ORDER BY turn) AS details FROM conversations GROUP BY 1), l AS (SELECT *, len(list_distinct(list_filter(list_transform(string_split(details, ';'), lambda x: trim(x)), lambda x: x <> ''))) AS listed FROM d)
SELECT conv_id, declared, listed, greatest(0, declared - listed) AS truncated FROM l""")
def diagnostics_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "conversations").withColumn("d", F.when(F.col("turn") % 3 > 0, F.concat("role", F.lit("; "), (F.col("turn") % 4).cast("string"))).otherwise(" "))
    told = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("declared"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "d"))), lambda x: x["d"]), ";").alias("details"))
    return context.reconcile(told).select("conv_id", "declared", F.col("listed").cast("long").alias("listed"), F.col("truncated").cast("long").alias("truncated"))


@query("""WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS owner, c_custkey % 11 AS lo, c_custkey % 13 AS hi, list_filter([CASE WHEN c_custkey % 3 = 0 THEN '*.example' END, CASE WHEN c_custkey % 4 > 0 THEN 'host' END], lambda x: x IS NOT NULL) AS targets FROM customer),
i AS (SELECT id, list_filter([CASE WHEN coalesce(trim(owner), '') = '' THEN 'no owner' END, CASE WHEN hi < lo THEN 'window ends before it begins' END, CASE WHEN 6 < lo THEN 'not yet valid' END, CASE WHEN 6 > hi THEN 'expired' END, CASE WHEN len(targets) = 0 THEN 'no targets' END, CASE WHEN len(list_filter(targets, lambda t: contains(t, '*'))) > 0 THEN 'wildcard target' END], lambda x: x IS NOT NULL) AS issues FROM s)
SELECT id, array_to_string(issues, ', ') AS issues, len(issues) = 0 AS accepted FROM i""")
def live_scope_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    scopes = tables.read(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "").when(k % 5 == 1, F.lit(None)).otherwise(F.col("c_name")).alias("owner"), (k % 11).alias("valid_from"), (k % 13).alias("valid_until"),
        F.filter(F.array(F.when(k % 3 == 0, "*.example"), F.when(k % 4 > 0, "host")), lambda x: x.isNotNull()).alias("targets"),
    )
    return context.scope_issues(scopes, F.lit(6)).select("id", F.array_join("issues", ", ").alias("issues"), "accepted")


@query("""SELECT event_type, CASE WHEN value >= CASE lower(event_type) WHEN 'error' THEN 90 WHEN 'view' THEN 70 WHEN 'click' THEN 40 ELSE 1e-300 END THEN 'breach' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2""")
def breach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = catalog.dimension(spark, [("error", 90.0), ("view", 70.0), ("click", 40.0)], "category string, least double")
    rows = tables.read(spark, sf_dir, "events").join(F.broadcast(limits), F.lower("event_type") == F.col("category"), "left")
    breach = F.when(F.col("least").isNull(), F.col("value") > 0).otherwise(F.col("value") >= F.col("least"))
    return rows.groupBy("event_type", F.when(breach, "breach").otherwise("ok").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_nationkey AS module, count(DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'Domain' WHEN s_suppkey % 6 = 1 THEN 'Application' END) AS roles, count(DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'Domain' WHEN s_suppkey % 6 = 1 THEN 'Application' END) >= 2 AS layered FROM supplier GROUP BY 1""")
def layer_model_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("module"), F.when(k % 3 == 0, "Domain").when(k % 6 == 1, "Application").alias("role"))
    return rows.groupBy("module").agg(F.countDistinct("role").alias("roles")).withColumn("layered", F.col("roles") >= 2)
