"""Whole facts meet the rule book: scope, evidence, completeness, units and producers, and findings with message and lines.

A fact is (fact_id, source, target, category, project, file, line, evidence, metrics, metadata): what one evaluator measured of
one file or project, with its metrics by name and free metadata. Names compare without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.expr import breaches, finite
from govlens.rulebook import UNITS

FACT_SCHEMA = (
    "fact_id long, source string, target string, category string, project string, file string, line int, evidence string, "
    "metrics map<string,double>, metadata map<string,string>"
)
#: The category of facts about whole projects, and statuses of an analysis that isn't complete.
SUMMARY = "architecturesummary"
UNFINISHED = ("incomplete", "partial", "completedwithdiagnostics")


def meta(key: str | Column) -> Column:
    return F.try_element_at("metadata", F.lit(key) if isinstance(key, str) else key)


def filled(text: Column) -> Column:
    """The text, or null where it is blank."""
    return F.when(F.trim(text) != "", text)


def fact_scope() -> Column:
    """Project or File: as the metadata says, else by category."""
    said = F.lower(meta("EvaluationScope"))
    return F.when(said == "project", "Project").when(said == "file", "File").when(F.lower("category") == SUMMARY, "Project").otherwise("File")


def incomplete() -> Column:
    return F.coalesce(F.lower(meta("AnalysisComplete")) == "false", F.lit(False)) | F.coalesce(F.lower(meta("AnalysisStatus")).isin(*UNFINISHED), F.lit(False))


def evidence_path() -> Column:
    return F.coalesce(filled(F.col("file")), filled(meta("FilePath")))


def has_evidence(metric: Column, scope: Column) -> Column:
    """Whether a violation of this metric can be traced.

    Evidence or a snippet of the metric itself counts, and so does the fact's own evidence if it has no other metric. A file
    metric also needs a path, and a line unless its evidence is the file's name or its metrics as a whole.
    """
    of = lambda kind: meta(F.concat(F.lit(f"{kind}."), metric))
    own = (filled(of("Evidence")).isNotNull()) | (filled(of("CodeSnippet")).isNotNull())
    generic = filled(F.coalesce(F.col("evidence"), meta("Evidence"))).isNotNull() & (F.size("metrics") == 1)
    whole = F.coalesce(F.lower(of("EvidenceScope")).isin("filename", "filemetrics"), F.lit(False))
    at_line = F.coalesce(of("EvidenceLine").try_cast("int") > 0, F.lit(False))
    in_file = F.when(whole | at_line, own).otherwise(generic & F.coalesce(F.col("line") > 0, F.lit(False)))
    in_project = F.coalesce(F.lower(meta("AnalysisComplete")) != "false", F.lit(True))
    return (own | generic) & F.when(scope == "Project", in_project).otherwise(evidence_path().isNotNull() & in_file)


def unit_holds() -> Column:
    """Whether metric, unit, comparison, value and threshold of a rule with a unit are what it was verified for."""
    holds = F.lit(True)
    for rule, metric, unit, op, least, lowest, highest in UNITS:
        top = F.lit(True) if highest is None else F.col("threshold") <= highest
        said = F.coalesce(meta(f"MetricUnit.{metric}") == unit, F.lit(False))
        sound = (F.col("metric_key") == metric) & (F.col("op") == op) & said & (F.col("metric_value") >= least) & (F.col("threshold") >= lowest) & top
        holds = F.when(F.endswith(F.col("rule_id"), F.lit(rule)), sound).otherwise(holds)
    return F.coalesce(holds, F.lit(False))


def applicable(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per fact, rule and metric that the rule reads: of its scope, by a producer declared for it.

    A metric's exact spelling wins; without one, another spelling counts if there is only one.
    """
    known = rules.where("producers IS NOT NULL").select("rule_id", "name", F.col("category").alias("rule_category"), "scope", "metric_key", "op", "threshold", "severity", "producers")
    keys = F.transform(F.map_keys("metrics"), lambda k: F.lower(k))
    seen = facts.withColumn("fact_scope", fact_scope()).withColumn("keys", keys).withColumn("names", F.map_keys("metrics"))
    seen = seen.select("*", F.explode("metrics").alias("spelling", "metric_value"))
    met = seen.join(F.broadcast(known), (F.lower("spelling") == F.lower("metric_key")) & (F.col("fact_scope") == F.col("scope")))  # a rule book is small
    spellings = F.size(F.filter("keys", lambda k: k == F.lower("metric_key")))
    chosen = (F.col("spelling") == F.col("metric_key")) | ((spellings == 1) & ~F.array_contains("names", F.col("metric_key")))
    return met.where(chosen & F.array_contains("producers", F.lower("source"))).drop("keys", "names", "producers", "spelling")


def evaluate(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Applicable facts with their status: Skipped, InsufficientEvidence, Passed or Violated."""
    violated = breaches(F.col("op"), F.col("metric_value"), F.col("threshold"))
    status = (
        F.when(~(finite(F.col("metric_value")) & finite(F.col("threshold"))) | ~unit_holds(), "Skipped").when(incomplete(), "InsufficientEvidence")
        .when(~violated, "Passed").when(has_evidence(F.col("metric_key"), F.col("scope")), "Violated").otherwise("InsufficientEvidence")
    )
    return applicable(facts, rules).withColumn("status", status)


def _number(x: Column) -> Column:
    """At most two digits behind the point, none that are zero."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.round(x, 2)), "0+$", ""), r"\.$", "")


def findings(evaluations: DataFrame) -> DataFrame:
    """Violations as findings: where, what, and the lines of evidence."""
    of = lambda kind: meta(F.concat(F.lit(f"{kind}."), F.col("metric_key")))
    project = F.col("scope") == "Project"
    lines = F.transform(F.split(F.coalesce(of("Evidence"), F.col("evidence"), F.lit("")), "\r?\n"), lambda x: F.trim(x))
    message = F.concat(F.lit("["), "source", F.lit("] Metric '"), "metric_key", F.lit("' = "), _number(F.col("metric_value")), F.lit(", threshold = "), _number(F.col("threshold")), F.lit("."))
    line = F.coalesce(of("EvidenceLine").try_cast("int"), F.when(F.size("metrics") == 1, F.col("line")))
    return evaluations.where("status = 'Violated'").select(
        "fact_id", "rule_id", "name", F.col("rule_category").alias("category"), "severity", message.alias("message"), F.col("source").alias("detected_by"),
        F.when(project, "").otherwise(F.coalesce(evidence_path(), F.lit(""))).alias("file"),
        F.when(project, F.coalesce("project", "target")).otherwise(F.col("target")).alias("target"),
        F.when(~project, line).alias("line"), F.coalesce(of("CodeSnippet"), F.lit("")).alias("snippet"),
        F.filter(lines, lambda x: x != "").alias("evidence"), meta("Namespace").alias("namespace"),
    )


def documentation_gates(facts: DataFrame, by: list[str], producer: str = "DocumentationEvaluator", metric: str = "DocumentationCoverage") -> DataFrame:
    """Per group: whether every project scan of documentation completed and found nothing to document. No scans, no row."""
    mine = facts.where((F.lower("source") == producer.lower()) & (fact_scope() == "Project"))
    measured = F.exists(F.map_keys("metrics"), lambda k: F.lower(k) == metric.lower())
    none = (F.lower(meta("EvaluatorExecutionStatus")) == "noapplicabledeclarations") & (F.lower(meta("AnalysisComplete")) == "true")
    return mine.groupBy(*by).agg(F.count(F.lit(1)).alias("scans"), F.bool_and(F.coalesce(~measured & none, F.lit(False))).alias("not_applicable"))


def switched_off(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of which a declared producer says that policy has switched it off."""
    off = facts.where(F.lower(meta("EvaluatorExecutionStatus")) == "disabledbypolicy").select(F.lower("source").alias("producer")).distinct()
    declared = rules.where("producers IS NOT NULL").select("rule_id", F.explode("producers").alias("producer"))
    return declared.join(off, "producer", "left_semi").select("rule_id").distinct()


def layer_of(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """paths with the layer of the deepest module that owns each, else of the longest one whose folder's name is a part of it."""
    parts = F.split(F.lower("path"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = modules.select(F.lower(F.rtrim("module_path", F.lit("/"))).alias("module"), "layer").withColumn("base", F.element_at(F.split("module", "/"), -1))
    own = paths.select("path").distinct()
    inside = own.withColumn("module", F.explode(prefixes)).join(known, "module").groupBy("path").agg(F.max_by("layer", F.struct(F.length("module"), "module")).alias("inside"))
    named = own.withColumn("base", F.explode(F.array_distinct(parts))).join(known, "base").groupBy("path").agg(F.max_by("layer", F.struct(F.length("module"), "module")).alias("named"))
    found = paths.join(inside, "path", "left").join(named, "path", "left")
    return found.withColumn("layer", F.coalesce("inside", "named", F.lit("Unclassified"))).drop("inside", "named")


def book_defects(rules: DataFrame, severities: list[str]) -> DataFrame:
    """(check, n): rules that a sound rule book doesn't have, by kind."""
    copies = rules.groupBy(F.lower("rule_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    checks = {
        "duplicate id": F.col("n") > 1, "blank name": F.coalesce(F.trim("name"), F.lit("")) == "", "unknown severity": ~F.col("severity").isin(*severities),
        "unknown scope": ~F.col("scope").isin("Project", "File"), "threshold is not finite": ~finite(F.col("threshold")),
        "no producer": F.col("producers").isNull(), "candidates without a producer": F.col("gated") & F.col("producers").isNull(),
    }
    row = rules.join(copies, F.lower("rule_id") == F.col("key")).agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    return row.unpivot([], list(checks), "check", "n")
