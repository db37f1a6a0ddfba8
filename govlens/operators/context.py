"""What kind of repository this is, which rules and conventions apply to it, and whether a scan may run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(flags: list[tuple[str, Column]], otherwise: str = "Unknown") -> Column:
    """The first label whose aggregate flag holds."""
    label, flag = flags[0]
    return reduce(lambda c, kv: c.when(kv[1], F.lit(kv[0])), flags[1:], F.when(flag, F.lit(label))).otherwise(F.lit(otherwise))


def detect_language(files: DataFrame, by: str, order: list[tuple[str, str]]) -> DataFrame:
    """Per module the first language of the order with a file of its extension, and how many languages there are."""
    ext = F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1))
    rows = files.select(by, ext.alias("ext"))
    found = rows.groupBy(by).agg(first_match([(name, F.bool_or(F.col("ext") == e)) for name, e in order]).alias("language"), F.countDistinct("ext").alias("languages"), F.count(F.lit(1)).alias("n_files"))
    return found


def detect_layers(names: DataFrame, hints: DataFrame) -> DataFrame:
    """Each name's layer by hint words: certain if all its hints agree, else the first by name at half the confidence."""
    met = names.withColumn("word", F.explode(F.split(F.lower("name"), "[^a-z]+"))).join(F.broadcast(hints), "word")
    found = met.groupBy("id").agg(F.countDistinct("layer").alias("candidates"), F.min("layer").alias("layer"))
    return found.withColumn("confidence", F.when(F.col("candidates") == 1, F.lit(1.0)).otherwise(F.lit(0.5)))


def convention_for(items: DataFrame, conventions: DataFrame) -> DataFrame:
    """The naming convention of (language, framework): both match, else the language alone, else the default."""
    met = items.join(F.broadcast(conventions), (F.col("c_language").isNull() | (F.lower("language") == F.lower("c_language"))) & (F.col("c_framework").isNull() | (F.lower("framework") == F.lower("c_framework"))))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.when(F.col("c_framework").isNotNull(), 0).when(F.col("c_language").isNotNull(), 1).otherwise(2), "convention"))
    return met.withColumn("rank", rank).where("rank = 1").select("id", "language", "framework", "convention")


def fact_applicability(facts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Why a fact can't serve a rule, in this order: unsupported rule, other producer, other language, no declarations; else applicable."""
    met = facts.join(F.broadcast(contracts), "metric_key")
    verdict = (
        F.when(F.col("unsupported"), "unsupported rule")
        .when(~F.array_contains("producers", F.col("producer")), "producer not allowed")
        .when(F.col("only_language").isNotNull() & (F.lower("language") != F.lower("only_language")), "other language")
        .when(F.coalesce("declarations", F.lit(0)) == 0, "no declarations")
        .otherwise("applicable")
    )
    return met.withColumn("verdict", verdict)


def match_signals(signals: DataFrame, rules: list[dict], keep: list[str]) -> DataFrame:
    """Signals and the security rules of their category that match: by pattern, by artifact in the text, or by tag as metadata key.

    Each rule's pattern is a literal predicate, so no pattern is compiled per row, and the category comes first.
    """

    def holds(r: dict) -> Column:
        found = F.lower("category") == r["category"].lower()
        text = F.coalesce("evidence", F.lit(""))
        own = text.rlike(r["pattern"]) if r.get("pattern") else F.lit(False)
        for a in r.get("artifacts", []):
            own = own | F.contains(F.lower(text), F.lit(a.lower()))
        for t in r.get("tags", []):
            own = own | F.coalesce(F.array_contains(F.map_keys("metadata"), t), F.lit(False))
        return found & own

    score = lambda r: float(r["min_score"] + r["max_score"]) / 2 if r.get("max_score") else {0: 0.0, 1: 2.0, 2: 4.0, 3: 7.0, 4: 9.0}[r["ordinal"]]
    flags = F.array(*(F.when(holds(r), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["ordinal"]).alias("ordinal"), F.lit(score(r)).alias("score"))) for r in rules))
    return signals.withColumn("hit", F.explode(F.filter(flags, lambda x: x.isNotNull()))).select(*keep, "hit.rule_id", "hit.ordinal", "hit.score")


def reconcile(diagnostics: DataFrame) -> DataFrame:
    """Declared against listed details: how many are missing from the list."""
    listed = F.size(F.array_distinct(F.filter(F.transform(F.split("details", ";"), lambda x: F.trim(x)), lambda x: x != "")))
    return diagnostics.withColumn("listed", F.coalesce(listed, F.lit(0))).withColumn("truncated", F.greatest(F.lit(0), F.col("declared") - F.col("listed")))


def scope_issues(scopes: DataFrame, at: Column) -> DataFrame:
    """All issues of each live scope, not only the first."""
    issues = F.array(
        F.when(F.coalesce(F.trim("owner"), F.lit("")) == "", "no owner"),
        F.when(F.col("valid_until") < F.col("valid_from"), "window ends before it begins"),
        F.when(at < F.col("valid_from"), "not yet valid"),
        F.when(at > F.col("valid_until"), "expired"),
        F.when(F.size("targets") == 0, "no targets"),
        F.when(F.exists("targets", lambda t: F.contains(t, F.lit("*"))), "wildcard target"),
    )
    return scopes.withColumn("issues", F.filter(issues, lambda x: x.isNotNull())).withColumn("accepted", F.size("issues") == 0)
