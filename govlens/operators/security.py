"""Signals to findings, and findings to compliance and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.expr import half_even

FAILED_FROM = 2  # Medium

# The ports that must not be open.
CRITICAL_PORTS = [21, 23, 445, 3389, 5432, 27017]


def pattern_hits(rows: DataFrame, text: str, patterns: list[tuple[str, str, int]], keep: list[str]) -> DataFrame:
    """Rows and the pattern rules (id, pattern, severity) that match. Each pattern is a literal, so it compiles once a task."""
    flags = F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("ordinal"))) for i, p, s in patterns))
    return rows.withColumn("hit", F.explode(F.filter(flags, lambda x: x.isNotNull()))).select(*keep, "hit.rule_id", "hit.ordinal")


def heuristics(signals: DataFrame, predicates: list[tuple[str, Column, int]], keep: list[str]) -> DataFrame:
    """All predicates (name, condition, severity) that hold for a signal, as findings."""
    flags = F.array(*(F.when(c, F.struct(F.lit(n).alias("finding"), F.lit(s).alias("ordinal"))) for n, c, s in predicates))
    return signals.withColumn("hit", F.explode(F.filter(flags, lambda x: x.isNotNull()))).select(*keep, "hit.finding", "hit.ordinal")


def port_findings(signals: DataFrame) -> DataFrame:
    """(host, port, is_open, latency_ms, error) to findings."""
    open_ = F.coalesce("is_open", F.lit(False))
    return heuristics(signals, [("critical port", open_ & F.col("port").isin(CRITICAL_PORTS), 4), ("slow port", open_ & (F.col("latency_ms") > 500), 2), ("probe error", F.col("error").isNotNull(), 1)], ["host", "port"])


def tls_findings(signals: DataFrame, now: str) -> DataFrame:
    """(host, protocol, cipher, expires, key_bits, error) to findings; the weak-cipher test is a substring test."""
    weak = reduce(lambda a, b: a | b, (F.contains(F.upper("cipher"), F.lit(x)) for x in ("NULL", "EXPORT", "RC4", "MD5", "DES")))
    at = F.lit(now).cast("timestamp")
    left = F.col("expires").cast("timestamp")
    return heuristics(
        signals,
        [
            ("broken protocol", F.col("protocol").isin("Ssl2", "Ssl3"), 4), ("old protocol", F.col("protocol").isin("Tls", "Tls10", "Tls11"), 3), ("weak cipher", weak, 4), ("no certificate", left.isNull(), 3),
            ("expired", left <= at, 4), ("expires soon", (left > at) & (left <= at + F.expr("INTERVAL 30 DAYS")), 2), ("short key", F.col("key_bits") < 2048, 3), ("probe error", F.col("error").isNotNull(), 1),
        ],
        ["host"],
    )


# Algorithm suites that are weak, and the sizes in bytes and MB from which a file and a process stand out.
WEAK_SUITES, LARGE_FILE, LARGE_PROCESS = ("Basic128", "TripleDes", "Basic128Rsa15"), 100_000_000, 500


def hardening_findings(hosts: DataFrame) -> DataFrame:
    """(host, os_version, firewall, smb1, guest): how a host is set up."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [("end of life", F.contains("os_version", F.lit("Windows 7")), 3), ("firewall off", ~on("firewall"), 3), ("old file sharing", on("smb1"), 4), ("guest account", on("guest"), 2)]
    return heuristics(hosts, rules, ["host"])


def process_findings(processes: DataFrame) -> DataFrame:
    """(host, name, memory_mb, variable): processes and names of environment variables."""
    name = F.lower("name")
    odd = (name == "nc.exe") | (name == "powershell.exe") & (F.col("memory_mb") > LARGE_PROCESS)
    return heuristics(processes, [("suspicious process", odd, 3), ("secret in environment", F.contains(F.upper("variable"), F.lit("SECRET")), 4)], ["host", "name"])


def cloud_findings(resources: DataFrame) -> DataFrame:
    """(resource, kind, public, encrypted, mfa, admin, open_to_world); kind is bucket, principal or network."""
    of = lambda kind, c: (F.col("kind") == kind) & c
    rules = [
        ("public bucket", of("bucket", F.col("public")), 3), ("unencrypted bucket", of("bucket", ~F.col("encrypted")), 4), ("no second factor", of("principal", ~F.col("mfa")), 3),
        ("admin role", of("principal", F.col("admin")), 2), ("open to the world", of("network", F.col("open_to_world")), 4),
    ]
    return heuristics(resources, rules, ["resource"])


def crypto_findings(algorithms: DataFrame) -> DataFrame:
    """(host, algorithm, weak, error)."""
    return heuristics(algorithms, [("weak algorithm", F.col("weak"), 3), ("scan error", F.col("error") != "", 1)], ["host", "algorithm"])


def file_findings(found: DataFrame) -> DataFrame:
    """(path, present, sensitive, world_readable, world_writable, secrets, size, error); a missing file has none."""
    rules = [
        ("sensitive and readable", F.col("sensitive") & F.col("world_readable"), 4), ("writable by all", F.col("world_writable"), 3), ("holds secrets", F.col("secrets"), 4),
        ("very large", F.col("size") > LARGE_FILE, 1), ("scan error", F.trim("error") != "", 1),
    ]
    return heuristics(found.where("present"), rules, ["path"])


def service_findings(endpoints: DataFrame) -> DataFrame:
    """(service, https, mode, anonymous, suite, metadata, binding): service endpoints of the older kind."""
    plain = ~F.col("https")
    rules = [
        ("no transport security", plain & (F.col("mode") == "None"), 4), ("anonymous clients", F.col("anonymous"), 3), ("weak suite", F.col("suite").isin(*WEAK_SUITES), 3),
        ("metadata exposed", F.col("metadata"), 1), ("basic binding in clear text", plain & F.contains("binding", F.lit("basicHttpBinding")), 4),
    ]
    return heuristics(endpoints, rules, ["service"])


def target_of(signals: DataFrame) -> DataFrame:
    """signals (detector, evidence, metadata) with target and location: the metadata's target, else the evidence's first line."""
    lines = F.split("evidence", "\n")
    named = F.try_element_at("metadata", F.lit("target"))
    first = F.trim(F.get(lines, F.lit(0)))
    has_name = F.coalesce(F.trim(named) != "", F.lit(False))
    target = F.when(has_name, named).when(F.coalesce(first != "", F.lit(False)), first).otherwise(F.col("detector"))
    location = F.get(F.filter(F.slice(lines, 2, 1 << 30), lambda x: F.contains(F.lower(x), F.lit("line"))), F.lit(0))
    filled = F.coalesce(F.trim("evidence") != "", F.lit(False))
    return signals.withColumn("target", target).withColumn("location", F.when(~has_name & filled, location))


def domain_compliance(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """Per domain; one without findings is fully compliant here, on purpose unlike an unassessed architecture domain."""
    found = findings.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ordinal") >= FAILED_FROM).alias("failed"), F.max("ordinal").alias("max_severity"))
    joined = domains.join(found, "category", "left").na.fill(0, ["total", "failed", "max_severity"])
    rate = half_even(F.when(F.col("total") == 0, F.lit(100.0)).otherwise(100.0 * (F.col("total") - F.col("failed")) / F.col("total")))
    return joined.select("category", "total", "failed", "max_severity", rate.alias("rate"), (F.col("failed") == 0).alias("compliant"))


def scan_risk(domains: DataFrame, risks: list[str]) -> DataFrame:
    """The unweighted mean of domain rates, the worst severity and its risk."""
    worst = F.coalesce(F.max("max_severity"), F.lit(0))
    label = reduce(lambda c, kv: c.when(worst == kv[0], F.lit(kv[1])), list(enumerate(risks))[1:], F.when(worst == 0, F.lit(risks[0])))
    return domains.agg(F.count(F.lit(1)).alias("domains"), F.sum("total").alias("total"), F.sum("failed").alias("failed"), half_even(F.coalesce(F.avg("rate"), F.lit(100.0))).alias("compliance"), worst.alias("max_severity"), label.alias("risk"), F.bool_and("compliant").alias("all_compliant"))


def governance_rollup(findings: DataFrame) -> DataFrame:
    """The roll-up as (key, value) signals."""
    n = lambda k: F.count_if(F.col("ordinal") == k).cast("double")
    row = findings.agg(F.count(F.lit(1)).cast("double").alias("total"), n(4).alias("critical"), n(3).alias("high"), n(2).alias("medium"), F.countDistinct("category").cast("double").alias("domains"), F.coalesce(F.max("ordinal"), F.lit(0)).cast("double").alias("worst"), half_even(F.coalesce(F.avg("ordinal"), F.lit(1.0))).alias("average"))
    return row.unpivot([], row.columns, "key", "value")


def governance_findings(rollup: DataFrame) -> DataFrame:
    """A missing input counts as 0, so the low-average finding also fires on no data; kept as it is, and named."""
    value = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(0.0))
    row = rollup.agg(value("critical").alias("critical"), value("high").alias("high"), value("average").alias("average"))
    return heuristics(row, [("critical findings", F.col("critical") > 0, 4), ("many high findings", F.col("high") > 5, 3), ("low average or no data", F.col("average") < 5, 2)], [])
