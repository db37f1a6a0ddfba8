"""Policies composed of many documents: read leniently, merged by precedence, and joined with the rules that they switch."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that a whole document may be wrapped in, and the section that a root may stand for.
WRAPPERS = ("architecturepolicy", "policy")
SECTION = "architecture"
# The settings that a rule or a family of rules needs to be on; all of them must be true.
_PATTERNS = "architecture:designpatterns:"
ENABLED_BY = {
    "ARCH-R1": ("circulardependency:enabled",), "ARCH-R2": ("architecture:enforcelayerboundaries",), "ARCH-R3": ("architecture:enforcelayerboundaries",), "ARCH-R5": ("architecture:enforcelayerboundaries",),
    "ARCH-R8": (_PATTERNS + "detectgodclasses",), "ARCH-R10": ("security:enabled",), "DES-ADM": (_PATTERNS + "detectanemicdomainmodels",), "DES-BLD001": (_PATTERNS + "enforcebuilderpattern",),
    "DES-BLD002": (_PATTERNS + "enforcebuilderpattern", _PATTERNS + "suggestimmutability"), "DES-CIRC": (_PATTERNS + "detectcirculardependencies",), "DES-CMD": (_PATTERNS + "enforcecommandpattern",),
    "DES-DEC": (_PATTERNS + "enforcedecoratorpattern",), "DES-FAC0": (_PATTERNS + "enforcefacadepattern",), "DES-FACR": (_PATTERNS + "enforcefactorypattern",), "DES-GOD": (_PATTERNS + "detectgodclasses",),
    "DES-MEDI": (_PATTERNS + "enforcemediatorpattern",), "DES-OBS001": (_PATTERNS + "enforceobserverpattern", _PATTERNS + "detectleakingsubscriptions"), "DES-OBS002": (_PATTERNS + "enforceobserverpattern",),
    "DES-REPO": (_PATTERNS + "enforcerepositorypattern",), "DES-SING": (_PATTERNS + "enforcesingletonpattern",), "DES-STRAT001": (_PATTERNS + "enforcestrategypattern", _PATTERNS + "detectconditionalstrategyswitch"),
    "DES-STRAT002": (_PATTERNS + "enforcestrategypattern",), "DEPS-R1": ("dependency:enabled", "dependency:checkoutdatedpackages"), "DEPS-R2": ("dependency:enabled", "dependency:checkoutdatedpackages"),
    "DEPS-R3": ("dependency:enabled", "dependency:checkunusedreferences"), "DEPS-R4": ("dependency:enabled", "dependency:checkoutdatedpackages"), "FRONT-": ("frontend:enabled",), "INF-R1": ("configuration:enabled",),
    "INF-R2": ("logging:enabled",), "NAM-": ("naming:enabled",), "PERF-": ("performance:enabled",), "TXN-": ("transaction:enabled",),
}

#: A string, or else a comment, or a comma before a closing bracket.
_LENIENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?:.|\n)*?\*/|,(?=(?:\s|//[^\n]*|/\*(?:.|\n)*?\*/)*[}\]])')
_READ = "status string, key string, value string"


def read_policy(text: str | None, vendor: str = "") -> tuple[str, list[tuple[str, str | None]]]:
    """(status, settings) of one document: a setting is its keys joined by colons, in lower case, and its value as text.

    Comments and commas before a closing bracket are let pass. A document is refused if it is no JSON object, if it has two wrappers,
    or if its wrapper holds no object; it then has no settings. Of keys that differ in case only the last counts. A wrapper's name may
    have the vendor's before it.
    """
    try:
        root = json.loads(_LENIENT.sub(lambda m: m[1] or "", text or ""))
    except (ValueError, RecursionError):
        return "not JSON", []
    if not isinstance(root, dict):
        return "no object", []
    wrapped = [k for k in root if k.lower().removeprefix(vendor.lower()) in WRAPPERS]
    if len(wrapped) > 1:
        return "two wrappers", []
    if wrapped:
        root = root[wrapped[0]]
        if not isinstance(root, dict):
            return "empty wrapper", []
    settings: dict[str, str | None] = {}
    todo: list[tuple[str, object]] = [("", root)]
    while todo:
        at, value = todo.pop()
        below = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if below is None:
            settings[at[1:]] = value if isinstance(value, str) or value is None else json.dumps(value)
        else:
            todo += reversed([(f"{at}:{str(k).lower()}", v) for k, v in below])
    return "read", list(settings.items())


def policy_documents(documents: DataFrame, vendor: str = "") -> DataFrame:
    """(scope, path, rank, status, key, value): the settings of documents (scope, path, rank, text); one row with a null key if there are none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_policy(t, vendor) for t in batch.column("text").to_pylist()]
            rows = [(i, status, k, v) for i, (status, settings) in enumerate(found) for k, v in settings or [(None, None)]]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("scope", "path", "rank")), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3))], ["scope", "path", "rank", "status", "key", "value"])

    rows = documents.select(F.col("scope").cast("string").alias("scope"), "path", F.col("rank").cast("int").alias("rank"), "text")
    return rows.mapInArrow(read, f"scope string, path string, rank int, {_READ}")


def composed(settings: DataFrame) -> DataFrame:
    """(scope, key, value, path): each scope's settings merged deeply; of equal keys the highest rank wins, then the later path.

    Lists merge by place, so a shorter list of higher rank leaves the rest of a longer one. A setting of null is a setting. What the section
    `architecture` says wins over the same key at the root of any document, which stands for that section.
    """
    own = settings.where("key is not null").groupBy("scope", "key").agg(F.max(F.struct("rank", "path", "value")).alias("x")).select("scope", "key", "x.value", "x.path")
    inner = F.startswith("key", F.lit(f"{SECTION}:"))
    both = own.select("scope", F.when(inner, F.col("key")).otherwise(F.concat(F.lit(f"{SECTION}:"), "key")).alias("key"), "value", "path", inner.alias("inner"))
    section = both.groupBy("scope", "key").agg(F.max(F.struct("inner", "value", "path")).alias("x")).select("scope", "key", "x.value", "x.path")
    return section.unionByName(own.where(~inner))


def enabled_rules(rules: DataFrame, settings: DataFrame) -> DataFrame:
    """(scope, rule_id, enabled, missing): the rules of a book under each scope's composed settings.

    A rule that no setting switches is on. A setting that isn't given, or is no boolean, counts as on; missing names the first that is off. The
    book and its switches are a few rows, sent to every task.
    """
    spark = settings.sparkSession
    needs = [(prefix, key, i) for prefix, keys in ENABLED_BY.items() for i, key in enumerate(keys)]
    switches = spark.createDataFrame(needs, "prefix string, key string, nth int")
    needed = rules.select("rule_id").join(F.broadcast(switches), F.startswith("rule_id", F.col("prefix")) & (~F.col("prefix").rlike("[0-9]$") | (F.col("rule_id") == F.col("prefix")) | F.endswith("prefix", F.lit("0"))), "left")
    keys = [k for k in dict.fromkeys(k for _, k, _ in needs)]
    off = settings.where(F.col("key").isin(*keys) & (F.lower(F.trim("value")) == "false")).select("scope", F.col("key").alias("off"))
    scopes = settings.select("scope").distinct()
    by_scope = scopes.join(off.groupBy("scope").agg(F.collect_set("off").alias("off")), "scope", "left")  # at most as many as there are switches
    book = needed.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("nth", "key")))).alias("needs"))
    judged = by_scope.crossJoin(F.broadcast(book))  # a row for each rule of the book
    hit = F.get(F.filter("needs", lambda n: F.array_contains(F.coalesce("off", F.array().cast("array<string>")), n["key"])), 0)["key"]
    return judged.select("scope", "rule_id", hit.isNull().alias("enabled"), hit.alias("missing"))
