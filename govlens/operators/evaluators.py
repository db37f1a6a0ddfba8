"""Source evaluators: counts of lexical signals per file, and metrics computed from them.

An evaluator is data: which files it applies to, linear patterns to count, and metrics as expressions over the counts. A
batch of texts is handed to Arrow's pattern kernels, whose time is linear in the text whatever the pattern; a backtracking
matcher took over half a millisecond a kilobyte and ran out of stack on long lists of modifiers. They are heuristics; syntax
trees are out of scope and come in as tables (see `sources`). The same declaration is also written out as SQL, for the twin
of each query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Dialect:
    """What differs between Spark and the twin's SQL."""

    def __init__(self, spark: bool):
        self.spark = spark

    def d(self, x: float) -> str:
        return f"CAST({x} AS DOUBLE)"

    def r2(self, x: str) -> str:
        return f"rint(({x}) * 100) / 100" if self.spark else f"round_even(({x}) * 100, 0) / 100"

    def ratio(self, a: str, b: str) -> str:
        """a / b as a double; null without a denominator."""
        return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"

    def clamp(self, x: str, lo: float = 0, hi: float = 1) -> str:
        return f"greatest({self.d(lo)}, least({self.d(hi)}, {x}))"

    def flag(self, x: str) -> str:
        return f"(CASE WHEN {x} THEN {self.d(1)} ELSE {self.d(0)} END)"

    def weighted(self, *terms: tuple[float, str]) -> str:
        return " + ".join(f"{self.d(w)} * ({x})" for w, x in terms)


Metric = Callable[[Dialect], str]


@dataclass(frozen=True)
class Evaluator:
    name: str
    applies: str  # a pattern of the text
    signals: dict[str, str]  # patterns; a start of the text is only written (^|x), where x takes \n and no other branch begins with it
    metrics: dict[str, Metric] = field(default_factory=dict)
    average: str = ""  # the metric that a project's summary averages


# Weights, limits and penalties of the scores.
GOD_LINES, GOD_METHODS = 500, 20
FACADE_MOST = (10, 20, 30)

# What signals share: linear patterns of the C-like languages and Python; \n is a line's end.
_DECISIONS = "(^|[^A-Za-z0-9_])(if|for|foreach|while|case|catch|elif|except)[ (:]"
_LOOPS = "(^|[^A-Za-z0-9_])(for|foreach|while)[ (]"
_MODIFIED = "(public|private|protected|internal) ((static|async|virtual|override|sealed|final|abstract) )*"
_METHODS = _MODIFIED + "[A-Za-z][A-Za-z0-9_<>, ?]* [A-Za-z_][A-Za-z0-9_]*[(]|(^|[ \n])def [A-Za-z_][A-Za-z0-9_]*[(]|(^|[ \n])function [A-Za-z_]"
_PUBLIC = "public ((static|async|virtual|override|sealed|final) )*[A-Za-z][A-Za-z0-9_<>, ?]* [A-Za-z_][A-Za-z0-9_]*[(]|(^|[ \n])def [a-z][A-Za-z0-9_]*[(]"
_FIELDS = "private ((static|readonly|final|volatile) )*[A-Za-z][A-Za-z0-9_<>?]* [A-Za-z_][A-Za-z0-9_]*( =[^;\n]*)?;"
_PROPERTIES = "[{][ \n]*get;[ \n]*((private |protected |internal )?(set|init);)?[ \n]*[}]"
_COMMENTS = "//|/[*]|(^|\n) *#"
_CATCH = "catch *[({]|(^|[ \n])except[ :]"
_WRAPPED = "(inner|decorated|wrapped|component|next)"
_LOG = "(^|[^A-Za-z0-9_])_?(log|logger|Log|LOG|logging)[.]"
_BEGIN = "(BeginTransaction|BeginTransactionAsync|beginTransaction|begin_transaction)[(]|@Transactional|[.]begin[(]"

EVALUATORS: dict[str, Evaluator] = {
    e.name: e
    for e in (
        Evaluator("complexity", "class ", {"decisions": _DECISIONS + "|&&|[|][|]", "methods": _METHODS}, {"estimated_complexity": lambda q: "1 + decisions", "complexity_per_method": lambda q: q.r2(q.ratio("1 + decisions", "methods"))}, "estimated_complexity"),
        Evaluator("cohesion", "class ", {"fields": _FIELDS, "methods": _METHODS}, {"member_count": lambda q: "fields + methods", "method_field_ratio": lambda q: q.r2(q.ratio("methods", "fields"))}, "member_count"),
        Evaluator("maintainability", "class ", {"decisions": _DECISIONS, "lines": "\n", "comments": _COMMENTS}, {"maintainability_score": lambda q: q.r2(q.clamp(f"{q.d(100)} - decisions * {q.d(2)} - greatest(0, lines - 500) * {q.d(0.02)}", 0, 100)), "comment_density": lambda q: q.r2(q.ratio("comments", "lines"))}, "maintainability_score"),
        Evaluator("error_handling", _CATCH, {"catches": _CATCH, "empty": "catch *([(][^)]*[)])?[ \n]*[{][ \n]*[}]|except[^:\n]*:[ \n]+pass", "generic": "catch *[(](final )?(Exception|Throwable)[ )]|catch[ \n]*[{]|except( Exception[^:]*)?:"}, {"swallowed": lambda q: "empty", "error_handling_coverage": lambda q: q.r2(f"{q.d(100)} * " + q.clamp(f"{q.d(1)} - " + q.ratio("empty", "catches")))}, "error_handling_coverage"),
        Evaluator("anemic_model", "class [A-Za-z0-9]*Entity", {"properties": _PROPERTIES, "fields": _FIELDS, "methods": _METHODS}, {"state_members": lambda q: "properties + fields", "behavior_ratio": lambda q: q.r2(q.ratio("methods", "(properties + fields)")), "anemic_index": lambda q: q.r2(f"{q.d(1)} - least({q.ratio('methods', '(properties + fields)')}, {q.d(1)})")}, "anemic_index"),
        Evaluator("god_class", "class ", {"lines": "\n", "methods": _METHODS, "properties": _PROPERTIES}, {"god_class_severity": lambda q: q.r2(f"greatest({q.d(0)}, least(lines / {q.d(GOD_LINES)}, methods / {q.d(GOD_METHODS)}))"), "too_large": lambda q: q.flag(f"least(lines / {q.d(GOD_LINES)}, methods / {q.d(GOD_METHODS)}) > 1")}, "god_class_severity"),
        Evaluator("builder", "class [A-Za-z0-9]*Builder", {"builds": "(Build|BuildAsync|build)[(]", "fluent": "return (this|self)", "mutations": "(this[.]|self[.]|[ \n]_)[A-Za-z_]+ = "}, {"builder_compliance": lambda q: f"CASE WHEN builds > 0 THEN {q.d(100)} ELSE {q.d(0)} END", "mutability_violation": lambda q: q.flag("mutations > 0 AND fluent = 0")}, "builder_compliance"),
        Evaluator("command", "class [A-Za-z0-9]*Command([^A-Za-z0-9]|$)", {"methods": _METHODS, "forbidden": "new (Sql|Http|Db)[A-Za-z]*[(]|import (requests|sqlite3)", "handled": "(Handle|HandleAsync|handle)[(]"}, {"command_compliance": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.5, q.flag("handled > 0")), (0.25, q.clamp(f"{q.d(1)} - methods / {q.d(5)}")), (0.25, f"{q.d(1)} - least({q.d(1)}, forbidden / {q.d(3)})")) + ")")}, "command_compliance"),
        Evaluator("decorator", "class [A-Za-z0-9]*Decorator", {"wrapped": "private (readonly |final )I?[A-Z][A-Za-z<>]* _?" + _WRAPPED, "delegated": _WRAPPED + "[.][A-Za-z]+[(]"}, {"decorator_compliance": lambda q: q.r2(f"({q.flag('wrapped > 0')} + {q.flag('delegated > 0')}) / {q.d(2)} * {q.d(100)}")}, "decorator_compliance"),
        Evaluator("facade", "class [A-Za-z0-9]*Facade", {"dependencies": "private (readonly |final )[A-Z][A-Za-z<>]* ", "public_methods": _PUBLIC, "calls": "[^A-Za-z0-9_.][a-z_][A-Za-z0-9_]*[.][A-Za-z_]+[(]"}, {"dependency_ratio": lambda q: q.r2(f"dependencies / {q.d(FACADE_MOST[0])}"), "public_surface_ratio": lambda q: q.r2(f"public_methods / {q.d(FACADE_MOST[1])}"), "orchestration_ratio": lambda q: q.r2(f"calls / {q.d(FACADE_MOST[2])}")}, "public_surface_ratio"),
        Evaluator("factory", "class [A-Za-z0-9]*Factory", {"abstractions": "return I[A-Z]|: I[A-Z]", "instantiations": "new [A-Z][A-Za-z0-9]*[(]", "leaks": "new (Sql|Http|Db)[A-Za-z]*[(]"}, {"factory_compliance": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.40, q.flag("abstractions > 0")), (0.25, q.clamp(f"{q.d(1)} - instantiations / {q.d(10)}")), (0.15, q.flag("leaks = 0")), (0.20, q.flag("abstractions >= instantiations"))) + ")")}, "factory_compliance"),
        Evaluator("mediator", "class [A-Za-z0-9]*Mediator|[Mm]ediator[.][Ss]end", {"sends": "[Mm]ediator[.](Send|SendAsync|send|Publish)[(]", "handlers": "IRequestHandler<|(Handle|HandleAsync|handle)[(]", "direct": "[Ss]ervice[.][A-Za-z]+[(]"}, {"usage_ratio": lambda q: q.r2(q.ratio("sends", "(sends + direct)")), "coupling_risk": lambda q: q.r2(q.ratio("direct", "(sends + handlers + direct)"))}, "coupling_risk"),
        Evaluator("observer", "[Ss]ubscribe[(]|[Pp]ublish[(]|[A-Za-z] [+]= On[A-Z]", {"publishes": "[.]([Pp]ublish|emit|next)[(]", "subscribes": "[.]([Ss]ubscribe|addListener)[(]|[A-Za-z] [+]= On[A-Z]", "released": "([Uu]nsubscribe|Dispose|removeListener|ngOnDestroy)[(]|[A-Za-z] -= On[A-Z]"}, {"unsubscribe_missing": lambda q: q.flag("subscribes > 0 AND released = 0"), "observer_compliance": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.35, q.flag("publishes > 0")), (0.30, q.flag("subscribes = 0 OR released > 0")), (0.15, q.flag("subscribes > 0")), (0.20, q.d(1))) + ")")}, "observer_compliance"),
        Evaluator("repository_pattern", "class [A-Za-z0-9]*Repository", {"interface": "(:|implements|,) *(I[A-Z][A-Za-z0-9]*Repository|[A-Z][A-Za-z0-9]*Repository<)", "methods": _METHODS, "fields": _FIELDS, "asyncs": "await |CompletableFuture<", "external": "HttpClient|RestTemplate|requests[.](get|post)|File[.](Read|Write)"}, {"interface_adherence": lambda q: q.flag("interface > 0"), "repository_complexity": lambda q: q.r2(f"least({q.d(1)}, methods / {q.d(30)} + fields / {q.d(50)})"), "repository_compliance": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.30, q.flag("interface > 0")), (0.35, q.flag("asyncs > 0")), (0.15, q.flag("external = 0")), (0.20, f"{q.d(1)} - least({q.d(1)}, methods / {q.d(30)} + fields / {q.d(50)})")) + ")")}, "repository_compliance"),
        Evaluator("singleton", "class [A-Za-z0-9]*Singleton", {"locks": "lock *[(]|Lazy<|synchronized|threading[.]Lock", "lazy": "Lazy<|== null|is None", "instance": "static (readonly |final |volatile )?[A-Z][A-Za-z0-9<>]* _?[A-Za-z]+|_instance = None", "private_constructor": "private [A-Z][A-Za-z0-9]*[(][)]"}, {"thread_safety": lambda q: f"CASE WHEN locks > 0 THEN {q.d(100)} ELSE {q.d(0)} END", "singleton_compliance": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.35, q.flag("locks > 0")), (0.25, q.flag("lazy > 0")), (0.30, q.flag("private_constructor > 0")), (0.10, q.flag("instance > 0"))) + ")")}, "singleton_compliance"),
        Evaluator("strategy", "class [A-Za-z0-9]*Strategy", {"interface": "(:|implements|,) *(I[A-Z][A-Za-z0-9]*Strategy|[A-Z][A-Za-z0-9]*Strategy<)", "dispatch": "switch *[(]|else if *[(]|elif ", "leaks": "new (Sql|Http|Db)[A-Za-z]*[(]"}, {"strategy_compliance": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.35, q.flag("interface > 0")), (0.25, q.flag("leaks = 0")), (0.15, q.flag("dispatch = 0")), (0.25, q.d(1))) + ")")}, "strategy_compliance"),
        Evaluator("logging", _LOG + "[A-Za-z]+[(]", {"calls": _LOG + "(Log[A-Z][a-z]+|trace|debug|info|warn|warning|error|critical)[(]", "structured": _LOG + "[A-Za-z]+[(][^;\n]*([{][A-Za-z]*[}]|%s)", "levelled": _LOG + "(LogInformation|LogWarning|LogError|LogCritical|info|warn|warning|error|critical)[(]", "noisy": _LOG + "(LogTrace|LogDebug|trace|debug)[(]"}, {"logging_integrity": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.50, q.clamp(q.ratio("structured", "calls"))), (0.25, q.clamp(q.ratio("levelled", "calls"))), (0.25, q.clamp(f"{q.d(1)} - " + q.ratio("noisy", "calls")))) + ")")}, "logging_integrity"),
        Evaluator("transaction", _BEGIN, {"commits": "[.](Commit|CommitAsync|commit)[(]", "rollbacks": "[.](Rollback|RollbackAsync|rollback)[(]", "isolation": "IsolationLevel|isolation *=|isolation_level", "guarded": "using *([(]|var )|with [a-z]"}, {"transaction_integrity": lambda q: q.r2(f"{q.d(100)} * (" + q.weighted((0.35, f"CASE WHEN commits > 0 THEN {q.d(1)} ELSE {q.d(0.6)} END"), (0.30, f"CASE WHEN rollbacks > 0 THEN {q.d(1)} ELSE {q.d(0.6)} END"), (0.20, f"CASE WHEN isolation > 0 THEN {q.d(1)} ELSE {q.d(0.85)} END"), (0.15, f"CASE WHEN guarded > 0 THEN {q.d(1)} ELSE {q.d(0.6)} END")) + ")")}, "transaction_integrity"),
        Evaluator("performance", "class ", {"blocking": "Thread[.][Ss]leep|[.]Wait[(][)]|[.]Result[^A-Za-z]|time[.]sleep[(]", "asyncs": "await ", "concatenations": "[+]= *\"", "loops": _LOOPS}, {"performance_index": lambda q: q.r2(q.weighted((0.35, q.clamp(f"{q.d(1)} - {q.d(0.05)} * concatenations - {q.d(0.2)} * {q.flag('loops > 3')}")), (0.30, q.clamp(f"{q.d(1)} - {q.d(0.25)} * blocking")), (0.20, q.flag("asyncs > 0")), (0.15, q.clamp(f"{q.d(1)} - {q.d(0.2)} * blocking"))))}, "performance_index"),
        Evaluator("architectural_security", "class ", {"secrets": "([Pp]assword|[Ss]ecret|[Aa]pi_?[Kk]ey) *= *\"[^\"]", "weak_crypto": "(MD5|SHA1|DES)[.]Create|getInstance[(]\"(MD5|SHA-1|DES)|hashlib[.](md5|sha1)", "weak_tls": "Ssl3|Tls11|SSLv3|TLSv1[^.2-9_]", "unsafe": "(^|[^A-Za-z])unsafe[ \n]*[{]"}, {"findings": lambda q: "secrets + weak_crypto + weak_tls + unsafe"}, "findings"),
        Evaluator("documentation", "class ", {"declarations": _PUBLIC + "|public (sealed |final |abstract |static )*(class|interface|record|enum) ", "documented": "/// *<summary>|/[*][*]|:[ \n]+\"\"\""}, {"documentation_coverage": lambda q: q.r2(f"{q.d(100)} * " + q.clamp(q.ratio("documented", "declarations"))), "missing_documentation": lambda q: "greatest(0, declarations - documented)"}, "documentation_coverage"),
        Evaluator("repository_hygiene", "class ", {"todos": "TODO|FIXME|HACK", "lines": "\n"}, {"maintenance_score": lambda q: q.r2(q.clamp(f"{q.d(1)} - {q.d(0.15)} * least({q.d(1)}, todos) - {q.flag('lines > 400')} * {q.d(0.02)}"))}, "maintenance_score"),
    )
}


def found(text: str, pattern: str) -> Column:
    """Whether the pattern is in the text; null for a null text."""

    @F.arrow_udf("boolean")
    def match(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return match(text)


def occurrences(text: str, pattern: str) -> Column:
    """How often the pattern is in the text, without overlaps; null for a null text.

    The kernel begins anew behind each match and takes that place for a start, so a start is made a line's end before the text.
    """
    starts = "(^|" in pattern
    inner = pattern.replace("(^|", "(")
    if re.search(r"(?<!\[)\^", inner):
        raise ValueError(f"a start of the text is written (^|x): {pattern}")

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pc.count_substring_regex(pc.binary_join_element_wise("\n", texts, "") if starts else texts, inner).cast(pa.int64())

    return count(text)


def measure(files: DataFrame, evaluator: Evaluator) -> DataFrame:
    """(path, module, signals, metrics) of the files the evaluator applies to. A null text has no row; so has a file without candidates."""
    q = Dialect(True)
    counted = files.where(found("text", evaluator.applies)).select("path", "module", *(occurrences("text", p).alias(n) for n, p in evaluator.signals.items()))
    return counted.select("*", *(F.expr(m(q)).alias(n) for n, m in evaluator.metrics.items()))


def summarize(measured: DataFrame, evaluator: Evaluator) -> DataFrame:
    """Per module: files measured and the mean of the evaluator's main metric; null where no file has it."""
    return measured.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"), (F.rint(F.avg(evaluator.average) * 100) / 100).alias("mean"))


def measure_sql(evaluator: Evaluator, files: str) -> str:
    q = Dialect(False)
    signals = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {n}" for n, p in evaluator.signals.items())
    counted = f"SELECT path, module, {signals} FROM {files} WHERE regexp_matches(text, '{evaluator.applies}')"
    return f"SELECT *, {', '.join(f'{m(q)} AS {n}' for n, m in evaluator.metrics.items())} FROM ({counted})"


def pairs(files: DataFrame, kind: str, partner: str) -> DataFrame:
    """Classes named *kind with whether a class of the derived name *partner exists in the same module."""
    name = F.regexp_extract("text", "class ([A-Za-z0-9]+)", 1)
    named = files.select("module", name.alias("name"))
    owners = named.where(F.endswith("name", F.lit(kind)))
    partners = named.where(F.endswith("name", F.lit(partner))).select("module", F.col("name").alias("partner")).distinct()
    derived = F.concat(F.expr(f"substring(name, 1, length(name) - {len(kind)})"), F.lit(partner))
    return owners.withColumn("partner", derived).join(partners.withColumn("found", F.lit(True)), ["module", "partner"], "left").select("module", "name", "partner", F.coalesce("found", F.lit(False)).alias("found"))
