"""Measures drawn from text with built-in functions: one pass per document, linear patterns, no look-around."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.functions.expr import clamp, half_even

# Weights of the scores.
MAINTAINABILITY = {"decision": 2.0, "line": 0.02, "most_lines": 500}
ROUTE_WEIGHTS = (0.35, 0.15, 0.15, 0.20, 0.15)
LOG_WEIGHTS = (0.50, 0.25, 0.25)
NAMING_WEIGHTS = {"type": 0.25, "interface": 0.10, "method": 0.20, "variable": 0.15, "constant": 0.05, "file": 0.05}


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def maintainability(docs: DataFrame, decisions: str) -> DataFrame:
    """100, less so much per decision and per line over the most, within [0, 100]."""
    m = MAINTAINABILITY
    counted = docs.withColumn("decisions", count_of(F.col("text"), decisions)).withColumn("n_lines", line_count(F.col("text")))
    over = F.greatest(F.lit(0), F.col("n_lines") - m["most_lines"])
    return counted.withColumn("score", half_even(clamp(100.0 - F.col("decisions") * m["decision"] - over * m["line"], 0.0, 100.0)))


def route_consistency(pages: DataFrame) -> DataFrame:
    """Per host: shares of routes without a fault, fused; the last term says that there are routes at all."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = pages.select(host.alias("host"), path.alias("path")).select(
        "host", F.col("path").rlike("[A-Z]").alias("upper"), (F.col("path").rlike("[^/]") & F.endswith("path", F.lit("/"))).alias("slashed"), (F.size(F.array_distinct(parts)) < F.size(parts)).alias("repeated"), (~F.col("path").rlike("/(en|fr|de|es)/")).alias("unversioned")
    )
    share = lambda c: F.greatest(F.lit(0.0), 100.0 - 100.0 * F.col(c) / F.col("routes"))
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("routes"), *(F.count_if(c).alias(c) for c in ("upper", "slashed", "repeated", "unversioned")))
    w = ROUTE_WEIGHTS
    return counts.withColumn("score", half_even(w[0] * share("upper") + w[1] * share("slashed") + w[2] * share("repeated") + w[3] * share("unversioned") + w[4] * 100.0))


def markup_scores(pages: DataFrame) -> DataFrame:
    """Counts of elements and step functions of them."""
    count = lambda tag: count_of(F.col("html"), f"<{tag}[ >]")
    rows = pages.select("page_id", count("p").alias("paragraphs"), count("a").alias("links"), count("b").alias("bold"), count("script").alias("scripts"), F.length("html").cast("long").alias("size"))
    step = lambda c, cuts: F.when(F.col(c) <= cuts[0], F.lit(100.0)).when(F.col(c) <= cuts[1], F.lit(75.0)).when(F.col(c) <= cuts[2], F.lit(50.0)).otherwise(F.lit(25.0))
    rows = rows.withColumn("complexity", step("paragraphs", (5, 15, 40))).withColumn("separation", F.when(F.col("scripts") == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 100.0 - 15.0 * F.col("scripts")))).withColumn("composition", step("links", (6, 12, 24)))
    return rows.withColumn("index", half_even(0.5 * F.col("complexity") + 0.3 * F.col("separation") + 0.2 * F.col("composition")))


def naming_compliance(names: DataFrame, conventions: list[tuple[str, str]], by: str) -> DataFrame:
    """(by, kind, name): share that follows the convention by kind, and the mean weighted over the kinds that occur."""
    follows = F.lit(None).cast("boolean")
    for kind, pattern in conventions:
        follows = F.when(F.col("kind") == kind, F.col("name").rlike(pattern)).otherwise(follows)
    shares = names.withColumn("follows", follows).groupBy(by, "kind").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if("follows") / F.count(F.lit(1))).alias("share"))
    w = F.lit(None).cast("double")
    for kind, x in NAMING_WEIGHTS.items():
        w = F.when(F.col("kind") == kind, F.lit(x)).otherwise(w)
    return shares.groupBy(by).agg(F.sum("n").alias("names"), half_even(F.sum(F.col("share") * w) / F.sum(w)).alias("compliance"))


def logging_quality(lines: DataFrame, by: str) -> DataFrame:
    """(by, text): structured, levelled and not too noisy lines."""
    rows = lines.select(by, F.col("text").rlike("[:=|]").alias("structured"), F.col("text").rlike("^[A-ZÀ-Þ]").alias("levelled"), (F.length("text") <= 400).alias("quiet"))
    share = lambda c: 100.0 * F.count_if(c) / F.count(F.lit(1))
    w = LOG_WEIGHTS
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_lines"), half_even(w[0] * share("structured") + w[1] * share("levelled") + w[2] * share("quiet")).alias("score"))


def preceded(lines: DataFrame, group: str, order: str, kind: str, documented: str, documents: str) -> DataFrame:
    """Share of lines of one kind whose previous line, in the same group, is of another."""
    before = F.lag(kind).over(Window.partitionBy(group).orderBy(order))
    return lines.withColumn("before", before).where(F.col(kind) == documented).groupBy(group).agg(F.count(F.lit(1)).alias("declared"), F.count_if(F.col("before") == documents).alias("documented"))


# Folders that are not analysed, in any case, and those of tests and examples.
EXCLUDED = (
    ".git", ".vs", ".idea", ".vscode", "bin", "obj", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", "coverage", "testresults", "logs",
    "packagecache", "generated", "thirdparty", "third-party", "vendor", ".nuget",
)
VENDORED = ("thirdparty", "third-party", "vendor")
GENERATED_FILES = (".designer.cs", ".g.cs", ".generated.cs", ".assemblyinfo.cs")
TESTS = ("test", "tests", "testdata", "test-data", "spec", "specs")
EXAMPLES = ("example", "examples", "sample", "samples", "benchmark", "benchmarks")


def path_parts(path: Column) -> Column:
    """Lower-case parts of a path with either slash."""
    return F.filter(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda x: x != "")


def exclusion_reason(path: Column) -> Column:
    """Why a path is not analysed, by its first excluded folder or its name; null if it is analysed."""
    parts = path_parts(path)
    hit = F.get(F.filter(parts, lambda x: x.isin(*EXCLUDED)), F.lit(0))
    example = F.arrays_overlap(parts, F.array(F.lit("textmesh pro"), F.lit("textmeshpro"))) & F.array_contains(parts, "examples & extras")
    name = F.element_at(parts, -1)
    generated = reduce(lambda a, b: a | b, (F.endswith(name, F.lit(x)) for x in GENERATED_FILES))
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "InvalidPath").when(hit == "generated", "GeneratedCode").when(hit.isin(*VENDORED), "VendoredCode")
        .when(hit.isNotNull(), "BuildOrDependencyCache").when(example, "VendoredExample").when(generated, "GeneratedFile")
    )


def with_exclusions(files: DataFrame, path: str = "path") -> DataFrame:
    """files with reason, also for the caches of game projects: Library and Temp beside Assets and ProjectSettings or Packages."""
    parts = path_parts(F.col(path))
    at = F.transform(parts, lambda x, i: F.struct(x.alias("name"), F.array_join(F.slice(parts, 1, i), "/").alias("parent")))
    seen = files.select(F.explode(at).alias("x")).select("x.*").where(F.col("name").isin("assets", "projectsettings", "packages"))
    marks = seen.groupBy("parent").agg(F.collect_set("name").alias("names"))
    roots = marks.where(F.array_contains("names", "assets") & (F.size("names") > 1)).select("parent")
    caches = files.select(F.col(path).alias("p"), F.explode(F.filter(at, lambda x: x["name"].isin("library", "temp"))).alias("x")).join(roots, F.col("x.parent") == F.col("parent")).select("p").distinct()
    return files.join(caches, F.col(path) == F.col("p"), "left").withColumn("reason", F.coalesce(exclusion_reason(F.col(path)), F.when(F.col("p").isNotNull(), "UnityGeneratedCache"))).drop("p")


def ownership(path: Column) -> Column:
    """Whose a file is, as far as its path tells."""
    reason, parts = exclusion_reason(path), path_parts(path)
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(reason.isin("GeneratedCode", "GeneratedFile"), "Generated").when(reason.isin("VendoredCode", "VendoredExample"), "Vendored")
        .when(reason == "BuildOrDependencyCache", "DependencyOrBuildCache").when(has(TESTS), "Test").when(has(EXAMPLES), "Example").otherwise("FirstParty")
    )


def unpinned(version: Column) -> Column:
    """A declared version that does not name one release."""
    v = F.trim(version)
    return v.isNull() | (v == "") | (F.lower(v) == "latest") | v.rlike(r"^[\^~><=]") | v.rlike(r"[*x]") | v.rlike("^(git|http|file|link|workspace):")


def all_or_nothing(values: Column, valid: Column, ok: Column) -> Column:
    """Share of ok elements, withheld if any element is malformed or there is none."""
    return F.when(valid & (F.size(values) > 0), ok)


def search(rows: DataFrame, needle: str, columns: list[str], lists: list[str] | None = None) -> DataFrame:
    """Rows with needle, without case, in any of the columns or in any element of the list columns."""
    n = F.lit(needle.lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), n)
    for c in lists or []:
        found = found | F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), n)), F.lit(False))
    return rows.where(found)
