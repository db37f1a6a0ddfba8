"""Ledgers over findings, modules and references: unions, partitions, resolution of references, look-ahead windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Algorithms of the inventory and whether each is weak.
CRYPTO = [("MD5", True), ("SHA1", True), ("SHA256", False), ("SHA512", False), ("DES", True), ("3DES", True), ("RC2", True), ("AES", False), ("Random", True)]
# Parts of a folder's name that make it look like one of sources.
SOURCE_HINTS = ("src", "source", "app", "lib")


def production(modules: DataFrame) -> DataFrame:
    """Modules that are neither tests nor support of tests, by flag, type or kind."""
    other = lambda c: F.coalesce(F.lower(c).isin("test", "testsupport"), F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return modules.where(~(flag("is_test") | flag("is_support") | other("type") | other("kind")))


def dependency_scope(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """edges (source, target, scope) with is_test: of scope test, or with a module at either end that isn't production."""
    own = modules.select("module").distinct().join(production(modules).select("module").distinct(), "module", "left_anti")
    mark = lambda end: own.select(F.col("module").alias(end), F.lit(True).alias(f"{end}_test"))
    met = edges.join(mark("source"), "source", "left").join(mark("target"), "target", "left")
    test = (F.lower("scope") == "test") | F.coalesce("source_test", F.lit(False)) | F.coalesce("target_test", F.lit(False))
    return met.select(*edges.columns, F.coalesce(test, F.lit(False)).alias("is_test"))


def normalized_path(base: Column, relative: Column) -> Column:
    """relative seen from the folder base, with either slash, without . and .. parts; null where it leaves the root."""
    parts = F.split(F.translate(F.concat_ws("/", base, relative), "\\", "/"), "/")
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1))
        return F.when(part == "..", up).when((part == ".") | (part == ""), done).otherwise(F.concat(done, F.array(part)))

    return F.lower(F.array_join(F.aggregate(parts, start, step), "/"))


def resolved_references(references: DataFrame, projects: DataFrame) -> DataFrame:
    """references (project, include) joined with the project that each names, by normalised path; null where there is none."""
    known = projects.select(F.lower("project").alias("known"), F.col("project").alias("resolved")).dropDuplicates(["known"])
    folder = F.regexp_replace("project", "/?[^/]*$", "")
    met = references.withColumn("known", normalized_path(folder, F.col("include")))
    return met.join(known, "known", "left").drop("known")


def implementations(types: DataFrame) -> DataFrame:
    """Classes (project, name, kind, header) with whether the interface I<name> is in their project and in their header."""
    interfaces = types.where("kind = 'interface'").select("project", F.col("name").alias("interface")).distinct()
    classes = types.where("kind = 'class'").withColumn("interface", F.concat(F.lit("I"), "name"))
    met = classes.join(interfaces.withColumn("declared", F.lit(True)), ["project", "interface"], "left")
    named = F.contains(F.coalesce("header", F.lit("")), F.col("interface"))
    return met.select("project", "name", F.coalesce("declared", F.lit(False)).alias("declared"), (F.coalesce("declared", F.lit(False)) & named).alias("implements"))


def look_ahead(text: Column, needle: str, length: int) -> Column:
    """After each occurrence of needle the next so many characters."""
    before = lambda i: F.length(F.call_function("substring_index", text, F.lit(needle), i)) + len(needle)
    count = F.size(F.split(text, "\\Q" + needle + "\\E", -1)) - 1
    windows = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, before(i) + 1, F.lit(length)))
    return F.when(count > 0, windows).otherwise(F.array().cast("array<string>"))


def merged_layers(rows: DataFrame) -> DataFrame:
    """Per layer its distinct files, sorted, and the least confidence that any of its rows has."""
    least = rows.groupBy("layer").agg(F.min("confidence").alias("confidence"))
    named = rows.select("layer", F.explode("files").alias("file")).distinct().groupBy("layer").agg(F.array_sort(F.collect_list("file")).alias("files"))  # copies are gone before files are gathered
    none = F.array().cast(rows.schema["files"].dataType)
    return least.join(named, "layer", "left").select("layer", F.coalesce("files", none).alias("files"), "confidence")


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the order given."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def unified(**ledgers: DataFrame) -> DataFrame:
    """All ledgers in one, with where each row is from; columns that one lacks are null."""
    parts = [df.withColumn("ledger", F.lit(name)) for name, df in ledgers.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def scopes(evaluators: DataFrame, projects: DataFrame) -> DataFrame:
    """Which evaluator runs over which project: by language or framework; one for the whole repository runs once."""
    reads = F.arrays_overlap("languages", F.array("language")) | F.arrays_overlap("frameworks", F.col("project_frameworks"))
    per = evaluators.where("not whole").join(F.broadcast(projects), reads).select("evaluator", "project")  # both are inventories of a repository
    return per.unionByName(evaluators.where("whole").select("evaluator", F.lit(None).cast("string").alias("project")))


def policy_settings(documents: DataFrame) -> DataFrame:
    """(path, section, key, value) of policy documents (path, text): JSON, where comments and commas before a bracket may stand."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)(^|[\s{\[,])//[^\n]*", "$1"), r",(\s*[}\]])", "$1")
    sections = F.from_json(bare, "map<string,map<string,string>>")
    found = documents.select("path", F.explode(sections).alias("section", "settings"))
    return found.select("path", "section", F.explode("settings").alias("key", "value"))
