"""Versions as sortable structs, ranges as intervals of them, and which published version a requirement resolves to.

A version is (numbers, release, pre): four numbers, 1 for a release and 0 before it, and the parts of what is before it, of which
numbers come before words. Structs of that shape sort as versions do, in Spark and elsewhere. A requirement is a list of
alternatives, each one interval. The best version of an interval is the last one at or below its end, found by one sort of
versions and ends together for each package, and not by comparing all versions with all requirements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBERS = 4
_VERSION = r"^[vV=]?\s*([0-9]+(?:\.[0-9]+)*)(?:[-._]?([A-Za-z][0-9A-Za-z.-]*)|-([0-9A-Za-z.-]+))?(?:\+.*)?$"
_TOKEN = r"(\^|~>|~=|~|>=|<=|>|<|===|==|!=|=)?\s*[vV]?([0-9]+|[xX*])[0-9A-Za-z.*+-]*"
KEY = "struct<numbers:array<bigint>,release:int,pre:array<struct<word:int,n:bigint,text:string>>>"
_PRE = "array<struct<word:int,n:bigint,text:string>>"


def _padded(numbers: Column) -> Column:
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), _NUMBERS)), 1, _NUMBERS)


def _key(numbers: Column, release: Column, pre: Column | None = None) -> Column:
    return F.struct(_padded(numbers).alias("numbers"), release.cast("int").alias("release"), (F.array() if pre is None else pre).cast(_PRE).alias("pre")).cast(KEY)


def version_key(version: Column) -> Column:
    """The version as a struct that sorts; null where it is none. What stands behind a plus doesn't count."""
    v = F.trim(version)
    numbers = F.transform(F.split(F.regexp_extract(v, _VERSION, 1), r"\."), lambda x: x.cast("long"))
    before = F.concat(F.regexp_extract(v, _VERSION, 2), F.regexp_extract(v, _VERSION, 3))
    parts = F.transform(F.split(F.lower(before), "[.-]"), lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("word"), F.when(x.rlike("^[0-9]+$"), x).otherwise("0").cast("long").alias("n"), F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("text")))
    return F.when(v.rlike(_VERSION), _key(numbers, F.when(before == "", 1).otherwise(0), F.when(before == "", F.array().cast(_PRE)).otherwise(parts.cast(_PRE))))


def _bound(token: Column, form: Column) -> Column:
    """(low, above, high, below) of one comparison, null where it has no such end; above and below leave the end itself out."""
    op = F.regexp_extract(token, r"^(\^|~>|~=|~|>=|<=|>|<|===|==|!=|=)?", 1)
    text = F.regexp_replace(token, r"^(\^|~>|~=|~|>=|<=|>|<|===|==|!=|=)?\s*[vV]?", "")
    cut = F.regexp_replace(text, r"(^|\.)[xX*].*$", "")  # what stands before a wildcard
    wild, whole = cut != text, version_key(F.when(cut == "", "0").otherwise(cut))
    n = F.when(cut == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(F.regexp_extract(cut, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda x: x.cast("long")))
    given = F.size(n)

    def after(at: Column) -> Column:
        """The first version beyond all that share the first at numbers."""
        return F.when(at > 0, _key(F.concat(F.slice(n, 1, F.greatest(at - 1, F.lit(0))), F.array(F.get(n, at - 1) + 1)), F.lit(0)))

    first = F.coalesce(F.array_position(F.transform(n, lambda x: F.when(x > 0, 1).otherwise(0)), 1).cast("int"), F.lit(0))
    caret, tilde = after(F.when(first > 0, first).otherwise(given)), after(F.least(F.lit(2), given))
    family = after(F.greatest(given - 1, F.lit(1)))
    none, no, yes = F.lit(None).cast(KEY), F.lit(False), F.lit(True)
    span = lambda low, above, high, below: F.struct(low.alias("low"), above.alias("above"), high.alias("high"), below.alias("below"))
    least, exact, line = span(whole, no, none, no), span(whole, no, whole, no), span(whole, no, after(given), yes)
    loose = wild | ((form == "npm") & (given < 3))
    equal = F.when(wild, line).otherwise(exact)
    bare = F.when(form == "dotnet", F.when(wild, line).otherwise(least)).when((form == "npm") & (given < 3), line).otherwise(equal)
    return (
        F.when(op == "^", span(whole, no, caret, yes)).when(op == "~", span(whole, no, tilde, yes)).when(op.isin("~=", "~>"), span(whole, no, family, yes)).when(op == ">=", least)
        .when(op == ">", F.when(loose, span(after(given), no, none, no)).otherwise(span(whole, yes, none, no))).when(op == "<=", F.when(loose, span(none, no, after(given), yes)).otherwise(span(none, no, whole, no)))
        .when(op == "<", span(none, no, whole, yes)).when(op.isin("=", "==", "==="), equal).when(op == "", bare)
    )


def intervals(spec: Column, form: Column) -> Column:
    """The alternatives of a requirement as structs (low, above, high, below); null where it can't be read.

    form is npm, maven, dotnet or pip. Understood are ^, ~, ~=, comparisons, wildcards, hyphens, bare versions as the form means
    them, and intervals in brackets; spaces and commas join, || separates. != is not.
    """
    text = F.trim(spec)

    def one(part: Column) -> Column:
        part = F.regexp_replace(part, r"^\s*(\S+)\s+-\s+(\S+)\s*$", ">=$1 <=$2")
        tokens = F.transform(F.regexp_extract_all(part, F.lit(_TOKEN), 0), lambda t: _bound(t, form))
        ordered = lambda x, key, flag, high: F.struct(x[key].alias("key"), F.when(x[flag], 0 if high else 1).otherwise(1 if high else 0).alias("edge"))
        low = F.array_max(F.transform(F.filter(tokens, lambda x: x["low"].isNotNull()), lambda x: ordered(x, "low", "above", False)))
        high = F.array_min(F.transform(F.filter(tokens, lambda x: x["high"].isNotNull()), lambda x: ordered(x, "high", "below", True)))
        return F.struct(low["key"].alias("low"), (low["edge"] == 1).alias("above"), high["key"].alias("high"), (high["edge"] == 0).alias("below"))

    bracket = r"^([\[(])\s*([^,\])]*)(,?)\s*([^,\])]*?)\s*([\])])$"
    part = lambda i: F.regexp_extract(text, bracket, i)
    low, high = version_key(part(2)), F.when(part(3) == "", version_key(part(2))).otherwise(version_key(part(4)))
    within = F.array(F.struct(low.alias("low"), (part(1) == "(").alias("above"), high.alias("high"), (part(5) == ")").alias("below")))
    left = F.trim(F.regexp_replace(F.regexp_replace(text, _TOKEN, ""), r"[\s,|-]+", ""))
    anything = F.array(F.struct(F.lit(None).cast(KEY).alias("low"), F.lit(False).alias("above"), F.lit(None).cast(KEY).alias("high"), F.lit(False).alias("below")))
    return F.when(text.isin("", "*", "x", "X"), anything).when(text.rlike(bracket), within).when((left == "") & ~F.contains(text, F.lit("!=")) & text.rlike("[0-9]"), F.transform(F.split(text, r"\|\|"), one))


def _below(high: Column, key: Column, below: Column) -> Column:
    return high.isNull() | (key < high) | ((key == high) & ~F.coalesce(below, F.lit(False)))


def resolve(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """wanted (name, form, spec) with best, newest and status of each, once: satisfied, outdated, unresolved or unreadable.

    published is (name, version). best is the highest published version in the requirement; versions before a release count only
    where the requirement names one; newest is the highest release. outdated says that best is not newest. A package that
    nobody publishes, or a null spec, is unresolved.
    """
    versions = published.select("name", "version", version_key(F.col("version")).alias("key")).where("key is not null").groupBy("name", "key").agg(F.min("version").alias("version"))
    asked = wanted.select("name", "form", "spec").distinct().withColumn("parts", intervals(F.col("spec"), F.col("form")))
    early = F.exists("parts", lambda x: F.coalesce((F.size(x["low"]["pre"]) > 0), F.lit(False)) | F.coalesce((F.size(x["high"]["pre"]) > 0), F.lit(False)))
    probes = asked.withColumn("early", F.coalesce(early, F.lit(False))).select("name", "form", "spec", "early", F.explode("parts").alias("p")).select("name", "form", "spec", "early", "p.*")
    none = lambda kind: F.lit(None).cast(kind)
    rows = versions.select("name", "key", F.lit(1).alias("edge"), "version", none("string").alias("form"), none("string").alias("spec"), none("boolean").alias("early"), none(KEY).alias("low"), none("boolean").alias("above"))
    ends = probes.select("name", F.col("high").alias("key"), F.when(F.col("below"), 0).otherwise(2).alias("edge"), none("string").alias("version"), "form", "spec", "early", "low", "above")
    order = Window.partitionBy("name").orderBy(F.col("key").isNull(), "key", "edge").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda ok: F.last(F.when(F.col("version").isNotNull() & ok, F.struct("key", "version")), ignorenulls=True).over(order)
    both = rows.unionByName(ends).withColumns({"any": seen(F.lit(True)), "released": seen(F.col("key.release") == 1)})
    found = F.when(F.col("early"), F.col("any")).otherwise(F.col("released"))
    hit = F.when(F.col("low").isNull() | (F.col("found.key") > F.col("low")) | ((F.col("found.key") == F.col("low")) & ~F.coalesce("above", F.lit(False))), F.col("found"))
    best = both.where("version is null and form is not null").withColumn("found", found).withColumn("hit", hit).groupBy("name", "form", "spec").agg(F.max("hit").alias("best"))
    newest = versions.where("key.release = 1").groupBy("name").agg(F.max(F.struct("key", "version")).alias("newest"))
    out = asked.join(best.withColumnRenamed("spec", "s"), (asked["name"] == best["name"]) & (asked["form"] == best["form"]) & (asked["spec"] == F.col("s")), "left").select(asked["name"], asked["form"], asked["spec"], "parts", "best")
    out = out.join(newest, "name", "left")
    status = F.when(F.col("spec").isNotNull() & F.col("parts").isNull(), "unreadable").when(F.col("best").isNull(), "unresolved").when(F.col("best.key") < F.col("newest.key"), "outdated").otherwise("satisfied")
    return out.select("name", "form", "spec", F.col("best.version").alias("best"), F.col("newest.version").alias("newest"), status.alias("status"))
