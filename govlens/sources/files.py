"""File inventories, manifests, configuration files and target lists as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.operators.lexical import exclusion_reason


def scan_files(spark: SparkSession, root: str, extensions: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(path, length, modified, text, reason) of all files below root; reason says why a file is not analysed.

    Excluded files keep their row, so they can be counted, but not their text.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(root)
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))
    reason = exclusion_reason(F.col("path"))
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), F.when(reason.isNull(), F.col("content").cast("string")).alias("text"), reason.alias("reason"))


def json_dependencies(files: DataFrame) -> DataFrame:
    """(path, section, name, version) of package manifests in JSON; unreadable ones give one row with an error."""
    sections = ("dependencies", "devDependencies", "peerDependencies")
    parsed = files.withColumn("m", F.from_json("text", ", ".join(f"{s} map<string,string>" for s in sections) + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where(F.col("m._corrupt").isNull())
    parts = [good.select("path", F.lit(s).alias("section"), F.explode(f"m.{s}").alias("name", "version"), F.lit(None).cast("string").alias("error")) for s in sections]
    bad = parsed.where(F.col("m._corrupt").isNotNull()).select("path", *(F.lit(None).cast("string").alias(c) for c in ("section", "name", "version")), F.lit("not a JSON object").alias("error"))
    out = bad
    for part in parts:
        out = out.unionByName(part)
    return out


def xml_dependencies(files: DataFrame, item: str, name: str, version: str) -> DataFrame:
    """(path, name, version) by XPath from project files; item is the element, name and version its parts, as in @Include."""
    names = F.xpath("text", F.lit(f"{item}/{name}" if name.startswith("@") else f"{item}/{name}/text()"))
    versions = F.xpath("text", F.lit(f"{item}/{version}" if version.startswith("@") else f"{item}/{version}/text()"))
    return files.select("path", F.explode(F.arrays_zip(names.alias("name"), versions.alias("version"))).alias("d")).select("path", "d.name", "d.version")


def requirement_lines(files: DataFrame) -> DataFrame:
    """(path, line, name, pinned) of line-oriented manifests: comments and options left out, == alone pins."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "raw"))
    spec = F.trim(F.regexp_replace("raw", "(^|[ \t])#.*", ""))
    rows = lines.select("path", (F.col("at") + 1).alias("line"), spec.alias("spec")).where((F.col("spec") != "") & ~F.startswith("spec", F.lit("-")))
    return rows.select("path", "line", F.regexp_extract("spec", r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.col("spec").rlike(r"^[A-Za-z0-9._\[\],-]+ *== *[^=*, ]+ *(;.*)?$").alias("pinned"))


def config_diagnostics(files: DataFrame) -> DataFrame:
    """(path, format, valid) of JSON, XML (well-formed), properties and ini files; null where the format isn't checked here."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    lines = F.filter(F.split("text", "\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^[#;!]"))
    pair = F.forall(lines, lambda x: x.rlike(r"^\s*[^=:\s]+\s*[=:]"))
    ini = F.forall(lines, lambda x: x.rlike(r"^\s*(\[[^\]]+\]|[^=:\s][^=:]*[=:])"))
    parsed = F.from_xml("text", "_corrupt_record string", {"mode": "PERMISSIVE"})  # the text itself where it isn't well-formed
    xml = parsed["_corrupt_record"].isNull() & (F.trim("text") != "")
    valid = F.when(ext == "json", F.try_parse_json("text").isNotNull()).when(ext == "properties", pair).when(ext.isin("ini", "cfg", "conf"), ini).when(ext.isin("xml", "config", "csproj"), xml)
    return files.select("path", ext.alias("format"), valid.alias("valid"))


def parse_targets(text: Column) -> Column:
    """Distinct (host, port) of a target list: lines or ';' separate, '#' begins a comment, brackets hold IPv6 hosts."""
    cleaned = F.transform(F.split(text, "[\r\n]+"), lambda x: F.regexp_replace(x, "#.*", ""))
    items = F.filter(F.transform(F.flatten(F.transform(cleaned, lambda x: F.split(x, ";"))), lambda x: F.trim(x)), lambda x: x != "")

    def target(x: Column) -> Column:
        v6 = F.regexp_extract(x, r"^\[([0-9A-Fa-f:.]+)\]", 1)
        host = F.when(v6 != "", F.lower(v6)).otherwise(F.lower(F.regexp_extract(x, r"^([^:/]+)", 1)))
        port = F.when(v6 != "", F.regexp_extract(x, r"\]:([0-9]+)$", 1)).otherwise(F.regexp_extract(x, r"^[^:/]+:([0-9]+)$", 1))
        return F.struct(host.alias("host"), F.when(port != "", port.cast("int")).alias("port"))

    return F.array_distinct(F.transform(items, target))
