"""Projects inside a repository: their manifests in several formats, what they declare, which files they own, what they don't use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.operators.graph import owned

# What a name says about a project, in order of precedence; how is one of is, ends, begins, holds, part.
TYPES = (
    ("Test", "is", ("test", "tests")), ("Test", "ends", (".test", ".tests", "tests")), ("Test", "begins", ("test-", "tests-")),
    ("TestSupport", "is", ("testing",)), ("TestSupport", "ends", (".testing",)), ("TestSupport", "holds", ("testsupport",)),
    ("Contracts", "holds", ("contracts", "annotations")), ("Contracts", "ends, no http part", (".headers", ".errors")),
    ("Api", "ends", ("api",)), ("Application", "holds", ("application",)), ("Application", "ends", (".app",)), ("Domain", "holds", ("domain", "business")), ("Domain", "ends", (".core",)),
    ("Infrastructure", "holds", (
        "infrastructure", "persistence", "database", "mediator", "messaging", "http", "refit", "serialization", "serializer", "reflection", "dependencyinjection", "bootstrap", "hosting",
        "entityframework", "cosmos", "mongodb", "grpc", "aras", "mapping", "opentelemetry", "polly", "kafka", "rabbitmq", "masstransit", "sagas", "azureevent", "multitenancy", "identity", "sso",
        "caching", "cache", "logging", "security", "integration", "transport", "storage", "observability", "resilience", "abstractions",
    )),
    ("Infrastructure", "part", ("io",)), ("Infrastructure", "ends", (".base",)), ("Infrastructure", "begins", ("base.",)),
    ("Consumer", "holds", ("consumer", "worker", "background")), ("Presentation", "holds", ("admin", "presentation", "web")), ("Client", "holds", ("client",)),
)
LANGUAGES = {"cs": "C#", "java": "Java", "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript"}
TEST_PACKAGES = ("xunit", "nunit", "mstest.")
NODE_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
ELSEWHERE = "^(file:|git:|git[+]|https?:|link:|workspace:|catalog:)"


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def _above(path: Column) -> Column:
    """A file's path as far as its last slash, or as it is without one; never null, so that joins filter by nothing where files are read."""
    return F.coalesce(F.regexp_replace(path, "/[^/]*$", ""), F.lit(""))


def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def type_of_name(name: Column) -> Column:
    """What kind of project a lower-case name speaks of; Unknown if of none."""
    parts = F.split(name, "[.]")
    tests = {
        "is": lambda x: name == x, "ends": lambda x: F.endswith(name, F.lit(x)), "begins": lambda x: F.startswith(name, F.lit(x)), "holds": lambda x: F.contains(name, F.lit(x)),
        "part": lambda x: F.array_contains(parts, x), "ends, no http part": lambda x: F.endswith(name, F.lit(x)) & ~F.array_contains(parts, "http"),
    }
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, map(tests[how], names)), kind) for kind, how, names in TYPES), F.lit("Unknown"))


def manifests(files: DataFrame) -> DataFrame:
    """(path, folder, format, broken, name, packaging, sdk, properties, packages) of package.json, pom.xml, *.csproj and requirements.txt.

    One pass over the texts: JSON as VARIANT, XML by paths, requirements by lines. packages has (section, name, spec); a broken
    manifest has none, and a null text is broken. Files that are no manifests have no row.
    """
    name = F.lower(_name(F.col("path")))
    form = F.when(name == "package.json", "npm").when(name == "pom.xml", "maven").when(F.endswith(name, F.lit(".csproj")), "dotnet").when(name == "requirements.txt", "pip")
    rows = files.withColumn("format", form).where("format is not null").select("path", _folder(F.col("path")).alias("folder"), "format", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    xml = F.col("format").isin("maven", "dotnet")
    rows = rows.withColumn("json", F.when(F.col("format") == "npm", F.try_parse_json("text")))
    bad_xml = F.from_xml("text", "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull() | (F.trim("text") == "")
    sections = [F.try_variant_get("json", f"$.{s}", "map<string,variant>") for s in NODE_SECTIONS]
    wrong = reduce(lambda a, b: a | b, (F.schema_of_variant(F.try_variant_get("json", f"$.{s}", "variant")).rlike("^(?!OBJECT)") for s in NODE_SECTIONS))
    no_object = F.col("json").isNull() | ~F.schema_of_variant("json").startswith("OBJECT") | F.coalesce(wrong, F.lit(False))
    rows = rows.withColumn("broken", F.when(xml, bad_xml).when(F.col("format") == "npm", no_object).otherwise(F.trim("text") == ""))

    def npm(section: str, declared: Column) -> Column:
        spec = lambda e: F.try_variant_get(e["value"], "$", "string")
        strings = F.filter(F.map_entries(declared), lambda e: F.schema_of_variant(e["value"]) == "STRING")
        return F.transform(strings, lambda e: F.struct(F.lit(section).alias("section"), F.trim(e["key"]).alias("name"), F.trim(spec(e)).alias("spec")))

    node = F.flatten(F.array(*(F.coalesce(npm(s, m), F.array().cast("array<struct<section:string,name:string,spec:string>>")) for s, m in zip(NODE_SECTIONS, sections))))
    text = lambda path: F.xpath("text", F.lit(path))
    given = lambda names, versions: F.transform(F.arrays_zip(names.alias("n"), versions.alias("v")), lambda z: F.struct(F.lit("references").alias("section"), F.trim(z["n"]).alias("name"), F.trim(z["v"]).alias("spec")))
    maven = F.transform(F.arrays_zip(text("/project/dependencies/dependency/groupId/text()").alias("g"), text("/project/dependencies/dependency/artifactId/text()").alias("a"), text("/project/dependencies/dependency[version]/version/text()").alias("v")), lambda z: F.struct(F.lit("references").alias("section"), F.concat(F.trim(z["g"]), F.lit(":"), F.trim(z["a"])).alias("name"), F.trim(z["v"]).alias("spec")))
    dotnet = F.concat(given(text("//PackageReference[@Version]/@Include"), text("//PackageReference[@Version]/@Version")), given(text("//PackageReference[not(@Version)]/@Include"), F.array().cast("array<string>")))
    lines = F.filter(F.transform(F.split("text", "\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "(^|[ \t])#.*", ""), ";.*", ""))), lambda x: (x != "") & ~x.rlike("^-|@|^(git[+]|https?://|file:)"))
    pip = F.filter(F.transform(lines, lambda x: F.struct(F.lit("requirements").alias("section"), F.lower(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1)).alias("name"), F.trim(F.regexp_replace(x, r"^[A-Za-z0-9._-]+ *(\[[^\]]*\])?", "")).alias("spec"))), lambda p: p["name"] != "")
    packages = F.when(F.col("broken"), F.array()).when(F.col("format") == "npm", node).when(F.col("format") == "maven", maven).when(F.col("format") == "dotnet", dotnet).otherwise(pip)
    own = F.when(F.col("broken"), None).when(F.col("format") == "npm", F.try_variant_get("json", "$.name", "string")).when(F.col("format") == "maven", F.get(text("/project/artifactId/text()"), 0))
    dot = lambda path: F.when((F.col("format") == "dotnet") & ~F.col("broken"), F.try_element_at(text(path), F.lit(-1)))
    properties = F.struct(
        dot("/Project/@Sdk").alias("sdk"), dot("//PropertyGroup/OutputType/text()").alias("output"), dot("//PropertyGroup/IsTestProject/text()").alias("test"), dot("//PropertyGroup/UseWPF/text()").alias("wpf"), dot("//PropertyGroup/UseWindowsForms/text()").alias("forms"),
        F.when((F.col("format") == "maven") & ~F.col("broken"), F.get(text("/project/packaging/text()"), 0)).alias("packaging"),
    )
    return rows.select("path", "folder", "format", "broken", F.trim(own).alias("name"), properties.alias("properties"), packages.cast("array<struct<section:string,name:string,spec:string>>").alias("packages"))


def declared_references(found: DataFrame) -> DataFrame:
    """(path, folder, format, section, name, spec): what manifests declare; spec is null without one and for what lies elsewhere."""
    rows = found.select("path", "folder", "format", F.explode("packages").alias("p")).select("path", "folder", "format", "p.*").where("trim(name) <> ''")
    return rows.withColumn("spec", F.when((F.trim("spec") == "") | F.col("spec").rlike(ELSEWHERE), None).otherwise(F.col("spec")))


def manifest_counts(found: DataFrame, by: str = "format") -> DataFrame:
    """(by, manifests, parse_failures, references, versions)."""
    spec = declared_references(found)
    counts = spec.groupBy("path").agg(F.count(F.lit(1)).alias("references"), F.count("spec").alias("versions"))
    return found.join(counts, "path", "left").groupBy(by).agg(F.count(F.lit(1)).alias("manifests"), F.count_if("broken").alias("parse_failures"), F.coalesce(F.sum("references"), F.lit(0)).alias("references"), F.coalesce(F.sum("versions"), F.lit(0)).alias("versions"))


def project_modules(files: DataFrame, found: DataFrame) -> DataFrame:
    """(folder, name, project_file, type, kind, framework, frameworks, languages, n_files): a project for each folder with a manifest.

    Its first manifest (project file, then pom.xml, then package.json) names it. A file belongs to the nearest folder above it;
    languages are those of the files that belong to the project. Folders are told apart without regard to case. requirements.txt
    makes no project. Files are counted by folder and language where they are read, and only the counts are joined with modules.
    """
    found = found.where("format <> 'pip'").withColumn("key", F.lower("folder"))
    rank = F.when(F.col("format") == "dotnet", 0).when(F.col("format") == "maven", 1).otherwise(2)
    names = lambda p: F.lower(p["name"])
    has = lambda *wanted: F.exists("packages", lambda p: names(p).isin(*wanted))
    p = F.col("properties")
    true = lambda c: F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))
    test_package = F.exists("packages", lambda x: (names(x) == "microsoft.net.test.sdk") | reduce(lambda a, b: a | b, (F.startswith(names(x), F.lit(t)) for t in TEST_PACKAGES)))
    net, node, java = (((F.col("format") == f) & ~F.col("broken")) for f in ("dotnet", "npm", "maven"))
    web = F.contains(F.lower(F.coalesce(p["sdk"], F.lit(""))), F.lit("microsoft.net.sdk.web")) | F.exists("packages", lambda x: F.contains(names(x), F.lit("microsoft.aspnetcore")))
    desktop, runs = true(p["wpf"]) | true(p["forms"]), F.coalesce(F.lower(p["output"]).isin("exe", "winexe"), F.lit(False))
    orm = F.exists("packages", lambda x: F.contains(names(x), F.lit("entityframeworkcore")))
    dotnet_framework = F.when(web, "ASP.NET Core").when(true(p["wpf"]), "WPF").when(true(p["forms"]), "Windows Forms").when(orm, ".NET (EF Core)").otherwise(".NET")
    front = F.array_compact(F.array(F.when(has("@angular/core", "@angular/cli"), "Angular"), F.when(has("react"), "React"), F.when(has("vue"), "Vue")))
    facts = found.select(
        "key", "folder", "path", F.when(F.col("format").isin("npm", "maven") & (F.coalesce("name", F.lit("")) != ""), F.col("name")).otherwise(F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "")).alias("name"), rank.alias("rank"),
        F.when(net, F.array(dotnet_framework)).when(java, F.array(F.lit("Java"))).when(node, F.when(F.size(front) > 0, front).otherwise(F.array(F.lit("Node.js")))).otherwise(F.array().cast("array<string>")).alias("frameworks"),
        (net & (true(p["test"]) | test_package)).alias("tests"),
        F.when(net, F.when(true(p["test"]) | test_package, "Test").when(web, "WebApplication").when(desktop, "DesktopApplication").when(runs, "Executable").otherwise("ClassLibrary"))
        .when(java, F.when(F.lower(F.coalesce(p["packaging"], F.lit(""))) == "war", "WebApplication").otherwise("JavaProject")).when(node, F.when(F.size(front) > 0, "FrontendApplication").otherwise("NodePackage")).alias("kind"),
        F.when(java, F.col("name")).alias("artifact"),
    )
    first = F.struct("rank", F.lower("path").alias("low"), "path", "name", "folder")
    # a pom.xml says the kind last; package.json only where nothing else has said one
    said = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("kind"))), F.max(F.when(F.col("rank") == 0, F.col("kind"))), F.max(F.when(F.col("rank") == 2, F.col("kind"))), F.lit("Unknown"))
    of_rank = F.array_sort(F.collect_list(F.struct("rank", "frameworks")))
    modules = facts.groupBy("key").agg(F.min(first).alias("first"), F.max("artifact").alias("artifact"), said.alias("kind"), F.max("tests").alias("tests"), of_rank.alias("of_rank"))
    name = F.coalesce(F.when(F.col("artifact") != "", F.col("artifact")), F.col("first.name"))
    parts = F.split("key", "/")
    last = F.element_at(parts, -1)
    holds_tests = F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests")))
    support = F.contains(last, F.lit("testsupport")) | (last == "testing") | F.endswith(last, F.lit(".testing"))
    by_path = type_of_name(last)
    kind_of_module = F.when(holds_tests, "Test").when(support, "TestSupport").when(by_path != "Unknown", by_path).otherwise(type_of_name(F.lower(F.col("module"))))
    modules = modules.withColumn("module", name).withColumn("guess", kind_of_module).withColumn("type", F.when(F.col("tests") | (F.col("guess") == "Test"), "Test").otherwise(F.col("guess")))

    language = F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), _ext(F.col("path")))
    kept = ["path", "language", "razor"]
    low = files.where("path is not null").select(F.lower("path").alias("path"))
    counts = low.select(_above(F.col("path")).alias("path"), language.alias("language"), F.endswith("path", F.lit(".razor")).alias("razor")).groupBy(*kept).agg(F.count(F.lit(1)).alias("n"))
    holds = owned(counts, modules.select(F.col("key").alias("module_path")), kept).groupBy(F.col("owner").alias("key")).agg(F.array_sort(F.collect_set("language")).alias("languages"), F.sum("n").alias("n_files"), F.max("razor").alias("razor"))
    modules = modules.join(holds, "key", "left")
    net_module = F.exists("of_rank", lambda x: (x["rank"] == 0) & (F.size(x["frameworks"]) > 0))
    frameworks = F.array_distinct(F.flatten(F.array_compact(F.array(F.flatten(F.transform(F.filter("of_rank", lambda x: x["rank"] == 0), lambda x: x["frameworks"])), F.when(net_module & F.col("razor"), F.array(F.lit("Blazor"))), F.flatten(F.transform(F.filter("of_rank", lambda x: x["rank"] == 2), lambda x: x["frameworks"])), F.flatten(F.transform(F.filter("of_rank", lambda x: x["rank"] == 1), lambda x: x["frameworks"]))))))
    # Node.js is named only where the project has no other framework so far
    plain = F.when((F.size(frameworks) > 1) & net_module, F.array_except(frameworks, F.array(F.lit("Node.js")))).otherwise(frameworks)
    rows = modules.withColumn("frameworks", plain)
    framework = F.when(F.size("frameworks") == 0, None).when(F.size("frameworks") == 1, F.get("frameworks", 0)).otherwise("Multi-Framework")
    kind = F.when(F.col("type").isin("Test", "TestSupport"), F.col("type")).otherwise(F.col("kind"))
    empty = F.array().cast("array<string>")
    return rows.select(
        F.col("first.folder").alias("folder"), F.col("module").alias("name"), F.col("first.path").alias("project_file"), "type", kind.alias("kind"), framework.alias("framework"), F.array_join("frameworks", ", ").alias("frameworks"),
        F.array_join(F.coalesce("languages", empty), ", ").alias("languages"), F.coalesce("n_files", F.lit(0)).alias("n_files"),
    )


def imported_names(files: DataFrame) -> DataFrame:
    """(path, name): packages that source files name: imports, requires, usings; relative ones and builtins aside, without repeats."""
    ext = F.col("ext")
    patterns = {
        "js": r"(?:from|import|require[(])\s*['\"]([^'\".][^'\"]*)['\"]", "py": r"(?:^|\n)\s*(?:import|from)[ \t]+([A-Za-z_][A-Za-z0-9_.]*)",
        "java": r"(?:^|\n)\s*import[ \t]+(?:static[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)", "cs": r"(?:^|\n)\s*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)[ \t]*;",
    }
    found = F.when(ext.isin("js", "jsx", "ts", "tsx"), F.regexp_extract_all("text", F.lit(patterns["js"]), 1))
    for x in ("py", "java", "cs"):
        found = found.when(ext == x, F.regexp_extract_all("text", F.lit(patterns[x]), 1))
    rows = files.select("path", "text", _ext(F.col("path")).alias("ext"))
    return rows.select("path", "ext", F.explode_outer(F.array_distinct(found)).alias("name")).where("name is not null")  # outer: the plain one looks for names twice


def unused_references(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, folder, format, name): declared references that no file of the project names.

    Identifiers of each project's files (an inverted index: prefix of a name, project) are anti-joined with what it declares. A scoped
    or deep import names its package; a namespace names every package that it begins with; for Java the group counts. A project
    without source files in the manifest's languages has no unused references, as nothing is known. What the files of a folder name is
    gathered where they are read, without repeats; no path of a file is shuffled.
    """
    speaks = {"npm": ("js", "jsx", "ts", "tsx"), "pip": ("py",), "maven": ("java",), "dotnet": ("cs",)}
    form = F.coalesce(*(F.when(F.col("ext").isin(*x), f) for f, x in speaks.items()), F.lit(""))
    at = [_above(F.col("path")).alias("path"), form.alias("format")]
    files = files.where("path is not null")
    spoken = files.select("path", _ext(F.col("path")).alias("ext")).select(*at).distinct()
    placed = owned(spoken, found.select(F.col("folder").alias("module_path")), ["path", "format"])
    known = placed.select(F.col("owner").alias("folder"), "format").distinct()
    names = imported_names(files).select(*at, "name").distinct()
    parts = F.when(F.col("format") == "npm", F.split("name", "/")).otherwise(F.split(F.lower("name"), "[.]"))
    joined = lambda x: F.when(F.col("format") == "npm", F.array_join(x, "/")).otherwise(F.array_join(x, "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: joined(F.slice(parts, F.lit(1), n)))
    index = names.join(placed, ["path", "format"]).select(F.col("owner").alias("folder"), "format", F.explode_outer(prefixes).alias("used")).distinct()
    declared = declared_references(found).join(known, ["folder", "format"], "left_semi")
    key = F.when(F.col("format") == "maven", F.lower(F.regexp_extract("name", "^([^:]+)", 1))).when(F.col("format") == "pip", F.translate(F.lower("name"), "-", "_")).when(F.col("format") == "dotnet", F.lower("name")).otherwise(F.col("name"))
    return declared.withColumn("used", key).join(index, ["folder", "format", "used"], "left_anti").select("path", "folder", "format", "name")
