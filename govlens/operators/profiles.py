"""What kind of repository the modules make: domain, style, patterns, nature, boundaries and how sure that is.

modules: (repo, module, kind, role, frameworks, dependencies, layer); role is production, test or support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a single kind of project makes of a repository, and of its nature.
DOMAIN_OF_KIND = {"ClassLibrary": "Library", "WebApplication": "Backend", "FrontendApplication": "Frontend", "DesktopApplication": "Desktop", "Executable": "Application"}
NATURE_OF_KIND = {
    "Test": "TestSuite", "ClassLibrary": "Library", "TestSupport": "Library", "WebApplication": "Service", "FrontendApplication": "FrontendApp",
    "DesktopApplication": "DesktopApp", "Executable": "Application",
}
# Packages that carry messages, and (part of a package's name, pattern) and (part of a framework's name, pattern).
MESSAGING = ("MassTransit", "Confluent.Kafka", "RabbitMQ.Client", "NServiceBus", "Azure.Messaging.ServiceBus")
PACKAGE_PATTERNS = (
    ("mediat", "CQRS"), ("entityframework", "Repository Pattern"), ("kafka|rabbit|masstransit", "Event Driven Architecture"), ("dependencyinjection", "Dependency Injection"),
)
FRAMEWORK_PATTERNS = (
    ("angular", "Angular Modular Architecture"), ("spring", "Spring Layered Architecture"), ("django", "Django MTV Architecture"), ("asp.net", "ASP.NET Web Architecture"),
)
# Per preset and layer, the layers it may and may not use.
BOUNDARIES = [
    ("clean", "Domain", [], ["Application", "Infrastructure", "Api", "Presentation", "Database"]),
    ("clean", "Application", ["Domain", "Contracts"], ["Api", "Presentation", "Infrastructure"]),
    ("clean", "Infrastructure", ["Application", "Domain", "Contracts"], []),
    ("clean", "Api", ["Application", "Domain", "Infrastructure", "Contracts"], []),
    ("clean", "Presentation", ["Application", "Contracts", "Client"], ["Infrastructure", "Database"]),
    ("clean", "Contracts", [], []),
    ("layered", "Domain", [], []),
    ("layered", "Application", ["Domain", "Contracts"], ["Api", "Presentation"]),
    ("layered", "Infrastructure", ["Domain", "Application", "Contracts"], []),
    ("layered", "Api", ["Application", "Domain", "Infrastructure", "Contracts"], []),
    ("layered", "Contracts", [], []),
]
BOUNDARY_SCHEMA = "preset string, source_layer string, allowed array<string>, forbidden array<string>"


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _holds(column: str, part: str) -> Column:
    return F.exists(column, lambda x: F.lower(x).rlike(part))


def repository_profile(modules: DataFrame) -> DataFrame:
    """Per repo: domain, style, patterns, nature and confidence. Blank and unknown kinds count as none."""
    production = F.col("role") == "production"
    kind = F.when(production & (F.trim("kind") != "") & (F.col("kind") != "Unknown"), F.col("kind"))
    web = production & (F.col("kind") == "WebApplication")
    of = modules.groupBy("repo").agg(
        F.array_sort(F.collect_set(kind)).alias("kinds"), F.count_if(production).alias("n_production"), F.count_if(F.col("role") == "support").alias("n_support"),
        F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(web).alias("n_web"), F.count_if(production & F.col("kind").isin("WebApplication", "Executable")).alias("n_service"),
        F.coalesce(F.bool_or(web & F.array_contains("frameworks", "Blazor")), F.lit(False)).alias("web_blazor"),
        F.coalesce(F.bool_or(production & F.array_contains("frameworks", "Blazor")), F.lit(False)).alias("any_blazor"),
        F.array_distinct(F.flatten(F.collect_list("frameworks"))).alias("frameworks"), F.array_distinct(F.flatten(F.collect_list("dependencies"))).alias("dependencies"),
        F.collect_set("layer").alias("layers"), F.min("kind").alias("one_kind"),
    )
    has = lambda x: F.array_contains("kinds", x)
    only = lambda x: has(x) & (F.size(F.array_except("kinds", F.array(F.lit(x), F.lit("ClassLibrary")))) == 0)
    backend = _holds("frameworks", "asp[.]net core|entityframeworkcore")
    domain = (
        F.when(has("WebApplication") & has("FrontendApplication") | (F.col("n_web") > 1) & F.col("web_blazor"), "FullStack")
        .when(only("WebApplication"), F.when(F.col("any_blazor"), "FullStack").otherwise("Backend")).when(only("FrontendApplication"), "Frontend")
        .when(only("DesktopApplication"), "Desktop").when(F.size("kinds") > 1, "Mixed").when(F.size("kinds") == 1, F.coalesce(_mapped(F.get("kinds", F.lit(0)), DOMAIN_OF_KIND), F.lit("Unknown")))
        .when((F.col("n_production") == 0) & (F.col("n_support") > 0), "Library").when((F.col("n_production") == 0) & (F.col("n_test") > 0), "Test")
        .when((F.array_contains("frameworks", "Blazor") | F.array_contains("frameworks", "Unity")) & backend, "FullStack")
        .when(F.array_contains("frameworks", "Unity"), "Game").when(F.array_contains("frameworks", "Blazor"), "Frontend").otherwise("Unknown")
    )
    layer = F.when(F.size("layers") == 1, F.get("layers", F.lit(0)))
    mediator = F.exists("dependencies", lambda x: F.contains(x, F.lit("MediatR")) | F.contains(x, F.lit("Common.Mediator")))
    entities = F.exists("dependencies", lambda x: F.contains(x, F.lit("EntityFrameworkCore")))
    messages = F.exists("dependencies", lambda x: x.rlike("|".join(m.replace(".", "[.]") for m in MESSAGING)))
    many = F.col("n_production") > 1
    style = (
        F.when(F.col("domain") == "Library", F.when(many, "Multi-Project Library").otherwise("Library")).when(F.col("domain") == "Mixed", "Multi-Project / Mixed")
        .when(mediator & entities, "CQRS").when(entities & (F.col("layer") == "Infrastructure"), "Clean").when((F.col("domain") == "FullStack") & many, "Multi-Project Full-Stack")
        .when((F.col("n_service") == 1) & many, "Modular Monolith").when(messages & (F.col("n_service") > 1), "Message-Driven Multi-Service")
        .when(messages, "Message-Driven Application").when(F.col("domain").isin("Backend", "FullStack") & (F.col("layer") == "Api"), "MVC").otherwise("Layered")
    )
    found = [F.when(_holds("frameworks", part.replace(".", "[.]")), name) for part, name in FRAMEWORK_PATTERNS]
    found += [F.when(_holds("dependencies", part), name) for part, name in PACKAGE_PATTERNS]
    found += [F.when(many, "Modular Architecture"), F.when(F.array_contains("layers", "Domain"), "Domain Driven Design")]
    nature = (
        F.when(many, "MultiProject").when((F.col("n_production") == 0) & (F.col("n_support") > 0), "Library").when((F.col("n_production") == 0) & (F.col("n_test") > 0), "TestSuite")
        .otherwise(F.coalesce(_mapped(F.get("kinds", F.lit(0)), NATURE_OF_KIND), F.lit("Generic")))
    )
    sure = lambda known, yes, no: F.when(known, F.lit(yes)).otherwise(F.lit(no))
    # How sure each part of the profile is with and without a sign of it.
    parts = [
        sure(F.size("frameworks") > 0, 0.9, 0.5), sure(F.col("domain") != "Unknown", 0.85, 0.5), sure(F.size("layers") > 0, 0.85, 0.4),
        sure(F.col("style").isNotNull(), 0.75, 0.5), sure(F.col("n_production") > 0, 0.9, 0.4),
    ]
    profile = of.withColumn("domain", domain).withColumn("layer", layer).withColumn("style", style).withColumn("patterns", F.array_compact(F.array(*found))).withColumn("nature", nature)
    mean = F.round(sum(parts[1:], parts[0]) / len(parts), 4)
    preset = F.when(F.array_contains("patterns", "Domain Driven Design") | (F.col("style") == "Clean"), "clean").otherwise("layered")
    return profile.select("repo", "domain", "style", "patterns", "nature", preset.alias("preset"), mean.alias("confidence"))


def boundary_decisions(edges: DataFrame, boundaries: DataFrame) -> DataFrame:
    """edges (preset, source_layer, target_layer, ...) with a decision; a layer whose boundary lists nothing decides nothing."""
    rules = boundaries.select(F.col("preset").alias("b_preset"), F.lower("source_layer").alias("b_source"), "allowed", "forbidden")
    met = edges.join(F.broadcast(rules), (F.col("preset") == F.col("b_preset")) & (F.lower("source_layer") == F.col("b_source")), "left")  # eleven rows
    listed = lambda c: F.exists(c, lambda x: F.lower(x) == F.lower("target_layer"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    decision = (
        F.when(blank("source_layer") | blank("target_layer"), "Unclassified").when(F.lower("source_layer") == F.lower("target_layer"), "SameLayer")
        .when(F.col("b_source").isNull(), "Unclassified").when(listed("forbidden"), "Forbidden").when(F.size("allowed") == 0, "Unclassified")
        .when(listed("allowed"), "Allowed").otherwise("Forbidden")
    )
    return met.withColumn("decision", decision).drop("b_preset", "b_source", "allowed", "forbidden")


def deployability(files: DataFrame) -> DataFrame:
    """Per repo: whether its files hold container and cluster descriptions, and its entry point."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    entry = F.when(name == "program.cs", 0).when(name == "startup.cs", 1).when(name.rlike("main[.](cs|py|ts|js)$"), 2)
    return files.groupBy("repo").agg(
        F.bool_or((name == "dockerfile") | F.contains(F.lower("path"), F.lit("docker-compose"))).alias("containerized"),
        F.bool_or(F.col("path").rlike("(deployment|ingress|service)[.]yaml")).alias("clustered"), F.min_by("path", F.when(entry.isNotNull(), F.struct(entry, "path"))).alias("entry_point"),
    )
