"""The library's own catalogues: ordinals, rules, policies. Small by construction; joined as broadcast dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Ordinals of severities; labels are never compared as strings.
SEVERITIES = {"Info": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4, "Blocker": 5}
RISKS = ["Information", "Low", "Moderate", "High", "Severe"]

RULE_SCHEMA = "rule_id string, name string, category string, scope string, metric_key string, op string, threshold double, severity string, enabled boolean, unsupported string"
RULES = [
    ("G-PRICE-1", "discount too deep", "Security", "File", "Discount", ">", 0.08, "High", True, None),
    ("G-PRICE-2", "tax too high", "Maintainability", "File", "Tax", ">=", 0.07, "Medium", True, None),
    ("G-PRICE-3", "unit price out of range", "Security", "File", "UnitPrice", ">", 2900.0, "Blocker", True, None),
    ("G-VOL-1", "volume too small", "Performance", "File", "Quantity", "<", 5.0, "Low", True, None),
    ("G-VOL-2", "volume too large", "Architecture", "File", "quantity", ">", 46.0, "Critical", True, None),
    ("G-VOL-3", "volume at the sentinel", "Naming", "File", "Quantity", "=", 25.00005, "Info", True, None),
    ("G-SCOPE-1", "project volume", "Architecture", "Project", "Quantity", ">", 10.0, "High", True, None),
    ("G-MISS-1", "coupling", "Architecture", "File", "Coupling", ">", 0.6, "Medium", True, None),
    ("G-MISS-2", "cohesion", "Maintainability", "File", "Cohesion", "<", 75.0, "Medium", True, "no producer measures cohesion"),
    ("G-NAN-1", "threshold is not a number", "Naming", "File", "Tax", ">", float("nan"), "Low", True, None),
    ("G-OFF-1", "switched off", "Naming", "File", "Tax", ">", 0.01, "Low", False, None),
]

#: (by rule id or metric key, value): the rule's own override wins over its metric's.
OVERRIDES = [("rule", "g-price-1", 0.06), ("metric", "DISCOUNT", 0.03), ("metric", "tax", 0.05)]


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rules(spark: SparkSession) -> DataFrame:
    return dimension(spark, RULES, RULE_SCHEMA)


def severities(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(k, v) for k, v in SEVERITIES.items()], "severity string, ordinal int")


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return "'NaN'::DOUBLE" if x != x else f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values_sql(rows: list[tuple], schema: str, name: str) -> str:
    """The same catalogue as a SQL relation."""
    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS {name}({columns})"
