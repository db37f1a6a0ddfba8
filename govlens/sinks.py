"""Findings and reports to files. Queries stay in Spark; only small frames are rendered on the driver."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rows a rendering takes at most; it says so when there are more.
MOST_ROWS = 200


def write_csv(findings: DataFrame, path: str) -> None:
    """Quoted CSV with a header; line breaks inside a value become blanks."""
    flat = [F.regexp_replace(F.col(c), "[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in findings.dtypes]
    findings.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def json_report(findings: DataFrame, level: str = "full") -> DataFrame:
    """One JSON value a row: by category (summary), by category and domain (standard), or each finding (full)."""
    if level == "full":
        return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))
    by = ["category"] if level == "summary" else ["category", "domain"]
    top = findings.groupBy(*by, "rule_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max_by("rule_id", F.struct("n", F.col("rule_id"))).alias("top_rule"), F.sum("n").alias("violations"))
    counts = findings.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"))
    joined = top.join(counts, by)
    return joined.select(F.to_json(F.struct(*joined.columns)).alias("value"))


def write_json(findings: DataFrame, path: str, level: str = "full") -> None:
    json_report(findings, level).write.mode("overwrite").text(path)


def append_history(results: DataFrame, path: str, by: str = "project") -> None:
    results.write.mode("append").partitionBy(by).parquet(path)


def write_snapshot(report: DataFrame, path: str, report_id: str) -> None:
    """Store one whole report under its id: all at once when the job commits, and in place of an earlier snapshot of that id alone."""
    rows = report.withColumn("report_id", F.lit(report_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_id").parquet(path)


def read_snapshot(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """The report of this id, from its own folder alone; no rows if there is none."""
    text = spark.read.option("basePath", path).schema(_with_text_id(spark.read.parquet(path).schema)).parquet(path)
    return text.where(F.col("report_id") == report_id).drop("report_id")


def _with_text_id(schema: StructType) -> StructType:
    """The schema with report_id as a string, whatever the ids of the folders look like."""
    return StructType([StructField(f.name, StringType()) if f.name == "report_id" else f for f in schema.fields])


def _rows(df: DataFrame) -> tuple[list[str], list[tuple], bool]:
    rows = df.limit(MOST_ROWS + 1).collect()
    return df.columns, [tuple("" if v is None else str(v) for v in r) for r in rows[:MOST_ROWS]], len(rows) > MOST_ROWS


def markdown(title: str, df: DataFrame) -> str:
    columns, rows, more = _rows(df)
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join(lines + ["", "More rows were left out."] * more) + "\n"


def html_page(title: str, df: DataFrame) -> str:
    columns, rows, more = _rows(df)
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    table = "<table>" + line("th", columns) + "".join(line("td", r) for r in rows) + "</table>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{table}{'<p>More rows were left out.</p>' if more else ''}</body></html>"


def fan_out(sinks: dict[str, Callable[[], object]]) -> dict[str, str | None]:
    """Run every sink; one that fails is told by its message and does not stop the others."""
    out: dict[str, str | None] = {}
    for name, run in sinks.items():
        try:
            run()
            out[name] = None
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out
