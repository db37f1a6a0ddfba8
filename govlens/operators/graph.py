"""Dependency edges: policy, density, degrees, fan-out, cycles, paths and their owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.functions.expr import half_even


def classify_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Allowed, Forbidden, or Unclassified where the policy doesn't know the source layer."""
    sources = pairs.select(F.col("source_layer").alias("known")).distinct()
    marked = edges.join(F.broadcast(sources), F.col("source_layer") == F.col("known"), "left").join(F.broadcast(pairs.withColumn("listed", F.lit(True))), ["source_layer", "target_layer"], "left")
    verdict = F.when(F.col("source_layer") == F.col("target_layer"), "Allowed").when(F.col("known").isNull(), "Unclassified").when(F.col("listed"), "Allowed").otherwise("Forbidden")
    return marked.withColumn("verdict", verdict).drop("known", "listed")


def density(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes over n (n - 1)."""
    distinct = edges.where("source <> target").select("source", "target").distinct()
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    return distinct.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("n_nodes"))).withColumn("density", half_even(F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(F.lit(0.0)), 4))


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("source").alias("node")).agg(F.countDistinct("target").alias("out_degree"), F.sum("observed").alias("out_observed"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("in_degree"), F.sum("observed").alias("in_observed"))
    return out.join(into, "node", "full_outer").na.fill(0)


def fan_out(edges: DataFrame, limit: int) -> DataFrame:
    """Layers that depend on more than limit others."""
    return edges.where("source_layer <> target_layer").groupBy("source_layer").agg(F.countDistinct("target_layer").alias("targets"), F.countDistinct("source", "target").alias("relations")).where(F.col("targets") > limit)


def short_cycles(edges: DataFrame) -> DataFrame:
    """Elementary cycles of up to three nodes, each once, from its smallest node. Their number doesn't depend on an order."""
    e = edges.select("source", "target").distinct()
    none = F.lit(None).cast("long")
    one = e.where("source = target").select(F.col("source").cast("long").alias("a"), none.alias("b"), none.alias("c"))
    proper = e.where("source <> target")
    first = proper.select(F.col("source").cast("long").alias("a"), F.col("target").cast("long").alias("b")).where("a < b")
    back = proper.select(F.col("source").cast("long").alias("b"), F.col("target").cast("long").alias("a"))
    two = first.join(back, ["a", "b"]).select("a", "b", none.alias("c"))
    middle = proper.select(F.col("source").cast("long").alias("b"), F.col("target").cast("long").alias("c"))
    last = proper.select(F.col("source").cast("long").alias("c"), F.col("target").cast("long").alias("a"))
    three = first.join(middle, "b").where("a < c").join(last, ["a", "c"]).select("a", "b", "c")
    return one.unionByName(two).unionByName(three)


def ego_network(edges: DataFrame, node: int) -> DataFrame:
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def layer_labels(edges: DataFrame) -> DataFrame:
    """The layers each node depends on, sorted, as one string; nodes without a label come last."""
    found = edges.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target_layer")), " · ").alias("layers"))
    parts = ["unlabelled", "label", "block"]  # in order of position; a part holds 65,536 nodes at most
    rows = found.withColumns({"unlabelled": F.when(F.col("layers") == "", 1).otherwise(0), "label": F.lower("layers"), "block": F.shiftright("source", 16)})
    counts = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"{c}_of") for c in parts), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy("source"))
    dealt = rows.withColumn("inside", inside).join(counts, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in parts])
    return dealt.select("source", "layers", (F.col("before") + F.col("inside")).cast("int").alias("position"))


def owned(rows: DataFrame, modules: DataFrame, keys: list[str]) -> DataFrame:
    """The deepest module that owns the path of each row, by keys, which hold the path; rows that none owns are left out.

    The outer explode adds no filter of its own, which would be worked out where the rows are read.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = rows.withColumn("module_path", F.explode_outer(prefixes)).join(modules.select("module_path").distinct(), "module_path")
    rest = [F.first(c).alias(c) for c in rows.columns if c not in keys]
    return own.groupBy(*keys).agg(F.max_by("module_path", F.length("module_path")).alias("owner"), *rest)


def owners(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """The deepest module that owns each path. Each path is joined by its own prefixes, so this is an equi-join."""
    deepest = owned(paths.select("path").distinct(), modules, ["path"])
    return paths.join(deepest, "path", "left").select(*paths.columns, "owner")


def outermost(roots: DataFrame) -> DataFrame:
    """Roots that lie in no other root; a sibling with the same beginning is no parent. Each root is joined by its own proper prefixes."""
    parts = F.split("module_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = roots.where(F.size(parts) > 1).select("module_path", F.explode(above).alias("outer_path")).join(roots.select(F.col("module_path").alias("outer_path")).distinct(), "outer_path", "left_semi")
    return roots.join(inside.select("module_path").distinct(), "module_path", "left_anti").select(*roots.columns)
