"""Cycles of any length: strongly connected components of many graphs at once.

A group of edges (a project, later a colour of it) of bounded size is solved in the task that it is sent to, which takes many
groups, sorted, one after the other. A larger one is cut by colouring: every node takes the largest node that reaches it; the nodes of a colour that reach its name back are one
component; what remains falls apart into its colours, as no component has two. Each round writes tables, so it survives lost
executors, and finishes at least one component of each large group, so no size is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.operators.written import written

#: Edges that one task solves.
TASK_EDGES = 200_000
#: Edges from which on the groups at hand are solved; they are never cut.
_CHUNK = 50_000
_FOUND = "project string, node long, component long, size long, inner long"


def components_of(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest node of each node's component: Tarjan's search without recursion."""
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    component: dict[int, int] = {}
    stack: list[int] = []
    for root in after:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        path = [(root, iter(after[root]))]
        while path:
            node, rest = path[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    path.append((b, iter(after[b])))
                    break
                if b not in component:
                    low[node] = min(low[node], index[b])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    component.update(dict.fromkeys(members, min(members)))
    return component


def _changes(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(where a row's group is not the one before's, the projects); rows of a group follow each other."""
    projects = table.column("project").combine_chunks().dictionary_encode()
    project, part = projects.indices.to_numpy(), table.column("part").to_numpy()
    return np.concatenate([[False], (project[1:] != project[:-1]) | (part[1:] != part[:-1])]), projects


def _solve_groups(table: pa.Table) -> pa.RecordBatch:
    """The nodes of whole groups of edges, solved as one graph whose parts don't meet."""
    changes, projects = _changes(table)
    group, n = np.cumsum(changes), table.num_rows
    ends, of = np.concatenate([table.column("source").to_numpy(), table.column("target").to_numpy()]), np.concatenate([group, group])
    order = np.lexsort((ends, of))
    first = np.concatenate([[True], (ends[order][1:] != ends[order][:-1]) | (of[order][1:] != of[order][:-1])])
    number = np.empty(2 * n, np.int64)
    number[order] = np.cumsum(first) - 1  # rises with the node inside its group
    rows, source, target = order[first] % n, number[:n], number[n:]
    nodes = ends[order][first]
    # An edge from a node that none enters, or to one that none leaves, is on no cycle; stop where that no longer takes an eighth.
    a, b, before = source, target, 0
    while len(a) and (not before or before - len(a) > before // 8):
        before = len(a)
        kept = (np.bincount(b, minlength=len(nodes))[a] > 0) & (np.bincount(a, minlength=len(nodes))[b] > 0)
        a, b = a[kept], b[kept]
    component = np.arange(len(nodes))
    if found := components_of(list(zip(a.tolist(), b.tolist()))):
        component[list(found)] = list(found.values())
    size = np.bincount(component)[component]
    inner = np.bincount(source[component[source] == component[target]], minlength=len(nodes))
    return pa.RecordBatch.from_arrays([projects.take(pa.array(rows)).dictionary_decode(), *map(pa.array, (nodes, nodes[component], size, inner))], ["project", "node", "component", "size", "inner"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n, limit = 0, _CHUNK
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(_changes(table)[0])
            cut = int(starts[-1]) if len(starts) else 0  # the last group may go on
            if cut:
                yield _solve_groups(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), n - cut
            limit = max(_CHUNK, 2 * n)
    if n:
        yield _solve_groups(pa.Table.from_batches(held))


def _settled(of: DataFrame, step) -> DataFrame:
    """Repeat step, which gives (table, something changed), until nothing changes."""
    while True:
        of, changed = step(of)
        if not changed:
            return of


def _colours(edges: DataFrame) -> DataFrame:
    """(project, part, node, colour): the largest node of the group that reaches each node."""
    by = ["project", "part", "node"]
    ends = edges.select("project", "part", F.col("source").alias("node")).unionByName(edges.select("project", "part", F.col("target").alias("node")))
    start = written(ends.distinct().withColumn("colour", F.col("node")))

    def step(colours: DataFrame) -> tuple[DataFrame, bool]:
        sent = edges.join(colours.withColumnRenamed("node", "source"), ["project", "part", "source"]).select("project", "part", F.col("target").alias("node"), F.col("colour").alias("new"))
        best = sent.groupBy(*by).agg(F.max("new").alias("new"))
        now = written(colours.join(best, by, "left").select(*by, F.greatest("colour", "new").alias("colour"), F.coalesce(F.col("new") > F.col("colour"), F.lit(False)).alias("moved")))
        return now.drop("moved"), now.where("moved").limit(1).count() > 0

    return _settled(start, step)


def _members(coloured: DataFrame, colours: DataFrame) -> DataFrame:
    """(project, part, node, component): the nodes that reach their colour's name inside the colour."""
    by = ["project", "part", "node"]
    start = written(colours.where("node = colour").select(*by, F.col("colour").alias("component")))

    def step(found: DataFrame) -> tuple[DataFrame, bool]:
        back = coloured.join(found.withColumnRenamed("node", "target"), ["project", "part", "target"]).where("colour = component")
        new = written(back.select("project", "part", F.col("source").alias("node"), "component").distinct().join(found.select(*by), by, "left_anti"))
        more = new.limit(1).count() > 0
        return (written(found.unionByName(new)) if more else found), more

    return _settled(start, step)


def _components(edges: DataFrame, task_edges: int) -> DataFrame:
    """(project, node, component, size, inner) of every node: inner is the number of its distinct edges to nodes of its component."""
    group = ["project", "part"]
    left = edges.select(F.col("project").cast("string").alias("project"), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).na.drop().distinct()
    left = written(left.withColumn("part", F.lit(0).cast("long")))
    done = None
    while True:
        # at most one row for each task_edges edges
        crowded = written(left.groupBy(*group).agg(F.count(F.lit(1)).alias("n_edges")).where(F.col("n_edges") > task_edges).select(*group))
        more = crowded.limit(1).count() > 0
        small = left.join(F.broadcast(crowded), group, "left_anti") if more else left
        solved = small.select("project", "part", "source", "target").repartition(*group).sortWithinPartitions(*group).mapInArrow(_solve, _FOUND)
        done = solved if done is None else done.unionByName(solved)
        if not more:
            return done
        large = written(left.join(F.broadcast(crowded), group, "left_semi"))
        colours = _colours(large)
        own = large.join(colours.select(*group, F.col("node").alias("source"), "colour"), [*group, "source"])
        same = written(own.join(colours.select(*group, F.col("node").alias("target"), F.col("colour").alias("other")), [*group, "target"]).where("colour = other").drop("other"))
        found = _members(same, colours)
        names = found.groupBy(*group, "component").agg(F.min("node").alias("smallest"), F.count(F.lit(1)).alias("size"))
        ends = same.join(found.withColumnRenamed("node", "source"), [*group, "source"]).join(found.select(*group, F.col("node").alias("target"), F.col("component").alias("other")), [*group, "target"])
        inner = ends.where("component = other").groupBy(*group, F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
        named = found.join(names, [*group, "component"]).join(inner, [*group, "node"], "left").select("project", "node", F.col("smallest").alias("component"), "size", F.coalesce("inner", F.lit(0).cast("long")).alias("inner"))
        gone = found.select(*group, "node")
        rest = same.join(gone.withColumnRenamed("node", "source"), [*group, "source"], "left_anti").join(gone.withColumnRenamed("node", "target"), [*group, "target"], "left_anti")
        lone = colours.join(gone, [*group, "node"], "left_anti").join(rest.select(*group, F.col("source").alias("node")).unionByName(rest.select(*group, F.col("target").alias("node"))).distinct(), [*group, "node"], "left_anti")
        lone = lone.select("project", "node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("inner"))
        done = written(done.unionByName(named).unionByName(lone))
        left = written(rest.select("project", "source", "target", F.col("colour").alias("part")))


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(project, node, component, size, cyclic) of every node: component is its smallest node, cyclic says that a cycle goes through it.

    edges are (project, source, target); repeats count once, and rows with a null project, source or target are no edges.
    """
    return _components(edges, task_edges).select("project", "node", "component", "size", (F.col("inner") > 0).alias("cyclic"))


def _facts(components: DataFrame) -> DataFrame:
    """A component is counted at the node that it is named after."""
    c = F.col("cyclic")
    return components.groupBy("project").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(c & (F.col("node") == F.col("component"))).alias("cycles"), F.count_if(c).alias("cyclic_nodes"), F.coalesce(F.max(F.when(c, F.col("size"))), F.lit(0)).alias("largest"), F.sum("inner").alias("inner_edges")
    )


def project_cycles(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """The rows of `cycle_facts` straight from the edges: components and the edges within them are counted where they are found."""
    return _facts(_components(edges, task_edges).withColumn("cyclic", F.col("inner") > 0))


def cycle_facts(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(project, nodes, cycles, cyclic_nodes, largest, inner_edges): what the rule against circular dependencies asks for.

    cycles counts the components that a cycle goes through, inner_edges the distinct edges within them.
    """
    c = components.where("cyclic")
    unique = edges.select(F.col("project").cast("string").alias("project"), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).na.drop().distinct()
    ends = unique.join(c.select("project", F.col("node").alias("source"), "component"), ["project", "source"]).join(c.select("project", F.col("node").alias("target"), F.col("component").alias("other")), ["project", "target"])
    inner = ends.where("component = other").groupBy("project", F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
    return _facts(components.join(inner, ["project", "node"], "left").withColumn("inner", F.coalesce("inner", F.lit(0).cast("long"))))
