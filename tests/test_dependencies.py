"""Strong components, modules, versions and references against values worked out by hand or by plain search."""

import random

import pytest
from govlens.operators import cycles

EDGES = [("p", 1, 2), ("p", 2, 3), ("p", 3, 1), ("p", 3, 4), ("p", 4, 5), ("p", 5, 4), ("p", 6, 6), ("p", 7, 1), ("p", 5, 8), ("q", 1, 2), ("q", 2, 3), ("p", 1, 2), (None, 1, 2), ("q", None, 2)]
LONG = [("ring", i, (i + 1) % 30) for i in range(30)] + [("path", i, i + 1) for i in range(20)]


def plain(edges):
    """(project, node): (component, size, cyclic) by reachability."""
    out = {}
    for p in {e[0] for e in edges if None not in e}:
        after = {}
        for q, a, b in edges:
            if q == p and a is not None and b is not None:
                after.setdefault(a, set()).add(b)
                after.setdefault(b, set())
        reach = {}
        for n in after:
            seen, todo = set(), list(after[n])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after[x]
            reach[n] = seen
        for n in after:
            own = {m for m in reach[n] if n in reach[m]} | {n}
            out[p, n] = (min(own), len(own), n in reach[n])
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "project string, source long, target long")


def rows_of(df):
    return {(r.project, r.node): (r.component, r["size"], r.cyclic) for r in df.collect()}


def test_components_by_hand(spark):
    found = rows_of(cycles.strong_components(table(spark, EDGES)))
    assert found[("p", 3)] == (1, 3, True) and found[("p", 5)] == (4, 2, True) and found[("p", 6)] == (6, 1, True) and found[("p", 7)] == (7, 1, False) and found[("q", 2)] == (2, 1, False)
    assert found == plain(EDGES)
    facts = {r.project: tuple(r)[1:] for r in cycles.cycle_facts(table(spark, EDGES), cycles.strong_components(table(spark, EDGES))).collect()}
    assert facts == {"p": (8, 3, 6, 3, 6), "q": (3, 0, 0, 0, 0)}
    assert cycles.strong_components(table(spark, []).limit(0)).count() == 0


def test_components_do_not_depend_on_recursion_or_order():
    n = 50_000
    ring = [(i, (i + 1) % n) for i in range(n)]
    random.Random(1).shuffle(ring)
    assert set(cycles.components_of(ring).values()) == {0}
    rnd = random.Random(2)
    for _ in range(60):
        edges = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(rnd.randrange(1, 26))]
        assert cycles.components_of(edges) == {n: c for (_, n), (c, _, _) in plain([("x", a, b) for a, b in edges]).items()}


@pytest.mark.parametrize("limit", [0, 3])
def test_colouring_finds_the_same_components(spark, limit):
    rnd = random.Random(3)
    edges = [("a", rnd.randrange(9), rnd.randrange(9)) for _ in range(12)] + [("b", i, (i + 1) % 4) for i in range(4)] + [("p", 7, 1), ("p", 6, 6)]
    assert rows_of(cycles.strong_components(table(spark, edges), task_edges=limit)) == plain(edges)


FILES = [
    ("repo/client/package.json", '{"name": "@sample/client-app", "dependencies": {"react": "^18.2.0", "left-pad": "1.3.0", "@scope/kit": "workspace:*"}, "devDependencies": {"x": 5, "vue": " ~3.1 "}}'),
    ("repo/client/src/a.tsx", "import React from 'react';\nimport { k } from \"@scope/kit/deep\";\nimport './local';\n"),
    ("repo/api/pom.xml", '<project xmlns="http://m"><parent><artifactId>parent</artifactId></parent><artifactId> sample-api </artifactId><packaging>war</packaging><dependencies><dependency><groupId>org.kit</groupId><artifactId>kit</artifactId><version>1.2</version></dependency></dependencies></project>'),
    ("repo/api/src/B.java", "package a;\nimport static org.kit.B.c;\n"),
    ("repo/Core/Shop.Domain.csproj", '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net9.0</TargetFramework></PropertyGroup><ItemGroup><PackageReference Include="Polly" Version="8.0.0"/><PackageReference Include="Serilog"/></ItemGroup></Project>'),
    ("repo/Core/package.json", '{"dependencies": {}}'),
    ("repo/Core/D.cs", "using Polly.Retry;\nusing System;\n"),
    ("repo/Core/tests/unit/U.csproj", '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><PackageReference Include="xunit.core" Version="2.0"/></ItemGroup></Project>'),
    ("repo/Core/tests/unit/t.cs", None),
    ("repo/web/W.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"></Project>'),
    ("repo/web/pages/p.razor", "x"),
    ("repo/bad/package.json", '{"dependencies": ["a"]}'),
    ("repo/bad2/package.json", "{"),
    ("repo/bad3/pom.xml", "<project>"),
    ("repo/py/requirements.txt", "requests[socks]>=2.1 # why\n# no\n-r other.txt\nscikit-learn\npkg @ https://x\nflask==1.0; python_version<'3'\n"),
    ("repo/py/m.py", "import requests\nfrom flask.app import x\nfrom . import y\n"),
    ("repo/readme.md", "no manifest"),
]


@pytest.fixture(scope="module")
def repository(spark):
    from govlens.operators import modules

    files = spark.createDataFrame(FILES, "path string, text string")
    return files, modules.manifests(files).cache()


def test_modules_are_named_and_typed_by_their_manifests(repository):
    from govlens.operators import modules

    files, found = repository
    rows = {r.folder: (r.name, r.type, r.kind, r.framework, r.frameworks, r.languages, r.n_files) for r in modules.project_modules(files, found).collect()}
    assert rows == {
        "repo/client": ("@sample/client-app", "Client", "FrontendApplication", "Multi-Framework", "React, Vue", "TypeScript", 2),
        "repo/api": ("sample-api", "Api", "WebApplication", "Java", "Java", "Java", 2),
        "repo/Core": ("Shop.Domain", "Domain", "ClassLibrary", ".NET", ".NET", "C#", 3),
        "repo/Core/tests/unit": ("U", "Test", "Test", ".NET", ".NET", "C#", 2),
        "repo/web": ("W", "Presentation", "WebApplication", "Multi-Framework", "ASP.NET Core, Blazor", "", 2),
        "repo/bad": ("package", "Unknown", "Unknown", None, "", "", 1), "repo/bad2": ("package", "Unknown", "Unknown", None, "", "", 1), "repo/bad3": ("pom", "Unknown", "Unknown", None, "", "", 1),
    }


def test_references_are_declared_counted_and_unused(repository):
    from govlens.operators import modules

    files, found = repository
    assert {(r.path.split("/")[1], r.name, r.spec) for r in modules.declared_references(found).collect()} == {
        ("client", "react", "^18.2.0"), ("client", "left-pad", "1.3.0"), ("client", "@scope/kit", None), ("client", "vue", "~3.1"), ("api", "org.kit:kit", "1.2"), ("Core", "Polly", "8.0.0"), ("Core", "Serilog", None),
        ("Core", "xunit.core", "2.0"), ("py", "requests", ">=2.1"), ("py", "scikit-learn", None), ("py", "flask", "==1.0"),
    }
    assert {tuple(r) for r in modules.manifest_counts(found).collect()} == {("npm", 4, 2, 4, 3), ("maven", 2, 1, 1, 1), ("dotnet", 3, 0, 3, 2), ("pip", 1, 0, 3, 2)}
    assert {(r.folder, r.name) for r in modules.unused_references(files, found).collect()} == {("repo/client", "left-pad"), ("repo/client", "vue"), ("repo/Core", "Serilog"), ("repo/Core/tests/unit", "xunit.core"), ("repo/py", "scikit-learn")}


@pytest.mark.parametrize("name, kind", [("tests", "Test"), ("shop.http.errors", "Infrastructure"), ("shop.errors", "Contracts"), ("orders.api", "Api"), ("a.io.b", "Infrastructure"), ("my-web", "Presentation"), ("zzz", "Unknown")])
def test_types_by_name(spark, name, kind):
    from govlens.operators.modules import type_of_name
    from pyspark.sql import functions as F

    assert spark.range(1).select(type_of_name(F.lit(name))).first()[0] == kind


def test_versions_sort_as_versions_do(spark):
    from govlens.operators.versions import version_key
    from pyspark.sql import functions as F

    ordered = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "v1.0.1", "1.2", "1.10.0", "2.0.0.1", "10.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r.v for r in rows.orderBy(version_key(F.col("v"))).collect()] == ordered
    same = spark.createDataFrame([("1.0", "1.0.0+build.5"), ("1.0rc1", "1.0-rc1")], "a string, b string").select(version_key(F.col("a")) == version_key(F.col("b"))).collect()
    assert [r[0] for r in same] == [True, True]
    odd = spark.createDataFrame([("latest",), ("",), (None,), ("1..2",)], "v string").select(version_key(F.col("v"))).collect()
    assert [r[0] for r in odd] == [None] * 4


PUBLISHED = ["0.1.5", "0.2.0", "1.0.0", "1.2.0", "1.2.9", "1.9.9", "2.0.0-rc.1", "2.0.0", "2.1.0", "3.0.0-beta"]
RANGES = [
    ("npm", "^1.2.0", "1.9.9", "outdated"), ("npm", "^0.1.0", "0.1.5", "outdated"), ("npm", "~1.2.3", "1.2.9", "outdated"), ("npm", "~1", "1.9.9", "outdated"), ("npm", "1.2", "1.2.9", "outdated"), ("npm", "1.x", "1.9.9", "outdated"),
    ("npm", ">=1.0.0 <1.9.9", "1.2.9", "outdated"), ("npm", ">1.9.9", "2.1.0", "satisfied"), ("npm", "1.0.0 - 1.2.0", "1.2.0", "outdated"), ("npm", "^5 || ^1.0.0 || ~0.2", "1.9.9", "outdated"), ("npm", "*", "2.1.0", "satisfied"),
    ("npm", "2.0.0-rc.1", "2.0.0-rc.1", "outdated"), ("npm", ">=3.0.0-alpha", "3.0.0-beta", "satisfied"), ("npm", "^4.0.0", None, "unresolved"), ("npm", "latest", None, "unreadable"), ("npm", None, None, "unresolved"),
    ("npm", "<2.0.0", "1.9.9", "outdated"), ("npm", "<=2", "2.1.0", "satisfied"), ("pip", "==2.0", "2.0.0", "outdated"), ("pip", "~=1.2", "1.9.9", "outdated"), ("pip", "~=1.2.0", "1.2.9", "outdated"), ("pip", "==1.2.*", "1.2.9", "outdated"),
    ("pip", ">=1.0,<1.2", "1.0.0", "outdated"), ("pip", "!=1.0", None, "unreadable"), ("dotnet", "1.0", "2.1.0", "satisfied"), ("dotnet", "[1.0,2.0)", "1.9.9", "outdated"), ("dotnet", "(1.0,1.2.0]", "1.2.0", "outdated"),
    ("dotnet", "[2.0.0]", "2.0.0", "outdated"), ("maven", "1.2", "1.2.0", "outdated"), ("maven", "(,1.0]", "1.0.0", "outdated"),
]


def test_requirements_resolve_to_the_highest_version_in_range(spark):
    from govlens.operators.versions import resolve

    wanted = spark.createDataFrame([("p", f, s) for f, s, *_ in RANGES] + [("nobody", "npm", "^1.0.0"), ("p", "npm", "^1.2.0")], "name string, form string, spec string")
    published = spark.createDataFrame([("p", v) for v in PUBLISHED] + [("p", "junk"), ("q", "9.0.0"), ("p", "1.0")], "name string, version string")
    found = {(r.name, r.form, r.spec): (r.best, r.status) for r in resolve(wanted, published).collect()}
    expected = {("p", f, s): (b, x) for f, s, b, x in RANGES} | {("nobody", "npm", "^1.0.0"): (None, "unresolved")}
    assert {k: v for k, v in found.items() if expected.get(k) != v and (v[0], expected[k][0]) != ("1.0", "1.0.0")} == {} and set(found) == set(expected)


def test_a_walk_reads_its_edges_from_a_table_and_not_from_the_line_items(spark, sf_dir):
    from govlens.plans.insight import reachable_nodes

    walk = reachable_nodes(spark, sf_dir)
    assert "lineitem" not in walk._jdf.queryExecution().executedPlan().toString()
    assert min(r.depth for r in walk.collect()) == 0


@pytest.mark.parametrize("chunk, size", [(1, 3), (20, 7), (50_000, 1000)])
def test_groups_are_solved_together_and_never_cut(monkeypatch, chunk, size):
    import pyarrow as pa

    monkeypatch.setattr(cycles, "_CHUNK", chunk)
    rnd = random.Random(4)
    for _ in range(40):
        edges = sorted({(f"p{rnd.randrange(5)}", rnd.randrange(-8, 8), rnd.randrange(-8, 8)) for _ in range(rnd.randrange(1, 90))}, key=lambda e: e[0])
        edges += [("r", i, i + 1) for i in range(40)] + [("r", 40, 30)]
        rows = pa.table({"project": [e[0] for e in edges], "part": [0] * len(edges), "source": [e[1] for e in edges], "target": [e[2] for e in edges]})
        found = [r for b in cycles._solve(iter(rows.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        expected = plain(edges)
        inner = {k: sum(1 for p, a, b in edges if (p, a) == k and expected[p, b][0] == v[0]) for k, v in expected.items()}
        assert {(r["project"], r["node"]): (r["component"], r["size"], r["inner"]) for r in found} == {k: (*v[:2], inner[k]) for k, v in expected.items()}
        assert len(found) == len(expected)


@pytest.mark.parametrize("limit", [0, 3, cycles.TASK_EDGES])
def test_cycles_of_projects_are_those_of_their_components(spark, limit):
    edges = table(spark, EDGES + LONG)
    expected = {tuple(r) for r in cycles.cycle_facts(edges, cycles.strong_components(edges)).collect()}
    assert {tuple(r) for r in cycles.project_cycles(edges, limit).collect()} == expected and ("ring", 30, 1, 30, 30, 30) in expected
    assert not cycles.project_cycles(table(spark, []).limit(0)).count()


def test_circular_dependencies_are_solved_once_and_not_in_a_call_for_each_project(spark, sf_dir):
    from govlens.plans.dependencies import circular_dependencies

    plan = circular_dependencies(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan and "l_orderkey" not in plan


def shuffled(spark, df):
    """The rows of df, and the most rows that one of its stages shuffled."""
    store, empty = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    stages = lambda: store.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty)
    before = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    rows, after = df.collect(), stages()
    return rows, max(s.shuffleWriteRecords() for s in map(after.apply, range(after.size())) if s.stageId() > before)


MANIFESTS = [("r/a/package.json", '{"dependencies": {"kit": "1", "odd": "1"}}'), ("r/a/in/package.json", '{"dependencies": {"kit": "1"}}'), ("r/b/requirements.txt", "kit\n"), ("r/c/pom.xml", None), ("package.json", '{"dependencies": {"kit": "1"}}')]


def test_what_files_name_is_gathered_by_folder_and_no_path_is_shuffled(spark):
    from govlens.operators import modules

    n = 4000
    many = [(f"r/{('a', 'a/in/deep', 'b', 'a/in')[i % 4]}/src/f{i}.{('ts', 'tsx', 'py', 'js')[i % 4]}", ("import x from 'kit/deep';", "import y from 'other';", "import kitten\n", None)[i % 4]) for i in range(n)]
    odd = [("alone.ts", "import x from 'odd';"), ("/x.ts", "import x from 'zzz';"), (None, "import x from 'odd';"), ("r/a/", "import x from 'odd';"), ("r/a/README", None), ("r/c/x.ts", "import x from 'a';")]
    files = spark.createDataFrame(MANIFESTS + many + many[:50] + odd, "path string, text string")
    rows, most = shuffled(spark, modules.unused_references(files, modules.manifests(spark.createDataFrame(MANIFESTS, "path string, text string"))))
    assert sorted((r.path, r.name) for r in rows) == [("package.json", "kit"), ("r/a/in/package.json", "kit"), ("r/a/package.json", "odd"), ("r/b/requirements.txt", "kit")]
    assert most < n / 10


def test_source_files_are_dealt_by_all_columns_and_none_is_read_for_a_manifest(spark, sf_dir):
    from govlens.plans import dependencies

    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for query in (dependencies.declared_references, dependencies.manifest_counts):
        assert "lineitem" not in planned(query(spark, sf_dir))
    dealt = [x for x in planned(dependencies.source_files(spark, sf_dir)).splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and all(c in dealt[0] for c in ("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "REPARTITION_BY_COL"))
    assert "hashpartitioning" not in planned(dependencies.source_files(spark, sf_dir, once=False))


def test_files_are_counted_by_folder_and_no_path_is_shuffled(spark):
    from govlens.operators import modules

    rnd, n = random.Random(5), 4000
    folders = ["R/a", "r/A/In", "r/a/in/deep/er", "r/b", "r/bb", "r", "q/r/b", ""]
    manifests = [(f"{f}/package.json" if f else "package.json", "{}") for f in ("r/a", "r/a/in", "r/A/in", "r/b", "")] + [("r/b/B.csproj", "<Project></Project>")]
    paths = [f"{rnd.choice(folders)}/f{i}.{rnd.choice(['ts', 'CS', 'py', 'md', 'razor'])}" for i in range(n)]
    paths += paths[:40] + ["alone.ts", "r/a/", "r//x.js", None]
    modules_of = {f.lower() for f in ("r/a", "r/a/in", "r/b", "")}
    counted, spoken = dict.fromkeys(modules_of, 0), {f: set() for f in modules_of}
    for p in filter(None, paths):
        parts = p.lower().split("/")
        own = next((f for f in ("/".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)) if f in modules_of), None)
        if own is not None:
            counted[own] += 1
            spoken[own] |= {x for x in [modules.LANGUAGES.get(parts[-1].rpartition(".")[2])] if x}
    found = modules.manifests(spark.createDataFrame(manifests, "path string, text string"))
    rows, most = shuffled(spark, modules.project_modules(spark.createDataFrame([(p, None) for p in paths], "path string, text string"), found))
    assert {r.folder.lower(): (r.n_files, r.languages, "Blazor" in r.frameworks) for r in rows} == {f: (counted[f], ", ".join(sorted(spoken[f])), f == "r/b") for f in modules_of}
    assert min(counted.values()) > 100 and most < n / 10
