"""Blanking, brace and indentation blocks, and what is measured on them, against values worked out by hand."""

import time

import pytest
from govlens.operators import blocks

CS = 'class A\n{\n    string s = "{ \\" }"; // {\n    string v = @"a""{";\n    char c = \'}\';\n    /* } */ void M(int a) { if (a > 1 && a < 9) { Go(); } }\n    int P { get; set; }\n    void N()\n    {\n        try { M(1); }\n        catch (Exception) { /* { */ }\n        Run(x => { a; b; });\n    }\n}\n}\n'
JAVA = 'class B {\n  String t = """\n   { "quoted" {\n  """;\n  B() throws E { for (int i = 0; i < 3; i++) { go(); } }\n  int f(int a) {\n'
TS = "export class C {\n  f(x) { return `${x} { `; }\n  g = () => { return '}'; }\n}\n"
PY = 'class D:\n    """Doc: {"""\n    def f(self,\n          a):\n        if a:  # why:\n            return "x:"\n\n    async def g(self):\n\t  try:\n\t    go()\n\t  except Exception:\n\t    pass\ndef last(): return 1\nwith a:\n  b'
FILES = [("a.cs", "m", "csharp", CS), ("b.java", "m", "java", JAVA), ("c.ts", "n", "typescript", TS), ("d.py", "n", "python", PY), ("e.cs", "n", "csharp", ""), ("f.cs", "n", "csharp", None), ("g.rb", "n", "ruby", "{ }"), ("h.cs", "n", "csharp", "} } { /* {")]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(*f, 7) for f in FILES], "path string, module string, language string, text string, header int")
    return blocks.code_blocks(blocks.lexed(files)).cache()


@pytest.mark.parametrize("language, text", [(f[2], f[3]) for f in FILES if f[3] and f[2] in blocks.LITERALS])
def test_blanking_keeps_offsets_and_line_ends(language, text):
    code = blocks.blanked(text, language)
    assert len(code) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
    assert all(a in (b, " ") for a, b in zip(code, text))


def test_what_is_blanked():
    assert blocks.blanked('a "b{" c // d\n/* e */f', "csharp") == "a      c     \n       f"
    assert blocks.blanked("x = 'it' + \"un\nfinished", "python") == "x =      +    \nfinished"
    assert blocks.blanked("`a\n${b}` c", "typescript") == "  \n      c"
    assert blocks.blanked("a", "ruby") is None


def test_blocks_of_four_languages(found):
    text = {f[0]: f[3] for f in FILES}
    rows = {}
    for r in found.collect():
        rows.setdefault(r.path, set()).add((r.kind, r.name, r.depth, None if r.end is None else text[r.path][r.end :][:6]))
    assert set(rows) == {"a.cs", "b.java", "c.ts", "d.py", "h.cs"}  # a file without text or of another language has no block
    assert rows["a.cs"] == {
        ("type", "A", 1, "}\n}\n"), ("method", "M", 2, "}\n    "), ("control", None, 3, "} }\n  "), ("other", None, 2, "}\n    "), ("method", "N", 2, "}\n}\n}\n"[:6]),
        ("control", None, 3, "}\n    "), ("catch", None, 3, "}\n    "), ("lambda", None, 3, "});\n  "),
    }
    assert rows["b.java"] == {("type", "B", 1, None), ("method", "B", 2, "}\n  in"), ("control", None, 3, "} }\n  "), ("method", "f", 2, None)}
    assert rows["c.ts"] == {("type", "C", 1, "}\n"), ("method", "f", 2, "}\n  g "), ("lambda", None, 2, "}\n}\n")}
    assert rows["d.py"] == {
        ("type", "D", 1, "def la"), ("method", "f", 2, "    as"), ("control", None, 3, "    as"), ("method", "g", 2, "def la"), ("control", None, 3, "\t  exc"), ("catch", None, 3, "def la"), ("control", None, 1, ""),
    }
    assert rows["h.cs"] == {("other", None, -1, None)}  # below the braces that close too much


def test_methods_handlers_and_types(found):
    methods = {(r.path, r.name): (r.lines, r.decisions, r.complexity) for r in blocks.method_measures(found).collect()}
    assert methods == {("a.cs", "M"): (1, 2, 3), ("a.cs", "N"): (5, 1, 2), ("b.java", "B"): (1, 1, 2), ("c.ts", "f"): (1, 0, 1), ("d.py", "f"): (4, 1, 2), ("d.py", "g"): (5, 1, 2)}
    assert {r.path: (r.catches, r.swallowed, r.generic, r.coverage) for r in blocks.catch_measures(found).collect()} == {"a.cs": (1, 1, 1, 0.0), "d.py": (1, 1, 1, 0.0)}
    assert {(r.path, r.name): (r.lines, r.methods, r.severity) for r in blocks.type_measures(found).collect()} == {("a.cs", "A"): (13, 2, 0.03), ("c.ts", "C"): (4, 1, 0.01), ("d.py", "D"): (12, 2, 0.02)}


def test_long_unfinished_and_deep_files_take_linear_time(spark):
    texts = ["/*" * 200_000, '"' * 200_000, "{" * 50_000 + "}" * 49_999, "'a\n" * 100_000, "x(;" * 100_000]
    files = spark.createDataFrame([(str(i), "m", "csharp", t) for i, t in enumerate(texts)], "path string, module string, language string, text string")
    began = time.time()
    rows = blocks.code_blocks(blocks.lexed(files)).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in rows} == {"2": 50_000}
    assert time.time() - began < 120
    deep = "\n".join(" " * i + "if a:" for i in range(2000))
    assert len(blocks.indented_blocks(deep)) == 2000


def test_names_resolve_by_namespace_and_import(spark):
    from govlens.operators import coupling

    files = [
        ("a.cs", "Api", "csharp", "using Shop.Core;\nusing System;\nnamespace Shop.Api;\nclass A { B b; C c; D d; // E\n string s = \"E\"; List l; Twin t; }"), ("b.cs", "Api", "csharp", "namespace Shop.Api;\npublic class B { A a; Local x; } class Local { }"),
        ("c.cs", "Core", "csharp", "namespace Shop.Core;\nclass C { }\nclass Twin { } class B { }"), ("c2.cs", "Core", "csharp", "namespace Shop.Core { class Twin { } interface E { } }"), ("d.cs", "Data", "csharp", "namespace Shop.Data;\nrecord D { C c; }"),
        ("F.java", "Core", "java", "package org.f;\nimport org.g.G;\nimport org.h.*;\nclass F { G g; H h; I i; }"), ("G.java", "Data", "java", "package org.g;\nclass G { } class I { }"), ("H.java", "Data", "java", "package org.h;\nclass H { }"), ("n.cs", "Api", "csharp", None),
    ]
    found = coupling.symbols(blocks.lexed(spark.createDataFrame(files, "path string, module string, language string, text string"))).cache()
    resolved = coupling.uses(found).cache()
    assert {(r.source, r.name): r.target for r in resolved.collect()} == {("a.cs", "B"): "b.cs", ("a.cs", "C"): "c.cs", ("a.cs", "Twin"): None, ("b.cs", "A"): "a.cs", ("F.java", "G"): "G.java", ("F.java", "H"): "H.java"}
    rows = {r.path: (r.fan_out, r.fan_in, r.across, r.ambiguous, r.instability) for r in coupling.coupling(found, resolved).collect()}
    assert rows == {
        "a.cs": (2, 1, 1, 1, 0.67), "b.cs": (1, 1, 0, 0, 0.5), "c.cs": (0, 1, 0, 0, 0.0), "c2.cs": (0, 0, 0, 0, None), "d.cs": (0, 0, 0, 0, None), "F.java": (2, 0, 2, 0, 1.0), "G.java": (0, 1, 0, 0, 0.0), "H.java": (0, 1, 0, 0, 0.0),
    }
    policy = spark.createDataFrame([("api", ["core"], []), ("core", [], ["data"]), ("web", [], [])], "source_layer string, allowed array<string>, forbidden array<string>")
    judged = {r.module: tuple(r)[1:] for r in coupling.module_coupling(found, resolved, policy).collect()}
    assert judged == {"Api": (1, 1, 0, 0, True, 100.0), "Core": (2, 0, 2, 0, True, 0.0), "Data": (0, 0, 0, 0, True, None)}


def test_blocks_need_no_join_and_are_counted_once_per_file(spark, sf_dir):
    from govlens.plans import code

    for of in (blocks.code_blocks, lambda x: blocks.method_measures(blocks.code_blocks(x)), lambda x: blocks.type_measures(blocks.code_blocks(x))):
        plan = of(blocks.lexed(code.polyglot_files(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan and "Window" not in plan  # texts were sent to the driver for a join
    nested = "class A { void f() { class B { void g() { } } } void h() { } } class C { }\nvoid x() { }"
    rows = blocks.type_measures(blocks.code_blocks(blocks.lexed(spark.createDataFrame([("a.cs", "m", "csharp", nested)], "path string, module string, language string, text string")))).collect()
    assert {(r.name, r.methods) for r in rows} == {("A", 2), ("B", 1), ("C", 0)}


def test_a_name_that_many_files_define_is_not_multiplied(spark):
    from govlens.operators import coupling

    n = 700
    rows = [(f"d{i:04}.cs", "m", f"S.N{i % 2}", [], ["Shared"], []) for i in range(n)] + [(f"u{i:04}.cs", "m", "S.U", ["S.N0", "S.N1"], [], ["Shared", "Lone"]) for i in range(n)] + [("l.cs", "k", "S.N1", [], ["Lone"], [])]
    found = spark.createDataFrame(rows, "path string, module string, namespace string, imports array<string>, types array<string>, names array<string>")
    store, empty = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    stages = lambda: store.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty)
    before = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    resolved = {(r.source, r.name): r.target for r in coupling.uses(found).collect()}
    assert resolved == {(f"u{i:04}.cs", x): t for i in range(n) for x, t in (("Shared", None), ("Lone", "l.cs"))}
    after = stages()
    assert max(s.shuffleWriteRecords() for s in map(after.apply, range(after.size())) if s.stageId() > before) <= 6 * n


def test_small_tables_that_make_large_work_are_dealt_over_the_tasks(spark, sf_dir):
    from govlens.plans import code, dependencies, sources

    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for files in (code.polyglot_files, sources.code_files):
        assert files(spark, sf_dir).rdd.getNumPartitions() == wanted
    assert "REPARTITION_BY_NUM" in dependencies.repository_files(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
