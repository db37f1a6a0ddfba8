"""History, graph, security, lexical operators, sources, sinks and streams."""

import json

from govlens import sinks
from govlens.operators import graph, history, lexical, security
from govlens.sources import files
from govlens.streaming import monitor
from pyspark.sql import functions as F


def test_new_findings(spark):
    schema = "rule_id string, category string, domain string, source_path string, target string"
    now = spark.createDataFrame([("R", "c", "D", "a/x", "x"), ("R", "c", None, "b/x", "x"), ("S", "c", "d", "a/y", "y"), ("T", "c", "d", "a/z", "z")], schema)
    was = spark.createDataFrame([("r", "C", "d", "a/x", "x"), ("R", "c", None, "b/x", "x"), ("S", "c", "d", None, "y"), ("T", "c", "e", "a/z", "z")], schema)
    assert [r.rule_id for r in history.new_findings(now, was).collect()] == ["T"] and not history.new_findings(now, now).count()


def test_hash_chain(spark):
    rows = spark.createDataFrame([(1, i, "t", "p", "x", "a", "ok", None if i % 2 else "d") for i in range(5)] + [(2, 0, "t", "p", "x", "a", "ok", None)], "log_id long, sequence long, at string, probe_id string, target string, action string, outcome string, detail string")
    stored = history.chain(rows)
    assert {r.log_id: r.intact for r in history.verify_chain(stored).collect()} == {1: True, 2: True}
    changed = stored.withColumn("outcome", F.when(F.col("sequence") == 3, "no").otherwise(F.col("outcome")))
    assert {r.log_id: (r.intact, r.changed) for r in history.verify_chain(changed).collect()} == {1: (False, 1), 2: (True, 0)}
    missing = {r.log_id: r.broken_links for r in history.verify_chain(stored.where("sequence <> 2")).collect()}
    assert missing == {1: 1, 2: 0}


def test_long_chain_is_built_batch_by_batch(spark):
    rows = spark.range(2500).select(F.when(F.col("id") % 5 > 0, F.lit(1)).otherwise(F.col("id") % 3 + 2).alias("log_id"), F.col("id").alias("sequence"), *(F.lit("x").alias(c) for c in ("at", "probe_id", "target", "action", "outcome")), F.lit(None).cast("string").alias("detail"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        built = history.chain(rows)
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
        assert {r.log_id: (r.entries, r.intact) for r in history.verify_chain(built).collect()} == {1: (2000, True), 2: (167, True), 3: (166, True), 4: (167, True)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_previous_report_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, 1, "2024-01-01", 1.0), (3, 1, "2024-01-02", 3.0), (2, 1, "2024-01-02", 2.0)], "report_id long, project long, scanned_at string, total double")
    assert {r.report_id: r.previous_id for r in history.previous_reports(rows).collect()} == {1: None, 2: 1, 3: 2}


def test_graph(spark):
    e = spark.createDataFrame([(1, "A", 2, "B", 1), (2, "B", 1, "A", 1), (2, "B", 3, "C", 1), (3, "C", 1, "A", 2), (3, "C", 3, "C", 1), (4, "D", 1, "A", 1)], "source int, source_layer string, target int, target_layer string, observed long")
    cycles = {(r.a, r.b, r.c) for r in graph.short_cycles(e).collect()}
    assert cycles == {(3, None, None), (1, 2, None), (1, 2, 3)}
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "B")], "source_layer string, target_layer string")
    found = {(r.source, r.target): r.verdict for r in graph.classify_edges(e, pairs).collect()}
    assert found == {(1, 2): "Allowed", (2, 1): "Forbidden", (2, 3): "Allowed", (3, 1): "Forbidden", (3, 3): "Allowed", (4, 1): "Unclassified"}
    d = graph.density(e).first()
    assert (d.n_edges, d.n_nodes, d.density) == (5, 4, 0.4167)
    assert {r.node: (r.out_degree, r.in_degree) for r in graph.degrees(e).collect()} == {1: (1, 3), 2: (2, 1), 3: (2, 2), 4: (1, 0)}
    assert [r.source_layer for r in graph.fan_out(e, 1).collect()] == ["B"]
    modules = spark.createDataFrame([("src", "a"), ("src/app", "b"), ("src/app2", "c")], "module_path string, module_name string")
    paths = spark.createDataFrame([("src/app/x.cs",), ("src/app2/y.cs",), ("src/app",), ("src/z",), ("other/w",)], "path string")
    assert {r.path: r.owner for r in graph.owners(paths, modules).collect()} == {"src/app/x.cs": "src/app", "src/app2/y.cs": "src/app2", "src/app": "src/app", "src/z": "src", "other/w": None}
    assert [r.module_path for r in graph.outermost(modules).collect()] == ["src"] and graph.outermost(modules.where("module_path <> 'src'")).count() == 2


def test_layer_labels_are_numbered_in_parts(spark):
    e = spark.createDataFrame([(1 << 17, "B"), (3, "B"), (5, "a"), (70_000, "B"), (4, None), (3, "C"), (None, "B")], "source int, target_layer string")
    found = graph.layer_labels(e)
    assert [(r.source, r.layers) for r in found.orderBy("position").collect()] == [(5, "a"), (None, "B"), (70_000, "B"), (1 << 17, "B"), (3, "B · C"), (4, "")]
    assert [r.position for r in found.orderBy("position").collect()] == [1, 2, 3, 4, 5, 6]
    numbered = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in x]
    assert numbered and all(", [unlabelled#" in x for x in numbered)


def test_security(spark):
    ports = spark.createDataFrame([("a", 5432, True, 25, None), ("b", 5432, False, None, None), ("c", 80, True, 900, None), ("d", 80, False, None, "refused"), ("e", 5432, True, 900, None)], "host string, port int, is_open boolean, latency_ms long, error string")
    found = sorted((r.host, r.ordinal) for r in security.port_findings(ports).collect())
    assert found == [("a", 4), ("c", 2), ("d", 1), ("e", 2), ("e", 4)]
    tls = spark.createDataFrame([("a", "Ssl3", "X_3DES", "2023-12-31", 1024, None), ("b", "Tls13", "AES", "2024-01-15", 4096, None), ("c", "Tls12", None, None, None, "x")], "host string, protocol string, cipher string, expires string, key_bits int, error string")
    found = {(r.host, r.finding) for r in security.tls_findings(tls, "2024-01-01 00:00:00").collect()}
    assert found == {("a", "broken protocol"), ("a", "weak cipher"), ("a", "expired"), ("a", "short key"), ("b", "expires soon"), ("c", "no certificate"), ("c", "probe error")}
    none = spark.createDataFrame([], "category string, ordinal int")
    domains = security.domain_compliance(none, spark.createDataFrame([("x",)], "category string"))
    assert domains.first().rate == 100.0 and security.scan_risk(domains, ["i", "l", "m", "h", "s"]).first().risk == "i"
    assert [r.finding for r in security.governance_findings(security.governance_rollup(none)).collect()] == ["low average or no data"]


def test_config_diagnostics_read_xml(spark):
    rows = [("a.xml", "<a></b>"), ("b.xml", '<a><b x="1"/></a>'), ("c.config", "<a>"), ("d.csproj", ""), ("e.json", "{"), ("f.ini", "[s]\nk=v"), ("g.xml", None), ("h.yaml", "a: 1")]
    found = {r.path: r.valid for r in files.config_diagnostics(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {"a.xml": False, "b.xml": True, "c.config": False, "d.csproj": False, "e.json": False, "f.ini": True, "g.xml": None, "h.yaml": None}


def test_owners_keep_equal_rows(spark):
    modules = spark.createDataFrame([("src", "a")], "module_path string, module_name string")
    paths = spark.createDataFrame([("src/x", 1), ("src/x", 1), (None, 2)], "path string, n int")
    assert sorted((str(r.path), r.n, str(r.owner)) for r in graph.owners(paths, modules).collect()) == [("None", 2, "None"), ("src/x", 1, "src"), ("src/x", 1, "src")]


def test_lexical(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(lexical.line_count(F.lit("a\nb\n"))) == 3 and one(lexical.count_of(F.lit("if x for if"), "if|for")) == 3
    assert [one(lexical.exclusion_reason(F.lit(p))) for p in ("a/OBJ/b", "node_modules/x", "a\\vendor\\b", "a/objects/b", "Generated/x", "a/b.Designer.cs", " ")] == ["BuildOrDependencyCache", "BuildOrDependencyCache", "VendoredCode", None, "GeneratedCode", "GeneratedFile", "InvalidPath"]
    assert [one(lexical.ownership(F.lit(p))) for p in ("generated/x", "vendor/x", "bin/x", "a/Tests/x", "samples/x", "docs/x")] == ["Generated", "Vendored", "DependencyOrBuildCache", "Test", "Example", "FirstParty"]
    games = spark.createDataFrame([("g/Assets/a.cs",), ("g/Packages/m.json",), ("g/Library/x.cs",), ("g/Temp/y.cs",), ("app/Library/z.cs",)], "path string")
    assert {r.path: r.reason for r in lexical.with_exclusions(games).collect()} == {"g/Assets/a.cs": None, "g/Packages/m.json": None, "g/Library/x.cs": "UnityGeneratedCache", "g/Temp/y.cs": "UnityGeneratedCache", "app/Library/z.cs": None}
    assert [one(lexical.unpinned(F.lit(v))) for v in ("1.2.3", "^1.2", "latest", "", "1.x", "git:a", "gita")] == [False, True, True, True, True, True, False]
    rows = spark.createDataFrame([(1, "Alpha", ["z"]), (2, None, ["has ALPHA"]), (3, "b", None)], "id int, name string, evidence array<string>")
    assert sorted(r.id for r in lexical.search(rows, "alpha", ["name"], ["evidence"]).collect()) == [1, 2]


def test_file_sources(spark, tmp_path):
    (tmp_path / "src/obj").mkdir(parents=True)
    (tmp_path / "src/package.json").write_text('{"dependencies": {"a": "^1.0", "b": "2.0.0"}, "devDependencies": {"c": "latest"}}')
    (tmp_path / "src/bad.json").write_text("{nope")
    (tmp_path / "src/requirements.txt").write_text("# c\nx==1.0\ny>=2  # d\n-r other\nz\n")
    (tmp_path / "src/obj/hidden.json").write_text("{}")
    (tmp_path / "src/p.csproj").write_text('<Project><ItemGroup><PackageReference Include="P" Version="1.0"/><PackageReference Include="Q" Version="2.0"/></ItemGroup></Project>')
    (tmp_path / "src/a.ini").write_text("[s]\nk = v\n; c\n")
    found = files.scan_files(spark, str(tmp_path), [".json", ".txt", ".csproj", ".ini"]).cache()
    assert found.count() == 6 and found.where("reason = 'BuildOrDependencyCache' and text is null").count() == 1
    name = F.element_at(F.split("path", "/"), -1)
    deps = files.json_dependencies(found.where(name.isin("package.json", "bad.json"))).collect()
    assert {(d.section, d.name, d.version) for d in deps if not d.error} == {("dependencies", "a", "^1.0"), ("dependencies", "b", "2.0.0"), ("devDependencies", "c", "latest")} and sum(d.error is not None for d in deps) == 1
    assert {(r.name, r.pinned) for r in files.requirement_lines(found.where(name == "requirements.txt")).collect()} == {("x", True), ("y", False), ("z", False)}
    assert {(r.name, r.version) for r in files.xml_dependencies(found.where(name == "p.csproj"), "//PackageReference", "@Include", "@Version").collect()} == {("P", "1.0"), ("Q", "2.0")}
    valid = {r.path.rsplit("/", 1)[1]: r.valid for r in files.config_diagnostics(found.where("reason is null")).collect()}
    assert valid == {"package.json": True, "bad.json": False, "requirements.txt": None, "p.csproj": True, "a.ini": True}
    targets = spark.createDataFrame([("Host-A:80; 10.0.0.1 # x\n[::1]:443\nhost-a:80;;\n",)], "t string").select(files.parse_targets(F.col("t"))).first()[0]
    assert [(t.host, t.port) for t in targets] == [("host-a", 80), ("10.0.0.1", None), ("::1", 443)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r", "c", "d", "High", "line\nbreak, \"q\"", 1), ("r", "c", "e", "Low", None, 2), ("s", "c", "d", "High", "x", 1)], "rule_id string, category string, domain string, severity string, evidence string, project int")
    said = sinks.fan_out({"csv": lambda: sinks.write_csv(rows, f"{tmp_path}/csv"), "bad": lambda: 1 / 0, "json": lambda: sinks.write_json(rows, f"{tmp_path}/json", "summary"), "history": lambda: sinks.append_history(rows, f"{tmp_path}/history")})
    assert said["csv"] is None and said["json"] is None and said["history"] is None and said["bad"].startswith("ZeroDivisionError")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").where("evidence = 'line break, \"q\"'").count() == 1
    summary = json.loads(spark.read.text(f"{tmp_path}/json").first()[0])
    assert summary == {"category": "c", "top_rule": "r", "violations": 3, "severities": {"High": 2, "Low": 1}}
    assert sinks.json_report(rows, "standard").count() == 2 and sinks.json_report(rows).count() == 3
    assert spark.read.parquet(f"{tmp_path}/history").where("project = 1").count() == 2
    assert "| r | c | d |" in sinks.markdown("T", rows) and "&quot;q&quot;" in sinks.html_page("T", rows)


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = events._jdf.schema().toDDL()
    high = lambda df: df.where("value > 100").select("event_id", "value")
    q = monitor.monitor(monitor.signal_stream(spark, f"{tmp_path}/in", schema), high, f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == high(events).count() > 0
    stream = monitor.signal_stream(spark, f"{tmp_path}/in", schema, 10)
    for name, df, mode in (("w", monitor.tumbling(stream), "complete"), ("s", monitor.sessions(stream), "complete"), ("c", monitor.chained_log(stream.select((F.col("event_id") % 2).alias("log_id"), F.col("props").alias("message"))), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"t_{name}").option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("t_w").agg(F.sum("n")).first()[0] == spark.table("t_s").agg(F.sum("n")).first()[0] == events.count()
    log = spark.table("t_c").where("log_id = 1").orderBy("sequence").collect()
    assert len(log) == events.where("event_id % 2 = 1").count() and all(a.hash == b.previous_hash for a, b in zip(log, log[1:]))
