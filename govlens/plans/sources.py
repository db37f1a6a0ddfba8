"""Source evaluators over code files that are written from the parts, each part a small class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from govlens.operators.evaluators import EVALUATORS, Evaluator, measure, measure_sql, pairs, summarize
from govlens.plans.registry import ORACLES, QUERIES, query
from govlens.sources import tables

_NAME = "concat('Order', p_partkey - p_partkey % 12, CASE p_partkey % 12 WHEN 0 THEN 'Command' WHEN 1 THEN 'CommandHandler' WHEN 2 THEN 'Repository' WHEN 3 THEN 'Factory' WHEN 4 THEN 'Facade' WHEN 5 THEN 'Decorator' WHEN 6 THEN 'Builder' WHEN 7 THEN 'Mediator' WHEN 8 THEN 'Observer' WHEN 9 THEN 'Singleton' WHEN 10 THEN 'Strategy' ELSE 'Entity' END)"
# Members of the classes, several of them in each of two styles, on lines of their own: (parts that have it, text).
_PIECES = [
    ("3 = 0", "    /// <summary>Doc.</summary>\n"), ("5 = 0", "    private readonly IOrders _inner;\n"), ("2 = 0", "    private readonly IClock clock;\n"), ("7 = 1", "    private static readonly Lazy<Item> Instance = new(Load);\n"),
    ("4 = 1", "        lock (_gate)\n        {\n            count++;\n        }\n"), ("6 = 3", "    private Hidden() { }\n"), ("5 = 1", "        try\n        {\n            Run();\n        }\n        catch (Exception e)\n        {\n        }\n"),
    ("5 = 2", "        try { Run(); }\n        catch (IOException e) when (e.Fatal)\n        {\n            _logger.LogError(e, \"failed {Id}\", id);\n        }\n"), ("4 = 2", "        return this;\n"), ("3 = 1", "    public Item Build()\n    {\n        this.total = next;\n    }\n"),
    ("5 = 3", "    public async Task HandleAsync(Order o)\n    {\n        _inner.Run(o);\n    }\n"), ("4 = 3", "        await _store.SaveAsync();\n"), ("7 = 2", "        var c = new SqlConnection(text);\n"), ("3 = 2", "        return new Helper(a, b);\n"),
    ("5 = 4", "        await _mediator.Send(new Query());\n"), ("6 = 1", "        orderService.Call(1);\n"), ("4 = 0", "        _bus.Subscribe(OnOrder);\n"), ("7 = 3", "        _bus.Publish(new Event());\n"), ("8 = 0", "    public void Dispose() => _bus.Unsubscribe(OnOrder);\n"),
    ("9 = 0", "    private readonly HttpClient web;\n"), ("6 = 2", "        switch (kind)\n        {\n            case 1: break;\n        }\n"), ("2 = 1", "        _logger.LogInformation(\"order {Id}\", id);\n"), ("9 = 1", "        _logger.LogTrace(\"here\");\n"),
    ("5 = 0", "        using var t = db.BeginTransaction(IsolationLevel.Snapshot);\n"), ("10 = 0", "        t.Commit();\n"), ("15 = 0", "        t.Rollback();\n"), ("7 = 4", "        Thread.Sleep(100);\n"), ("8 = 3", "        foreach (var x in all)\n        {\n            text += \"x\";\n        }\n"),
    ("11 = 0", "        var password = \"hunter2\";\n"), ("13 = 0", "        using var h = MD5.Create();\n"), ("6 = 0", "        // TODO: later\n"),
]
_BODY = ", ".join(f"CASE WHEN p_partkey % {c} THEN '{t}' ELSE '' END" for c, t in _PIECES)
_TAIL = "repeat('    private int _field = 0;\n', p_size % 5), repeat('    public int Property { get; private set; }\n', p_size % 4), repeat('    public bool Check(int a)\n    {\n        if (a > 1 && b)\n            return true;\n    }\n', p_size % 30)"
_TEXT = f"concat('namespace Shop;\n\npublic sealed class ', {_NAME}, CASE WHEN p_size % 3 > 0 THEN concat(' : I', {_NAME}) ELSE '' END, '\n{{\n', {_BODY}, {_TAIL}, '}}\n')".replace("{{", "{").replace("}}", "}")
_FILES = f"(SELECT concat('src/m', p_size % 6, '/f', p_partkey, '.cs') AS path, concat('m', p_size % 6) AS module, {_TEXT} AS text FROM part)"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(tables.read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr("concat('src/m', p_size % 6, '/f', p_partkey, '.cs') AS path", "concat('m', p_size % 6) AS module", f"{_TEXT} AS text")


def _register(evaluator: Evaluator) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return measure(code_files(spark, sf_dir), evaluator)

    def total(spark: SparkSession, sf_dir: str) -> DataFrame:
        return summarize(measure(code_files(spark, sf_dir), evaluator), evaluator)

    QUERIES[f"evaluator_{evaluator.name}"] = run
    ORACLES[f"evaluator_{evaluator.name}"] = measure_sql(evaluator, _FILES)
    QUERIES[f"summary_{evaluator.name}"] = total
    ORACLES[f"summary_{evaluator.name}"] = f"SELECT module, count(*) AS n_files, round_even(avg({evaluator.average}) * 100, 0) / 100 AS mean FROM ({measure_sql(evaluator, _FILES)}) GROUP BY 1"


for _evaluator in EVALUATORS.values():
    _register(_evaluator)


@query(f"""WITH n AS (SELECT module, regexp_extract(text, 'class ([A-Za-z0-9]+)', 1) AS name FROM {_FILES}), o AS (SELECT module, name, name || 'Handler' AS partner FROM n WHERE ends_with(name, 'Command'))
SELECT module, name, partner, EXISTS (SELECT 1 FROM n WHERE n.module = o.module AND n.name = o.partner) AS found FROM o""")
def command_handler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(code_files(spark, sf_dir), "Command", "CommandHandler")
