"""Evaluators on files with and without what they look for."""

import pytest
from govlens.operators.evaluators import EVALUATORS, found, measure, occurrences, pairs, summarize
from pyspark.sql import functions as F

GOOD = """/// <summary>Doc.</summary> public class OrderSingleton { static readonly Lazy<int> Instance; private Hidden() { } lock (gate) { }
 void Run() { if (a && b) { } try { x(); } catch (IOException e) { log.LogError(e); } } log.LogInformation(text {Id}); db.BeginTransaction(); db.Commit(); db.Rollback(); using (db) { } }"""
BAD = """public class OrderSingleton { try { x(); } catch (Exception e) { } log.LogTrace(x); db.BeginTransaction(); Thread.Sleep(1); password = "x"; MD5.Create(); // TODO"""
EMPTY = "nothing to see"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("g", "m", GOOD), ("b", "m", BAD), ("e", "m", EMPTY), ("n", "m", None)], "path string, module string, text string").cache()


@pytest.mark.parametrize("name,metric,good,bad", [("singleton", "singleton_compliance", 100.0, 0.0), ("error_handling", "error_handling_coverage", 100.0, 0.0), ("logging", "logging_integrity", 100.0, 0.0), ("transaction", "transaction_integrity", 97.0, 65.0), ("architectural_security", "findings", 0, 2), ("performance", "performance_index", 0.8, 0.7)])
def test_metrics(files, name, metric, good, bad):
    found = {r.path: r[metric] for r in measure(files, EVALUATORS[name]).collect()}
    assert found.keys() == {"g", "b"}
    if name == "logging":
        assert found["g"] > found["b"]
    elif name == "performance":
        assert found["g"] > found["b"]
    else:
        assert (found["g"], found["b"]) == (good, bad)


@pytest.mark.parametrize("name", sorted(EVALUATORS))
def test_nothing_comes_of_nothing(files, name):
    none = files.where("path IN ('e', 'n')")
    assert not measure(none, EVALUATORS[name]).count() and not summarize(measure(none, EVALUATORS[name]), EVALUATORS[name]).count()


def test_pairs(spark):
    rows = spark.createDataFrame([("m", "class PayCommand {"), ("m", "class PayCommandHandler {"), ("n", "class SendCommand {"), ("m", "class SendCommandHandler {")], "module string, text string")
    assert {(r.name, r.found) for r in pairs(rows, "Command", "CommandHandler").collect()} == {("PayCommand", True), ("SendCommand", False)}


ODD = ["", "\n", "if", "for for ", "for(for(", "while(for (x)", "\nfor(", " for(if(", "forfor(", "é if(x)", "éif(x)", "\U0001f600for (", "#", "# a\n# b\n  # c//", "\n\n#\n", "def f(", "def f(\ndef g( def h(", "xdef f(", "function a function b",
       "log.info(log.info(", "_log.info(", "xlog.info(", "x_log.info({a} %s)", "unsafe {unsafe {", "xunsafe {", "except:except:", "except e:\n pass except:pass", "catch (Exception e) { }catch{", "MyCommand class ACommand", "class ACommandX", "class ACommand\n", GOOD, BAD, None]


def test_counts_are_those_of_the_patterns_as_written(spark):
    texts = spark.createDataFrame([(t,) for t in ODD], "text string")
    for e in EVALUATORS.values():
        both = [c for i, p in enumerate(e.signals.values()) for c in (occurrences("text", p).alias(f"a{i}"), F.expr(f"regexp_count(text, '{p}')").cast("long").alias(f"b{i}"))]
        rows = texts.select("text", found("text", e.applies).alias("a"), F.expr(f"text RLIKE '{e.applies}'").alias("b"), *both).collect()
        assert [(r.text, k) for r in rows for k in r.asDict() if k[0] == "a" and r[k] != r["b" + k[1:]]] == []
    with pytest.raises(ValueError):
        occurrences("text", "^a")


@pytest.mark.parametrize("name,text", [("complexity", "class A {{ public {0}int f() {{ if (a) }} }}"), ("documentation", "class A {{ public {0}int f() {{ }} }}"), ("cohesion", "class A {{ private {0}int f; public {0}int g() {{ }} }}")])
def test_a_long_list_of_modifiers_is_counted(spark, name, text):
    files = spark.createDataFrame([("a", "m", text.format("static " * 20_000))], "path string, module string, text string")
    row = measure(files, EVALUATORS[name]).first()
    assert row["declarations" if name == "documentation" else "methods"] == 1
