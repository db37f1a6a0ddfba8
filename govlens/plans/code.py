"""Blocks of code in four languages, over files that are written from the parts table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govlens import catalog, rulebook
from govlens.operators import blocks, coupling
from govlens.operators.written import written
from govlens.plans.registry import query
from govlens.sources import tables


#: Characters that one of the engines reads in its own way inside a literal.
_SPELLED = {"~": 92, "^": 39, "$": 36}


def _text(template: str) -> str:
    """A template as SQL of both engines: between « and » stands an expression, ~ is a backslash and ^ a single quote."""
    out = []
    for i, piece in enumerate(re.split("[«»]", template)):
        if i % 2:
            out.append(f"CAST({piece} AS STRING)")
        elif piece:
            out += [f"chr({_SPELLED[x]})" if x in _SPELLED else f"'{x}'" for x in re.split("([~^$])", piece) if x]
    return "concat(" + ", ".join(out) + ")"


_CS = """namespace Shop.M«p_size»
{
    // a { brace in a comment, «p_name»
    public sealed class Item«p_partkey» : IItem
    {
        private string s = "{ ~" } «p_name»";
        private char c = ^{^;
        public int Run«p_size»(int a, bool b)
        {
            if (a > 1 && b) { return 1; }
            for (int i = 0; i < a; i++) { Go(@"~" + "}"); }
«repeat('            while (Next()) { Go(1); }
', p_size % 7)»            try { Go(2); } catch (Exception e) { /* nothing } */ }
            try { Go(3); }
            catch (IOException e) when (e.Fatal)
            {
                Log(e);
            }
            return list.Sum(x => { return x.Value; });
        }
«repeat('        public void Small() { Go(4); }
', p_size % 30)»    }
«CASE WHEN p_partkey % 40 = 0 THEN '' ELSE '}
' END»"""
_JAVA = """package shop.m«p_size»;
/* { «p_name» */
public class Item«p_partkey» extends Base {
    private final String t = "~" { «p_brand»";
    Item«p_partkey»(int a) throws IOException { super(a); }
    static int run(int a) {
        switch (a) { case 1: return 2; case 2: return 3; }
        try { go(); } catch (RuntimeException | IOException e) { throw e; } finally { done(); }
«repeat('        if (a == 1 || a == 2) { go(); }
', p_size % 5)»        Object o = new Object() { public String toString() { return "}"; } };
        return a;
    }
}
«CASE WHEN p_partkey % 44 = 1 THEN '}
' ELSE '' END»"""
_TS = """import { a } from ^m«p_size»^;
export class Item«p_partkey» {
  name = `{ «p_name» ${1}`;
  load(x: number) {
    if (x) { return ^}^; }
    for (const k of this.all) { this.go(k); }
    const f = (y) => { return y; };
    try { this.go(1); } catch (e) { }
  }
«repeat('  next() { return 1; } // }
', p_size % 25)»}
"""
_PY = """# «p_name»:
class Item«p_partkey»(Base):
    ^^^Doc: {
    text:
    ^^^
    def run(self, a):
        if a and b:
            return ^x:^
        for i in range(a):
            try:
                go(i)
            except Exception as e:
                pass
«repeat('        while a:
            a = next(a)
', p_size % 6)»
    async def wait(self):
        with lock:  # held:
            try:
                go()
            except OSError:
                log(1)
«CASE WHEN p_size % 3 = 0 THEN 'def last():
\treturn 1' ELSE '' END»
"""
_EXT = "CASE p_partkey % 4 WHEN 0 THEN 'cs' WHEN 1 THEN 'java' WHEN 2 THEN 'ts' ELSE 'py' END"
_WRITTEN = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate((_CS, _JAVA, _TS, _PY))) + " END"
_COLUMNS = f"concat('src/m', p_size % 6, '/f', p_partkey, '.', {_EXT}) AS path, concat('m', p_size % 6) AS module, CASE p_partkey % 4 WHEN 0 THEN 'csharp' WHEN 1 THEN 'java' WHEN 2 THEN 'typescript' ELSE 'python' END AS language, {_WRITTEN} AS text"


def polyglot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in one of four languages for each part, with braces and colons in comments and strings, and some unbalanced."""
    part = tables.read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand")
    return tables.spread(part, "p_partkey").selectExpr(*_split(_COLUMNS))


def _split(columns: str) -> list[str]:
    """The columns of a SELECT list, cut at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def _re2(pattern: str) -> str:
    return pattern.replace(r"\Z", r"\z").replace("'", "''")


_TOKEN = {x: _re2(p) for x, p in blocks.LITERALS.items()}
_KIND = f"""CASE WHEN regexp_matches(header, '{blocks._CATCH}') THEN 'catch' WHEN regexp_matches(header, '{blocks._CONTROL}') THEN 'control' WHEN regexp_matches(header, '{blocks._TYPE}') THEN 'type' WHEN ends_with(header, '=>') THEN 'lambda'
 WHEN regexp_matches(header, '{blocks._METHOD}') AND NOT regexp_matches(header, '{blocks._CREATED}') AND NOT contains(header, ' = ') THEN 'method' ELSE 'other' END"""
_TOKENS = " ".join(f"WHEN '{x}' THEN regexp_extract_all(text, '{p}|[{{}}();]|[^{{}}();\"''`/@$#]+|[^{{}}();]')" for x, p in _TOKEN.items())
_SQL = f"""
WITH files AS (SELECT {_COLUMNS} FROM part),
lexed AS (SELECT path, module, language, unnest(t) AS raw, unnest(generate_series(1, len(t))) AS pos FROM (SELECT *, CASE language {_TOKENS} END AS t FROM files)),
blank AS (SELECT path, module, language, pos, length(raw) AS n, CASE WHEN regexp_matches(raw, '^(//|/[*]|["''`#]|[$]?@[$]?")') THEN regexp_replace(raw, '[^\n]', ' ', 'g') ELSE raw END AS token FROM lexed),
code AS (SELECT path, module, language, string_agg(token, '' ORDER BY pos) AS code FROM blank GROUP BY 1, 2, 3),
steps AS (SELECT *, CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS step, CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS paren FROM blank WHERE language <> 'python'),
sums AS (SELECT *, sum(n) OVER f - n AS start, sum(step) OVER f AS level, sum(abs(step)) OVER f - abs(step) AS section FROM steps WINDOW f AS (PARTITION BY path ORDER BY pos)),
ended AS (SELECT *, CASE WHEN token = ';' AND sum(paren) OVER (PARTITION BY path, section ORDER BY pos) <= 0 THEN 1 ELSE 0 END AS ended FROM sums),
parts AS (SELECT *, sum(ended) OVER (PARTITION BY path ORDER BY pos) - ended AS part FROM ended),
headers AS (SELECT path, trim(regexp_replace(coalesce(string_agg(token, '' ORDER BY pos) FILTER (token <> '{{'), ''), '[ \t\r\n]+', ' ', 'g')) AS header, max(CASE WHEN token = '{{' THEN start END) AS start FROM parts GROUP BY path, section, part),
levels AS (SELECT path, token, start, CASE WHEN step = 1 THEN level ELSE level + 1 END AS depth FROM parts WHERE step <> 0),
pairs AS (SELECT *, lead(start) OVER (PARTITION BY path, depth ORDER BY start) AS "end" FROM levels),
braces AS (SELECT p.path, p.start, p."end", p.depth, h.header FROM pairs p JOIN headers h ON h.path = p.path AND h.start = p.start WHERE p.token = '{{'),
lines AS (SELECT path, unnest(string_split(code, chr(10))) AS line, unnest(generate_series(1, len(string_split(code, chr(10))))) AS nr, length(code) AS total FROM code WHERE language = 'python'),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY nr) - length(line) - 1 AS pos, length(regexp_replace(regexp_extract(line, '^[ \t]*'), '\t', '    ', 'g')) AS indent FROM lines),
worded AS (SELECT * FROM placed WHERE regexp_matches(line, '[^ \t\r]')),
heads AS (SELECT * FROM worded WHERE regexp_matches(line, ':[ \t]*$')),
closed AS (SELECT h.path, h.pos, h.indent, h.pos + length(h.line) + 1 AS start, coalesce((SELECT min(w.pos) FROM worded w WHERE w.path = h.path AND w.nr > h.nr AND w.indent <= h.indent), h.total) AS "end", regexp_replace(regexp_replace(trim(regexp_replace(h.line, '[ \t]+', ' ', 'g')), ':$', ''), '[ \t]+', ' ', 'g') AS header FROM heads h),
indented AS (SELECT c.path, c.start, c."end", (SELECT count(*) FROM closed o WHERE o.path = c.path AND o.pos <= c.pos AND o."end" > c.pos) AS depth, c.header FROM closed c),
found AS (SELECT * FROM braces UNION ALL SELECT * FROM indented),
kinds AS (SELECT f.path, c.module, c.language, {_KIND} AS kind, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(depth AS INTEGER) AS depth, header,
          CASE WHEN "end" IS NOT NULL THEN substr(code, CAST(start AS INTEGER) + CASE language WHEN 'python' THEN 1 ELSE 2 END, CAST("end" - start AS INTEGER) - CASE language WHEN 'python' THEN 0 ELSE 1 END) END AS body FROM found f JOIN code c ON c.path = f.path),
blocks AS (SELECT *, CASE kind WHEN 'type' THEN regexp_extract(header, '(class|interface|struct|record|enum) +([A-Za-z_][A-Za-z0-9_]*)', 2) WHEN 'method' THEN regexp_extract(header, '([A-Za-z_][A-Za-z0-9_]*) *[(]', 1) END AS name FROM kinds)"""
_METHODS_SQL = f"""SELECT path, module, name, start, length(body) - length(replace(body, chr(10), '')) + 1 AS lines, CAST(len(regexp_extract_all(body, '{blocks.DECISIONS}')) AS BIGINT) AS decisions,
 CAST(len(regexp_extract_all(body, '{blocks.DECISIONS}')) AS BIGINT) + 1 AS complexity FROM blocks WHERE kind = 'method' AND body IS NOT NULL"""
_CATCHES_SQL = f"""SELECT path, module, catches, swallowed, generic, round_even(100.0::DOUBLE * (1.0::DOUBLE - CAST(swallowed AS DOUBLE) / catches) * 100, 0) / 100 AS coverage FROM (
 SELECT path, module, count(*) AS catches, count(*) FILTER (trim(regexp_replace(body, '[ \t\r\n]+', ' ', 'g')) IN ('', 'pass', '...')) AS swallowed,
 count(*) FILTER (regexp_matches(header, '(^|[^A-Za-z0-9_])(Exception|Throwable|BaseException)([^A-Za-z0-9_]|$)') OR header IN ('catch', 'except')) AS generic FROM blocks WHERE kind = 'catch' AND body IS NOT NULL GROUP BY 1, 2)"""
_TYPES_SQL = f"""SELECT path, module, name, start, lines, methods, round_even(least(CAST(lines AS DOUBLE) / {blocks.TYPE_LINES}, CAST(methods AS DOUBLE) / {blocks.TYPE_METHODS}) * 100, 0) / 100 AS severity FROM (
 SELECT t.path, t.module, t.name, t.start, length(t.body) - length(replace(t.body, chr(10), '')) + 1 AS lines, (SELECT count(*) FROM blocks m WHERE m.kind = 'method' AND m.path = t.path AND m.depth = t.depth + 1 AND m.start > t.start AND m.start < t."end") AS methods
 FROM blocks t WHERE kind = 'type' AND body IS NOT NULL)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.code_blocks(blocks.lexed(polyglot_files(spark, sf_dir)))


@query(_SQL + ' SELECT path, module, language, kind, name, start AS start_at, "end" AS end_at, depth, header FROM blocks')
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("path", "module", "language", "kind", "name", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "depth", "header")


@query(_SQL + _METHODS_SQL.replace("start,", "start AS start_at,", 1))
def method_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.method_measures(_blocks(spark, sf_dir)).withColumnRenamed("start", "start_at")


@query(_SQL + _CATCHES_SQL)
def swallowed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.catch_measures(_blocks(spark, sf_dir))


@query(_SQL + _TYPES_SQL.replace("start,", "start AS start_at,", 1))
def large_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.type_measures(_blocks(spark, sf_dir)).withColumnRenamed("start", "start_at")


#: Metrics of the rule book that blocks measure, by what measures them.
_MEASURED = ("EstimatedCyclomaticComplexity", "GodClassSeverity", "ErrorHandlingCoverage")


@query(
    _SQL
    + f""", rules AS (SELECT * FROM {catalog.values_sql([r for r in rulebook.ARCHITECTURE_RULES if r[4] in _MEASURED], rulebook.RULE_SCHEMA, 'r')}),
facts AS (SELECT path, 'EstimatedCyclomaticComplexity' AS metric_key, CAST(sum(decisions) + 1 AS DOUBLE) AS value FROM ({_METHODS_SQL}) GROUP BY path
 UNION ALL SELECT path, 'GodClassSeverity', max(severity) FROM ({_TYPES_SQL}) GROUP BY path UNION ALL SELECT path, 'ErrorHandlingCoverage', coverage FROM ({_CATCHES_SQL}))
SELECT rule_id, path, value, threshold, severity, CASE op WHEN '>' THEN value > threshold ELSE value < threshold END AS violated FROM facts JOIN rules USING (metric_key)"""
)
def code_rule_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule book over what the blocks of each file measure."""
    found = _blocks(spark, sf_dir)
    fact = lambda rows, key, value: rows.groupBy("path").agg(value.cast("double").alias("value")).select("path", F.lit(key).alias("metric_key"), "value")
    facts = fact(blocks.method_measures(found), _MEASURED[0], F.sum("decisions") + 1).unionByName(fact(blocks.type_measures(found), _MEASURED[1], F.max("severity"))).unionByName(fact(blocks.catch_measures(found), _MEASURED[2], F.max("coverage")))
    rules = rulebook.architecture_rules(spark).where(F.col("metric_key").isin(*_MEASURED)).select("rule_id", "metric_key", "op", "threshold", "severity")
    violated = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return facts.join(F.broadcast(rules), "metric_key").select("rule_id", "path", "value", "threshold", "severity", violated.alias("violated"))


_USES = "uses AS (SELECT DISTINCT l_partkey AS a, next AS b FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS next FROM lineitem) WHERE next IS NOT NULL)"
_CUSTOM = "concat('// Item0 Item1{0}namespace Shop.M', s.p_size, ';{0}public class Item', s.p_partkey, CASE WHEN s.p_partkey % 50 = 7 THEN ' { } class Shared' ELSE '' END, '{0}{{ void Run() {{ ', coalesce(names, ''), ' string s = \"Item2\"; Shared x; }} }}{0}')".replace("{0}", "\n").replace("{{", "{").replace("}}", "}")
_MODULE = "element_at(array('Api', 'Domain', 'Data', 'Web', 'Kit'), CAST(s.p_size % 5 AS INT) + 1)"


def _referring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C# file for each part: it names the parts that follow it in orders, and imports the namespaces of the even ones of them."""
    part, line = tables.read(spark, sf_dir, "part").select("p_partkey", "p_size"), tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    pairs = line.withColumn("b", following).where("b is not null").select(F.col("l_partkey").alias("a"), "b").distinct()
    sized = pairs.join(part.select(F.col("p_partkey").alias("b"), F.col("p_size").alias("size")), "b")
    lists = sized.groupBy(F.col("a").alias("p_partkey")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Item"), F.col("b").cast("string"), F.lit(" a;")))), " ").alias("names"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("b") % 2 == 0, F.concat(F.lit("using Shop.M"), F.col("size").cast("string"), F.lit(";\n"))))), "").alias("imports"),
    )
    return tables.spread(part.join(lists, "p_partkey", "left"), "p_partkey").alias("s").selectExpr("concat('src/f', s.p_partkey, '.cs') AS path", f"{_MODULE} AS module", "'csharp' AS language", f"concat(coalesce(imports, ''), {_CUSTOM}) AS text")


_RESOLVED = f"""WITH {_USES},
sizes AS (SELECT a, b, x.p_size AS sa, y.p_size AS sb FROM uses JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b),
imports AS (SELECT DISTINCT a, sb AS size FROM sizes WHERE b % 2 = 0),
modules AS (SELECT p_partkey AS k, p_size, list_extract(['Api', 'Domain', 'Data', 'Web', 'Kit'], CAST(p_size % 5 AS INTEGER) + 1) AS module FROM part),
shared AS (SELECT p_partkey AS b, p_size FROM part WHERE p_partkey % 50 = 7),
own AS (SELECT m.k, 0 AS step, s.b FROM modules m JOIN shared s ON s.p_size = m.p_size WHERE m.k % 50 <> 7 UNION ALL SELECT m.k, 1, s.b FROM modules m JOIN imports i ON i.a = m.k JOIN shared s ON s.p_size = i.size WHERE m.k % 50 <> 7 AND i.size <> m.p_size),
nearest AS (SELECT k, step, count(DISTINCT b) AS n, min('src/f' || b || '.cs') AS target FROM own GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY step) = 1),
resolved AS (SELECT 'src/f' || a || '.cs' AS source, 'Item' || b AS name, 'src/f' || b || '.cs' AS target FROM sizes WHERE a <> b AND (sa = sb OR EXISTS (SELECT 1 FROM imports i WHERE i.a = sizes.a AND i.size = sb))
 UNION ALL SELECT 'src/f' || k || '.cs', 'Shared', CASE WHEN n = 1 THEN target END FROM nearest),
named AS (SELECT r.source, s.module AS source_module, r.name, r.target, t.module AS target_module FROM resolved r JOIN modules s ON 'src/f' || s.k || '.cs' = r.source LEFT JOIN modules t ON 'src/f' || t.k || '.cs' = r.target),
sure AS (SELECT DISTINCT source, source_module, target, target_module FROM named WHERE target IS NOT NULL)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(coupling.symbols(blocks.lexed(_referring_files(spark, sf_dir), with_blocks=False)))


@query(_RESOLVED + " SELECT source, source_module, name, target, target_module FROM named")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.uses(_symbols(spark, sf_dir))


@query(
    _RESOLVED
    + """, counts AS (SELECT 'src/f' || k || '.cs' AS path, module, (SELECT count(*) FROM sure s WHERE s.source = 'src/f' || k || '.cs') AS fan_out, (SELECT count(*) FROM sure s WHERE s.target = 'src/f' || k || '.cs') AS fan_in,
 (SELECT count(*) FROM sure s WHERE s.source = 'src/f' || k || '.cs' AND source_module <> target_module) AS across, (SELECT count(*) FROM named s WHERE s.source = 'src/f' || k || '.cs' AND target IS NULL) AS ambiguous FROM modules)
SELECT *, round_even(CAST(fan_out AS DOUBLE) / nullif(fan_out + fan_in, 0) * 100, 0) / 100 AS instability FROM counts"""
)
def file_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _symbols(spark, sf_dir)
    return coupling.coupling(found, coupling.uses(found))


#: Which modules each module may use, and which it may not.
BOUNDARIES = [("api", ["domain", "kit"], []), ("domain", [], ["data"]), ("data", ["domain", "kit", "api", "web"], ["api"]), ("web", ["api", "kit", "data", "domain"], [])]


@query(
    _RESOLVED
    + """, judged AS (SELECT source_module AS module, CASE source_module WHEN 'Api' THEN CASE WHEN target_module IN ('Domain', 'Kit') THEN 'allowed' ELSE 'forbidden' END WHEN 'Domain' THEN CASE target_module WHEN 'Data' THEN 'forbidden' ELSE 'unclassified' END
 WHEN 'Data' THEN CASE target_module WHEN 'Api' THEN 'forbidden' ELSE 'allowed' END WHEN 'Web' THEN 'allowed' ELSE 'unclassified' END AS verdict FROM sure WHERE source_module <> target_module),
counts AS (SELECT m.module, count(verdict) FILTER (verdict = 'allowed') AS allowed, count(verdict) FILTER (verdict = 'forbidden') AS forbidden, count(verdict) FILTER (verdict = 'unclassified') AS unclassified FROM (SELECT DISTINCT module FROM modules) m LEFT JOIN judged j ON j.module = m.module GROUP BY 1)
SELECT module, allowed + forbidden AS cross_layer, allowed, forbidden, unclassified, unclassified = 0 AS complete, CASE WHEN unclassified = 0 THEN round_even(CAST(allowed * 100.0 AS DOUBLE) / nullif(allowed + forbidden, 0) * 100, 0) / 100 END AS compliance FROM counts"""
)
def module_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _symbols(spark, sf_dir)
    boundaries = spark.createDataFrame(BOUNDARIES, "source_layer string, allowed array<string>, forbidden array<string>")
    return coupling.module_coupling(found, coupling.uses(found), boundaries)
