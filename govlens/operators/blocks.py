"""Blocks of source files: comments and strings blanked without moving an offset, braces paired by running sums, indentation
blocks, and what is measured by method and by type.

Blanking is one pass of an alternation of literals over the text, in Arrow batches. Braces are paired and indentation blocks ended
with a stack in the same pass, so a file costs time in proportion to its length; files are neither joined nor shuffled, and what is
measured on blocks is grouped and counted in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.expr import half_even

_C_COMMENTS = r"//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)"
_DOUBLE, _SINGLE, _BACKTICK = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?", r"`(?:[^`\\]|\\.|\\\n)*`?"
_TRIPLE, _TRIPLE_SINGLE = r'"""(?:.|\n)*?(?:"""|\Z)', r"'''(?:.|\n)*?(?:'''|\Z)"
#: What is blanked, by language: comments and strings; an unfinished one ends with its line, or with the text if it may span lines.
LITERALS = {
    "csharp": "|".join((_C_COMMENTS, _TRIPLE, r'\$?@\$?"(?:[^"]|"")*"?', _DOUBLE, _SINGLE)),
    "java": "|".join((_C_COMMENTS, _TRIPLE, _DOUBLE, _SINGLE)),
    "typescript": "|".join((_C_COMMENTS, _BACKTICK, _DOUBLE, _SINGLE)),
    "python": "|".join((r"#[^\n]*", _TRIPLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE)),
}
INDENTED = ("python",)
TAB = 4

_W = "[^A-Za-z0-9_]"
_TYPE, _CATCH = f"(^|{_W})(class|interface|struct|record|enum)[ \t\n]+[A-Za-z_]", f"^(catch|except)({_W}|$)"
_CONTROL = f"^(if|elif|else|for|foreach|while|do|switch|match|case|try|finally|with|using|lock|synchronized|async for|async with)({_W}|$)"
_METHOD, _CREATED = "^(async )?def |[A-Za-z0-9_>] *[(]", f"(^|{_W})new [A-Za-z_][A-Za-z0-9_.<>]* *[(]"
#: Decisions inside a method, on blanked text.
DECISIONS = f"(^|{_W})(if|for|foreach|while|case|catch|elif|except)[ (:]|&&|[|][|]"
#: Limits of a type that is too large.
TYPE_LINES, TYPE_METHODS = 500, 20

_compiled: dict[str, re.Pattern] = {}


def blanked(text: str, language: str) -> str | None:
    """The text with comments and strings as spaces, line feeds kept: offsets stay. None for an unknown language."""
    if language not in LITERALS:
        return None
    if language not in _compiled:
        _compiled[language] = re.compile(LITERALS[language])
    return _compiled[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def indented_blocks(code: str) -> list[dict]:
    """Blocks of blanked text by indentation: (start, end, depth, header), in order of their headers.

    A block starts behind its header's line and ends at the first line with text that is indented no deeper. A header may go
    over several lines inside brackets.
    """
    found, open_blocks = [], []
    at = brackets = begun = indent = 0
    for line in code.splitlines(keepends=True) if "\r" not in code else re.findall(r"[^\n]*\n|[^\n]+$", code):
        text = line.strip()
        if text:
            if not brackets:
                begun, lead = at, line[: len(line) - len(line.lstrip())]
                indent = lead.count(" ") + TAB * lead.count("\t")
                while open_blocks and open_blocks[-1][0] >= indent:
                    open_blocks.pop()[1]["end"] = at
            brackets = max(0, brackets + sum(map(text.count, "([{")) - sum(map(text.count, ")]}")))
            if not brackets and text.endswith(":"):
                found.append({"start": at + len(line), "end": len(code), "depth": len(open_blocks) + 1, "header": code[begun : at + len(line)].strip()[:-1], "within": open_blocks[-1][1] if open_blocks else None})
                open_blocks.append((indent, found[-1]))
        at += len(line)
    for block in found:  # a header that ends its own block and the outer one at once is in none
        outer = block["within"]
        block["within"] = outer["start"] if outer and block["start"] < outer["end"] else None
    return found


def braced_blocks(code: str) -> list[dict]:
    """Blocks of blanked text by braces: (start, end, depth, header, within), in order; end is null where no brace closes it.

    The header is what stands before the brace, back to a brace or to a semicolon outside brackets. A closing brace too many
    lowers the depth of what follows. within is the start of the innermost open block.
    """
    found, open_blocks = [], []
    begun = level = brackets = 0
    for mark in _MARKS.finditer(code):
        at, what = mark.start(), mark[0]
        if what == "{":
            level += 1
            found.append({"start": at, "end": None, "depth": level, "header": code[begun:at].strip(" \t\r\n"), "within": open_blocks[-1]["start"] if open_blocks else None})
            open_blocks.append(found[-1])
        elif what == "}":
            level -= 1
            if open_blocks:
                open_blocks.pop()["end"] = at
        elif what != ";":
            brackets += 1 if what == "(" else -1
        if what in "{}":
            begun, brackets = at + 1, 0
        elif what == ";" and brackets <= 0:
            begun = at + 1
    return found


_MARKS = re.compile("[{}();]")
_BLOCK = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("header", pa.string()), ("within", pa.int32())])


def lexed(files: DataFrame, with_blocks: bool = True) -> DataFrame:
    """(path, module, language, code, blocks): files in a known language with their blanked text and, if asked for, its blocks."""

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column("language").to_pylist()
            code = [blanked(t, x) for t, x in zip(batch.column("text").to_pylist(), languages)]
            blocks = [(indented_blocks(c) if x in INDENTED else braced_blocks(c)) if with_blocks else None for c, x in zip(code, languages)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "module", "language")), pa.array(code, pa.string()), pa.array(blocks, pa.list_(_BLOCK))], ["path", "module", "language", "code", "blocks"])

    known = files.where(F.col("text").isNotNull() & F.col("language").isin(*LITERALS)).select("path", "module", "language", "text")
    return known.mapInArrow(lex, "path string, module string, language string, code string, blocks array<struct<start int, end int, depth int, header string, within int>>")


def kind_of(header: Column) -> Column:
    return (
        F.when(header.rlike(_CATCH), "catch").when(header.rlike(_CONTROL), "control").when(header.rlike(_TYPE), "type").when(F.endswith(header, F.lit("=>")), "lambda")
        .when(header.rlike(_METHOD) & ~header.rlike(_CREATED) & ~header.rlike(" = "), "method").otherwise("other")
    )


def name_of(kind: Column, header: Column) -> Column:
    return F.when(kind == "type", F.regexp_extract(header, "(class|interface|struct|record|enum) +([A-Za-z_][A-Za-z0-9_]*)", 2)).when(kind == "method", F.regexp_extract(header, "([A-Za-z_][A-Za-z0-9_]*) *[(]", 1))


def code_blocks(code: DataFrame) -> DataFrame:
    """(path, module, language, kind, name, start, end, depth, header, body, within) of lexed files.

    start is the offset of the opening brace or of the line behind the header, end that of the closing brace or of the line that ends
    the block; a brace that is never closed has no end and no body, a closing brace too many none at all. within is the start of
    the block that it stands in. A path occurs once.
    """
    # kinds are told inside the array: a condition on one behind the explode would try all patterns again
    neat = F.transform("blocks", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["depth"].alias("depth"), F.regexp_replace(x["header"], "[ \t\r\n]+", " ").alias("header"), x["within"].alias("within")))
    told = F.transform(neat, lambda x: F.struct(kind_of(x["header"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["depth"].alias("depth"), x["header"].alias("header"), x["within"].alias("within")))
    rows = code.select("path", "module", "language", "code", F.explode(told).alias("b")).select("path", "module", "language", "code", "b.*")
    from_ = F.when(F.col("language").isin(*INDENTED), F.col("start") + 1).otherwise(F.col("start") + 2)
    body = F.when(F.col("end").isNotNull(), F.expr("substring(code, from_, greatest(0, end + 1 - from_))"))
    rows = rows.withColumn("from_", from_).withColumn("body", body)
    return rows.select("path", "module", "language", "kind", name_of(F.col("kind"), F.col("header")).alias("name"), "start", "end", "depth", "header", "body", "within")


def _lines(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")


def method_measures(blocks: DataFrame) -> DataFrame:
    """(path, module, name, start, lines, decisions, complexity) of each whole method."""
    methods = blocks.where("kind = 'method' and body is not null")
    rows = methods.select("path", "module", "name", "start", _lines(F.col("body")).alias("lines"), F.regexp_count("body", F.lit(DECISIONS)).cast("long").alias("decisions"))
    return rows.withColumn("complexity", F.col("decisions") + 1)


def catch_measures(blocks: DataFrame) -> DataFrame:
    """(path, module, catches, swallowed, generic, coverage): handlers with nothing in them, or of everything; comments are nothing."""
    nothing = F.trim(F.regexp_replace("body", "[ \t\r\n]+", " ")).isin("", "pass", "...")
    generic = F.col("header").rlike(f"(^|{_W})(Exception|Throwable|BaseException)({_W}|$)") | F.col("header").isin("catch", "except")
    rows = blocks.where("kind = 'catch' and body is not null").groupBy("path", "module").agg(F.count(F.lit(1)).alias("catches"), F.count_if(nothing).alias("swallowed"), F.count_if(generic).alias("generic"))
    return rows.withColumn("coverage", half_even(100.0 * (1.0 - F.col("swallowed") / F.col("catches"))))


def type_measures(blocks: DataFrame) -> DataFrame:
    """(path, module, name, start, lines, methods, severity): the methods directly in each type; severity over 1 is too large."""
    is_type = F.col("kind") == "type"
    held = blocks.where("kind = 'method' or kind = 'type' and body is not null").select("path", F.when(is_type, F.col("start")).otherwise(F.col("within")).alias("start"), is_type.alias("is_type"), F.when(is_type, F.struct("module", "name", _lines(F.col("body")).alias("lines"))).alias("t"))
    rows = held.where("start is not null").groupBy("path", "start").agg(F.max("t").alias("t"), F.count_if(~F.col("is_type")).alias("methods")).where("t is not null")
    rows = rows.select("path", "t.module", "t.name", "start", "t.lines", "methods")
    return rows.withColumn("severity", half_even(F.least(F.col("lines") / TYPE_LINES, F.col("methods") / TYPE_METHODS)))
