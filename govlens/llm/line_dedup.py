"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A run is a whole number of consecutive lines with at least MIN_WORDS words, or of at least MIN_LINES lines. Of each window
(a run of at most MIN_LINES lines) the minimum line hash is its fingerprint, so every window that occurs twice has its
fingerprint twice. Windows at fingerprints that occur once are done. At the others positions are joined: each window with
the first place that holds the same lines. A match of a text with that place is extended both ways, window by window along
the same distance between the two, to a run as long as they agree; the lines of all runs are deleted from the later text.

Nothing is lost by looking at first places only: a run is made of windows, each of which has a first place of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import stored, unused

MIN_LINES, MIN_WORDS = 3, 50


def _windows(text: Column) -> Column:
    """Per line with text: its number, the window's number of lines (null: the text ends first), hashes and fingerprint."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda line, i: F.struct(i.alias("pos"), F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(7)).alias("g"), F.size(F.filter(F.split(line, " ", -1), lambda w: w != "")).alias("w")),
    )
    return F.filter(lines, lambda x: x["w"] > 0)


def line_windows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, n_lines, last, fingerprint, h, g): the runs of one, two and three lines beginning at each line, where there are any."""
    rows = docs.select(F.col(key).alias("key"), _windows(F.col(text).cast("string")).alias("line"))

    def windows(x: Column, i: Column) -> Column:
        one, two = F.get("line", i + 1), F.get("line", i + 2)

        def window(n: int, last: Column, print_: Column, h: Column, g: Column) -> Column:
            return F.struct(x["pos"].alias("pos"), F.lit(n).alias("n_lines"), last["pos"].alias("last"), print_.alias("fingerprint"), h.alias("h"), g.alias("g"))

        alone = F.when(x["w"] >= MIN_WORDS, window(1, x, x["h"], F.xxhash64(x["h"], x["g"]), x["g"]))
        pair = F.when(one.isNotNull() & (x["w"] + one["w"] >= MIN_WORDS), window(2, one, F.least(x["h"], one["h"]), F.xxhash64(x["h"], one["h"], x["g"]), F.xxhash64(x["g"], one["g"], F.lit(2))))
        three = F.when(two.isNotNull(), window(3, two, F.least(x["h"], one["h"], two["h"]), F.xxhash64(x["h"], one["h"], two["h"]), F.xxhash64(x["g"], one["g"], two["g"], F.lit(3))))
        return F.array_compact(F.array(alone, pair, three))

    return rows.select("key", F.explode(F.flatten(F.transform("line", windows))).alias("w")).select("key", "w.*")


def matched_windows(windows: DataFrame) -> DataFrame:
    """(key, pos, last, source, source_pos): each window that occurred before, with the first place that holds its lines."""
    # what windows are joined with is a table each time, so that the join of a hot fingerprint or run can be split
    shared = stored(windows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"))
    candidates = windows.join(shared, "fingerprint").select("key", "pos", "last", "h", "g")
    first = stored(candidates.groupBy("h", "g").agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first"))
    later = candidates.join(first, ["h", "g"]).where(F.struct("key", "pos") > F.col("first"))
    return later.select("key", "pos", "last", F.col("first.key").alias("source"), F.col("first.pos").alias("source_pos"))


def repeated_runs(matches: DataFrame) -> DataFrame:
    """(key, source, distance, pos, last): matches of a text with one place, extended both ways to whole runs.

    Matches in the same two texts at the same distance are one run where they overlap or meet.
    """
    along = Window.partitionBy("key", "source", "distance").orderBy("pos", "last")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = matches.withColumn("distance", F.col("pos") - F.col("source_pos")).withColumn("opens", F.when(F.col("pos") <= before + 1, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "source", "distance", "run").agg(F.min("pos").alias("pos"), F.max("last").alias("last")).drop("run")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", added: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """docs with the later repeats of line runs deleted from text, and the numbers of all and of deleted lines added.

    Lines end at a line feed. Lines without words are never part of a run; they go when the lines on both sides of them go
    in one deleted run. A null text stays null with 0 lines, an empty one has 1 line. Rows with the same key count as
    copies only of earlier rows with smaller keys, so keys should be unique: rows of a repeated key lose the same lines.
    A row with a null key neither loses nor causes anything. An empty table stays empty. Other columns stay as they are;
    docs must not have columns of the names in added.
    """
    if set(added) & set(docs.columns):
        raise ValueError("docs has a column of a name that is added here")
    runs = unused("deleted_runs", docs.columns)
    windows = stored(line_windows(docs.where(F.col(key).isNotNull()), text, key))
    found = repeated_runs(matched_windows(windows)).groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("pos", "last")).alias(runs))  # at most three a line
    return docs.join(found, key, "left").select(*_rebuilt(docs, text, runs, added))


def _rebuilt(docs: DataFrame, text: str, runs: str, added: tuple[str, str]) -> list[Column]:
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["pos"], r["last"]))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(F.col(runs).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(added[0])
    n_deleted = F.when(F.col(runs).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(added[1])
    return [*(F.col(f"`{c}`") if c != text else kept.alias(text) for c in docs.columns), n_lines, n_deleted]
