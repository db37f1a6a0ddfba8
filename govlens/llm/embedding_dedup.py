"""Near-duplicate embeddings by an inverted multi-index.

Two independent codebooks, one for each half of the vectors, form a product grid of cells. Every vector lies in the cell of
its nearest codewords. Its search visits cells in order of their distance, which is the sum over both halves, as a
multi-sequence traversal does, until the cells visited hold the target recall: the share of partners expected in a cell
falls off exponentially with its distance, and how fast, and where a search has to stop, is fitted on worst cases, random
vectors at exactly the threshold from sampled ones. Candidates met in a cell are verified by cosine in double precision. A
pair can be met from either side and is counted in one cell only.

The number of cells grows with the number of vectors. Equal vectors collapse before the search. In a cell only its own
vectors meet each other and the visitors, and large cells are dealt to several tasks by chunks of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, stored
from govlens.llm.components import Forest, connected_components

THRESHOLD, RECALL = 0.93, 0.99
#: Vectors sampled to fit the codebooks, vectors of one label wanted in a cell, most codewords of one half, and members of a cell that one
#: task compares.
SAMPLE, CELL, MOST_CODES, CHUNK = 20_000, 64, 1024, 1024
_BATCH = 4096


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    kind = np.float32 if column and len(data) == 4 * dimension * len(column) else np.float64
    raw = np.frombuffer(data, kind).reshape(-1, dimension).astype(np.float64)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _scaled(values: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest component near 1, so that no square over- or underflows."""
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True))[1])


class Grid:
    """The codebooks of both halves, and how far a search goes."""

    #: Rates at which the expected share of partners may fall off with a cell's distance.
    RATES = (4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0)

    def __init__(self, vectors: np.ndarray, n_codes: int, threshold: float, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.cut = vectors.shape[1] // 2
        self.codes = [self._fit(half, n_codes, rng) for half in (vectors[:, : self.cut], vectors[:, self.cut :])]
        n, d = vectors.shape
        aside = rng.normal(size=(n, d))
        aside -= (aside * vectors).sum(axis=1, keepdims=True) * vectors
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-12)
        home = self.home(self.distances(threshold * vectors + np.sqrt(1 - threshold * threshold) * aside))
        distances = self.distances(vectors)
        cost = self.excess(distances, home)
        self.reach = float(cost.max(initial=0)) + 1e-9  # no search goes further than any of the sample had to
        likely = [float(np.mean(-r * cost - self._log_total(distances, r))) for r in self.RATES]
        self.rate = self.RATES[int(np.argmax(likely))]
        # the share that the cells nearer than a partner's hold: at its recall quantile a search may stop
        self.share = 1.0
        vector, cell, costs, shares = self._ordered(distances)
        at_home = np.flatnonzero(cell == home[vector])
        if len(at_home):
            self.share = float(np.quantile(shares[at_home], min(1.0, recall), method="higher"))

    def _log_total(self, distances: tuple[np.ndarray, np.ndarray], rate: float) -> np.ndarray:
        return sum(np.log(np.exp(-rate * x).sum(axis=1)) for x in distances)

    @staticmethod
    def _fit(half: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        codes = half[rng.choice(len(half), min(k, len(half)), replace=False)].copy()
        for _ in range(rounds):
            nearest = Grid._squares(half, codes).argmin(axis=1)
            for c in range(len(codes)):
                own = half[nearest == c]
                if len(own):
                    codes[c] = own.mean(axis=0)
        return codes

    @staticmethod
    def _squares(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (half * half).sum(axis=1)[:, None] - 2 * half @ codes.T + (codes * codes).sum(axis=1)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codewords of each half, less the smallest."""
        found = [self._squares(half, codes) for half, codes in zip((vectors[:, : self.cut], vectors[:, self.cut :]), self.codes)]
        return tuple(x - x.min(axis=1, keepdims=True) for x in found)

    def home(self, distances: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return distances[0].argmin(axis=1) * len(self.codes[1]) + distances[1].argmin(axis=1)

    def excess(self, distances: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
        at = np.arange(len(cells))
        return distances[0][at, cells // len(self.codes[1])] + distances[1][at, cells % len(self.codes[1])]

    def _ordered(self, distances: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """(vector, cell, cost, share of the cells before it) of the cells within reach, nearest first.

        Codewords of each half are walked in order of distance; the k-th of one half meets no more of the other than the
        one before it, so each vector's frontier only moves back.
        """
        first, second = (np.sort(x, axis=1) for x in distances)
        order = [np.argsort(x, axis=1, kind="stable") for x in distances]
        vectors, cells, cost = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k in range(first.shape[1]):
            open_ = np.flatnonzero(first[:, k] <= self.reach)
            if not len(open_):
                break
            n = (second[open_] <= (self.reach - first[open_, k])[:, None]).sum(axis=1)
            v = np.repeat(open_, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            vectors.append(v)
            cells.append(order[0][v, k] * len(self.codes[1]) + order[1][v, step])
            cost.append(first[v, k] + second[v, step])
        vectors, cells, cost = (np.concatenate(x) for x in (vectors, cells, cost))
        by_cost = np.lexsort((cells, cost, vectors))
        vectors, cells, cost = vectors[by_cost], cells[by_cost], cost[by_cost]
        share = np.exp(-self.rate * cost - self._log_total(distances, self.rate)[vectors])
        total = np.cumsum(share)
        before = total - share
        begins = np.searchsorted(vectors, vectors)
        return vectors, cells, cost, before - before[begins]

    def visits(self, distances: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, cell) of every visit, nearest cells first, and of each vector how far its search goes.

        A search goes on while the cells before hold less than the share that the target recall needs.
        """
        vectors, cells, cost, before = self._ordered(distances)
        wanted = before <= self.share
        vectors, cells, cost = vectors[wanted], cells[wanted], cost[wanted]
        far = np.zeros(len(distances[0]))
        np.maximum.at(far, vectors, cost)
        return vectors, cells, far + 1e-12


def _probes(reps: DataFrame, sent, dimension: int) -> DataFrame:
    """(label, cell, home, far, rep, m, vec) for each visit of each vector, which goes so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                grid: Grid = sent.value
                distances = grid.distances(_unit(batch.column("vec"), dimension))
                home = grid.home(distances)
                vector, cell, far = grid.visits(distances)
                taken = batch.take(pa.array(vector))
                yield pa.RecordBatch.from_arrays([taken.column("label"), pa.array(cell), pa.array(home[vector]), pa.array(far[vector]), taken.column("rep"), taken.column("m"), taken.column("vec")], ["label", "cell", "home", "far", "rep", "m", "vec"])

    label = reps.schema["label"].dataType.simpleString()
    return reps.select("label", "rep", "m", "vec").mapInArrow(run, f"label {label}, cell long, home long, far double, rep long, m long, vec binary")


def _dealt(visits: DataFrame, chunk: int) -> DataFrame:
    """Visits with the pairs of parts (part, i, j) in which they meet: a cell's own vectors in parts before its visitors'."""
    own = F.col("home") == F.col("cell")
    sizes = visits.groupBy("label", "cell").agg(F.ceil(F.count_if(own) / F.lit(chunk)).cast("int").alias("own"), F.ceil(F.count_if(~own) / F.lit(chunk)).cast("int").alias("others"))
    parts = visits.join(sizes.where("own > 0"), ["label", "cell"])
    parts = parts.withColumn("part", F.when(own, F.pmod(F.xxhash64("rep"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("rep"), F.greatest("others", F.lit(1)))).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("own") + F.col("others") - 1).otherwise(F.col("own") - 1))))
    return parts.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "own", "others")


def _verify(dealt: DataFrame, sent, dimension: int, threshold: float) -> DataFrame:
    """(rep, n, root) of the members of each pair of chunks: links met here, and a fellow of the same component."""

    def run(rows: pa.Table) -> pa.Table:
        grid: Grid = sent.value
        rows = rows.combine_chunks()
        rep, home, far, m, part = (np.asarray(rows[c]) for c in ("rep", "home", "far", "m", "part"))
        cell, i, j = rows["cell"][0].as_py(), rows["i"][0].as_py(), rows["j"][0].as_py()
        vectors = _unit(rows["vec"], dimension)
        distances = grid.distances(vectors)
        n, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            linked = vectors[a] @ vectors[right].T >= threshold
            if i == j:
                linked &= a[:, None] < right[None, :]
            x, y = np.nonzero(linked)
            x, y = a[x], right[y]
            # a visitor meets the other in its own cell too, if the other goes that far
            guest = np.where(home[x] == cell, y, x)
            host = np.where(home[x] == cell, x, y)
            both = home[guest] != cell
            again = np.zeros(len(x), bool)
            again[both] = grid.excess(tuple(d[host[both]] for d in distances), home[guest[both]]) <= far[host[both]]
            counted = ~(again & (home[guest] < cell))
            np.add.at(n, x[counted], m[y[counted]])
            np.add.at(n, y[counted], m[x[counted]])
            forest.link(a, right, linked)
        told = np.flatnonzero((n > 0) | (forest.root != np.arange(len(rep))))
        return pa.table({"rep": rep[told], "n": n[told], "root": rep[forest.root[told]]})

    return dealt.groupBy("label", "cell", "i", "j").applyInArrow(run, "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", label: str = "label", key: str = "vec_id", threshold: float = THRESHOLD, recall: float = RECALL, n_codes: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per row: key, n_links, component_id (the smallest key reachable by links, itself included), kept.

    Rows link when their labels are equal and not null and their cosine is at least threshold. Vectors that are null, empty
    or zero, or hold a null or non-finite number, and rows without a key, link with nothing; nor do vectors of different
    length. Equal vectors are always linked; other links are found with at least the target recall in the worst case.
    The grid is fitted on at most SAMPLE vectors and holds all. Vectors whose length isn't the commonest one are compared
    in one cell. Other columns are not read.
    """
    spark = vectors.sparkSession
    arrow_bounds(spark)
    given = vectors.schema[embedding].dataType.elementType.simpleString()
    wide = F.col(embedding).cast("array<float>" if given == "float" else "array<double>")
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(wide) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), wide.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    scaled = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(given if given == "float" else "double")).otherwise(x))
    valid = rows.where("fine").select("key", "label", scaled.alias("v"))
    valid = valid.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(11)))
    valid = stored(valid)
    reps = stored(valid.groupBy("label", "h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("m"), F.min_by("v", "key").alias("v")))
    found = [_search(reps.where(F.size("v") == d), d, common, threshold, recall, n_codes, chunk) for d, common in _lengths(reps)]
    if found:
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        pairs = stored(pairs)
        links = pairs.groupBy("rep").agg(F.sum("n").alias("n"))
        component = connected_components(pairs.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        reps = reps.join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        reps = reps.withColumn("n", F.lit(0)).withColumn("component", F.col("rep"))
    of_vector = valid.select("key", "label", "h1", "h2").join(reps.select("label", "h1", "h2", "m", "n", F.coalesce("component", "rep").alias("component")), ["label", "h1", "h2"])
    out = of_vector.select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~F.col("fine")).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return out.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _lengths(reps: DataFrame) -> list[tuple[int, bool]]:
    """The lengths of vectors, and whether each is the commonest."""
    found = reps.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").collect()
    return [(r.d, k == 0) for k, r in enumerate(found)]


def _search(reps: DataFrame, dimension: int, gridded: bool, threshold: float, recall: float, n_codes: int | None, chunk: int) -> DataFrame:
    narrow = reps.schema["v"].dataType.elementType.simpleString() == "float"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _scaled(np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, dimension))
            values = values.astype(np.float32) if narrow else values
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "rep", "m")), pa.array([v.tobytes() for v in values], pa.binary())], ["label", "rep", "m", "vec"])

    label = reps.schema["label"].dataType.simpleString()
    packed = reps.select("label", "rep", "m", "v").mapInArrow(pack, f"label {label}, rep long, m long, vec binary")
    total, labels = reps.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    sample = packed.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vec").toArrow()
    units = _unit(sample["vec"], dimension)
    k = n_codes or max(4, min(MOST_CODES, int(np.ceil((total / (CELL * max(1, labels))) ** 0.5)))) if gridded and dimension > 1 else 1
    sent = reps.sparkSession.sparkContext.broadcast(Grid(units, k, threshold, recall))  # at most 2 * MOST_CODES half vectors
    return _verify(_dealt(_probes(packed, sent, dimension), chunk), sent, dimension, threshold)
