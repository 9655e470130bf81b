"""Nearest neighbours by inner product over an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a cell is a pair of
centroids. For a query the centroids of each half are ranked by inner product, and a heap
walks the pairs in the order of their sum until the cells passed hold enough entries.
Those entries are scored exactly. How many are enough is measured: a sample of the queries
is compared with all entries, and the walk is made as long as RECALL of their true
neighbours needs.

Equal vectors are one entry that keeps its smallest ids, which loses nothing: of equal
scores the smaller ids come first. Entries lie in blocks of a first-half centroid, large
ones split, and meet the queries that ask for them there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revmill.llm.tables import named, read, shuffled, stored

NEAREST = 20
QUERY_EVERY = 20
#: Vectors that the codebooks are trained on at most, those with the smallest hashes.
SAMPLE = 20_000
ROUNDS = 10
#: Centroids of a half: the fourth root of the entries times this, within bounds.
PER_ROOT, FEWEST, MOST = 8, 4, 256
#: Share of the sampled queries' true neighbours that the walk has to reach, and the sample.
#: Vectors without structure need a large part of all entries for it.
RECALL, CALIBRATING = 0.95, 128
#: Entries that a query passes at least, however few would do for the sample.
CANDIDATES = 1_024
#: Entries of a block on average at most.
BLOCK = 10_000
#: Queries whose scores for a block are held at once.
QUERIES = 64


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of rows that take part, as doubles.

    Null ids, null, zero and empty vectors, null or non-finite components and vectors of
    another length than most take no part.
    """
    rows = vectors.select(named(key).cast("long").alias("id"), named(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == F.lit(usual["n"] if usual else 0))


def entries(rows: DataFrame, most: int) -> DataFrame:
    """(vector as bytes, its `most` smallest different ids), a row per different vector.

    Every task keeps the smallest ids of its own vectors first, so that a vector with very
    many ids gives a few from each task.
    """
    out = "vector binary, ids array<bigint>"

    def smallest(ids: np.ndarray) -> np.ndarray:
        return np.unique(ids)[:most]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy().reshape(len(ids), -1) + 0.0  # -0.0 is 0.0
            kept: dict[bytes, list[int]] = {}
            for i, v in zip(ids.tolist(), flat, strict=True):
                kept.setdefault(v.tobytes(), []).append(i)
            lists = [smallest(np.array(x)) for x in kept.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(kept), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["vector", "ids"]
            )

    made = rows.select("id", "vector").mapInArrow(own, out)
    return made.groupBy("vector").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1) if data else np.empty((0, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (((centroids**2).sum(axis=1) - 2 * x @ centroids.T)).argmin(axis=1)


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Centroids of Lloyd's method; one that loses its points stays where it was."""
    rng = np.random.default_rng(0)
    different = np.unique(x, axis=0)
    centroids = different[rng.choice(len(different), min(size, len(different)), replace=False)].copy()
    for _ in range(ROUNDS):
        of = _nearest(x, centroids)
        count = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


class MultiIndex:
    """Two codebooks, and how many entries each cell has."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.counts = np.zeros((len(first), len(second)), dtype=np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(x[:, :half], self.first), _nearest(x[:, half:], self.second)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """(group of each first-half centroid, parts of each group).

        Neighbouring centroids share a group of up to BLOCK entries; a centroid with
        more is a group of its own, in several parts.
        """
        group, parts, held = [], [], BLOCK + 1
        for n in self.counts.sum(axis=1).tolist():
            if held + n > BLOCK:
                parts.append(max(1, -(-n // BLOCK)))
                held = 0
            group.append(len(parts) - 1)
            held += n
        return np.array(group), np.array(parts)

    def passed_before(self, query: np.ndarray, cells: list[int]) -> list[int]:
        """Entries that a walk passes before it comes to each of the cells, numbered i * MOST + j."""
        half = self.first.shape[1]
        sums = (self.first @ query[:half])[:, None] + (self.second @ query[half:])[None, :]
        order = np.argsort(-sums, axis=None, kind="stable")
        before = np.empty(sums.size, dtype=np.int64)
        counts = self.counts.ravel()[order]
        before[order] = np.cumsum(counts) - counts
        return [int(before[cell // MOST * len(self.second) + cell % MOST]) for cell in cells]

    def walk(self, query: np.ndarray, enough: int) -> dict[int, list[int]]:
        """Non-empty cells by first centroid, in order of summed inner product until they hold `enough`."""
        half = self.first.shape[1]
        one, two = self.first @ query[:half], self.second @ query[half:]
        left, right = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        one, two = one[left], two[right]
        heap, found, total = [(-(one[0] + two[0]), 0, 0)], {}, 0
        while heap and total < enough:
            _, a, b = heapq.heappop(heap)
            i, j = int(left[a]), int(right[b])
            if self.counts[i, j]:
                found.setdefault(i, []).append(j)
                total += int(self.counts[i, j])
            if b + 1 < len(two):
                heapq.heappush(heap, (-(one[a] + two[b + 1]), a, b + 1))
            # The pair below the first of a row comes from there alone, so each pair comes once.
            if b == 0 and a + 1 < len(one):
                heapq.heappush(heap, (-(one[a + 1] + two[0]), a + 1, 0))
        return found


def built(distinct: DataFrame, count: int) -> MultiIndex:
    """Codebooks from a bounded sample of the entries; counts over all of them."""
    sample = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow()
    x = _matrix(sample["vector"])
    size = int(min(MOST, max(FEWEST, PER_ROOT * round(count**0.25))))
    half = x.shape[1] // 2
    return MultiIndex(codebook(x[:, :half], size), codebook(x[:, half:], size))


def calibrated(placed: DataFrame, index: MultiIndex, queries: list[bytes], nearest: int, recall: float) -> int:
    """The least number of entries to pass so that `recall` of the queries' `nearest` entries are among them.

    `placed` are all entries with their cells. Each task keeps the best of its own entries
    for every query; the driver gets the cells of the best of all, `nearest` for a query.
    """
    if not queries:
        return 0
    asked = np.frombuffer(b"".join(queries)).reshape(len(queries), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = (np.empty((len(asked), 0), dtype) for dtype in (np.float64, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column("vector").to_pylist()
            mine = asked @ _matrix(batch.column("vector")).T
            # A query is no neighbour of its own, unless another row is equal.
            alone = {v: k for k, (v, n) in enumerate(zip(data, batch.column("n").to_pylist(), strict=True)) if n == 1}
            for q, query in enumerate(queries):
                if query in alone:
                    mine[q, alone[query]] = -np.inf
            cells = batch.column("i").to_numpy().astype(np.int64) * MOST + batch.column("j").to_numpy()
            score = np.concatenate([score, mine], axis=1)
            cell = np.concatenate([cell, np.broadcast_to(cells, mine.shape)], axis=1)
            at = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
            score, cell = (np.take_along_axis(x, at, axis=1) for x in (score, cell))
        q, k = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(score[q, k]), pa.array(cell[q, k])], ["q", "score", "cell"]
        )

    entries = placed.select("vector", F.size("ids").alias("n"), "i", "j")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    found = entries.mapInArrow(run, "q int, score double, cell long").withColumn("k", F.row_number().over(best))
    reached: dict[int, list[int]] = {}
    for row in found.where(F.col("k") <= nearest).select("q", "cell").collect():  # CALIBRATING * nearest rows
        reached.setdefault(row["q"], []).append(row["cell"])
    before = np.array([n for q, cells in reached.items() for n in index.passed_before(asked[q], cells)])
    if not len(before):
        return 0
    return int(np.sort(before)[int(np.ceil(recall * len(before))) - 1]) + 1


def _best(x: np.ndarray, query: np.ndarray, rough: np.ndarray, ids: list[list[int]], most: int):
    """Ids and exact scores of the `most` best rows, ties to smaller ids.

    `rough` holds the scores as a matrix product rounds them; what may be among the best
    is scored again, each row by the same sum.
    """
    at = np.flatnonzero(rough > -np.inf)
    if len(at) > most:
        cut = np.partition(rough[at], len(at) - most)[len(at) - most]
        at = at[rough[at] >= cut - 1e-9 * max(1.0, abs(cut))]
    scores = (x[at] * query).sum(axis=1)
    flat = np.array([i for k in at for i in ids[k]], dtype=np.int64)
    each = np.repeat(scores, [len(ids[k]) for k in at])
    order = np.lexsort((flat, -each))[:most]
    return flat[order], each[order]


def search(
    vectors: DataFrame,
    nearest: int = NEAREST,
    every: int = QUERY_EVERY,
    enough: int = CANDIDATES,
    recall: float = RECALL,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score, n_passed): the best found of all other rows for each row whose key `every` divides.

    A query passes `n_passed` entries at least: what reaches `recall` of the neighbours of
    a sample of the queries, and not under `enough`. Scores are inner products in double precision, ties go to the smaller key. Repeated
    rows count once; a row is another if its key is. Without rows there is no result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    distinct = stored(entries(rows, nearest + 1), "entries")
    count = distinct.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_passed long")
    if not count:
        return empty
    index = built(distinct, count)
    book = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = book.value.cells(_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["vector", "ids", "i", "j"]
                )

    placed = stored(distinct.mapInArrow(place, "vector binary, ids array<bigint>, i int, j int"), "placed")
    counted = MultiIndex(index.first, index.second)
    for r in placed.groupBy("i", "j").count().collect():  # at most MOST * MOST rows
        counted.counts[r["i"], r["j"]] = r["count"]
    group, parts = (F.array(*[F.lit(int(n)) for n in x]) for x in counted.blocks())
    held = placed.select(
        "vector", "ids", (F.col("i") * MOST + F.col("j")).alias("cell"), F.get(group, F.col("i")).alias("group")
    )
    held = held.withColumn("part", F.pmod(F.xxhash64("vector"), F.get(parts, F.col("group"))).cast("int"))

    queries = rows.where(F.col("id") % every == 0).select("id", "vector").distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) + 0.0
            data = pa.array([v.tobytes() for v in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["query_id", "query"])

    asked = stored(queries.mapInArrow(packed, "query_id long, query binary"), "queries")
    different = asked.select("query").distinct()
    sample = different.orderBy(F.xxhash64("query"), "query").limit(CALIBRATING).collect()
    sample = [bytes(r["query"]) for r in sample] if enough < count else []
    enough = max(enough, calibrated(placed, counted, sample, nearest, recall))
    ready = spark.sparkContext.broadcast(counted)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ready.value
        group, parts = index.blocks()
        for batch in batches:
            for v in batch.column(0).to_pylist():
                cells: dict[int, list[int]] = {}
                for first, second in index.walk(np.frombuffer(v), enough).items():
                    cells.setdefault(int(group[first]), []).extend(first * MOST + j for j in second)
                rows = [(g, k, c) for g, c in cells.items() for k in range(int(parts[g]))]
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(rows), pa.binary()), pa.array(columns[0], pa.int32())]
                    + [pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int32()))],
                    ["query", "group", "part", "cells"],
                )

    # Placed by another key than the distinct's, or the planner drops it and the walks,
    # which take long and are few rows, end up in one task.
    spread = different.repartition(shuffled(vectors), F.xxhash64("query"))
    asking = spread.mapInArrow(walks, "query binary, group int, part int, cells array<int>")

    def score(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        cell, x, ids = ours["cell"].to_numpy(), _matrix(ours["vector"]), ours["ids"].to_pylist()
        made: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        for batch in theirs.to_batches(QUERIES) if len(cell) else ():
            asked = _matrix(batch["query"])
            rough = asked @ x.T
            for q, data, cells, row in zip(asked, batch["query"].to_pylist(), batch["cells"], rough, strict=True):
                wanted = np.zeros(MOST * MOST, dtype=bool)
                wanted[cells.values.to_numpy()] = True
                row[~wanted[cell]] = -np.inf
                found, best = _best(x, q, row, ids, nearest + 1)
                made["query"] += [data] * len(found)
                made["vec_id"] += found.tolist()
                made["score"] += best.tolist()
        types = {"query": pa.binary(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in made.items()})

    met = held.groupBy("group", "part").cogroup(asking.groupBy("group", "part"))
    partial = met.applyInArrow(score, "query binary, vec_id long, score double")
    best = partial.groupBy("query").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("away"), "vec_id"))), 1, nearest + 1).alias("best")
    )
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, nearest)
    return (
        asked.join(best, "query")
        .select("query_id", F.posexplode(others).alias("at", "found"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("found.vec_id").alias("vec_id"),
            (-F.col("found.away")).alias("score"),
            F.lit(min(enough, count)).cast("long").alias("n_passed"),
        )
    )


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    return search(read(spark, sf_dir, "embeddings"))
