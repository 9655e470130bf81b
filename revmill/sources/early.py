"""The first passing reviews of each category in file order, without reading the files after them."""

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmill.operators.filters import as_human
from revmill.operators.pool import dedup, filter_pool, quotas, shuffle, take_quota
from revmill.schema import POOL_SIZE, SEED
from revmill.session import stored
from revmill.sources.reviews import category_of, read_lines


def files_of(spark: SparkSession, path) -> dict[str, list[str]]:
    """The files of each category in name order: the listing that Spark keeps of a folder anyway."""
    listed = spark.read.option("recursiveFileLookup", True).text(path).inputFiles()
    rows = spark.createDataFrame([(f,) for f in listed], "file string")
    found = defaultdict(list)
    for row in rows.select("file", category_of(F.col("file")).alias("category")).orderBy("file").collect():
        found[row.category].append(row.file)
    return found


def first_passing(
    spark: SparkSession,
    path,
    quota: Mapping[str, int],
    passes: Callable[[DataFrame], DataFrame],
    seed: int = SEED,
) -> DataFrame:
    """The first ``quota`` rows of each listed category that ``passes`` lets through, and their ``file``.

    Files are read in name order, one of each category at first and then twice as many
    each time, until their passing rows fill the quota; files after that are never
    opened, nor those of other categories. What has passed is stored with its file, so
    counts by file tell where the quota ends: files before that are taken whole. A line has no
    number that all readers agree on, so of the last file the rows that come first in
    the seeded hash order fill the rest.
    """
    files = files_of(spark, path)
    need = {c: n for c, n in quota.items() if n > 0 and files.get(c)}
    seen: dict[str, list[tuple[str, int]]] = {c: [] for c in need}
    at, wave, read = dict.fromkeys(need, 0), 1, []
    while True:
        short = [c for c in need if sum(n for _, n in seen[c]) < need[c] and at[c] < len(files[c])]
        if not short:
            break
        now = {c: files[c][at[c] : at[c] + wave] for c in short}
        lines = spark.read.text([f for some in now.values() for f in some])
        rows = passes(read_lines(lines).select(F.inline("row"), "category", "file"))
        rows = stored(rows, "passing")
        read.append(rows)
        for row in rows.groupBy("category", "file").agg(F.count("*").alias("n")).orderBy("file").collect():
            seen[row.category].append((row.file, row.n))
        for c in short:
            at[c] += wave
        wave *= 2
    whole, last = [], []
    for category, counts in seen.items():
        before = 0
        for file, n in counts:
            if before + n <= need[category]:
                whole.append((category, file))
            elif before < need[category]:
                last.append((category, file, need[category] - before))
            before += n
    if not read:
        return passes(read_lines(spark.read.text(path)).select(F.inline("row"), "category", "file")).where(F.lit(False))
    rows = reduce(DataFrame.unionByName, read)
    taken = rows.join(spark.createDataFrame(whole, "category string, file string"), ["category", "file"], "left_semi")
    if last:
        cut = rows.join(
            spark.createDataFrame([x[:2] for x in last], "category string, file string"), ["category", "file"], "left_semi"
        )
        rest = take_quota(cut, {c: n for c, _, n in last}, seed=seed)
        taken = taken.unionByName(rest)
    return taken


def build_pool_from_files(
    spark: SparkSession, path, categories: Sequence[str] | Mapping[str, int], n: int = POOL_SIZE, seed: int = SEED
) -> DataFrame:
    """The human pool of the first reviews in file order: filter, quota with early stop, dedup, shuffle.

    ``categories`` is a list that shares ``n``, or each one's quota. Of copies that of the
    first file stays, and in one file the smallest row.
    """
    quota = categories if isinstance(categories, Mapping) else quotas(categories, n)
    taken = first_passing(spark, path, quota, lambda raw: as_human(filter_pool(raw), "file"), seed)
    return shuffle(dedup(taken, "review_id", "file").drop("file"), seed=seed)
