"""Building and profiling the human pool."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmill.functions.order import order_key
from revmill.functions.text import word_count
from revmill.operators.filters import as_human, before_cutoff, word_band
from revmill.operators.ranking import (
    CUT_LEVELS,
    INTEGER_LEVELS,
    integer_key,
    nth_key,
    ranked,
    slices,
)
from revmill.schema import POOL_SIZE, SEED
from revmill.session import stored


def quotas(categories: Sequence[str], n: int) -> dict[str, int]:
    """n spread over the categories; the first ones take the remainder."""
    share, extra = divmod(n, len(categories))
    return {c: share + (i < extra) for i, c in enumerate(categories)}


def quota_table(spark, quota: Mapping[str, int]) -> DataFrame:
    """The quotas as a table, in list order."""
    rows = [(i, c, q) for i, (c, q) in enumerate(quota.items())]
    return spark.createDataFrame(rows, "pos int, category string, quota bigint")


def spread(rows: DataFrame, n: int, by: str = "category") -> DataFrame:
    """n spread over the categories that occur, in name order, as a quota table."""
    names = rows.agg(F.array_sort(F.collect_set(by)).alias("names"))
    each = names.select(F.size("names").alias("k"), F.posexplode("names").alias("pos", by))
    extra = F.when(F.col("pos") < F.lit(n) % F.col("k"), 1).otherwise(0)
    return each.select("pos", by, (F.expr(f"{n} div k") + extra).alias("quota"))


def take_quota(
    df: DataFrame,
    quota: Mapping[str, int] | DataFrame,
    by: str = "category",
    key: str = "review_id",
    order: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The first ``quota`` rows of each listed category (a mapping or a quota table).

    First means smallest in the integer column ``order`` if one is named (such
    as a position in the source file), else first in the seeded hash order.
    Rows are kept by comparing with one cut key per category, so neither a
    large category nor a large quota gathers rows in a task. Copies of the last
    key all stay; ``dedup`` is what removes them. The filters before this step run
    once: the rows that pass them are stored.
    """
    if isinstance(quota, Mapping):
        quota = quota_table(df.sparkSession, quota).withColumnRenamed("category", by)
    place = order_key(seed, key) if order is None else integer_key(order)
    listed = df.join(quota.select(by), by, "left_semi")
    kept = stored(listed.withColumn("_order", place).select(*df.columns, "_order"), "quota")

    def ends(sizes: DataFrame) -> DataFrame:
        return sizes.join(quota.select(by, "quota"), by).withColumn("kept", F.least("n", "quota"))

    digits = CUT_LEVELS if order is None else INTEGER_LEVELS
    taken = slices(kept, [by], "_order", ["kept"], ends, "_slice", keep_copies=True, digits=digits)
    return taken.select(*df.columns)


def take_first(
    df: DataFrame,
    n: int,
    key: str,
    seed: int = SEED,
    complete: bool = True,
    rows: DataFrame | None = None,
) -> DataFrame:
    """n rows drawn without replacement, by hash order of their unique key.

    With ``complete`` a table of fewer rows is an error. With ``rows``, the rows
    of that table whose key is drawn. There is no LIMIT, which would send all n
    rows through one task, but a comparison with the n-th key.
    """
    keyed = lambda table: table.withColumn("_order", order_key(seed, key))
    if n <= 0:
        return (df if rows is None else rows).where(F.lit(False))
    last = nth_key(keyed(df), "_order", n).scalar()
    short = F.raise_error(F.lit(f"cannot take {n} rows out of fewer"))
    drawn = F.when(last.isNull(), short.cast("boolean") if complete else F.lit(True))
    return (
        keyed(df if rows is None else rows)
        .where(drawn.otherwise(F.col("_order") <= last))
        .drop("_order")
    )


def dedup(df: DataFrame, key: str = "review_id", order=None) -> DataFrame:
    """One row per key, the first in ``order``.

    ``min`` combines before the shuffle, so copies of a frequent key collapse in
    the tasks that read them. All columns break ties, for one right answer.
    """
    order = F.col(order) if isinstance(order, str) else order
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    first = F.min(F.struct(*([] if order is None else [order.alias("at")]), row))
    return df.groupBy(F.col(key).alias("_key")).agg(first.alias("first")).select("first.row.*")


def shuffle(df: DataFrame, key: str = "review_id", seed=SEED) -> DataFrame:
    """Rows in a reproducible random order: a range-partitioned sort."""
    return (
        df.withColumn("_order", order_key(seed, key)).orderBy("_order").drop("_order")
    )


def shuffled_positions(df: DataFrame, key: str = "review_id", seed=SEED) -> DataFrame:
    """Rows with their 1-based ``position`` in the shuffled order."""
    return ranked(df.withColumn("_order", order_key(seed, key)), "_order").drop("_order")


def filter_pool(df: DataFrame) -> DataFrame:
    """The cutoff and the word band; the cheap test comes first."""
    return word_band(before_cutoff(df))


def build_human_pool(
    df: DataFrame,
    categories: Sequence[str] | DataFrame,
    n: int = POOL_SIZE,
    seed: int = SEED,
    order: str | None = None,
) -> DataFrame:
    """The human pool from raw reviews: filter, take each category's quota, keep
    one row per review, shuffle. The quotas are ``n`` spread over a list of
    categories, or a quota table.

    As duplicates go after the quota is filled, the pool may be below n.
    """
    place = [order] if order else []
    rows = as_human(filter_pool(df), *place)
    quota = categories if isinstance(categories, DataFrame) else quotas(categories, n)
    taken = take_quota(rows, quota, order=order, seed=seed)
    return shuffle(dedup(taken, "review_id", order).drop(*place), seed=seed)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return (
        df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    )


def word_stats(df: DataFrame) -> DataFrame:
    """Smallest, largest and mean word count."""
    wc = word_count("text")
    return df.agg(F.min(wc).alias("min"), F.max(wc).alias("max"), F.avg(wc).alias("mean"))


def head(df: DataFrame, k: int, order) -> DataFrame:
    """The first k rows in ``order``."""
    return df.orderBy(order).limit(k)
