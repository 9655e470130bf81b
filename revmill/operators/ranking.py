"""Exact positions in a shuffled order, without one task per group.

A window over a whole group would put a hot category or generator into one
task. Here every order key is cut into buckets first. ``ranked`` ranks inside a
bucket and adds the rows before it. ``slices`` goes further:
it needs only the keys at the cut positions, so it ranks nothing but the
buckets that hold a cut and then labels the rows by comparing keys, which
moves no row between tasks.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Hexadecimal digits of the order key. Ranking sorts every bucket, so it has more of
# them (65,536). Cuts sort only a few buckets, and fewer buckets (4,096) let each
# task combine its rows to few counts before the shuffle; the bucket of a cut is
# divided once more, into 4,096 again.
RANK_DIGITS = 4
CUT_LEVELS = (3, 6)
# Digits of an integer key may all agree but the last: it is cut down to single values.
INTEGER_LEVELS = (4, 8, 12, 16)


def _bucket(key: str, digits: int = CUT_LEVELS[0]) -> Column:
    return F.substring(key, 1, digits)


def _running(column: str, window) -> Column:
    return F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, 0))


def bucket_counts(df: DataFrame, by: Sequence[str], key: str, bucket: Column | None = None):
    """Rows per (group, bucket): a narrow scan, combined before its shuffle."""
    bucket = _bucket(key) if bucket is None else bucket
    return df.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def ranked(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Each row's 1-based position in the order of ``key``, a unique order key.

    The window and the join share one placement by bucket, so rows move once.
    """
    own = _bucket(key, RANK_DIGITS)
    counts = bucket_counts(df, [], key, own)
    # An unpartitioned window over at most 65,536 rows.
    before = counts.select(
        "bucket", (_running("n", Window.orderBy("bucket")) - F.col("n")).alias("_before")
    )
    inside = Window.partitionBy("bucket").orderBy(key)
    local = df.withColumn("bucket", own).withColumn("_local", F.row_number().over(inside))
    return (
        local.join(before, "bucket")
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("bucket", "_local", "_before")
    )


def nth_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n-th smallest key as a table of one row, or of none if there are fewer."""
    one = df.select(F.lit(0).alias("_all"), F.col(key).alias("key"))
    cut = df.sparkSession.range(1).select(
        F.lit(0).alias("_all"), F.lit("n").alias("cut"), F.lit(n).cast("bigint").alias("upto")
    )
    counts = bucket_counts(one, ["_all"], "key")
    return cut_keys(one, ["_all"], "key", cut, counts, keep_copies=True).select(
        F.col("cut_key").alias("key")
    )


def cut_keys(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    bounds: DataFrame,
    counts: DataFrame,
    keep_copies: bool = False,
    digits: Sequence[int] = CUT_LEVELS,
) -> DataFrame:
    """The order key at each cut position.

    ``bounds`` has the group columns, ``cut`` and ``upto``, the 1-based position
    of the last row before the cut; ``counts`` the rows per group and first
    ``digits[0]`` digits. The bucket that holds a cut is cut by more digits, level by
    level, so that the keys which are sorted in the end are few however the keys lie.
    Copies of one key count as often as they occur. A cut that falls between copies
    is an error, unless ``keep_copies`` says that all of them go before it.
    """
    # One row per cut, and the caller lists the cuts: small by construction.
    edges = bounds.select(*by, "cut", F.lit("").alias("near"), F.col("upto").alias("need"))
    known = 0
    for more in digits:
        if known:
            places = edges.select(*by, "near").distinct()
            counts = (
                df.select(*by, _bucket(key, known).alias("near"), _bucket(key, more).alias("bucket"))
                .join(F.broadcast(places), [*by, "near"])
                .groupBy(*by, "near", "bucket")
                .agg(F.count("*").alias("n"))
            )
        else:
            counts = counts.select(*by, F.lit("").alias("near"), "bucket", "n")
        across = Window.partitionBy(*by, "near").orderBy("bucket")
        spans = counts.withColumn("last", _running("n", across))
        edges = (
            spans.join(F.broadcast(edges), [*by, "near"])
            .where((F.col("need") <= F.col("last")) & (F.col("need") > F.col("last") - F.col("n")))
            .select(*by, "cut", F.col("bucket").alias("near"), (F.col("need") - F.col("last") + F.col("n")).alias("need"))
        )
        known = more
    near = (
        df.select(*by, F.col(key).alias("key"), _bucket(key, known).alias("near"))
        .join(F.broadcast(edges), [*by, "near"])
        .groupBy(*by, "cut", "need", "key")
        .agg(F.count("*").alias("copies"))
    )
    inside = Window.partitionBy(*by, "cut").orderBy("key")
    reached = near.withColumn("seen", _running("copies", inside)).where("seen >= need")
    first = reached.groupBy(*by, "cut").agg(F.min(F.struct("key", "seen", "need")).alias("at"))
    cut_key = F.col("at.key")
    if not keep_copies:
        message = F.concat(F.lit("a cut falls between copies of "), cut_key.cast("string"))
        cut_key = F.when(F.col("at.seen") > F.col("at.need"), F.raise_error(message)).otherwise(cut_key)
    return first.select(*by, "cut", cut_key.alias("cut_key"))


def slices(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    names: Sequence[str],
    bounds: Callable[[DataFrame], DataFrame],
    name: str = "split",
    keep_copies: bool = False,
    rows: DataFrame | None = None,
    digits: Sequence[int] = CUT_LEVELS,
) -> DataFrame:
    """Label the rows of each group by consecutive slices of its order.

    ``bounds`` maps the group sizes (group columns, ``n``) to the group columns
    plus one column per slice name that holds the position where the slice
    ends. Rows past the last slice are dropped. The number of groups must be
    small and known to the caller (rotations, generators, listed categories),
    as their cut keys are broadcast.

    ``df`` is read once for each level of ``digits`` and once more for the keys at the
    cuts, with only the group columns and the key, and then for its rows.
    With ``rows`` the third reading is of that table: its rows are labelled by the
    order of the keys in ``df``.
    """
    by = list(by)
    counts = bucket_counts(df, by, key, _bucket(key, digits[0]))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    ends = bounds(sizes).select(*by, *names)
    cuts = ends.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(n).alias("cut"), F.col(n).alias("upto")) for n in names])),
    )
    found = cut_keys(df, by, key, cuts, counts, keep_copies, digits)
    # Cut columns by name; a slice that ends at position 0 has no cut key.
    wide = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("cut") == n, F.col("cut_key"))).alias(f"_end_{n}") for n in names]
    )
    label = F.coalesce(*[F.when(F.col(key) <= F.col(f"_end_{n}"), F.lit(n)) for n in names])
    return (
        (df if rows is None else rows)
        .join(F.broadcast(wide), by)
        .withColumn(name, label)
        .where(F.col(name).isNotNull())
        .drop(*[f"_end_{n}" for n in names])
    )


def integer_key(column: str) -> Column:
    """An integer as 16 hexadecimal digits in the same order, negative ones first."""
    least = F.lit(-(1 << 63)).cast("bigint")
    return F.lpad(F.hex(F.col(column).cast("bigint").bitwiseXOR(least)), 16, "0")
