"""Exact classification metrics per group of a scored table.

A scored table has ``label`` (0 or 1), ``p`` and the group columns. Rows are
first combined to one row per distinct score. The running totals that an exact
AUC needs are taken over score ranges: the distinct scores are placed by range,
summed inside each range, and the ranges are put together at the end, so that a
group of any size is spread over all tasks and ties stay whole.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revmill.schema import HUMAN, THRESHOLD


def predict(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``pred`` is 1 where ``p`` reaches the threshold."""
    return df.withColumn("pred", (F.col("p") >= threshold).cast("int"))


def confusion(df: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """tp, fp, fn, tn per group."""
    called, true = F.col("p") >= threshold, F.col("label") == 1
    return df.groupBy(*by).agg(
        F.count_if(called & true).alias("tp"),
        F.count_if(called & ~true).alias("fp"),
        F.count_if(~called & true).alias("fn"),
        F.count_if(~called & ~true).alias("tn"),
    )


def f1_of(tp="tp", fp="fp", fn="fn") -> Column:
    """2 tp / (2 tp + fp + fn), and 0 where that is undefined."""
    twice = 2 * F.col(tp)
    return F.coalesce(F.try_divide(twice, twice + F.col(fp) + F.col(fn)), F.lit(0.0))


def f1(df: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """F1 of class 1 per group."""
    return confusion(df, by, threshold).select(*by, f1_of().alias("f1"))


def _by_score(df: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    """Positives and negatives per distinct score, placed by score range."""
    return (
        df.groupBy(*by, "p", *more)
        .agg(
            F.count_if(F.col("label") == 1).cast("double").alias("pos"),
            F.count_if(F.col("label") != 1).cast("double").alias("neg"),
        )
        .repartitionByRange(*by, "p")
        .withColumn("range", F.spark_partition_id())
    )


def _running(column, window) -> Column:
    return F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, 0))


def _sums(threshold: float) -> list[Column]:
    called = F.col("p") >= threshold
    pos, neg = F.col("pos"), F.col("neg")
    return [
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.when(called, pos).otherwise(0.0)).alias("tp"),
        F.sum(F.when(called, neg).otherwise(0.0)).alias("fp"),
    ]


def _report(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """f1, auc and n from ``tp, fp, pos, neg`` and the area."""
    twice = 2 * F.col("tp")
    return totals.select(
        *by,
        F.coalesce(
            F.try_divide(twice, twice + F.col("fp") + F.col("pos") - F.col("tp")), F.lit(0.0)
        ).alias("f1"),
        F.try_divide(F.col("area"), F.col("pos") * F.col("neg")).alias("auc"),
        (F.col("pos") + F.col("neg")).cast("bigint").alias("n"),
    )


def metrics(df: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """f1, auc and n per group; auc is null for a group of one class."""
    by = list(by)
    inside = Window.partitionBy(*by, "range").orderBy("p")
    below = _running("neg", inside) - F.col("neg")
    ranges = (
        _by_score(df, by)
        .withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy(*by, "range")
        .agg(F.sum("wins").alias("wins"), *_sums(threshold))
    )
    # From here on one row per group and range.
    across = Window.partitionBy(*by).orderBy("range")
    before = _running("neg", across) - F.col("neg")
    totals = (
        ranges.withColumn("area", F.col("wins") + F.col("pos") * before)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in ("area", "tp", "fp", "pos", "neg")])
    )
    return _report(totals, by)


def auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half."""
    return metrics(df, by).select(*by, "auc")


def per_generator(df: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Metrics of each generator's rows together with all human rows of the group.

    No human row is copied. A generator's area is the pairs within it, the pairs
    within the humans (the same for all), and the pairs across, which are sums
    over the generator's own rows of the humans that score lower.
    """
    by = list(by)
    group = [*by, "generator"]
    is_human = F.col("generator") == HUMAN
    humans = lambda c: F.when(is_human, F.col(c)).otherwise(0.0)

    at_score = Window.partitionBy(*by, "range", "p")
    up_to = Window.partitionBy(*by, "range").orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*group, "range").orderBy("p")
    # Humans scoring lower within the range, ties half.
    lower = lambda c: F.sum(humans(c)).over(up_to) - F.sum(humans(c)).over(at_score) / 2
    placed = _by_score(df, by, "generator").select(
        "*",
        lower("pos").alias("human_pos"),
        lower("neg").alias("human_neg"),
        (_running("neg", own) - F.col("neg")).alias("own_neg"),
    )
    ranges = placed.groupBy(*group, "range").agg(
        F.sum(F.col("pos") * (F.col("own_neg") + F.col("neg") / 2)).alias("own"),
        F.sum(F.col("pos") * F.col("human_neg")).alias("won"),
        F.sum(F.col("neg") * F.col("human_pos")).alias("kept"),
        *_sums(threshold),
    )

    # From here on one row per group, generator and range.
    earlier = Window.partitionBy(*by).orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(F.sum(humans(c)).over(earlier), F.lit(0.0)) for c in ("pos", "neg")}
    across = Window.partitionBy(*group).orderBy("range")
    own_before = _running("neg", across) - F.col("neg")
    totals = (
        ranges.withColumn("own", F.col("own") + F.col("pos") * own_before)
        .withColumn("won", F.col("won") + F.col("pos") * before["neg"])
        .withColumn("kept", F.col("kept") + F.col("neg") * before["pos"])
        .groupBy(*group)
        .agg(*[F.sum(c).alias(c) for c in ("own", "won", "kept", "tp", "fp", "pos", "neg")])
    )

    # From here on one row per group and generator.
    everyone = Window.partitionBy(*by)
    human_sum = {
        c: F.coalesce(F.sum(humans(c)).over(everyone), F.lit(0.0))
        for c in ("own", "tp", "fp", "pos", "neg")
    }
    joined = totals.select(
        *group,
        *[c for c in ("own", "won", "kept", "tp", "fp", "pos", "neg")],
        *[value.alias(f"h_{c}") for c, value in human_sum.items()],
    )
    plus = lambda c: F.when(is_human, F.col(c)).otherwise(F.col(c) + F.col(f"h_{c}"))
    # A human positive beats a generator's negative unless that scores higher.
    across_pairs = F.col("won") + F.col("neg") * F.col("h_pos") - F.col("kept")
    area = F.when(is_human, F.col("own")).otherwise(F.col("own") + F.col("h_own") + across_pairs)
    return _report(
        joined.select(*group, area.alias("area"), *[plus(c).alias(c) for c in ("tp", "fp", "pos", "neg")]),
        group,
    )
