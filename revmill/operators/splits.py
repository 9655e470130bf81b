"""Leave-one-generator-out splits.

All rotations are one plan. A row's place depends on its rank in a hash order,
and the ranks matter only at a few cuts per rotation and generator, so the rows
are labelled by comparing with cut keys (see ``ranking``): no text is shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revmill.functions.order import order_key
from revmill.operators.pool import shuffle
from revmill.operators.ranking import slices
from revmill.schema import GENERATORS, HUMAN, RESERVE, SEED, SPLITS


def rotations(spark: SparkSession, generators: Sequence[str] = GENERATORS) -> DataFrame:
    """One row per rotation: the generator held out and those trained on."""
    rows = [
        (r, held_out, ",".join(g for g in generators if g != held_out))
        for r, held_out in enumerate(generators)
    ]
    return spark.createDataFrame(rows, "rotation int, held_out string, train_gens string")


def _size(reserve: int | Column) -> Column:
    return reserve if isinstance(reserve, Column) else F.lit(reserve)


def _held_out(generators: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(g) for g in generators]), F.col("rotation"))


def each_rotation(df: DataFrame, generators: Sequence[str] = GENERATORS) -> DataFrame:
    """Every row once per rotation, inside its task."""
    return df.withColumn("rotation", F.explode(F.array(*[F.lit(r) for r in range(len(generators))])))


def _keyed(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("_order", order_key(F.col("rotation") + F.lit(seed), "review_id"))


def reserve_human(
    human: DataFrame,
    reserve: int | Column = RESERVE,
    seed: int = SEED,
    generators: Sequence[str] = GENERATORS,
) -> DataFrame:
    """Per rotation, which humans are kept back for the cross-generator test
    (``part`` = reserve) and which may be trained on (``part`` = pool).

    ``reserve`` is a number of rows, or a column over ``humans``, the pool size.
    """

    def ends(sizes: DataFrame) -> DataFrame:
        humans = sizes.withColumnRenamed("n", "humans")
        return humans.select(
            "rotation",
            F.least("humans", _size(reserve)).alias("reserve"),
            F.col("humans").alias("pool"),
        )

    rows = _keyed(each_rotation(human, generators), seed)
    return slices(rows, ["rotation"], "_order", ["reserve", "pool"], ends, "part").drop("_order")


def split_indist(
    df: DataFrame, by: Sequence[str] = ("rotation", "generator"), seed: int = SEED
) -> DataFrame:
    """80/10/10 train, val and test of each group; test takes the remainder."""

    def ends(sizes: DataFrame) -> DataFrame:
        return sizes.selectExpr(
            *by,
            "n * 8 div 10 AS train",
            "n * 8 div 10 + n div 10 AS val_indist",
            "n AS test_indist",
        )

    rows = _keyed(df, seed)
    return slices(rows, by, "_order", SPLITS[:3], ends).drop("_order")


def _need(
    sizes: DataFrame, generators: Sequence[str], reserve: int | Column
) -> DataFrame:
    """Per rotation: rows each in-distribution split needs from the humans."""
    ai = F.col("generator") != HUMAN
    trained = ai & (F.col("generator") != _held_out(generators))
    n = F.col("n")
    total = lambda value, keep: F.coalesce(F.sum(F.when(keep, value)), F.lit(0))
    sums = sizes.groupBy("rotation").agg(
        total(F.expr("n * 8 div 10"), trained).alias("need_train"),
        total(F.expr("n div 10"), trained).alias("need_val"),
        total(n, trained).alias("need"),
        total(n, ~ai).alias("humans"),
    )
    return sums.withColumn("kept", F.least("humans", _size(reserve)))


def balance_check(
    human: DataFrame,
    ai: DataFrame,
    reserve: int | Column = RESERVE,
    generators: Sequence[str] = GENERATORS,
) -> DataFrame:
    """Per rotation: humans needed, humans at hand, and by how many they fall short."""
    rows = human.select("generator").unionByName(ai.select("generator"))
    sizes = rows.groupBy("generator").agg(F.count("*").alias("n"))
    return _need(each_rotation(sizes, generators), generators, reserve).select(
        "rotation",
        "need",
        (F.col("humans") - F.col("kept")).alias("pool"),
        F.greatest(F.col("need") - F.col("humans") + F.col("kept"), F.lit(0)).alias("shortfall"),
    )


def _bounds(
    sizes: DataFrame, generators: Sequence[str], reserve: int | Column
) -> DataFrame:
    """Where the four splits of every (rotation, generator) end in hash order."""
    need = _need(sizes, generators, reserve)
    short = F.col("need") > F.col("humans") - F.col("kept")
    message = F.concat(
        F.lit("not enough human reviews to balance rotation "),
        F.col("rotation").cast("string"),
        F.lit(": short by "),
        (F.col("need") - F.col("humans") + F.col("kept")).cast("string"),
    )
    kept = F.when(short, F.raise_error(message).cast("bigint")).otherwise(F.col("kept"))
    need = need.withColumn("kept", kept)
    human = F.col("generator") == HUMAN
    held = F.col("generator") == _held_out(generators)
    n = F.col("n")
    cross = F.when(human, F.col("kept")).when(held, n).otherwise(F.lit(0))
    train = F.when(human, F.col("need_train")).when(held, F.lit(0)).otherwise(F.expr("n * 8 div 10"))
    val = F.when(human, F.col("need_val")).when(held, F.lit(0)).otherwise(F.expr("n div 10"))
    every = F.when(human, F.col("kept") + F.col("need")).otherwise(n)
    # One row per rotation and listed generator on both sides.
    return sizes.join(need, "rotation").select(
        "rotation",
        "generator",
        cross.alias("test_crossgen"),
        (cross + train).alias("train"),
        (cross + train + val).alias("val_indist"),
        every.alias("test_indist"),
    )


def logo_splits(
    human: DataFrame,
    ai: DataFrame,
    reserve: int | Column = RESERVE,
    seed: int = SEED,
    generators: Sequence[str] = GENERATORS,
    rotation: int | None = None,
) -> DataFrame:
    """All splits of all rotations (or of one), with ``rotation`` and ``split``.

    Per rotation the held-out generator and the reserved humans are the
    cross-generator test; every other generator is split 80/10/10 and matched
    1:1 by humans from the rest. Too few humans is an error. ``reserve`` is a number
    of rows, or a column over ``humans``, the pool size.

    The plan reads its inputs three times, twice with only ``review_id`` and
    ``generator``: pass stored tables rather than costly derivations.
    """
    rows = human.where(F.col("generator") == HUMAN).unionByName(
        ai.where(F.col("generator").isin(list(generators)))
    )
    rows = each_rotation(rows, generators)
    if rotation is not None:
        rows = rows.where(F.col("rotation") == rotation)
    order = ["test_crossgen", "train", "val_indist", "test_indist"]
    return slices(
        _keyed(rows, seed),
        ["rotation", "generator"],
        "_order",
        order,
        lambda sizes: _bounds(sizes, generators, reserve),
    ).drop("_order")


def balance(
    human: DataFrame,
    ai: DataFrame,
    reserve: int | Column = RESERVE,
    seed: int = SEED,
    generators: Sequence[str] = GENERATORS,
) -> DataFrame:
    """The humans matched to each in-distribution split of each rotation."""
    splits = logo_splits(human, ai, reserve, seed, generators)
    return splits.where((F.col("generator") == HUMAN) & (F.col("split") != "test_crossgen"))


def combine(*sides: DataFrame, seed: int = SEED) -> DataFrame:
    """The sides together, in shuffled order."""
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    return shuffle(rows, seed=seed)


def rotation_meta(splits: DataFrame, generators: Sequence[str] = GENERATORS) -> DataFrame:
    """Split sizes per rotation."""
    size = lambda split: F.count_if(F.col("split") == split)
    counts = splits.groupBy("rotation").agg(
        size("train").alias("n_train"),
        size("val_indist").alias("n_val"),
        size("test_indist").alias("n_test_indist"),
        size("test_crossgen").alias("n_test_crossgen"),
    )
    table = rotations(splits.sparkSession, generators)
    return counts.join(F.broadcast(table), "rotation").select(
        "rotation",
        "held_out",
        "train_gens",
        "n_train",
        "n_val",
        "n_test_indist",
        "n_test_crossgen",
    )


def leakage(
    splits: DataFrame,
    keys: Sequence[str] = ("review_id",),
    left: str = "train",
    right: str = "test_crossgen",
) -> DataFrame:
    """Per key column and rotation, how many values occur in both splits.

    One aggregate, combined before its shuffle, stands for the semi joins: a value
    that a third of the rows share costs one row per task.
    """
    each = F.explode(
        F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])
    )
    values = (
        splits.where(F.col("split").isin(left, right))
        .select("rotation", "split", each.alias("k"))
        .groupBy("rotation", "k.key", "k.value")
        .agg(
            F.bool_or(F.col("split") == left).alias("in_left"),
            F.bool_or(F.col("split") == right).alias("in_right"),
        )
    )
    both = F.col("value").isNotNull() & F.col("in_left") & F.col("in_right")
    return values.groupBy("key", "rotation").agg(F.count_if(both).alias("shared"))


def assert_no_leakage(splits: DataFrame) -> None:
    """Raise if train and cross-generator test of a rotation share a review."""
    shared = {r["rotation"]: r["shared"] for r in leakage(splits).collect() if r["shared"]}
    if shared:
        raise ValueError(f"train and cross-generator test share reviews: {shared}")
