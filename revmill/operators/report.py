"""Tables over many runs."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revmill.operators.losses import variants_array
from revmill.operators.splits import rotations
from revmill.schema import GENERATORS, MODELS, TEST_SPLITS, VARIANTS


def variants(spark) -> DataFrame:
    """The model variants and their loss weights."""
    return spark.range(1).select(F.inline(variants_array()))


def variant_weights(meta: DataFrame) -> DataFrame:
    """Every variant × rotation with its loss weights and the rows it trains on."""
    return (
        meta.select("rotation", "held_out", "n_train")
        .withColumn("v", F.explode(variants_array()))
        .select(
            F.col("v.name").alias("variant"),
            "rotation",
            "held_out",
            F.col("v.losses.ce").alias("ce"),
            F.col("v.losses.contrastive").alias("contrastive"),
            F.col("v.losses.adversarial").alias("adversarial"),
            "n_train",
        )
    )


def best_step(history: DataFrame, run: str = "run") -> DataFrame:
    """The earliest step with the highest validation F1 of each run."""
    best = F.min(F.struct((-F.col("f1")).alias("loss"), "step")).alias("best")
    return history.groupBy(run).agg(best).select(
        run, F.col("best.step").alias("step"), (-F.col("best.loss")).alias("f1")
    )


def strict_avg(column: str) -> Column:
    """The mean, or null if any input is null."""
    return F.when(F.count(column) == F.count("*"), F.avg(column))


def rotation_average(metrics: DataFrame) -> DataFrame:
    """Mean f1 and auc of each model and split over the rotations at hand."""
    return (
        metrics.groupBy("model", "split")
        .agg(strict_avg("f1").alias("f1"), strict_avg("auc").alias("auc"), F.count("*").alias("rotations"))
    )


def _model_table(spark) -> DataFrame:
    rows = [(i, run, name) for i, (run, name) in enumerate(MODELS)]
    return spark.createDataFrame(rows, "position int, run string, name string")


def comparison(metrics: DataFrame) -> DataFrame:
    """One row per scored model: f1 and auc, in-distribution and cross-generator."""
    average = rotation_average(metrics.where(F.col("split").isin(TEST_SPLITS)))
    wide = average.groupBy("model").pivot("split", TEST_SPLITS).agg(
        F.first("f1").alias("f1"), F.first("auc").alias("auc")
    )
    order = _model_table(metrics.sparkSession)
    # One row per model; those that are not listed come after the others, by name.
    joined = wide.join(F.broadcast(order), F.col("model") == F.col("run"), "left")
    listed = F.col("position").isNotNull()
    after = F.row_number().over(Window.partitionBy(listed).orderBy("model")) + (len(MODELS) - 1)
    return joined.select(
        F.coalesce("position", after).alias("position"),
        F.coalesce("name", "model").alias("model"),
        F.col("test_indist_f1").alias("f1_indist"),
        F.col("test_crossgen_f1").alias("f1_crossgen"),
        F.col("test_indist_auc").alias("auc_indist"),
        F.col("test_crossgen_auc").alias("auc_crossgen"),
    )


def heldout(metrics: DataFrame, generators: Sequence[str] = GENERATORS) -> DataFrame:
    """Cross-generator f1 of each variant by held-out generator; missing is null."""
    spark = metrics.sparkSession
    cross = metrics.where(F.col("split") == "test_crossgen").select("model", "rotation", "f1")
    # The variants and the rotations are listed, so both tables are tiny.
    grid = variants(spark).select(F.col("name").alias("variant")).withColumn(
        "rotation", F.explode(F.array(*[F.lit(r) for r in range(len(generators))]))
    )
    grid = grid.join(F.broadcast(rotations(spark, generators)), "rotation")
    found = grid.join(
        cross.withColumnRenamed("model", "variant"), ["variant", "rotation"], "left"
    )
    return found.groupBy("variant").pivot("held_out", list(generators)).agg(F.first("f1"))


def gap(comparison: DataFrame) -> DataFrame:
    """In-distribution beside cross-generator f1, and their difference."""
    return comparison.select(
        "position",
        "model",
        "f1_indist",
        "f1_crossgen",
        (F.col("f1_indist") - F.col("f1_crossgen")).alias("gap"),
    )


def pending_runs(done: DataFrame, generators: Sequence[str] = GENERATORS) -> DataFrame:
    """Variant × rotation pairs that ``done`` (model, rotation) does not list."""
    runs = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.lit(r).alias("rotation"))
            for name, *_ in VARIANTS
            for r in range(len(generators))
        ]
    )
    grid = done.sparkSession.range(1).select(F.inline(runs))
    return grid.join(done.select("model", "rotation").distinct(), ["model", "rotation"], "left_anti")
