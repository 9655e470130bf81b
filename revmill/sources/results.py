"""Reading and writing metric files and the summary table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revmill.schema import TEST_SPLITS

_ENTRY = "struct<f1:double,auc:double,n:bigint>"
_RUN = "struct<{}>".format(
    ",".join(
        field
        for split in TEST_SPLITS
        for field in (f"{split}:{_ENTRY}", f"{split}_per_generator:map<string,{_ENTRY}>")
    )
)


def _entries(items: Column) -> Column:
    return F.map_from_entries(F.collect_list(items))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as one nested JSON document:
    ``{model: {rotation_r: {split: {f1, auc, n}, split_per_generator: {g: {...}}}}}``.

    A missing AUC is written as the literal NaN. The table has one row per
    model, rotation, split and generator, so one document holds it. A split that is
    none of the tests is an error.
    """
    known = F.col("split").isin(TEST_SPLITS)
    other = F.raise_error(F.concat(F.lit("no test split: "), F.coalesce("split", F.lit("null"))))
    metrics = metrics.withColumn("split", F.when(known, F.col("split")).otherwise(other))
    entry = F.struct("f1", F.coalesce("auc", F.lit(float("nan"))).alias("auc"), "n")
    whole = F.col("generator").isNull()
    fields = []
    for split in TEST_SPLITS:
        here = F.col("split") == split
        fields.append(F.max(F.when(here & whole, entry)).alias(split))
        fields.append(
            _entries(F.when(here & ~whole, F.struct("generator", entry))).alias(
                f"{split}_per_generator"
            )
        )
    runs = metrics.groupBy("model", "rotation").agg(F.struct(*fields).alias("run"))
    models = runs.groupBy("model").agg(
        _entries(F.struct(F.concat(F.lit("rotation_"), "rotation").alias("key"), "run")).alias("runs")
    )
    document = models.agg(F.to_json(_entries(F.struct("model", "runs"))).alias("value"))
    document.select(F.regexp_replace("value", '"NaN"', "NaN").alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_metrics(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The long metric table of a metrics file; NaN becomes NULL.

    Give ``model`` for a file that starts at the rotations.
    """
    text = spark.read.text(path, wholetext=True)
    if model is None:
        parsed = F.from_json("value", f"map<string,map<string,{_RUN}>>")
        runs = text.select(F.explode(parsed).alias("model", "runs"))
    else:
        parsed = F.from_json("value", f"map<string,{_RUN}>")
        runs = text.select(F.lit(model).alias("model"), parsed.alias("runs"))
    runs = runs.select("model", F.explode("runs").alias("key", "run")).select(
        "model", F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("rotation"), "run"
    )
    # Every split contributes its own entry (no generator) and its groups.
    groups = [
        F.struct(
            F.lit(split).alias("split"),
            F.concat(
                F.array(
                    F.struct(F.lit(None).cast("string").alias("key"), F.col(f"run.{split}").alias("value"))
                ),
                F.coalesce(
                    F.map_entries(f"run.{split}_per_generator"),
                    F.array().cast(f"array<struct<key:string,value:{_ENTRY}>>"),
                ),
            ).alias("entries"),
        )
        for split in TEST_SPLITS
    ]
    return (
        runs.select("model", "rotation", F.inline(F.array(*groups)))
        .select("model", "rotation", "split", F.inline("entries"))
        .where(F.col("value").isNotNull())
        .select(
            "model",
            "rotation",
            "split",
            F.col("key").alias("generator"),
            "value.f1",
            F.nanvl("value.auc", F.lit(None).cast("double")).alias("auc"),
            "value.n",
        )
    )


SUMMARY_COLUMNS = {
    "model": "Model",
    "f1_indist": "F1 in-dist",
    "f1_crossgen": "F1 cross-gen",
    "auc_indist": "AUC in-dist",
    "auc_crossgen": "AUC cross-gen",
}


def write_summary(comparison: DataFrame, path: str) -> None:
    """The comparison table as one CSV file with a header, in table order.

    One task is enough: the table has one row per listed model.
    """
    (
        comparison.repartition(1)
        .sortWithinPartitions("position")
        .select([F.col(c).alias(title) for c, title in SUMMARY_COLUMNS.items()])
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
