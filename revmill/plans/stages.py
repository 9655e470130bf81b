"""The whole run, stage by stage, from stored tables to stored tables."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmill.operators import generation, linear, pool, report, splits
from revmill.schema import CATEGORIES, GENERATORS, MODELS, POOL_SIZE, RESERVE, SEED
from revmill.sources import results, reviews


def build_pool(
    spark: SparkSession,
    raw_path: str,
    human_path: str,
    n: int = POOL_SIZE,
    seed: int = SEED,
    categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """Raw JSON lines to the stored human pool."""
    raw = reviews.scan_reviews_json(spark, raw_path)
    reviews.write_reviews(pool.build_human_pool(raw, categories, n, seed), human_path)
    return reviews.scan_reviews(spark, human_path)


def write_requests(
    spark: SparkSession,
    human_path: str,
    requests_path: str,
    n: int = RESERVE,
    generators: Sequence[str] = GENERATORS,
    seed: int = SEED,
) -> DataFrame:
    """The human pool to prompts for every generator."""
    human = reviews.scan_reviews(spark, human_path)
    generation.requests(human, n, generators, seed).write.mode("overwrite").parquet(requests_path)
    return spark.read.parquet(requests_path)


def write_generated(
    requests: DataFrame,
    responses: DataFrame,
    generated_dir: str,
    generators: Sequence[str] = GENERATORS,
    seed: int = SEED,
) -> DataFrame:
    """Good responses to the generator tables; returns the requests still open."""
    reviews.write_generated(generation.ingest(requests, responses, seed), generated_dir, generators)
    return generation.pending(requests, responses)


def build_splits(
    spark: SparkSession,
    human_path: str,
    generated_dir: str,
    splits_path: str,
    reserve: int = RESERVE,
    seed: int = SEED,
    generators: Sequence[str] = GENERATORS,
    rotation: int | None = None,
) -> DataFrame:
    """Stored tables to stored splits, checked for leakage; returns their sizes.

    With ``rotation`` that one is built and any others that are stored stay; else
    nothing of an earlier build remains. The sizes are stored beside the splits, in
    ``<splits_path>_meta``.
    """
    human, ai = reviews.load_all(spark, human_path, generated_dir, generators)
    rows = splits.logo_splits(human, ai, reserve, seed, generators, rotation)
    replaced = None if rotation is None else [rotation]
    reviews.write_splits(rows, splits_path, replaced)
    built = reviews.read_splits(spark, splits_path, replaced)
    splits.assert_no_leakage(built)
    meta_path = f"{splits_path.rstrip('/')}_meta"
    reviews.write_meta(splits.rotation_meta(built, generators), meta_path, replaced)
    meta = reviews.read_meta(spark, meta_path)
    return meta if rotation is None else meta.where(F.col("rotation") == rotation)


def run_baseline(
    spark: SparkSession,
    splits_path: str,
    metrics_path: str,
    model: str = MODELS[0][0],
    fit: Callable = linear.fit_tfidf_lr,
    rotations: Sequence[int] = range(len(GENERATORS)),
) -> DataFrame:
    """Stored splits to the metrics file of one baseline."""
    stored = reviews.read_splits(spark, splits_path)
    found = linear.rotation_metrics(stored, fit, model, rotations)
    results.write_metrics(found.withColumn("generator", F.lit(None).cast("string")), metrics_path)
    return results.read_metrics(spark, metrics_path)


def write_report(spark: SparkSession, metrics_paths: Sequence[str], summary_path: str) -> DataFrame:
    """Metrics files to the comparison table."""
    read = [results.read_metrics(spark, path) for path in metrics_paths]
    whole = reduce(DataFrame.unionByName, read).where(F.col("generator").isNull())
    table = report.comparison(whole)
    results.write_summary(table, summary_path)
    return table
