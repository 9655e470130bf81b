"""Row filters and projections to the review schema."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmill.functions.text import review_key, strip, text_default, word_count
from revmill.schema import CUTOFF_MS, HUMAN, MAX_WORDS, MIN_WORDS, REVIEW, SEED


def before_cutoff(df: DataFrame, cutoff_ms: int = CUTOFF_MS) -> DataFrame:
    """Rows with a timestamp strictly before the cutoff; null and 0 go."""
    return df.where((F.col("timestamp") != 0) & (F.col("timestamp") < cutoff_ms))


def word_band(df: DataFrame, lo: int = MIN_WORDS, hi: int = MAX_WORDS) -> DataFrame:
    """Rows of lo to hi words, both included.

    ``lo`` words need ``2 * lo - 1`` characters, so a length test drops short
    texts before the regex sees them.
    """
    long_enough = F.length(text_default("text")) >= max(2 * lo - 1, 0)
    return df.where(long_enough & in_band(word_count("text"), lo, hi))


def in_band(n: Column, lo: int, hi: int) -> Column:
    """lo <= n <= hi as one mention of n; ``between`` would count words twice."""
    return F.width_bucket(n, F.lit(lo), F.lit(hi + 1), F.lit(1)) == 1


def as_human(raw: DataFrame, *keep: str) -> DataFrame:
    """Raw reviews (with ``category``) in the review schema, and columns to keep."""
    return raw.select(
        review_key("category", "user_id", "timestamp").alias("review_id"),
        "category",
        "parent_asin",
        "rating",
        "title",
        text_default("text").alias("text"),
        "timestamp",
        F.lit(0).alias("label"),
        F.lit(HUMAN).alias("generator"),
        *keep,
    )


def generated_key(generator, parent_asin, seed: int = SEED):
    """``generator_asin_seed``, the id of a request and of its review."""
    return F.concat_ws(
        "_", generator, F.coalesce(parent_asin, F.lit("None")), F.lit(str(seed))
    )


def as_generated(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows with ``generator`` and product columns in the review schema."""
    return df.select(
        generated_key(F.col("generator"), F.col("parent_asin"), seed).alias("review_id"),
        "category",
        "parent_asin",
        "rating",
        "title",
        strip(text_default("text")).alias("text"),
        F.lit(None).cast("bigint").alias("timestamp"),
        F.lit(1).alias("label"),
        "generator",
    )


def feature_columns(df: DataFrame) -> DataFrame:
    """The model inputs: text that is never null, integer label."""
    return df.select(
        "review_id", text_default("text").alias("text"), F.col("label").cast("int").alias("label")
    )


def conform(df: DataFrame) -> DataFrame:
    """The review columns in order, each with its declared type."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in REVIEW])
