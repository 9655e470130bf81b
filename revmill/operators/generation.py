"""The tables around text generation: requests out, responses in."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revmill.functions.order import order_key, uniform
from revmill.functions.text import word_count
from revmill.operators.filters import as_generated, generated_key
from revmill.operators.pool import dedup, take_first
from revmill.schema import (
    DEFAULT_STARS,
    DEFAULT_TITLE,
    GENERATORS,
    LENGTH_MU,
    LENGTH_SIGMA,
    PROMPT_TEMPLATE,
    SEED,
    TOKENS_PER_WORD,
)
from revmill.session import stored

CELLS = 1024


def seed_products(human: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n products drawn without replacement, each shown by its first review.

    Reviews without a product count as one product. Fewer than n is an error.
    The products are drawn before their reviews are grouped, so only reviews of
    drawn products are shuffled, and those without their text.
    """
    shown = human.select("parent_asin", "category", "rating", "title", "review_id")
    products = human.select("parent_asin").distinct()
    drawn = take_first(products, n, "parent_asin", seed, rows=shown)
    return dedup(drawn, "parent_asin", order_key(seed, "review_id"))


def length_bins(human: DataFrame) -> DataFrame:
    """The word counts of the pool as bins ``[start, stop)`` of row positions."""
    counts = human.groupBy(word_count("text").alias("wc")).agg(F.count("*").alias("n"))
    # An unpartitioned window, over one row per length that occurs.
    stop = F.sum("n").over(Window.orderBy("wc").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("wc", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def draw_length(
    df: DataFrame, bins: DataFrame, key: str = "parent_asin", seed: int = SEED
) -> DataFrame:
    """A target length per row, drawn with replacement from the pool's lengths.

    A hash uniform picks a position among the pool's rows and the bin that holds
    the position gives the length. Bins are joined by cell of the position range,
    so a row meets the one or two bins of its cell and not all of them. A pool without
    rows has no lengths, and the lognormal draw takes their place.
    """
    bins = stored(bins, "bins")
    total = bins.agg(F.max("stop")).first()[0] or 0
    cell = lambda at: F.expr(f"({at}) * {CELLS} div {max(total, 1)}")
    table = bins.select(
        F.explode(F.sequence(cell("start"), cell("stop - 1"))).alias("_cell"),
        F.col("wc").alias("_wc"),
        F.col("start").alias("_start"),
        F.col("stop").alias("_stop"),
    )
    drawn = uniform(F.lit(seed), F.lit("length"), F.col(key))
    rows = df.withColumn("_at", F.floor(drawn * float(total))).withColumn("_own", cell("_at"))
    here = (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_stop"))
    return (
        rows.join(table, (F.col("_own") == F.col("_cell")) & here, "left")
        .withColumn("target_wc", F.coalesce("_wc", lognormal(key, seed=seed)).cast("int"))
        .drop("_at", "_own", "_cell", "_wc", "_start", "_stop")
    )


def lognormal(
    key: str, mu: float = LENGTH_MU, sigma: float = LENGTH_SIGMA, seed: int = SEED
) -> Column:
    """A truncated lognormal length from the hash uniforms of a key."""
    u = F.lit(1.0) - uniform(F.lit(seed), F.lit("radius"), F.col(key))
    v = uniform(F.lit(seed), F.lit("angle"), F.col(key))
    normal = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)
    return F.exp(F.lit(mu) + F.lit(sigma) * normal).cast("int")


def draw_lognormal(
    df: DataFrame,
    key: str = "parent_asin",
    mu: float = LENGTH_MU,
    sigma: float = LENGTH_SIGMA,
    seed: int = SEED,
) -> DataFrame:
    """A target length per row from a truncated lognormal, for want of a pool."""
    return df.withColumn("target_wc", lognormal(key, mu, sigma, seed))


def stars(rating) -> Column:
    """Whole stars, half to even; a missing or zero rating counts as 5."""
    rating = F.col(rating) if isinstance(rating, str) else rating
    missing = rating.isNull() | F.isnan(rating) | (rating == 0)
    return F.when(missing, F.lit(DEFAULT_STARS)).otherwise(F.bround(rating, 0).cast("int"))


def prompt(title="title", category="category", rating="rating", target_wc="target_wc") -> Column:
    """The prompt of one product."""
    values = {
        "rating": stars(rating).cast("string"),
        "product_title": F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit(DEFAULT_TITLE)),
        "category": F.replace(F.col(category), F.lit("_"), F.lit(" ")),
        "target_word_count": F.col(target_wc).cast("string"),
    }
    # The template in pieces: text, {name}, text, ...
    parts = []
    for piece in PROMPT_TEMPLATE.split("{"):
        name, found, rest = piece.partition("}")
        parts += [values[name], F.lit(rest)] if found else [F.lit(piece)]
    return F.concat(*parts)


def token_budget(target_wc) -> Column:
    """How many tokens a response may have."""
    return (F.col(target_wc) * F.lit(TOKENS_PER_WORD)).cast("int")


def messages(text="prompt") -> Column:
    """The prompt as a chat of one user message."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))


def requests(
    human: DataFrame, n: int, generators: Sequence[str] = GENERATORS, seed: int = SEED
) -> DataFrame:
    """One request per generator and product.

    All generators see the same products with the same target lengths.
    """
    drawn = draw_length(seed_products(human, n, seed), length_bins(human), seed=seed)
    each = drawn.withColumn("generator", F.explode(F.array(*[F.lit(g) for g in generators])))
    return each.select(
        generated_key(F.col("generator"), F.col("parent_asin"), seed).alias("request_id"),
        "generator",
        "parent_asin",
        "category",
        "rating",
        "title",
        "target_wc",
        prompt().alias("prompt"),
        token_budget("target_wc").alias("max_tokens"),
    )


def ingest(requests: DataFrame, responses: DataFrame, seed: int = SEED) -> DataFrame:
    """Reviews from the responses that came back without an error."""
    good = responses.where(F.col("error").isNull()).select("request_id", "text")
    return as_generated(requests.join(good, "request_id"), seed)


def pending(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests that have no good response yet."""
    good = responses.where(F.col("error").isNull()).select("request_id")
    return requests.join(good, "request_id", "left_anti")
