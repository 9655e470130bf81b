"""The given tables in the shapes that the operators read.

Everything here is derived by Spark from all rows of a given table.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmill.functions.order import hash_u32
from revmill.operators.features import embed
from revmill.operators.pool import filter_pool
from revmill.operators.splits import logo_splits
from revmill.schema import HUMAN, MODELS, REVIEW, TEST_SPLITS, VARIANTS
from revmill.session import stored

STEPS = [200, 400, 600, 800, 1000]
RAW_SQL = """
    SELECT doc_id, lang AS category,
           CASE WHEN doc_id % 29 = 0 THEN NULL
                WHEN doc_id % 31 = 0 THEN 0
                ELSE 1669766400000 + ((doc_id div 3) * 7919 % 1000 - 850) * 86400000
           END AS timestamp,
           text,
           CASE WHEN doc_id % 37 <> 0
                THEN concat('u', cast((doc_id div 3) % 7 AS string)) END AS user_id,
           concat('P', cast(doc_id % 500 AS string)) AS parent_asin,
           cast(1 + doc_id % 5 AS double) AS rating,
           concat(source, ' ', cast(doc_id AS string)) AS title
    FROM {documents}
"""
REVIEWS_SQL = """
    SELECT concat('r', cast(doc_id AS string)) AS review_id,
           lang AS category,
           concat('P', cast(doc_id % 500 AS string)) AS parent_asin,
           cast(1 + doc_id % 5 AS double) AS rating,
           concat(source, ' ', cast(doc_id AS string)) AS title,
           text,
           CASE WHEN k >= 16 OR doc_id % 29 = 0 THEN NULL
                ELSE 1669766400000 + ((doc_id * 7919) % 1000 - 850) * 86400000
           END AS timestamp,
           CASE WHEN k < 16 THEN 0 ELSE 1 END AS label,
           CASE WHEN k < 16 THEN 'human' WHEN k = 16 THEN 'gpt5mini'
                WHEN k = 17 THEN 'granite' WHEN k = 18 THEN 'gemma'
                ELSE 'qwen' END AS generator
    FROM (SELECT *, cast(substr(source, 4) AS int) AS k FROM {documents}) s
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw reviews with ``category`` and ``doc_id``; three
    consecutive documents of one language are copies of a review id."""
    return spark.sql(RAW_SQL, documents=table(spark, sf_dir, "documents"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the review schema."""
    return spark.sql(REVIEWS_SQL, documents=table(spark, sf_dir, "documents"))


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The human pool: early reviews of 20 to 400 words."""
    return filter_pool(reviews(spark, sf_dir).where(F.col("generator") == HUMAN))


def ai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated reviews; never filtered."""
    return reviews(spark, sf_dir).where(F.col("generator") != HUMAN)


def stored_human(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the human pool from storage: its texts are filtered once."""
    return stored(human(spark, sf_dir).select(*columns), "human")


def quarter():
    """A quarter of the human pool, as small tables have fewer than 2,500 humans."""
    return F.expr("humans div 4")


#: What is known of a review without its text.
BRIEF = ["review_id", "category", "parent_asin", "rating", "label", "generator"]


def splits(spark: SparkSession, sf_dir: str, columns: Sequence[str] = BRIEF) -> DataFrame:
    """All splits of all rotations, with these columns of the reviews."""
    generated = ai(spark, sf_dir).select(*columns)
    return logo_splits(stored_human(spark, sf_dir, *columns), generated, quarter())


def whole_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits with all columns of the reviews, texts too."""
    return splits(spark, sf_dir, REVIEW.names)


def _with_p(df: DataFrame, *parts: str) -> DataFrame:
    """``p`` from a hash of the parts, shifted by the label; three decimals, so
    that ties occur."""
    u = hash_u32(*[F.col(c) for c in parts])
    thousandths = F.floor(u * 700 / F.lit(4294967296.0)) + 300 * F.col("label")
    return df.withColumn("p", thousandths / F.lit(1000.0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every test row by every model; one run (both, 3) is missing."""
    tests = splits(spark, sf_dir).where(F.col("split").isin(TEST_SPLITS))
    each = tests.select(
        F.explode(F.array(*[F.lit(run) for run, _ in MODELS])).alias("model"),
        "rotation",
        "split",
        "review_id",
        "generator",
        "label",
    ).where(~((F.col("model") == "both") & (F.col("rotation") == 3)))
    return _with_p(each, "model", "rotation", "review_id")


def validation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every validation row by every variant at five steps."""
    rows = splits(spark, sf_dir).where(F.col("split") == "val_indist")
    each = rows.select(
        F.explode(F.array(*[F.lit(v[0]) for v in VARIANTS])).alias("model"),
        "rotation",
        "review_id",
        "label",
    ).select(
        F.concat_ws("_", "model", F.col("rotation").cast("string")).alias("run"),
        F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("step"),
        "review_id",
        "label",
    )
    return _with_p(each, "run", "step", "review_id")


def _folded(vector: str, n: int):
    """n numbers from a whole vector: number k sums the components k, k + n, k + 2n, ..."""
    part = lambda k: F.filter(vector, lambda x, i: i % n == k)
    total = lambda k: F.aggregate(part(k), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[total(k) for k in range(n)])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with a class, a generator id, logits and token places."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        "embedding",
        (F.col("label") >= 5).cast("int").alias("label"),
        (F.col("label") % 4).alias("gen_label"),
        _folded("embedding", 2).alias("cls_logits"),
        _folded("embedding", 4).alias("gen_logits"),
        F.floor(F.col("vec_id") / 8).alias("doc"),
        (F.col("label") != 0).cast("int").alias("mask"),
    )


def embedded(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Review rows with their stored vector, null where there is none."""
    stored_vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("review_id"), "embedding"
    )
    return embed(rows, stored_vectors, "review_id")


def responses(requests: DataFrame) -> DataFrame:
    """One response per request: some failed, texts with outer whitespace."""
    place = hash_u32(F.col("request_id")) % 13
    return requests.select(
        "request_id",
        F.when(place != 0, F.concat(F.lit(" \n "), F.col("prompt"), F.lit("\t "))).alias("text"),
        F.when(place == 0, F.lit("timeout")).alias("error"),
    )
