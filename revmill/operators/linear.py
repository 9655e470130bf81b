"""Linear baselines with Spark ML."""

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.functions.text import tokens, with_pairs
from revmill.operators.features import (
    Scale,
    encode_generator,
    label_map,
    most_frequent,
    scale_apply,
    scale_fit,
    term_counts,
    vectorizer,
)
from revmill.operators.metrics import metrics
from revmill.schema import GENERATORS, MAX_FEATURES, MIN_DF, TEST_SPLITS
from revmill.session import new_folder, stored


def fit_logistic(
    train: DataFrame, n: int, c: float, max_iter: int, family: str = "binomial"
) -> LogisticRegressionModel:
    """L2 logistic regression on ``features`` and ``label``.

    Spark averages the loss over rows, hence 1 / (C n) for a penalty of 1 / C on
    the sum. Features are taken as they are, and the intercept is not penalised.
    Give stored features: every iteration reads them. Gradients are added up in a
    tree, so that the driver receives few whatever the number of tasks. The tolerance is
    below Spark's own, at which small tables stop short of the optimum.
    """
    return LogisticRegression(
        family=family,
        maxIter=max_iter,
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-8,
        aggregationDepth=3,
    ).fit(train)


def score(model: LogisticRegressionModel, features: DataFrame) -> DataFrame:
    """Every row with ``p``, the probability of class 1."""
    return (
        model.transform(features)
        .withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
        .drop("features", "rawPrediction", "probability", "prediction")
    )


class TfidfLr(NamedTuple):
    """A fitted vocabulary with its weights, and the classifier on top."""

    vectorizer: CountVectorizerModel
    idf: DenseVector
    classifier: LogisticRegressionModel | None

    def features(self, df: DataFrame) -> DataFrame:
        """Unit-length sparse TF-IDF vectors, made row by row in the JVM and stored.

        The counts are damped as arrays: a stored vector column and a struct of the same
        fields are the same file.
        """
        listed = df.withColumn("w", tokens("text")).withColumn("terms", with_pairs(F.col("w")))
        counted = self.vectorizer.transform(listed.drop("w")).drop("terms", "text")
        fields = F.unwrap_udt("counts")
        damped = F.transform(fields["values"], lambda x: F.lit(1.0) + F.log(x))
        parts = [fields[c].alias(c) for c in ("type", "size", "indices")]
        rows = counted.withColumn("tf", F.struct(*parts, damped.alias("values"))).drop("counts")
        path = new_folder(df.sparkSession, "tfidf")
        rows.write.parquet(path)
        others = [f for f in rows.schema if f.name != "tf"]
        vectors = T.StructType([*others, T.StructField("tf", VectorUDT())])
        weighted = ElementwiseProduct(
            scalingVec=self.idf, inputCol="tf", outputCol="weighted"
        ).transform(df.sparkSession.read.schema(vectors).parquet(path))
        return (
            Normalizer(p=2.0, inputCol="weighted", outputCol="features")
            .transform(weighted)
            .drop("tf", "weighted")
        )

    def score(self, df: DataFrame) -> DataFrame:
        return score(self.classifier, self.features(df))


def fit_tfidf_lr(
    train: DataFrame,
    min_df: int = MIN_DF,
    max_features: int = MAX_FEATURES,
    c: float = 1.0,
    max_iter: int = 1000,
    counts: DataFrame | None = None,
) -> TfidfLr:
    """TF-IDF over words and word pairs, then logistic regression.

    The weights of the vocabulary, at most ``max_features`` terms, come to the driver.
    ``counts`` are the term counts of ``train`` if they are there already.
    """
    rows = train.select("text", F.col("label").cast("int").alias("label"))
    counts = term_counts(train, min_df=min_df) if counts is None else counts
    chosen = stored(most_frequent(counts, max_features).select("term", "idf"), "chosen")
    idf = [r["idf"] for r in chosen.orderBy("term").select("idf").collect()]
    model = TfidfLr(vectorizer(chosen), Vectors.dense(idf), None)
    features = model.features(rows)
    return model._replace(classifier=fit_logistic(features, train.count(), c, max_iter))


def shared_counts(splits: DataFrame, rotations: Sequence[int], min_df: int = MIN_DF) -> DataFrame:
    """Term counts of every rotation's training rows, from one pass over the texts they share."""
    return term_counts(splits.where(F.col("split") == "train"), "rotation", rotations, min_df)


def largest_gradient(classifier: LogisticRegressionModel, features: DataFrame, c: float = 1.0) -> float:
    """The largest component of the penalised mean loss's gradient, over all rows of ``features``.

    It is 0 at the optimum and nowhere else, as the loss is strictly convex: a
    certificate of the fit that does not ask how it was found. Entries are added up by
    class and column in Spark; what comes back is one number.
    """
    n = features.count()
    p = vector_to_array("probability")
    rows = classifier.transform(features).select("label", p.alias("p"), F.unwrap_udt("features").alias("f"))
    places = F.when(F.col("f.type") == 0, F.col("f.indices")).otherwise(F.sequence(F.lit(0), F.size("f.values") - 1))
    entries = F.arrays_zip(F.concat(places, F.array(F.lit(-1))), F.concat("f.values", F.array(F.lit(1.0))))
    # Binomial models have one row of coefficients, that of class 1; the column -1 is the intercept.
    binomial = classifier.coefficientMatrix.numRows == 1
    wanted = [1] if binomial else range(classifier.numClasses)
    miss = F.array(
        *[
            F.struct(F.lit(0 if binomial else k).alias("k"), (F.get("p", F.lit(k)) - (F.col("label") == k).cast("double")).alias("miss"))
            for k in wanted
        ]
    )
    sums = (
        rows.select(F.inline(miss), entries.alias("entries"))
        .select("k", "miss", F.inline("entries").alias("j", "x"))
        .groupBy("k", "j")
        .agg((F.sum(F.col("miss") * F.col("x")) / n).alias("g"))
    )
    matrix = classifier.coefficientMatrix.toArray().tolist()
    spark = features.sparkSession
    weights = spark.createDataFrame([(k, w) for k, w in enumerate(matrix)], "k int, w array<double>")
    weights = weights.select("k", F.posexplode("w").alias("j", "w"))
    whole = weights.join(sums, ["k", "j"], "full").select(
        F.abs(F.coalesce("g", F.lit(0.0)) + F.coalesce("w", F.lit(0.0)) / (c * n)).alias("g")
    )
    return whole.agg(F.max("g")).first()[0]


class EmbeddingLr(NamedTuple):
    """A fitted scaling and the classifier on top."""

    scale: Scale
    classifier: LogisticRegressionModel

    def features(self, df: DataFrame) -> DataFrame:
        scaled = scale_apply(df, self.scale)
        return scaled.withColumn("features", array_to_vector("embedding")).drop("embedding")

    def score(self, df: DataFrame) -> DataFrame:
        return score(self.classifier, self.features(df))


def fit_embedding_lr(
    train: DataFrame, c: float = 1.0, max_iter: int = 2000, family: str = "binomial"
) -> EmbeddingLr:
    """Scaled stored vectors (``embedding``, ``label``), then logistic regression."""
    scale = scale_fit(train)
    features = EmbeddingLr(scale, None).features(train.select("embedding", "label"))
    return EmbeddingLr(scale, fit_logistic(features, train.count(), c, max_iter, family))


def each_rotation(
    splits: DataFrame,
    do: Callable[[DataFrame, int], DataFrame],
    rotations: Sequence[int] = range(len(GENERATORS)),
) -> DataFrame:
    """``do`` of each rotation's rows and number, with the rotation as a column.

    A fit is many short jobs, so the rotations run side by side. ``splits`` is read
    once per rotation and step: pass a stored table.
    """

    @inheritable_thread_target(splits.sparkSession)
    def done(rotation: int) -> DataFrame:
        rows = splits.where(F.col("rotation") == rotation)
        return do(rows, rotation).withColumn("rotation", F.lit(rotation))

    with ThreadPool(len(rotations)) as threads:
        return reduce(DataFrame.unionByName, threads.map(done, rotations))


def of_rotation(counts: DataFrame, rotation: int) -> DataFrame:
    return counts.where(F.col("rotation") == rotation).drop("rotation")


def optima(
    splits: DataFrame,
    fit: Callable[..., TfidfLr | EmbeddingLr],
    rotations: Sequence[int] = range(len(GENERATORS)),
) -> DataFrame:
    """For each rotation: training rows, features, and the largest gradient of the fitted loss over those rows."""
    counts = shared_counts(splits, rotations) if fit is fit_tfidf_lr else None

    def checked(rows: DataFrame, rotation: int) -> DataFrame:
        train = rows.where(F.col("split") == "train")
        model = fit(train, **({} if counts is None else {"counts": of_rotation(counts, rotation)}))
        vectors = stored(model.features(train), "checked")
        found = (vectors.count(), model.classifier.numFeatures, largest_gradient(model.classifier, vectors))
        return rows.sparkSession.createDataFrame([found], "n_train bigint, n_features int, largest_gradient double")

    return each_rotation(splits, checked, rotations)


def rotation_metrics(
    splits: DataFrame,
    fit: Callable[..., TfidfLr | EmbeddingLr],
    model: str,
    rotations: Sequence[int] = range(len(GENERATORS)),
) -> DataFrame:
    """Fit on each rotation's training rows and measure its two tests.

    Term counts of ``fit_tfidf_lr`` are taken for all rotations at once.
    """
    counts = shared_counts(splits, rotations) if fit is fit_tfidf_lr else None

    def scored(rows: DataFrame, rotation: int) -> DataFrame:
        shared = {} if counts is None else {"counts": of_rotation(counts, rotation)}
        fitted = fit(rows.where(F.col("split") == "train"), **shared)
        return fitted.score(rows.where(F.col("split").isin(TEST_SPLITS))).select("split", "label", "p")

    every = each_rotation(splits, scored, rotations).withColumn("model", F.lit(model))
    return metrics(every, ["model", "rotation", "split"])


def generator_probe(train: DataFrame, test: DataFrame) -> DataFrame:
    """How well a linear model tells the generators apart from the vectors.

    Classes are the label map of the training rows. Per test generator: rows,
    accuracy, and mean cross-entropy of the true class.
    """
    classes = label_map(train)
    encode = lambda df: encode_generator(df, classes).withColumn("label", F.col("gen_label"))
    model = fit_embedding_lr(encode(train), family="multinomial")
    scored = model.classifier.transform(model.features(encode(test)))
    true_p = F.get(vector_to_array("probability"), F.col("label"))
    return scored.groupBy("generator").agg(
        F.count("*").alias("n"),
        F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"),
        F.avg(-F.log(F.greatest(true_p, F.lit(1e-300)))).alias("cross_entropy"),
    )
