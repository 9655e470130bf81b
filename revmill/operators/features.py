"""Label maps, token ids, pooled and scaled vectors, TF-IDF."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revmill.functions.text import tokens, with_pairs, words
from revmill.functions.vectors import doubles
from revmill.schema import HUMAN, MAX_FEATURES, MAX_LEN, MIN_DF
from revmill.session import new_folder, stored

def label_map(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class numbers for each group of ``by``: human is 0, the other generators 1..N by name."""
    others = F.collect_set(F.when(F.col("generator") != HUMAN, F.col("generator")))
    names = train.groupBy(*by).agg(F.array_sort(others).alias("g"))
    listed = F.posexplode(F.concat(F.array(F.lit(HUMAN)), F.col("g"))).alias("gen_label", "generator")
    return names.select(*by, listed).select(*by, "generator", "gen_label")


def encode_generator(df: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``gen_label`` by the map; an unseen generator gets 0 and ``gen_known`` false.

    A plain join: Spark broadcasts the map if it is small and splits hot keys if not.
    """
    return (
        df.join(labels, [*by, "generator"], "left")
        .withColumn("gen_known", F.col("gen_label").isNotNull())
        .withColumn("gen_label", F.coalesce("gen_label", F.lit(0)))
    )


# --- Token ids ---------------------------------------------------------------

PAD, UNKNOWN, FIRST_ID = 0, 1, 2
#: Words of a vocabulary that every task has at hand, and their longest spelling: a few MB at most.
HEAD, LONG_WORD = 20_000, 64


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """Rows with their place from 1 in a total order, without one task that has them all.

    Rows are range-partitioned in the order and stored with their range; a place is the
    one in the range and the rows of the ranges before it. The order's first range holds
    the smallest rows, as the partitioner numbers ranges.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_here", here)
        .join(offsets, "_range")
        .withColumn(name, F.col("_here") + F.col("_before"))
        .drop("_range", "_here", "_before")
    )


def word_vocabulary(df: DataFrame, max_features: int | None = None) -> DataFrame:
    """The lower-cased words of the texts, numbered from 2 by falling frequency.

    All words, unless the caller names how many of the most frequent it wants.
    """
    counts = (
        df.select(F.explode_outer(words(F.lower("text"))).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    ranked = numbered(counts, F.desc("n"), F.asc("word"))
    if max_features is not None:
        ranked = ranked.where(F.col("position") <= max_features)
    return stored(ranked.select("word", (F.col("position") + (FIRST_ID - 1)).alias("id")), "vocabulary")


def _short(word: str) -> Column:
    """A word, or the digest of one that is longer than LONG_WORD; words hold no blank."""
    return F.when(F.length(word) <= LONG_WORD, F.col(word)).otherwise(F.concat(F.lit(" "), F.sha2(word, 256)))


def encode_tokens(
    df: DataFrame,
    vocabulary: DataFrame,
    max_len: int = MAX_LEN,
    key: str = "review_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of length ``max_len`` per text, and columns to keep.

    Longer texts are truncated, shorter ones padded with 0; words outside the
    vocabulary get 1. The first ``max_len`` words of the texts are placed by key once.
    The HEAD most frequent words of the vocabulary are looked up there; only the other
    words are shuffled, each of them at most one in HEAD of all words, so no word gathers
    a task's worth of rows, and their ids come back to the placed texts. A key that
    stands in two rows is an error.
    """
    first = F.slice(words(F.lower("text")), 1, max_len)
    # A struct of a null key equals itself, so that rows without a key get their rare words back too.
    placed = df.select(F.struct(key).alias("_key"), *keep, first.alias("words")).repartition("_key")
    long = placed.select("_key", *keep, F.posexplode_outer("words").alias("pos", "word"))
    frequent = F.col("id") < FIRST_ID + HEAD
    head = vocabulary.where(frequent).select(_short("word").alias("_short"), "id")
    marked = long.join(F.broadcast(head), _short("word") == F.col("_short"), "left")
    known = marked.groupBy("_key").agg(
        F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))).alias("ids"),
        *[F.first(c).alias(c) for c in keep],
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("_rows"),
    )
    rare = marked.where(F.col("id").isNull() & F.col("word").isNotNull()).select("_key", "pos", "word")
    rare = rare.join(vocabulary.where(~frequent), "word", "left")
    rare = rare.groupBy("_key").agg(
        F.collect_list(F.struct("pos", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))).alias("_rare")
    )
    grouped = known.join(rare, "_key", "left").select(
        F.col("_key")[key].alias(key),
        *keep,
        "_rows",
        F.sort_array(F.concat("ids", F.coalesce("_rare", F.array().cast(known.schema["ids"].dataType)))).alias("ids"),
    )
    twice = F.raise_error(F.concat(F.lit("two rows with the key "), F.col(key).cast("string")))
    grouped = grouped.withColumn(
        "ids",
        F.when(F.col("_rows") == 1, F.col("ids").getField("id")).otherwise(twice),
    )
    pad = F.lit(max_len) - F.size("ids")
    return grouped.select(
        key,
        *keep,
        F.concat("ids", F.array_repeat(F.lit(PAD).cast("bigint"), pad)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), pad)
        ).alias("attention_mask"),
    )


# --- Vectors -----------------------------------------------------------------


def mean_pool(
    vectors: DataFrame, by: str, vector: str = "embedding", mask: str = "mask"
) -> DataFrame:
    """Mean of a document's token vectors where the mask is 1.

    The vector sum is combined in the tasks that read the tokens. A document
    without any unmasked token gets the zero vector.
    """
    masked = F.transform(doubles(vector), lambda x: x * F.col(mask).cast("double"))
    sums = vectors.groupBy(by).agg(
        vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("sum"),
        F.sum(F.col(mask).cast("double")).alias("count"),
    )
    count = F.greatest("count", F.lit(1e-6))
    return sums.select(by, F.transform("sum", lambda x: x / count).alias("pooled"))


def embed(ids: DataFrame, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Every row with its stored vector; without one it is null and ``has_vector`` false."""
    return ids.join(vectors, key, "left").withColumn("has_vector", F.col("embedding").isNotNull())


class Scale(NamedTuple):
    """Per dimension: mean and population standard deviation (1 where it is 0)."""

    mean: list[float]
    std: list[float]


def scale_fit(train: DataFrame, vector: str = "embedding") -> Scale:
    """Fit the scaling on a table; the result is as long as one vector."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(doubles(vector))
    )
    row = train.select(stats.alias("s")).select("s.mean", "s.variance", "s.count").first()
    n = row["count"]
    # The summary has the sample variance.
    std = [(v * (n - 1) / n) ** 0.5 if n > 1 else 0.0 for v in row["variance"]]
    return Scale([float(x) for x in row["mean"]], [s if s > 0 else 1.0 for s in std])


def scale_apply(df: DataFrame, scale: Scale, vector: str = "embedding") -> DataFrame:
    """Centre and divide every vector."""
    mean, std = (F.array(*[F.lit(x) for x in values]) for values in scale)
    centred = F.zip_with(doubles(vector), mean, lambda x, m: x - m)
    return df.withColumn(vector, F.zip_with(centred, std, lambda x, s: x / s))


# --- TF-IDF ------------------------------------------------------------------


# Below, arrays made by a regex are exploded with the outer form. The inner form
# makes Spark test for empty arrays before the projection, at the price of running
# the regex again for each mention of it.


def with_terms(df: DataFrame, *keep: str) -> DataFrame:
    """Each text's tokens and pairs of neighbouring tokens as the array ``t``."""
    # Two projections, so that the regex runs once per text.
    return df.select(*keep, tokens("text").alias("w")).select(*keep, with_pairs(F.col("w")).alias("t"))


def term_counts(
    train: DataFrame, by: str | None = None, groups: Sequence[int] = (0,), min_df: int = MIN_DF
) -> DataFrame:
    """Stored rows ``term, df, total, idf`` of all terms of at least ``min_df`` documents, in every group.

    Groups are values of the column ``by`` (a short list, such as the rotations) and a
    column of the result; without it all rows are one group and no text is shuffled. Groups
    share most texts: a text is split into terms once, with how many of each group's rows
    have it. Counts per document and in total come from one pass: a text's terms are sorted
    and emitted, marked where they are the first of their kind, and combined before the shuffle.
    idf = ln((1 + n) / (1 + df)) + 1.
    """
    held = [F.lit(True) if by is None else F.col(by) == g for g in groups]
    rows = [f"_rows_{k}" for k in range(len(groups))]
    if by is None:
        # Nothing is shared, and texts need not meet.
        texts = train.select("text", F.lit(1).alias(rows[0]))
    else:
        texts = train.groupBy("text").agg(*[F.count_if(h).alias(name) for h, name in zip(held, rows, strict=True)])
        texts = stored(texts, "texts")
    documents = texts.agg(*[F.sum(name).alias(name) for name in rows]).first()
    terms = with_terms(texts, *rows).select(*rows, F.sort_array("t").alias("t"))
    first = (F.col("pos") == 0) | (F.get("t", F.col("pos") - 1) != F.col("term"))
    counts = (
        terms.select(*rows, "t", F.posexplode_outer("t").alias("pos", "term"))
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(
            *[F.sum(F.when(first, F.col(name)).otherwise(0)).alias(f"_df{name}") for name in rows],
            *[F.sum(name).alias(f"_total{name}") for name in rows],
        )
    )
    each = [
        F.struct(
            F.lit(g).alias(by or "_group"),
            F.col(f"_df{name}").alias("df"),
            F.col(f"_total{name}").alias("total"),
            (F.log(((documents[name] or 0) + 1.0) / (F.col(f"_df{name}") + 1.0)) + 1.0).alias("idf"),
        )
        for g, name in zip(groups, rows, strict=True)
    ]
    long = counts.select("term", F.inline(F.array(*each))).where(F.col("df") >= min_df)
    return stored(long if by is not None else long.drop("_group"), "terms")


def most_frequent(counts: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` terms of one group with the largest total (ties by term).

    The last term that gets in is found by position, not by a LIMIT, which would send
    ``max_features`` rows of every task through one. Give stored counts.
    """
    # One row per total count that occurs.
    reached = F.sum("n").over(Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0))
    totals = counts.groupBy("total").agg(F.count("*").alias("n")).withColumn("reached", reached)
    edge = totals.where(F.col("reached") >= max_features).orderBy(F.desc("total")).first()
    if edge is None:
        return counts
    tied = numbered(counts.where(F.col("total") == edge["total"]), F.asc("term"))
    room = max_features - (edge["reached"] - edge["n"])
    within = tied.where(F.col("position") <= room).drop("position")
    return counts.where(F.col("total") > edge["total"]).unionByName(within)


def tfidf_fit(
    train: DataFrame, min_df: int = MIN_DF, max_features: int = MAX_FEATURES
) -> DataFrame:
    """The vocabulary ``term, df, total, idf``: the most frequent terms of at least ``min_df`` documents."""
    return most_frequent(term_counts(train, min_df=min_df), max_features)


def vectorizer(vocabulary: DataFrame) -> CountVectorizerModel:
    """A count vectorizer for the terms of a table, in their order.

    The terms, one row of at most ``max_features``, are written as the data of a saved
    model and loaded: handed over by Python, they would cross to the JVM one by one.
    """
    path = new_folder(vocabulary.sparkSession, "vocabulary")
    CountVectorizerModel.from_vocabulary(["-"], inputCol="terms", outputCol="counts").save(path)
    listed = vocabulary.agg(F.sort_array(F.collect_list("term")).alias("vocabulary"))
    listed.write.mode("overwrite").parquet(f"{path}/data")
    return CountVectorizerModel.load(path)


def one_row_each(df: DataFrame, key: str) -> None:
    """Raise if a key stands in two rows; only keys are read and shuffled."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"two rows with the key {twice[key]}")


def tfidf_apply(df: DataFrame, vocabulary: DataFrame, key: str = "review_id") -> DataFrame:
    """TF-IDF weights in long form: ``key, term, weight``.

    weight = (1 + ln tf) * idf, scaled to unit length per document; terms
    outside the vocabulary are dropped, and a document without any known term
    keeps one row with a null term and weight 0. Terms are counted, weighted and scaled
    inside the document's row, so texts stay where they are read; the idf weights, at
    most ``max_features``, come to the driver. A key that stands in two rows is an error.
    """
    one_row_each(df, key)
    terms = stored(vocabulary.select("term", "idf"), "vocabulary")
    idf = [r["idf"] for r in terms.orderBy("term").select("idf").collect()]
    if not idf:
        return df.select(key, F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight"))
    listed = df.select(key, tokens("text").alias("w")).select(key, with_pairs(F.col("w")).alias("terms"))
    counted = vectorizer(terms).transform(listed).drop("terms")
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted"
    ).transform(counted)
    # The product has tf * idf where the count has tf, and idf is never 0.
    tf, product = (F.unwrap_udt(c) for c in ("counts", "weighted"))
    raw = F.zip_with(tf["values"], product["values"], lambda n, x: (F.log(n) + 1.0) * x / n)
    rows = weighted.select(key, tf["indices"].alias("places"), raw.alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda total, x: total + x * x))
    # The norm goes along with the terms: beside them it would be summed up again for each.
    entries = F.arrays_zip("places", "raw", F.array_repeat(norm, F.size("raw")))
    long = rows.select(key, F.inline_outer(entries).alias("place", "raw", "norm"))
    listed = terms.select(F.sort_array(F.collect_list("term")).alias("t")).select(F.posexplode("t").alias("place", "term"))
    # The vocabulary is limited to its max_features rows.
    return long.join(F.broadcast(listed), "place", "left").select(
        key, "term", F.coalesce(F.col("raw") / F.col("norm"), F.lit(0.0)).alias("weight")
    )
