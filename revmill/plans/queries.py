"""One query per operator, each over whole given tables.

Every function takes a session and the folder of the tables and returns a
DataFrame whose columns match the SQL of the same name in ``oracles``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmill.functions import text as tx
from revmill.functions.vectors import l2_normalize, softmax
from revmill.operators import (
    features,
    filters,
    generation,
    linear,
    losses,
    metrics,
    pool,
    report,
    splits,
)
from revmill.plans import inputs
from revmill.schema import GENERATORS, TEST_SPLITS
from revmill.session import new_folder, stored
from revmill.sources import early, results
from revmill.sources import reviews as source
from revmill.streaming.ingest import ingest_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BY_SPLIT = ["model", "rotation", "split"]
PRODUCT = ["parent_asin", "category", "rating", "title", "review_id"]
SPLIT_ROW = ["rotation", "split", "review_id", "category", "generator", "label"]


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def long_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("dim", "x")).select(
        key, "dim", F.round("x", 6).alias("x")
    )


# --- Sources and sinks -------------------------------------------------------


def _raw_lines(spark, sf_dir, chosen=None, *together) -> DataFrame:
    """Raw reviews as lines: some malformed, blank, arrays, or with a field of another type.

    Only the ``chosen`` ones, if given, placed as ``repartition`` would by ``together``.
    """
    raw = inputs.raw_reviews(spark, sf_dir)
    if chosen is not None:
        raw = raw.where(chosen).repartition(*together)
    line = F.to_json(F.struct("timestamp", "text", "user_id", "parent_asin", "rating", "title"))
    every = lambda n: F.col("doc_id") % n == 0
    rating = r'"rating":([0-9.]+)'
    return raw.select(
        "category",
        F.when(every(13), F.lit("{bad"))
        .when(every(17), F.lit(""))
        .when(every(41), F.lit('[1, {"rating": 2}]'))
        .when(every(19), F.regexp_replace(line, rating, '"rating":"$1"'))
        .when(every(23), F.regexp_replace(line, rating, '"rating":"abc"'))
        .when(every(43), F.regexp_replace(line, rating, '"rating":NaN'))
        .when(every(47), F.regexp_replace(line, r"^\{", '{"rating":77,"title":[],'))
        .when(every(53), F.concat(line, F.lit(" {}")))
        .when(every(7), F.regexp_replace(line, r'"timestamp":([0-9]+)', '"timestamp":$1.0'))
        .otherwise(line)
        .alias("value"),
    )


@query
def scan_reviews_json(spark, sf_dir):
    """Raw reviews as JSON lines of all kinds, scanned."""
    path = new_folder(spark, "raw")
    _raw_lines(spark, sf_dir).write.partitionBy("category").text(path)
    return source.scan_reviews_json(spark, path).select(
        "category",
        "timestamp",
        F.md5("text").alias("text_md5"),
        "user_id",
        "parent_asin",
        "rating",
        "title",
    )


@query
def rejected_reviews_json(spark, sf_dir):
    """The lines of the same files that do not parse, by category and reason."""
    path = new_folder(spark, "raw")
    _raw_lines(spark, sf_dir).write.partitionBy("category").text(path)
    rejected = source.scan_rejected_json(spark, path)
    return rejected.groupBy("category", "reason").agg(F.count("*").alias("n"))


@query
def scan_reviews_parquet(spark, sf_dir):
    """The human table and the generator tables, written and read together."""
    root = new_folder(spark, "tables")
    source.write_reviews(inputs.human(spark, sf_dir), f"{root}/human.parquet")
    source.write_generated(inputs.ai(spark, sf_dir), f"{root}/generated")
    human, generated = source.load_all(spark, f"{root}/human.parquet", f"{root}/generated")
    return human.unionByName(generated).select(
        "review_id", "category", "rating", "timestamp", "label", "generator",
        F.md5("text").alias("text_md5"),
    )


@query
def scan_split(spark, sf_dir):
    """One split of one rotation, read from its own folder."""
    path = new_folder(spark, "splits")
    source.write_splits(inputs.whole_splits(spark, sf_dir), path)
    return source.read_split(spark, path, 1, "test_crossgen").select(SPLIT_ROW)


@query
def write_reviews(spark, sf_dir):
    """The human pool after a round trip through storage."""
    path = new_folder(spark, "human")
    source.write_reviews(inputs.human(spark, sf_dir), path)
    return source.scan_reviews(spark, path).groupBy("category").agg(
        F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("n_chars")
    )


@query
def write_splits(spark, sf_dir):
    """Sizes of all stored splits."""
    path = new_folder(spark, "splits")
    source.write_splits(inputs.whole_splits(spark, sf_dir), path)
    return (
        source.read_splits(spark, path)
        .groupBy("rotation", "split", "generator")
        .agg(F.count("*").alias("n"))
    )


def _all_metrics(spark, sf_dir) -> DataFrame:
    scored = stored(inputs.scored(spark, sf_dir), "scored")
    whole = metrics.metrics(scored, BY_SPLIT).withColumn("generator", F.lit(None).cast("string"))
    return whole.unionByName(metrics.per_generator(scored, BY_SPLIT))


@query
def metrics_json(spark, sf_dir):
    """All metrics written as one JSON document and read back."""
    path = new_folder(spark, "metrics")
    results.write_metrics(_all_metrics(spark, sf_dir), path)
    return results.read_metrics(spark, path).select(
        *BY_SPLIT, "generator", *rounded("f1", "auc"), "n"
    )


@query
def write_summary_csv(spark, sf_dir):
    """The comparison table written as CSV and read back."""
    path = new_folder(spark, "summary")
    results.write_summary(report.comparison(_split_metrics(spark, sf_dir)), path)
    names = {title: name for name, title in results.SUMMARY_COLUMNS.items()}
    schema = "Model string, " + ", ".join(f"`{t}` double" for t in list(names)[1:])
    table = spark.read.schema(schema).option("header", True).csv(path)
    table = table.select([F.col(f"`{t}`").alias(n) for t, n in names.items()])
    return table.select("model", *rounded(*table.columns[1:]))


@query
def variant_table(spark, sf_dir):
    """Each variant's loss weights on each rotation's rows."""
    return report.variant_weights(splits.rotation_meta(inputs.splits(spark, sf_dir)))


# --- Filters and projections -------------------------------------------------


@query
def cutoff_filter(spark, sf_dir):
    return filters.before_cutoff(inputs.raw_reviews(spark, sf_dir)).select("doc_id", "timestamp")


@query
def word_count(spark, sf_dir):
    return inputs.reviews(spark, sf_dir).select(
        "review_id", tx.word_count("text").alias("words")
    )


@query
def word_band_filter(spark, sf_dir):
    return filters.word_band(inputs.reviews(spark, sf_dir)).select("review_id", "generator")


@query
def text_default(spark, sf_dir):
    """Every 11th text counts as missing here."""
    raw = inputs.raw_reviews(spark, sf_dir).withColumn(
        "text", F.when(F.col("doc_id") % 11 != 0, F.col("text"))
    )
    text = tx.text_default("text")
    return raw.select("doc_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


@query
def review_key(spark, sf_dir):
    raw = filters.before_cutoff(inputs.raw_reviews(spark, sf_dir))
    return raw.select("doc_id", tx.review_key("category", "user_id", "timestamp").alias("review_id"))


def _pool_rows(spark, sf_dir) -> DataFrame:
    """Filtered raw reviews in the review schema; ids repeat."""
    return filters.as_human(pool.filter_pool(inputs.raw_reviews(spark, sf_dir)), "doc_id")


@query
def human_rows(spark, sf_dir):
    return (
        _pool_rows(spark, sf_dir)
        .withColumn("text_md5", F.md5("text"))
        .drop("text")
    )


@query
def ai_rows(spark, sf_dir):
    """Generated reviews as review rows, from texts with outer whitespace."""
    padded = inputs.ai(spark, sf_dir).withColumn(
        "text", F.concat(F.lit("\u3000 \x1c"), F.col("text"), F.lit("\xa0 \t\n "))
    )
    return (
        filters.as_generated(padded.withColumn("parent_asin", F.col("review_id")))
        .withColumn("text_md5", F.md5("text"))
        .drop("text")
    )


@query
def feature_columns(spark, sf_dir):
    return filters.feature_columns(inputs.reviews(spark, sf_dir)).select(
        "review_id", F.md5("text").alias("text_md5"), "label"
    )


# --- The human pool ----------------------------------------------------------


def _quota(spark, sf_dir) -> DataFrame:
    """Quotas for a pool of a quarter of the documents."""
    rows = inputs.reviews(spark, sf_dir).select("category")
    return pool.spread(rows, rows.count() // 4 + 3)


@query
def category_quota(spark, sf_dir):
    """Each category's quota beside the pool rows it has."""
    rows = inputs.human(spark, sf_dir).groupBy("category").agg(F.count("*").alias("available"))
    return rows.join(_quota(spark, sf_dir), "category").select("pos", "category", "quota", "available")


@query
def quota_take(spark, sf_dir):
    rows = inputs.human(spark, sf_dir).select("category", "review_id")
    return pool.take_quota(rows, _quota(spark, sf_dir))


@query
def dedup_reviews(spark, sf_dir):
    return pool.dedup(_pool_rows(spark, sf_dir), "review_id", "doc_id").select(
        "review_id", "doc_id", F.md5("text").alias("text_md5")
    )


@query
def seeded_shuffle(spark, sf_dir):
    return pool.shuffled_positions(inputs.stored_human(spark, sf_dir, "review_id"))


@query
def human_pool(spark, sf_dir):
    """Filters, quota in document order, dedup, shuffle."""
    built = pool.build_human_pool(
        inputs.raw_reviews(spark, sf_dir), _quota(spark, sf_dir), order="doc_id"
    )
    return built.withColumn("text_md5", F.md5("text")).drop("text")


FILES = 8


@query
def pool_in_file_order(spark, sf_dir):
    """The pool of the first passing reviews in eight files per category; the rest is not read."""
    path = new_folder(spark, "files")
    raw = inputs.raw_reviews(spark, sf_dir)
    most = raw.agg(F.max("doc_id")).first()[0]
    line = F.to_json(F.struct("timestamp", "text", "user_id", "parent_asin", "rating", "title"))
    place = F.expr(f"cast(doc_id * {FILES} div {most + 1} as int)")
    placed = raw.select("category", line.alias("value"), place.alias("place")).repartitionById(FILES, "place")
    placed.drop("place").write.partitionBy("category").text(path)
    quota = {r["category"]: r["quota"] for r in _quota(spark, sf_dir).collect()}
    built = early.build_pool_from_files(spark, path, quota)
    return built.withColumn("text_md5", F.md5("text")).drop("text")


@query
def category_counts(spark, sf_dir):
    return pool.value_counts(inputs.human(spark, sf_dir), "category")


@query
def word_count_stats(spark, sf_dir):
    return pool.word_stats(inputs.human(spark, sf_dir)).select("min", "max", *rounded("mean"))


@query
def head_rows(spark, sf_dir):
    return pool.head(inputs.human(spark, sf_dir), 5, "review_id").select(
        "review_id", "category", "rating", "title"
    )


# --- Generation tables -------------------------------------------------------


def _half_of_products(human: DataFrame) -> int:
    return human.select("parent_asin").distinct().count() // 2


@query
def seed_products(spark, sf_dir):
    human = inputs.stored_human(spark, sf_dir, *PRODUCT)
    return generation.seed_products(human, _half_of_products(human))


@query
def length_draw(spark, sf_dir):
    """A length for every review, drawn from the human pool's lengths."""
    bins = generation.length_bins(inputs.human(spark, sf_dir))
    rows = inputs.reviews(spark, sf_dir).select("review_id")
    return generation.draw_length(rows, bins, "review_id")


@query
def length_lognormal(spark, sf_dir):
    rows = inputs.reviews(spark, sf_dir).select("review_id")
    return generation.draw_lognormal(rows, "review_id")


def _with_length(spark, sf_dir) -> DataFrame:
    return inputs.reviews(spark, sf_dir).withColumn("target_wc", tx.word_count("text"))


@query
def prompt_render(spark, sf_dir):
    return _with_length(spark, sf_dir).select("review_id", generation.prompt().alias("prompt"))


@query
def token_budget(spark, sf_dir):
    return _with_length(spark, sf_dir).select(
        "review_id", generation.token_budget("target_wc").alias("max_tokens")
    )


@query
def chat_messages(spark, sf_dir):
    chat = _with_length(spark, sf_dir).select(
        "review_id", generation.messages(generation.prompt()).alias("messages")
    )
    return chat.select(
        "review_id",
        F.size("messages").alias("n_messages"),
        F.col("messages")[0]["role"].alias("role"),
        F.col("messages")[0]["content"].alias("content"),
    )


def _requests(spark, sf_dir) -> DataFrame:
    human = inputs.stored_human(spark, sf_dir, *PRODUCT, "text")
    return generation.requests(human, _half_of_products(human))


@query
def generation_requests(spark, sf_dir):
    return _requests(spark, sf_dir)


@query
def ingest_responses(spark, sf_dir):
    requests = stored(_requests(spark, sf_dir), "requests")
    return generation.ingest(requests, inputs.responses(requests))


@query
def pending_requests(spark, sf_dir):
    requests = stored(_requests(spark, sf_dir), "requests")
    return generation.pending(requests, inputs.responses(requests)).select(
        "request_id", "generator", "parent_asin"
    )


# --- Splits ------------------------------------------------------------------


@query
def rotations(spark, sf_dir):
    """The rotation table, with how many generated rows each side has."""
    sizes = inputs.ai(spark, sf_dir).groupBy("generator").agg(F.count("*").alias("n"))
    held = F.col("generator") == F.col("held_out")
    rows = splits.each_rotation(sizes).join(
        F.broadcast(splits.rotations(spark)), "rotation"
    )
    return rows.groupBy("rotation", "held_out", "train_gens").agg(
        F.sum(F.when(held, F.col("n"))).alias("n_held_out"),
        F.sum(F.when(~held, F.col("n"))).alias("n_trained"),
    )


@query
def reserve_human(spark, sf_dir):
    human = inputs.stored_human(spark, sf_dir, "review_id")
    return splits.reserve_human(human, inputs.quarter()).select("rotation", "part", "review_id")


@query
def split_80_10_10(spark, sf_dir):
    rows = splits.each_rotation(inputs.ai(spark, sf_dir))
    return splits.split_indist(rows).select("rotation", "generator", "split", "review_id")


@query
def balance_human(spark, sf_dir):
    human = inputs.stored_human(spark, sf_dir, *inputs.BRIEF)
    ai = inputs.ai(spark, sf_dir).select(*inputs.BRIEF)
    return splits.balance(human, ai, inputs.quarter()).select("rotation", "split", "review_id")


@query
def balance_check(spark, sf_dir):
    return splits.balance_check(
        inputs.human(spark, sf_dir), inputs.ai(spark, sf_dir), inputs.quarter()
    )


@query
def logo_splits(spark, sf_dir):
    return inputs.splits(spark, sf_dir).select(SPLIT_ROW)


@query
def combine_shuffle(spark, sf_dir):
    """Humans and generated reviews together, with their shuffled position."""
    human = inputs.stored_human(spark, sf_dir, "review_id", "generator")
    ai = inputs.ai(spark, sf_dir).select("review_id", "generator")
    return pool.shuffled_positions(splits.combine(human, ai))


@query
def rotation_meta(spark, sf_dir):
    return splits.rotation_meta(inputs.splits(spark, sf_dir))


@query
def leakage_check(spark, sf_dir):
    """Reviews and products that train and cross-generator test share."""
    return splits.leakage(inputs.splits(spark, sf_dir), ["review_id", "parent_asin"])


# --- Features ----------------------------------------------------------------


def _train(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split") == "train")


@query
def generator_label_map(spark, sf_dir):
    """The classes of every rotation's training rows."""
    return features.label_map(_train(inputs.splits(spark, sf_dir)), ["rotation"])


@query
def generator_label_encode(spark, sf_dir):
    """All rows of all rotations by the classes of the rotation."""
    rows = stored(
        inputs.splits(spark, sf_dir).select("rotation", "split", "generator", "review_id"), "splits"
    )
    labels = features.label_map(_train(rows), ["rotation"])
    return features.encode_generator(rows, labels, ["rotation"])


@query
def token_ids(spark, sf_dir):
    """The encoded sample: ids, mask and both labels of every review."""
    rows = inputs.reviews(spark, sf_dir)
    labelled = features.encode_generator(rows, features.label_map(rows))
    vocabulary = features.word_vocabulary(rows)
    encoded = features.encode_tokens(labelled, vocabulary, keep=["label", "gen_label"])
    return encoded.select(
        "review_id",
        "label",
        "gen_label",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"),
    )


@query
def masked_mean_pool(spark, sf_dir):
    return long_vector(features.mean_pool(inputs.vectors(spark, sf_dir), "doc"), "doc", "pooled")


@query
def embed_table(spark, sf_dir):
    rows = inputs.reviews(spark, sf_dir).select("review_id", "label")
    return inputs.embedded(spark, sf_dir, rows).select(
        "review_id",
        "label",
        "has_vector",
        F.when(F.col("has_vector"), F.size("embedding")).alias("dims"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query
def l2_normalized(spark, sf_dir):
    rows = inputs.vectors(spark, sf_dir).select("vec_id", l2_normalize("embedding").alias("v"))
    return long_vector(rows, "vec_id", "v")


QUERIES["l2_normalize"] = QUERIES.pop("l2_normalized")


@query
def standard_scale(spark, sf_dir):
    """Fitted on the vectors of one class, applied to all."""
    rows = inputs.vectors(spark, sf_dir).select("vec_id", "embedding", "label")
    scale = features.scale_fit(rows.where(F.col("label") == 0))
    return long_vector(features.scale_apply(rows, scale), "vec_id", "embedding")


@query
def tokens_ngrams(spark, sf_dir):
    return features.with_terms(inputs.reviews(spark, sf_dir), "review_id").select(
        "review_id",
        F.size("t").alias("n_terms"),
        F.md5(F.array_join("t", "|")).alias("terms_md5"),
    )


@query
def tfidf_vocab(spark, sf_dir):
    return features.tfidf_fit(inputs.reviews(spark, sf_dir)).select(
        "term", "df", "total", *rounded("idf")
    )


@query
def tfidf_weights(spark, sf_dir):
    """All weights of all documents, summed up per document."""
    rows = inputs.reviews(spark, sf_dir).select("review_id", "text")
    weights = features.tfidf_apply(rows, features.tfidf_fit(rows))
    return weights.groupBy("review_id").agg(
        F.count("term").alias("n_terms"),
        F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.sum(F.col("weight") * F.coalesce(F.length("term"), F.lit(0))), 6).alias("by_length"),
        F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"),
    )


# --- Models ------------------------------------------------------------------


def _stored_splits(spark, sf_dir) -> DataFrame:
    """The splits from storage: fitting reads them many times."""
    return stored(inputs.splits(spark, sf_dir, [*inputs.BRIEF, "text"]), "splits")


@query
def tfidf_lr(spark, sf_dir):
    return linear.rotation_metrics(
        _stored_splits(spark, sf_dir), linear.fit_tfidf_lr, "tfidf_lr"
    )


@query
def embedding_lr(spark, sf_dir):
    """Fitted on the rows that have a vector, beside how many of each test have none."""
    rows = inputs.splits(spark, sf_dir).select("review_id", "rotation", "split", "label")
    rows = stored(inputs.embedded(spark, sf_dir, rows), "embedded")
    found = linear.rotation_metrics(
        rows.where("has_vector"), linear.fit_embedding_lr, "deberta_zero_shot"
    )
    missing = rows.groupBy("rotation", "split").agg(
        F.count_if(~F.col("has_vector")).alias("n_without_vector")
    )
    return found.join(missing, ["rotation", "split"])


#: The largest gradient at which the usual solver for this loss stops.
AT_OPTIMUM = 1e-4


def _optima(found: DataFrame) -> DataFrame:
    return found.select("rotation", "n_train", "n_features", (F.col("largest_gradient") < AT_OPTIMUM).alias("at_optimum"))


@query
def tfidf_lr_optimum(spark, sf_dir):
    """Whether each rotation's fit is the optimum over all of its training rows and terms."""
    return _optima(linear.optima(_stored_splits(spark, sf_dir), linear.fit_tfidf_lr))


@query
def embedding_lr_optimum(spark, sf_dir):
    """The same of the fits on stored vectors."""
    rows = inputs.splits(spark, sf_dir).select("review_id", "rotation", "split", "label")
    rows = stored(inputs.embedded(spark, sf_dir, rows), "embedded").where("has_vector")
    return _optima(linear.optima(rows, linear.fit_embedding_lr))


@query
def generator_probe(spark, sf_dir):
    """For each rotation trained on its training rows and tested on all its other rows."""
    rows = inputs.splits(spark, sf_dir).select("review_id", "rotation", "split", "generator")
    rows = stored(inputs.embedded(spark, sf_dir, rows), "embedded")
    is_train = (F.col("split") == "train") & F.col("has_vector")
    tested = (F.col("split") != "train") & F.col("has_vector")
    missing = rows.where((F.col("split") != "train") & ~F.col("has_vector"))
    missing = missing.groupBy("rotation", "generator").agg(F.count("*").alias("n_without_vector"))
    found = linear.each_rotation(
        rows, lambda own, _: linear.generator_probe(own.where(is_train), own.where(tested))
    )
    return found.join(missing, ["rotation", "generator"], "left").fillna(0, ["n_without_vector"])


@query
def score_split(spark, sf_dir):
    """Label and probability of every test row of every rotation."""
    rows = _stored_splits(spark, sf_dir)
    counts = linear.shared_counts(rows, range(len(GENERATORS)))

    def scored(own: DataFrame, rotation: int) -> DataFrame:
        model = linear.fit_tfidf_lr(_train(own), counts=linear.of_rotation(counts, rotation))
        tests = own.where(F.col("split").isin(TEST_SPLITS))
        return model.score(tests).select("split", "review_id", "label", *rounded("p"))

    return linear.each_rotation(rows, scored)


# --- Losses ------------------------------------------------------------------


def _batches(spark, sf_dir) -> DataFrame:
    return losses.training_batches(inputs.vectors(spark, sf_dir), "vec_id")


@query
def softmax_prob(spark, sf_dir):
    p = F.get(softmax("cls_logits"), F.lit(1))
    return inputs.vectors(spark, sf_dir).select("vec_id", F.round(p, 6).alias("p"))


@query
def cross_entropy(spark, sf_dir):
    loss = losses.cross_entropy(_batches(spark, sf_dir), "cls_logits", "label")
    return loss.select("batch_id", *rounded("loss"))


@query
def generator_cross_entropy(spark, sf_dir):
    loss = losses.cross_entropy(_batches(spark, sf_dir), "gen_logits", "gen_label")
    return loss.select("batch_id", *rounded("loss"))


@query
def supcon_loss(spark, sf_dir):
    batches = _batches(spark, sf_dir).withColumn("z", l2_normalize("embedding"))
    return losses.supcon(batches, "z", "label").select("batch_id", *rounded("loss"))


@query
def weighted_loss(spark, sf_dir):
    batches = _batches(spark, sf_dir).withColumn("z", l2_normalize("embedding"))
    parts = losses.loss_parts(batches, "z", "label", "cls_logits", "gen_label", "gen_logits")
    return losses.weighted_loss(parts).select(
        "batch_id", "variant", *rounded("ce", "contrastive", "adversarial", "total")
    )


# --- Evaluation and reports --------------------------------------------------


@query
def threshold_predict(spark, sf_dir):
    return metrics.predict(inputs.scored(spark, sf_dir)).select(
        *BY_SPLIT, "review_id", "pred"
    )


@query
def confusion_counts(spark, sf_dir):
    return metrics.confusion(inputs.scored(spark, sf_dir), BY_SPLIT)


@query
def f1(spark, sf_dir):
    return metrics.f1(inputs.scored(spark, sf_dir), BY_SPLIT).select(*BY_SPLIT, *rounded("f1"))


@query
def auc(spark, sf_dir):
    return metrics.auc(inputs.scored(spark, sf_dir), BY_SPLIT).select(*BY_SPLIT, *rounded("auc"))


def _split_metrics(spark, sf_dir) -> DataFrame:
    return metrics.metrics(inputs.scored(spark, sf_dir), BY_SPLIT)


@query
def split_metrics(spark, sf_dir):
    return _split_metrics(spark, sf_dir).select(*BY_SPLIT, *rounded("f1", "auc"), "n")


@query
def per_generator_metrics(spark, sf_dir):
    found = metrics.per_generator(inputs.scored(spark, sf_dir), BY_SPLIT)
    return found.select(*BY_SPLIT, "generator", *rounded("f1", "auc"), "n")


@query
def best_step(spark, sf_dir):
    """The best step of each run, on validation f1 of two decimals."""
    history = metrics.f1(inputs.validation_scores(spark, sf_dir), ["run", "step"])
    return report.best_step(history.withColumn("f1", F.round("f1", 2)))


@query
def rotation_average(spark, sf_dir):
    return report.rotation_average(_split_metrics(spark, sf_dir)).select(
        "model", "split", *rounded("f1", "auc"), "rotations"
    )


@query
def comparison_table(spark, sf_dir):
    table = report.comparison(_split_metrics(spark, sf_dir))
    return table.select("position", "model", *rounded(*table.columns[2:]))


@query
def heldout_pivot(spark, sf_dir):
    return report.heldout(_split_metrics(spark, sf_dir)).select("variant", *rounded(*GENERATORS))


@query
def gap_table(spark, sf_dir):
    table = report.gap(report.comparison(_split_metrics(spark, sf_dir)))
    return table.select("position", "model", *rounded(*table.columns[2:]))


@query
def pending_runs(spark, sf_dir):
    """Variant and rotation pairs without any scored row."""
    return report.pending_runs(inputs.scored(spark, sf_dir))


# --- Streaming ---------------------------------------------------------------


@query
def stream_review_ingest(spark, sf_dir):
    """The pool filter as a stream over JSON files that are written in three waves; first arrivals stay."""
    landing, out, state = (new_folder(spark, name) for name in ("landing", "ingested", "state"))
    for wave in (2, 1, 0):
        # Copies of one wave are in one file.
        lines = _raw_lines(spark, sf_dir, F.col("doc_id") % 3 == wave, 6, "user_id", "timestamp")
        lines.write.mode("append").partitionBy("category").text(landing)
    ingest_stream(spark, landing, out, state, files_per_trigger=30).awaitTermination()
    return source.scan_reviews(spark, out).select(
        "review_id", "category", "parent_asin", "rating", "timestamp", "label", F.md5("text").alias("text_md5")
    )
