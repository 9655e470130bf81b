"""Table schemas and the fixed values that results depend on."""

from pyspark.sql import types as T

RAW_REVIEW = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("title", T.StringType()),
])

REVIEW = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("generator", T.StringType()),
])

META = (
    "held_out string, train_gens string, n_train bigint, n_val bigint, "
    "n_test_indist bigint, n_test_crossgen bigint"
)

METRICS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("rotation", T.IntegerType()),
    T.StructField("split", T.StringType()),
    T.StructField("generator", T.StringType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("n", T.LongType()),
])

# --- Fixed values: results must equal them exactly. -------------------------

CUTOFF_MS = 1669766400000  # 2022-11-30 00:00:00 UTC
MIN_WORDS = 20
MAX_WORDS = 400
POOL_SIZE = 10_000
RESERVE = 2_500
SEED = 42

CATEGORIES = [
    "All_Beauty",
    "Books",
    "Electronics",
    "Home_and_Kitchen",
    "Sports_and_Outdoors",
    "Toys_and_Games",
    "Pet_Supplies",
    "Office_Products",
]

HUMAN = "human"
GENERATORS = ["gpt5mini", "granite", "gemma", "qwen"]

SPLITS = ["train", "val_indist", "test_indist", "test_crossgen"]
TEST_SPLITS = ["test_indist", "test_crossgen"]

# name, weights of the cross-entropy, contrastive and adversarial parts
VARIANTS = [
    ("base", 1.0, 0.0, 0.0),
    ("contrastive", 1.0, 0.5, 0.0),
    ("adversarial", 1.0, 0.0, 0.3),
    ("both", 1.0, 0.5, 0.3),
]

# training settings shared by all variants
BATCH_SIZE = 16
MAX_LEN = 256

# run name and the label it has in the comparison table, in table order
MODELS = [
    ("tfidf_lr", "TF-IDF + LR"),
    ("deberta_zero_shot", "DeBERTa zero-shot"),
    ("base", "DeBERTa-FT base"),
    ("contrastive", "DeBERTa-FT contrastive"),
    ("adversarial", "DeBERTa-FT adversarial"),
    ("both", "DeBERTa-FT both"),
]

PROMPT_TEMPLATE = (
    "Write a {rating}-star Amazon product review for: {product_title}\n"
    "Category: {category}\n"
    "Length: about {target_word_count} words.\n"
    "Voice: a real customer who bought this product. No emojis, no hashtags.\n"
    "Output only the review body — no title, no preamble."
)
DEFAULT_TITLE = "this product"
DEFAULT_STARS = 5
TOKENS_PER_WORD = 2.5
LENGTH_MU = 4.0
LENGTH_SIGMA = 0.6

TEMPERATURE = 0.07
THRESHOLD = 0.5
MIN_DF = 2
MAX_FEATURES = 50_000
