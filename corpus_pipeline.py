"""The training corpus, stage by stage: reject, drop, cut, cut, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the docs of the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmill.llm import decontaminate, packing, repeats, simhash, toxicity
from revmill.llm.tables import read, stored
from revmill.llm.tokens import word_bpe


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now; a null text has the count it had."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on labelled rows of `documents`."""
    model = toxicity.fit_on(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest doc_id."""
    return simhash.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of a 100-byte string that starts earlier in the corpus go; documents stay."""
    return _counted(repeats.without_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that mostly consist of them."""
    return _counted(decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences."""
    return packing.pack_documents(docs, word_bpe())


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]

#: No SQL can express a compression distance or a tokenizer; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
