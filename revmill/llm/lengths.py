"""Exact length histogram: how many tokens a corpus has under every context limit.

Documents are aggregated by encoded length, so what is kept grows with the number of
different lengths and not with documents. Running sums from the long end answer, for
any limit, how many documents are longer, how many tokens a cut at the limit leaves
and how many it drops; the same counts give exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.llm.tables import mapped, read, stored
from revmill.llm.tokens import Encoder, word_bpe

#: Lengths that share a window of running sums; totals of the spans are added to it.
SPAN = 1024
FIELDS = T.StructType([T.StructField("length", T.LongType(), False)])


def encoded_lengths(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, length): ids of the whole text and the end id. A null text has length 1."""

    def prepare():
        encoder = Encoder(tokenizer)
        return lambda texts: {"length": [len(ids) + 1 for ids in encoder.encode(texts)]}

    return mapped(docs, [key], text, prepare, FIELDS)


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs) of every length that occurs. Repeated rows count each; null lengths do not."""
    return lengths.where("length IS NOT NULL").groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """A row per length L that occurs, for the context limit L.

    n_docs have length L, n_longer more; tokens_longer is the sum of the lengths over
    L, truncated_tokens what a cut of every document at L leaves, dropped_tokens the
    rest; n_shorter documents are shorter, so L is the quantile of every rank in
    (n_shorter, n_shorter + n_docs]. Totals stand in each row. An empty table gives no row.
    The counts are stored first: sums by span and within a span both read them.
    """
    counts = stored(counts, "histogram").select(
        "length",
        "n_docs",
        (F.col("length") * F.col("n_docs")).alias("tokens"),
        F.expr(f"length div {SPAN}").alias("span"),
    )
    spans = counts.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    # One row for each SPAN lengths: a list that is ordered by itself.
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    spans = spans.select(
        "span",
        F.coalesce(F.sum("span_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("span_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("span_docs").over(every).alias("total_docs"),
        F.sum("span_tokens").over(every).alias("total_tokens"),
    )
    longer = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.join(spans, "span").select(
        "length",
        "n_docs",
        "tokens",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_after")).alias("n_longer"),
        (F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("tokens_after")).alias("tokens_longer"),
        "total_docs",
        "total_tokens",
    )
    dropped = F.col("tokens_longer") - F.col("n_longer") * F.col("length")
    return summed.select(
        "length",
        "n_docs",
        "tokens",
        "n_longer",
        "tokens_longer",
        (F.col("total_docs") - F.col("n_longer") - F.col("n_docs")).alias("n_shorter"),
        (F.col("total_tokens") - dropped).alias("truncated_tokens"),
        dropped.alias("dropped_tokens"),
        "total_docs",
        "total_tokens",
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Tokens left by each context limit, whether or not a document has that length.

    `limits` has a column `context` (a short list). The row of the largest length not
    over the limit holds all that is needed; below the shortest length every document
    is cut. Null or negative limits count as 0. Gives context, n_cut, truncated_tokens.
    """
    limits = limits.select(F.greatest(F.coalesce("context", F.lit(0)), F.lit(0)).cast("long").alias("context"))
    totals = sums.agg(F.max("total_docs").alias("all_docs"))
    best = (
        F.broadcast(limits)
        .join(sums, F.col("length") <= F.col("context"), "left")
        .groupBy("context")
        .agg(F.max_by(F.struct("n_longer", "total_tokens", "tokens_longer"), "length").alias("at"))
    )
    cut = F.coalesce("at.n_longer", "all_docs", F.lit(0))
    below = F.coalesce(F.col("at.total_tokens") - F.col("at.tokens_longer"), F.lit(0))
    return best.join(totals).select(
        "context", cut.alias("n_cut"), (below + cut * F.col("context")).alias("truncated_tokens")
    )


def quantiles(sums: DataFrame, fractions: DataFrame) -> DataFrame:
    """The exact length at each fraction q in (0, 1]: the smallest with at least q of all documents."""
    fractions = fractions.select(F.col("q").cast("double").alias("q"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total_docs")))
    inside = (F.col("n_shorter") < rank) & (rank <= F.col("n_shorter") + F.col("n_docs"))
    return sums.join(F.broadcast(fractions), inside).select("q", "length")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums over the lengths of all documents."""
    return suffix_sums(histogram(encoded_lengths(read(spark, sf_dir, "documents"), word_bpe())))
