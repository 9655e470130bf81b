"""Training losses as grouped aggregates over scored rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmill.functions.order import order_key
from revmill.functions.vectors import negative_log_softmax
from revmill.operators.ranking import ranked
from revmill.schema import BATCH_SIZE, SEED, TEMPERATURE, VARIANTS


def training_batches(
    df: DataFrame, key: str, size: int = BATCH_SIZE, seed: int = SEED
) -> DataFrame:
    """Rows in shuffled batches of ``size``; the last batch may be shorter.

    Batches are cut by position, so none is ever larger.
    """
    placed = ranked(df.withColumn("_order", order_key(seed, key)), "_order", "_position")
    return placed.withColumn("batch_id", F.floor((F.col("_position") - 1) / size)).drop(
        "_position", "_order"
    )


def cross_entropy(df: DataFrame, logits: str, label: str, by: Sequence[str] = ("batch_id",)):
    """Mean of -log softmax(logits)[label] per group; any number of classes."""
    return df.groupBy(*by).agg(F.avg(negative_log_softmax(logits, label)).alias("loss"))


def _gathered(vector: str, label: str) -> Column:
    return F.collect_list(F.struct(F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("y")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _of_anchor(logits: Column, i: Column, labels: Column) -> Column:
    """(log of the summed exponents, sum over partners, number of partners) of one anchor, its largest logit at 0."""
    most = F.array_max(logits)
    exponents = F.transform(logits, lambda x, j: F.when(j != i, F.exp(x - most)).otherwise(0.0))
    partner = lambda j: (j != i) & (F.get(labels, j) == F.get(labels, i))
    of_partners = F.transform(logits, lambda x, j: F.when(partner(j), x - most))
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
    return F.struct(
        F.log(add(exponents) + 1e-12).alias("log_sum"),
        add(F.filter(of_partners, F.isnotnull)).alias("partners"),
        F.size(F.filter(of_partners, F.isnotnull)).alias("n"),
    )


def _with_supcon(batches: DataFrame, name: str, size: int, temperature: float) -> DataFrame:
    """Batches with the supervised contrastive loss of their ``rows`` of unit vectors instead of these.

    Anchors without a partner of their class do not count; a batch without any pair has
    loss 0. Pairs are elements of arrays inside the batch's row.
    """
    rest = [F.col(c) for c in batches.columns if c != "rows"]
    too_large = F.raise_error(F.lit(f"a batch has more than {size} rows"))
    rows = batches.select(*rest, F.when(F.size("rows") > size, too_large).otherwise(F.col("rows")).alias("rows"))
    logits = F.transform("rows.v", lambda a: F.transform("rows.v", lambda b: _dot(a, b) / F.lit(temperature)))
    pairs = rows.select(*rest, F.col("rows.y").alias("labels"), logits.alias("logits"))
    anchors = F.transform("logits", lambda x, i: _of_anchor(x, i, F.col("labels")))
    counted = pairs.select(*rest, F.filter(anchors, lambda x: x["n"] > 0).alias("anchors"))
    total = F.aggregate("anchors", F.lit(0.0), lambda s, x: s + x["log_sum"] - x["partners"] / x["n"])
    loss = F.when(F.size("anchors") > 0, total / F.size("anchors")).otherwise(0.0)
    return counted.select(*rest, loss.alias(name))


def supcon(
    batches: DataFrame,
    vector: str,
    label: str,
    batch: str = "batch_id",
    temperature: float = TEMPERATURE,
    size: int = BATCH_SIZE,
) -> DataFrame:
    """Supervised contrastive loss per batch of ``training_batches``.

    A batch is gathered as one row, so it must not exceed ``size`` rows: the products
    of a batch are array expressions inside its row and no pair is ever a row.
    A larger batch is an error and not a silent sample.
    """
    rows = batches.groupBy(batch).agg(_gathered(vector, label).alias("rows"))
    return _with_supcon(rows, "loss", size, temperature)


def loss_parts(
    batches: DataFrame,
    vector: str,
    label: str,
    logits: str,
    gen_label: str,
    gen_logits: str,
    batch: str = "batch_id",
    temperature: float = TEMPERATURE,
    size: int = BATCH_SIZE,
) -> DataFrame:
    """The three losses of every batch, from one grouping."""
    rows = batches.groupBy(batch).agg(
        F.avg(negative_log_softmax(logits, label)).alias("ce"),
        F.avg(negative_log_softmax(gen_logits, gen_label)).alias("adversarial"),
        _gathered(vector, label).alias("rows"),
    )
    return _with_supcon(rows, "contrastive", size, temperature).select(batch, "ce", "contrastive", "adversarial")


def variants_array() -> Column:
    """The four variants as an array of ``(name, losses)``."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.struct(
                    F.lit(ce).alias("ce"),
                    F.lit(contrastive).alias("contrastive"),
                    F.lit(adversarial).alias("adversarial"),
                ).alias("losses"),
            )
            for name, ce, contrastive, adversarial in VARIANTS
        ]
    )


def weighted_loss(parts: DataFrame) -> DataFrame:
    """Every variant's weighted loss of each row of ``ce, contrastive, adversarial``.

    A part with weight 0 is left out: null, and not in the total.
    """
    each = parts.withColumn("v", F.explode(variants_array()))
    kept = {
        part: F.when(F.col(f"v.losses.{part}") > 0, F.col(part))
        for part in ("ce", "contrastive", "adversarial")
    }
    total = sum(
        (F.coalesce(F.col(f"v.losses.{part}") * value, F.lit(0.0)) for part, value in kept.items()),
        F.lit(0.0),
    )
    rest = [c for c in parts.columns if c not in kept]
    return each.select(
        *rest,
        F.col("v.name").alias("variant"),
        *[value.alias(part) for part, value in kept.items()],
        total.alias("total"),
    )
