"""Array expressions: norms, softmax, cross-entropy terms."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector) -> Column:
    """The vector as ``ARRAY<DOUBLE>``."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(vector) -> Column:
    """Unit-length vector; the norm is floored at 1e-12."""
    v = doubles(vector)
    norm = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return F.zip_with(
        v,
        F.array_repeat(F.greatest(norm, F.lit(1e-12)), F.size(v)),
        lambda x, scale: x / scale,
    )


def softmax(logits) -> Column:
    """Probabilities of an array of logits, with the maximum subtracted."""
    v = doubles(logits)
    powers = F.transform(
        F.arrays_zip(v.alias("x"), F.array_repeat(F.array_max(v), F.size(v)).alias("top")),
        lambda e: F.exp(e["x"] - e["top"]),
    )
    return F.zip_with(
        powers, F.array_repeat(_sum(powers), F.size(powers)), lambda e, total: e / total
    )


def negative_log_softmax(logits, label) -> Column:
    """-log softmax(logits)[label], stable for large logits."""
    v = doubles(logits)
    label = F.col(label) if isinstance(label, str) else label
    top = F.array_max(v)
    powers = F.zip_with(v, F.array_repeat(top, F.size(v)), lambda x, m: F.exp(x - m))
    return F.log(_sum(powers)) + top - F.get(v, label)
