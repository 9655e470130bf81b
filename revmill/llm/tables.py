"""What the operators share: table access, training folds and Arrow passes over a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revmill.llm.words import release
from revmill.session import stored  # noqa: F401 - operators take it from here


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(key: str, folds: int) -> Column:
    """crc32 of a key as text, modulo `folds`; a null key counts as empty text."""
    text = F.coalesce(named(key).cast("string"), F.lit(""))
    return (F.crc32(F.encode(text, "UTF-8")) % folds).cast("int")


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(label_key, label) of at most `most` keys outside the held-out fold, those with the smallest hashes.

    Rows with a null key or label do not train; of a repeated key the largest label counts.
    """
    return (
        labels.select(named("doc_id").alias("label_key"), named(label).cast("int").alias("label"))
        .where(F.col("label_key").isNotNull() & F.col("label").isNotNull())
        .where(fold("label_key", folds) != held_out)
        .groupBy("label_key")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_key"), "label_key")
        .limit(most)
    )


def shuffled(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores before it a name that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def mapped(
    df: DataFrame,
    keep: list[str],
    text: str,
    prepare: Callable[[], Callable[[list[str | None]], dict[str, Any]]],
    fields: T.StructType,
) -> DataFrame:
    """Columns `keep` of `df`, then `fields` computed from the whole text column.

    `prepare` runs once in each task and returns the function that turns the texts
    of a batch into one list or array per field. A kept column that has the name of
    a field gives way to the field.
    """
    keep = [c for c in keep if c not in fields.names]
    # Plain names on the way, whatever the columns are called.
    kept = [named(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    made = T.StructType([T.StructField(f"made_{k}", f.dataType, f.nullable) for k, f in enumerate(fields)])
    schema = T.StructType([*df.select(*kept).schema.fields, *made.fields])
    arrow, names = to_arrow_schema(schema), fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            if batch.num_rows:
                found = compute(batch.column(batch.num_columns - 1).to_pylist())
                added = [pa.array(found[n], type=f.type) for n, f in zip(names, list(arrow)[len(keep) :], strict=True)]
                old = [c.cast(f.type) for c, f in zip(batch.columns[:-1], arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*old, *added], schema=arrow)
        compute = None
        release()

    out = df.select(*kept, named(text).cast("string").alias("text_of_row")).mapInArrow(run, schema)
    return out.select(
        *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)],
        *[F.col(f"made_{k}").alias(n) for k, n in enumerate(names)],
    )
