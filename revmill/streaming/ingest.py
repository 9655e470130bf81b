"""The pool filter over a folder that keeps receiving files."""

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revmill.operators.filters import as_human
from revmill.operators.pool import dedup, filter_pool
from revmill.sources.reviews import parsed_lines

ARRIVAL = ["written", "file", "block"]


def _pool(lines: DataFrame) -> DataFrame:
    return as_human(filter_pool(parsed_lines(lines)), "arrival")


def first_arrivals(spark: SparkSession, in_dir: str) -> DataFrame:
    """What ``review_stream`` keeps of the files of a folder, read in one batch.

    Of copies that stays whose file was written first, by path and block if that is
    equal; inside one block it is the smallest row, as lines have no number there.
    """
    rows = _pool(spark.read.option("recursiveFileLookup", True).text(in_dir))
    return dedup(rows, order="arrival").drop("arrival")


def _earliest(order: list[str]):
    """Of each Arrow batch the first copy of every review, so that a hot review is few rows after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(c, "ascending") for c in ["review_id", *order]]
            rows = batch.take(pc.sort_indices(batch, sort_keys=keys, null_placement="at_start"))
            ids = rows.column("review_id")
            new = np.ones(len(ids), dtype=bool)
            new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            yield rows.filter(pa.array(new))

    return run


def _once(order: list[str]):
    """The first copy of a review in the micro-batch that brings it; nothing while its state lives."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, arrived = None, 0
        for frame in frames:
            arrived = int(frame["arrived_ms"].max())
            if not state.exists:
                both = frame if first is None else pd.concat([first, frame])
                first = both.sort_values(order, na_position="first").head(1) if len(both) > 1 else both
        if first is not None:
            state.update((True,))
            yield first.drop(columns=[*ARRIVAL, "arrived", "arrived_ms"])
        # Due when the watermark, which is the delay behind the clock, has passed this copy.
        state.setTimeoutTimestamp(arrived)

    return run


def review_stream(
    spark: SparkSession, in_dir: str, files_per_trigger: int = 1000, delay: timedelta = timedelta(days=7)
) -> DataFrame:
    """Pool reviews of a JSON-lines folder, each review once: the copy that arrives first.

    Files are taken in the order in which they were written. Inside a micro-batch the order is that of
    ``first_arrivals``, so stream and batch keep the same copy as long as no two files
    with copies are written in the same instant. A review is known until batches arrive
    ``delay`` after its last copy; then a timer drops its state, and a later copy counts
    as new. The review's own time plays no part: feeds are not sorted
    by it, and an old review that comes late is kept. Tasks send the first copy out of
    each of their Arrow batches, so a review that makes up much of the input is few
    rows where its state is.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True)
        .text(in_dir)
    )
    rows = _pool(lines)
    kept = [f for f in rows.schema if f.name != "arrival"]
    rows = rows.select(*[f.name for f in kept], "arrival.*")
    order = [*ARRIVAL, *[f.name for f in kept if f.name != "review_id"]]
    return (
        rows.mapInArrow(_earliest(order), rows.schema)
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", f"{int(delay.total_seconds() * 1000)} milliseconds")
        .withColumn("arrived_ms", F.unix_millis("arrived"))
        .groupBy("review_id")
        .applyInPandasWithState(
            _once(order),
            T.StructType(kept),
            "known boolean",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def ingest_stream(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append the new pool reviews to a Parquet folder and stop when caught up."""
    return (
        review_stream(spark, in_dir, **options)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
