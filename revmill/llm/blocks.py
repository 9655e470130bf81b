"""Compressed blocks of documents, and counting what blocks hold by one exchange.

A block asks for the counts of its different hashes. The questions are dealt out by
hash; whoever has all questions of a hash range adds them up and answers each block. What
moves is one sorted, packed array per block and range instead of a row per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmill.llm.tables import named, stored
from revmill.llm.words import release

#: Bytes of text in a block, on average.
BLOCK_BYTES = 8 << 20
#: Bits of a hash that is asked for.
BITS = 56
_U = np.uint64


def pack(x: np.ndarray) -> bytes:
    """An array of whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_hashes(x: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return pack(np.diff(x, prepend=_U(0)))


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Range by the leading bits, so that sorted hashes fall into runs."""
    return ((hashes >> _U(BITS - 32)) * _U(buckets)) >> _U(32)


def gathered(
    docs: DataFrame, key: str, text: str, kind: Column | None = None, keep: list[str] | None = None
) -> DataFrame:
    """(block, kind, keys, texts): stored runs of documents of one kind (0, 1 or 2).

    `texts` holds, compressed, the key as text, the text and the columns `keep` of each
    document. A block's number tells the task that made it and its place there.
    """
    names = ["block", "kind", "keys", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, size = TaskContext.get().partitionId() << 32, [0, 0, 0]
        waiting: list[list[pa.RecordBatch]] = [[], [], []]

        def block(of: int) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(waiting[of]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            data = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            made, waiting[of], size[of] = made + 1, [], 0
            row = [pa.array([made], pa.int64()), pa.array([of], pa.int32()), pa.array([len(table)], pa.int64())]
            return pa.RecordBatch.from_arrays([*row, pa.array([data], pa.binary())], names)

        for batch in batches:
            kinds = batch.column(0).to_numpy()
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            rows = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
            for of in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == of)
                while len(at):
                    total = size[of] + np.cumsum(lengths[at] + 16)
                    n = min(len(at), int(np.searchsorted(total, BLOCK_BYTES)) + 1)
                    waiting[of].append(rows.take(pa.array(at[:n])))
                    size[of], at = int(total[n - 1]), at[n:]
                    if size[of] >= BLOCK_BYTES:
                        yield block(of)
        for of in range(3):
            if waiting[of]:
                yield block(of)
        release()

    rows = docs.select(
        (F.lit(0) if kind is None else kind).cast("int").alias("kind_of_row"),
        named(key).cast("string").alias("key_of_row"),
        named(text).cast("string").alias("text_of_row"),
        *[named(c).alias(f"kept_{k}") for k, c in enumerate(keep or [])],
    )
    return stored(rows.mapInArrow(run, "block long, kind int, keys long, texts binary"), "blocks")


def contents(data: bytes) -> pa.Table:
    """A block's rows: key as text, text, and kept columns."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def texts_of(table: pa.Table) -> list[bytes]:
    """Texts as UTF-8; a null one is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(table["text_of_row"].type) else pa.binary()
    return [t or b"" for t in table["text_of_row"].cast(kind).to_pylist()]


def opened(data: bytes) -> tuple[list[str | None], list[bytes]]:
    """Keys and texts of a block."""
    table = contents(data)
    return table["key_of_row"].to_pylist(), texts_of(table)


def split_up(hashes: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Sorted different hashes and their counts, packed by range: (ranges, hashes, counts)."""
    at = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(at)).tolist()
    counts = counts.astype("<u4")
    return (
        full,
        [pack_hashes(hashes[at[k] : at[k + 1]]) for k in full],
        [pack(counts[at[k] : at[k + 1]]) for k in full],
    )
