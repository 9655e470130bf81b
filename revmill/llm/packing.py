"""Best-fit packing with a swap-based local search.

Texts become token ids and an end id; only what is longer than a sequence is cut, into
full pieces and a shorter last one. Pieces are dealt out into groups of a fixed size,
and every group is packed by itself: best fit, longest first, then exchanges between
underfull sequences until no exchange raises the sum of squared fills. A group gives at
most a part of one sequence away, so the sequences stay near the total's bound whatever
the number of groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revmill.llm.tables import named, read, stored
from revmill.llm.tokens import shared_encoder, word_bpe
from revmill.llm.words import release

CAPACITY = 2048
#: Pieces that are packed together, on average.
GROUP = 20_000
#: Pieces of a sequence up to which the search moves two of them at once.
PAIRED = 12
#: Donors among which the search takes the emptiest.
CHOICE = 256
LONG = T.LongType()
SALT = "salt_of_piece"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"):
    """A row per piece: doc_id, piece, start, length, ids_crc32, and a salt that deals pieces out evenly.

    A null or empty text is one piece, the end id. A null key stays null; repeated rows
    are documents of their own.
    """
    kind = docs.select(named(key)).schema[0].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(n, LONG) for n in ("start", "length", "ids_crc32", SALT)]
        + [T.StructField("piece", T.IntegerType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, salt = shared_encoder(tokenizer), 0
        for batch in batches:
            rows, start, length, crc, number = [], [], [], [], []
            for row, ids in enumerate(encoder.with_end(batch.column(1).to_pylist())):
                for at in range(0, len(ids), capacity):
                    cut = ids[at : at + capacity]
                    rows.append(row)
                    number.append(at // capacity)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
            if rows:
                ids = batch.column(0).take(pa.array(rows)).cast(arrow.field(0).type)
                salts = np.arange(salt, salt + len(rows), dtype=np.int64)
                salt += len(rows)
                made = [ids, *(pa.array(x, type=pa.int64()) for x in (start, length, crc, salts)), pa.array(number, type=pa.int32())]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)
        release()

    return docs.select(named(key), named(text).cast("string").alias("text_of_row")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers: longest first, each into the fullest sequence that has room."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0  # bit n is set if some sequence has room n: its lowest bit from n on is the best fit
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                bits ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        room -= n
        with_room[room].append(at)
        bits |= 1 << room
    return bins


class _Underfull:
    """The sequences that have room, with their pieces and pairs of pieces found by length."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        # What can be moved together out of a sequence, by its length; a bit for every length there is.
        self.sets: dict[int, dict[tuple[int, ...], int]] = {}
        self.bits = 0
        for k in range(len(bins)):
            self._list(k)

    def _movable(self, k: int) -> list[tuple[int, ...]]:
        """Single pieces, and pairs where there are few: one of many small pieces fills a gap as well as two."""
        b = self.bins[k]
        return [(i,) for i in b] + ([p for p in combinations(b, 2)] if len(b) <= PAIRED else [])

    def _list(self, k: int) -> None:
        if self.fill[k] < self.capacity:
            for some in self._movable(k):
                n = sum(self.size[i] for i in some)
                self.sets.setdefault(n, {})[some] = k
                self.bits |= 1 << n

    def _unlist(self, k: int) -> None:
        if self.fill[k] < self.capacity:
            for some in self._movable(k):
                n = sum(self.size[i] for i in some)
                del self.sets[n][some]
                if not self.sets[n]:
                    del self.sets[n]
                    self.bits ^= 1 << n

    def best(self, k: int) -> tuple[int, tuple[int, ...], tuple[int, ...], int] | None:
        """(gain, pieces to take in, pieces to give back, donor) that fills sequence k the most.

        A move, a one-for-one, two-for-one or one-for-two exchange. It must raise the sum of
        squared fills: with it, the sequence is fuller than its donor was. Of CHOICE
        donors of an equal gain the emptiest counts.
        """
        gap, found = self.capacity - self.fill[k], None
        for back in [(), *self._movable(k)]:
            given = sum(self.size[i] for i in back)
            least = given + (found[0] if found else 0)
            lengths = self.bits & ((2 << (given + gap)) - 1)
            while lengths >> (least + 1):
                n = lengths.bit_length() - 1
                gain = n - given
                fits = (
                    (self.fill[d], d, some)
                    for some, d in self.sets[n].items()
                    if d != k and self.fill[d] < self.fill[k] + gain and len(some) + len(back) < 4
                )
                if fits := list(islice(fits, CHOICE)):
                    _, donor, some = min(fits)
                    found = (gain, some, back, donor)
                    break
                lengths ^= 1 << n
            if found and found[0] == gap:
                break
        return found

    def exchange(self, k: int, gain: int, some: tuple[int, ...], back: tuple[int, ...], donor: int) -> None:
        self._unlist(k)
        self._unlist(donor)
        self.bins[k] = [i for i in self.bins[k] if i not in back] + list(some)
        self.bins[donor] = [i for i in self.bins[donor] if i not in some] + list(back)
        self.fill[k] += gain
        self.fill[donor] -= gain
        self._list(k)
        self._list(donor)


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchanges between underfull sequences until none raises the sum of squared fills; emptied ones go.

    The fullest are filled first, out of the emptiest. Every exchange raises a bounded
    whole number, so the search ends; it ends early when the room that is left holds no
    whole sequence, so that none can be emptied.
    """
    state = _Underfull([list(b) for b in bins], lengths.tolist(), capacity)
    changed = True
    while changed:
        changed = False
        underfull = [k for k, f in enumerate(state.fill) if 0 < f < capacity]
        room = sum(capacity - state.fill[k] for k in underfull)
        if not underfull or room - capacity < 0:
            break
        for k in sorted(underfull, key=lambda k: (-state.fill[k], k)):
            while 0 < state.fill[k] < capacity and (found := state.best(k)):
                state.exchange(k, *found)
                changed = True
    return [b for b in state.bins if b]


def packed(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset; `cut` is stored once, so that its salt does not change.

    Every sequence is filled from offset 0 without gaps. An empty table gives no row.
    """
    cut = stored(cut, "pieces")
    groups = max(1, cut.count() // group)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    number = F.pmod(F.xxhash64("doc_id", "piece", SALT), F.lit(groups))
    schema = T.StructType(
        [cut.schema[c] for c in columns] + [T.StructField("sequence_id", LONG), T.StructField("offset", LONG)]
    )

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence = np.empty(len(lengths), dtype=np.int64)
        offset = np.empty(len(lengths), dtype=np.int64)
        for k, b in enumerate(bins):
            at = np.asarray(b)
            sequence[at] = (key[0].as_py() << 32) + k
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        return rows.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return (
        cut.withColumn("group_of_piece", number)
        .groupBy("group_of_piece")
        .applyInArrow(pack, schema)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, packed."""
    return packed(pieces(docs, tokenizer, capacity), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), word_bpe())
