"""Exact repeated substrings by a partitioned suffix sort.

A byte goes if a string of LENGTH bytes covers it that also starts earlier, in a document
with a smaller key or before in the same one. Each window of LENGTH bytes is led by one of
its GRAM-byte tokens, the one with the smallest hash, so that equal windows are led by
equal tokens at equal places. Neighbouring windows under one token are a run. Runs whose
token stands nowhere else cannot repeat and go no further; runs that are equal as a whole
within a block are one, its first.

What is left is range-partitioned by its leading token, with splitters sampled from all
tokens, and sorted in each range by a multikey quicksort that compares eight bytes at a
time: first whole runs, of which the first of equal ones stays, then the windows of
different runs under one token. A splitter is a whole token, so equal windows never lie on
two sides of a boundary. Tokens with very many different runs, as at the edges of a line
that many texts hold, are taken window by window instead, and only windows that occur
twice go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revmill.llm import words as W
from revmill.llm.blocks import BITS, contents, gathered, pack, split_up, texts_of, unpack, unpack_hashes
from revmill.llm.tables import named, read, stored

LENGTH, GRAM = 100, 24
#: Different runs of a token from which on its windows are counted one by one.
MANY = 1_000
#: Bytes of text that one range of the sort answers for, and of asked hashes in a task.
RANGE_BYTES, ANSWER_BYTES = 12 << 20, 8 << 20
#: Tokens of a block that take part in choosing splitters, and blocks that do.
SAMPLED, SAMPLED_BLOCKS = 64, 4_096
#: Bytes of text whose windows are looked at together.
SEGMENT = 1 << 18
_U = np.uint64
_PLACE = _U((1 << 21) - 1)
_SECOND = 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        up = np.full(n, x, dtype=np.uint64)
        up[0] = 1
        out.append(np.multiply.accumulate(up))
    return out[0], out[1]


_BASES: list[tuple[np.ndarray, np.ndarray]] = []


def _bases() -> list[tuple[np.ndarray, np.ndarray]]:
    if not _BASES:
        n = SEGMENT + 2 * LENGTH
        _BASES.extend(_powers(base, n) for base in (0x9E3779B97F4A7C15, _SECOND))
    return _BASES


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


class Runs:
    """Runs of windows in a block's joined texts, in order: first window, windows, token's place, hashes."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        self.data = np.frombuffer(data, dtype=np.uint8)
        made: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))]
        for a, b, valid in self._segments(offsets):
            made.append(self._segment(a, b, valid))
        self.first, self.count, self.token, self.gram, one, two = (np.concatenate(x) for x in zip(*made, strict=True))
        self.one, self.two = one, two

    def _segments(self, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, valid window starts) of stretches of at most SEGMENT window starts."""
        ends = offsets[1:] - 1  # without the newline
        begins = offsets[:-1]
        long = ends - begins >= LENGTH
        begins, stops = begins[long], ends[long] - LENGTH + 1
        k = 0
        waiting: list[tuple[int, int]] = []
        while k < len(begins) or waiting:
            if not waiting:
                waiting, k = [(int(begins[k]), int(stops[k]))], k + 1
            a = waiting[0][0]
            while k < len(begins) and stops[k] - a <= SEGMENT:
                waiting.append((int(begins[k]), int(stops[k])))
                k += 1
            last = waiting[-1]
            rest = []
            if last[1] - a > SEGMENT:  # a long text goes on in the next stretch
                waiting[-1], rest = (last[0], a + SEGMENT), [(a + SEGMENT, last[1])]
            yield a, waiting[-1][1] + LENGTH - 1, np.concatenate([np.arange(x, y) for x, y in waiting]) - a
            waiting = rest

    def _segment(self, a: int, b: int, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        part = self.data[a:b].astype(np.uint64) + _U(1)
        sums = []
        for up, _ in _bases():
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            sums.append(total)

        def substring(which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            return W.mix((sums[which][end] - sums[which][start]) * _bases()[which][1][start])

        n = len(part) - GRAM + 1
        grams = W.mix((sums[0][GRAM:] - sums[0][:n]) * _bases()[0][1][:n])
        place = _sliding_least((grams & ~_PLACE) | np.arange(n, dtype=np.uint64), LENGTH - GRAM + 1)
        leader = (place[valid] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(valid) != 1) | (np.diff(leader) != 0)]))
        count = np.diff(np.concatenate([first, [len(valid)]]))
        start, token = valid[first], leader[first]
        end = start + count - 1 + LENGTH
        one, two = substring(0, start, end), substring(1, start, end)
        shape = ((token - start) * 128 + count).astype(np.uint64)
        # Mixed again: least hashes are all small and would fall into one range.
        gram = W.mix(grams[token] + _U(1)) >> _U(64 - BITS)
        return start + a, count, token + a, gram, W.chained(one, shape), W.chained(two, shape)


class Block:
    """A block's texts in the order of their keys, and its runs without those it has before."""

    def __init__(self, data: bytes):
        table = contents(data)
        keys, texts = table["key_of_row"].to_pylist(), texts_of(table)
        # A null key comes after all others.
        numbers = np.array([np.iinfo(np.int64).max if k is None else int(k) for k in keys], dtype=np.int64)
        order = np.argsort(numbers, kind="stable")
        self.rest = table.drop(["key_of_row", "text_of_row"]).take(pa.array(order))
        self.keys = [keys[k] for k in order]
        self.null = table["text_of_row"].is_null().to_numpy()[order]
        self.numbers = numbers[order]
        texts = [texts[k] for k in order]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.joined = b"\n".join(texts) + b"\n"
        self.runs = Runs(self.joined, self.offsets)
        order = np.lexsort((self.runs.two, self.runs.one))
        same = np.zeros(len(order), dtype=bool)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            same[1:] = (self.runs.one[a] == self.runs.one[b]) & (self.runs.two[a] == self.runs.two[b])
        # lexsort is stable: the first of equal runs is the earliest.
        self.again, self.own = np.sort(order[same]), np.sort(order[~same])

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bytes, hashes, second hashes) of every window of some runs."""
        count = self.runs.count[runs]
        start = np.repeat(self.runs.first[runs] - np.cumsum(count) + count, count) + np.arange(count.sum())
        data, one, two = self.runs.data, np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        powers = [up[:LENGTH] for up, _ in _bases()]
        for k in range(0, len(start), 1 << 14):
            piece = data[start[k : k + (1 << 14), None] + np.arange(LENGTH)].astype(np.uint64) + _U(1)
            for out, up in zip((one, two), powers, strict=True):
                out[k : k + (1 << 14)] = W.mix((piece * up).sum(axis=1))
        return start, one, two


def _first_of(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of equal pairs of hashes, all others), both in order."""
    order = np.lexsort((two, one))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    return np.sort(order[~same]), np.sort(order[same])


_ASKED = "bucket int, block long, round int, hashes binary, counts binary"


def _question(block: int, number: int, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    hashes, counts = np.unique(hashes, return_counts=True)
    full, asked, mine = split_up(hashes, counts, buckets)
    columns = [
        pa.array(full, pa.int32()),
        pa.array([block] * len(full), pa.int64()),
        pa.array([number] * len(full), pa.int32()),
        pa.array(asked, pa.binary()),
        pa.array(mine, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "round", "hashes", "counts"])


def tokens_asked(held: DataFrame, buckets: int) -> DataFrame:
    """Questions for the tokens of each block's runs; rows of bucket -1 hold sampled tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(data)
                yield _question(number, 1, block.runs.gram[block.own], buckets)
                if len(block.own):
                    at = block.runs.token[block.own[np.linspace(0, len(block.own) - 1, SAMPLED).astype(int)]]
                    sample = b"".join(block.joined[k : k + GRAM] for k in at.tolist())
                    row = ([-1], pa.int32()), ([number], pa.int64()), ([1], pa.int32()), ([sample], pa.binary()), ([b""], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(*x) for x in row], ["bucket", "block", "round", "hashes", "counts"])
                del block
        W.release()

    return held.select("block", "texts").mapInArrow(run, _ASKED)


def answered(asked: DataFrame, most: int = MANY) -> DataFrame:
    """(block, round, bucket, totals, many): how often each asked hash was counted by all blocks, stored."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        questions, mine = rows["hashes"].to_pylist(), rows["counts"].to_pylist()
        held, total = np.empty(0, np.uint64), np.empty(0, np.int64)
        for k in range(0, len(questions), 64):
            hashes = np.concatenate([held, *(unpack_hashes(q) for q in questions[k : k + 64])])
            counts = np.concatenate([total, *(unpack(c, "<u4").astype(np.int64) for c in mine[k : k + 64])])
            order = np.argsort(hashes, kind="stable")
            hashes, counts = hashes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            held, total = hashes[first], np.add.reduceat(counts, first)
        at = [np.searchsorted(held, unpack_hashes(q)) for q in questions]
        # More than `most` is all that matters beyond it.
        totals = [np.minimum(total[k], most + 1).astype("<u2") for k in at]
        n = len(questions)
        columns = {
            "block": rows["block"].combine_chunks(),
            "round": pa.array([key[1].as_py()] * n, pa.int32()),
            "bucket": pa.array([key[0].as_py()] * n, pa.int32()),
            "totals": pa.array([pack(t) for t in totals], pa.binary()),
            "many": pa.array([int((t > most).sum()) for t in totals], pa.int64()),
        }
        del held, total, at, totals
        W.release()
        return pa.table(columns)

    return stored(
        asked.groupBy("bucket", "round").applyInArrow(run, "block long, round int, bucket int, totals binary, many long"),
        "answers",
    )


def _totals(told: pa.Table, number: int, hashes: np.ndarray) -> np.ndarray:
    """Answers of one round, for hashes that the block asked for."""
    rows = [(b, t) for r, b, t in zip(*(told[c].to_pylist() for c in ("round", "bucket", "totals")), strict=True) if r == number]
    if not rows:
        return np.zeros(len(hashes), dtype=np.int64)
    totals = np.concatenate([unpack(t, "<u2") for _, t in sorted(rows)]).astype(np.int64)
    return totals[np.searchsorted(np.unique(hashes), hashes)]


def windows_asked(held: DataFrame, told: DataFrame, buckets: int, most: int = MANY) -> DataFrame:
    """Questions for single windows under tokens of very many runs."""

    def run(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        made = []
        for data in ours["texts"].to_pylist():
            block = Block(data)
            totals = _totals(theirs, 1, block.runs.gram[block.own])
            _, one, two = block.windows(block.own[totals > most])
            if len(one):
                first, _ = _first_of(one, two)
                made.append(_question(key[0].as_py(), 2, one[first] >> _U(64 - BITS), buckets))
        W.release()
        return pa.Table.from_batches(made, schema=_question(0, 2, np.empty(0, np.uint64), 1).schema)

    return _with(held, told).applyInArrow(run, _ASKED)


def _with(held: DataFrame, told: DataFrame):
    """Blocks beside what they were told."""
    ours = held.select("block", "texts").groupBy("block")
    return ours.cogroup(told.select("block", "round", "bucket", "totals").groupBy("block"))


_SENT = "span int, block long, runs long, pieces binary"


def sent(held: DataFrame, told: DataFrame, splitters: list[bytes], most: int = MANY) -> DataFrame:
    """(range, block, runs, pieces): runs and windows that may repeat, by the range of their leading token."""
    bounds = np.array([_words(s) for s in splitters], dtype=np.uint64).reshape(len(splitters), GRAM // 8)

    def run(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        made: dict[str, list[Any]] = {n: [] for n in ("span", "block", "runs", "pieces")}
        for data in ours["texts"].to_pylist():
            block = Block(data)
            runs, own = block.runs, block.own
            totals = _totals(theirs, 1, runs.gram[own])
            some = own[(totals > 1) & (totals <= most)]
            first, count, token = runs.first[some], runs.count[some], runs.token[some]
            start, one, two = block.windows(own[totals > most])
            if len(start):
                earliest, _ = _first_of(one, two)
                often = earliest[_totals(theirs, 2, one[earliest] >> _U(64 - BITS)) > 1]
                first = np.concatenate([first, start[often]])
                count = np.concatenate([count, np.ones(len(often), np.int64)])
                token = np.concatenate([token, start[often]])
            if not len(first):
                continue
            text = runs.data
            lead = _rows(text, token, GRAM)
            span = _ranges(lead, bounds)
            order = np.lexsort((first, span))
            at = np.searchsorted(span[order], np.arange(len(bounds) + 2))
            of = np.searchsorted(block.offsets, first, side="right") - 1
            for k in np.flatnonzero(np.diff(at)).tolist():
                rows = order[at[k] : at[k + 1]]
                size = count[rows] - 1 + LENGTH
                taken = np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
                parts = (block.numbers[of[rows]], first[rows], count[rows].astype(np.uint8), (token[rows] - first[rows]).astype(np.uint8), text[taken])
                made["span"].append(k)
                made["block"].append(key[0].as_py())
                made["runs"].append(len(rows))
                made["pieces"].append(zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts)))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        W.release()
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(made.items(), types, strict=True)})

    return _with(held, told).applyInArrow(run, _SENT)


def _words(data: bytes) -> list[int]:
    """Bytes as eight-byte words that compare like the bytes."""
    return [int(x) for x in np.frombuffer(data, dtype=">u8")]


def _rows(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """`size` bytes from each place, as eight-byte words."""
    out = np.empty((len(at), size // 8), dtype=np.uint64)
    for k in range(size // 8):
        out[:, k] = _word(text, at + 8 * k)
    return out


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, the first byte the highest."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << _U(8)) | text[at + k]
    return out


def _ranges(lead: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many splitters are not over each leading token."""
    if not len(bounds):
        return np.zeros(len(lead), dtype=np.int64)
    both = np.concatenate([bounds, lead])
    after = np.concatenate([np.zeros(len(bounds), np.int8), np.ones(len(lead), np.int8)])
    order = np.lexsort((after, *(both[:, k] for k in range(both.shape[1] - 1, -1, -1))))
    passed = np.cumsum(after[order] == 0)
    out = np.empty(len(both), dtype=np.int64)
    out[order] = passed
    return out[len(bounds) :]


def multikey_sort(group: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by group, then by text; and the number of the class of equal ones of each place.

    A multikey quicksort on eight-byte characters: each round orders the members of the
    classes that are still equal by their next character and splits the classes; what
    stands alone takes no part any more. Strings of a class have one length.
    """
    active = np.arange(len(group))
    _, label = np.unique(group, return_inverse=True)
    label = label.astype(np.int64)
    depth = 0
    while len(active):
        size = np.bincount(label[active])
        active = active[(size[label[active]] > 1) & (length[active] > depth)]
        if not len(active):
            break
        # The last character may overlap the one before.
        at = start[active] + np.maximum(np.minimum(depth, length[active] - 8), 0)
        character = _word(text, at)
        order = np.lexsort((character, label[active]))
        ordered, values = label[active][order], character[order]
        new_class = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        split = np.concatenate([[True], (values[1:] != values[:-1]) | new_class[1:]])
        # The first part of a class keeps its number, the others get new ones.
        fresh = split & ~new_class
        numbers = np.where(fresh, np.cumsum(fresh) + label.max(), 0)
        place = np.where(split, np.arange(len(order)), 0)
        head = np.maximum.accumulate(place)
        label[active[order]] = np.where(numbers[head] > 0, numbers[head], ordered)
        depth += 8
    return np.argsort(label, kind="stable"), label


_FLAGS = "block long, flags binary"


def repeated(pieces: DataFrame) -> DataFrame:
    """(block, flags): windows that start earlier elsewhere, as (first, windows) pairs of a block."""

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        owner, number, first, count, place, texts = [], [], [], [], [], []
        for block, n, data in zip(*(rows[c].to_pylist() for c in ("block", "runs", "pieces")), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(data)
            owner.append(np.full(n, block, dtype=np.int64))
            number.append(np.frombuffer(raw, dtype="<i8", count=n))
            first.append(np.frombuffer(raw, dtype="<i8", count=n, offset=8 * n))
            count.append(np.frombuffer(raw, dtype=np.uint8, count=n, offset=16 * n).astype(np.int64))
            place.append(np.frombuffer(raw, dtype=np.uint8, count=n, offset=17 * n).astype(np.int64))
            texts.append(np.frombuffer(raw, dtype=np.uint8, offset=18 * n))
        owner, number, first, count, place, text = map(np.concatenate, (owner, number, first, count, place, texts))
        size = count - 1 + LENGTH
        start = np.cumsum(size) - size
        # From the earliest on: of equal strings the first in this order stays.
        order = np.lexsort((first, owner, number))
        owner, first, count, place, size, start = (x[order] for x in (owner, first, count, place, size, start))
        made = []
        # Whole runs of one shape.
        _, label = multikey_sort(place * 128 + count, text, start, size)
        _, earliest = np.unique(label, return_index=True)
        late = np.ones(len(label), dtype=bool)
        late[earliest] = False
        made.append((owner[late], first[late], count[late]))
        own = np.flatnonzero(~late)
        # Windows of different runs under one token.
        _, token = multikey_sort(np.zeros(len(own), np.int64), text, start[own] + place[own], np.full(len(own), GRAM))
        shared = np.bincount(token)[token] > 1 if len(own) else np.zeros(0, dtype=bool)
        own, token = own[shared], token[shared]
        run_of = np.repeat(np.arange(len(own)), count[own])
        step = np.arange(len(run_of)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        at = start[own][run_of] + step
        aligned = token[run_of] * 256 + (step - place[own][run_of] + 128)
        _, label = multikey_sort(aligned, text, at, np.full(len(at), LENGTH))
        _, earliest = np.unique(label, return_index=True)
        late = np.ones(len(label), dtype=bool)
        late[earliest] = False
        made.append((owner[own][run_of[late]], first[own][run_of[late]] + step[late], np.ones(int(late.sum()), np.int64)))
        flags = _flags(*(np.concatenate(x) for x in zip(*made, strict=True)))
        del text, at, label, aligned, run_of, step, late, made
        W.release()
        return flags

    return pieces.groupBy("span").applyInArrow(sort, _FLAGS)


def _flags(block: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Table:
    """Windows by block, neighbours joined."""
    order = np.lexsort((first, block))
    block, first, end = block[order], first[order], (first + count)[order]
    out: dict[str, list[Any]] = {"block": [], "flags": []}
    for b in np.unique(block).tolist():
        a, z = np.searchsorted(block, [b, b + 1])
        starts, ends = first[a:z], np.maximum.accumulate(end[a:z])
        new = np.concatenate([[True], starts[1:] > ends[:-1]])
        starts, ends = starts[new], ends[np.concatenate([new[1:], [True]])]
        out["block"].append(b)
        out["flags"].append(pack(np.column_stack([starts, ends - starts]).astype("<u4").ravel()))
    return pa.table({"block": pa.array(out["block"], pa.int64()), "flags": pa.array(out["flags"], pa.binary())})


def _covered(block: Block, flags: list[bytes], many: np.ndarray) -> np.ndarray:
    """Which bytes of the joined texts go."""
    depth = np.zeros(len(block.joined) + 1, dtype=np.int32)

    def mark(first: np.ndarray, count: np.ndarray) -> None:
        np.add.at(depth, first, 1)
        np.add.at(depth, first + count - 1 + LENGTH, -1)

    mark(block.runs.first[block.again], block.runs.count[block.again])
    start, one, two = block.windows(many)
    if len(start):
        _, again = _first_of(one, two)
        mark(start[again], np.ones(len(again), np.int64))
    for data in flags:
        pairs = unpack(data, "<u4").astype(np.int64).reshape(-1, 2)
        mark(pairs[:, 0], pairs[:, 1])
    return np.cumsum(depth)[:-1] > 0


def _marked(docs: DataFrame, key: str, text: str, most: int, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of all documents, and what each is told: counts (rounds 1 and 2) and flags (round 0)."""
    kind = docs.select(named(key)).schema[0].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"keys are whole numbers, but {key} is {kind.simpleString()}")
    held = gathered(docs, key, text, keep=keep)
    size = held.agg(F.sum(F.octet_length("texts")), F.count("*")).first()
    bytes_held = 3 * (size[0] or 0)  # texts shrink to about a third
    buckets, ranges = max(1, int(bytes_held // 8 // ANSWER_BYTES)), max(1, int(bytes_held // RANGE_BYTES))
    asked = stored(tokens_asked(held, buckets), "asked")
    # Blocks of the whole corpus, chosen by hash, shape the ranges.
    sampled = asked.where("bucket = -1").orderBy(F.xxhash64("block"), "block").limit(SAMPLED_BLOCKS)
    sample = [r["hashes"] for r in sampled.select("hashes").collect()]
    tokens = sorted({s[k : k + GRAM] for s in sample for k in range(0, len(s), GRAM)})
    splitters = sorted({tokens[len(tokens) * k // ranges] for k in range(1, ranges)}) if tokens else []
    told = answered(asked.where("bucket >= 0"), most)
    if told.agg(F.max("many")).first()[0]:
        told = told.unionByName(answered(windows_asked(held, told, buckets, most), most))
    flags = repeated(sent(held, told, splitters, most))
    empty = F.lit(None).cast("int")
    rows = flags.select("block", F.lit(0).alias("round"), empty.alias("bucket"), F.col("flags").alias("totals"))
    return held, told.select("block", "round", "bucket", "totals").unionByName(rows)


def _kept(block: Block, told: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that go, document of each byte) of a block."""
    rounds, totals = told["round"].to_pylist(), told["totals"].to_pylist()
    many = block.own[_totals(told, 1, block.runs.gram[block.own]) > most]
    return _covered(block, [t for r, t in zip(rounds, totals, strict=True) if r == 0], many), block.offsets


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MANY) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), a row per row of `docs`.

    Keys are whole numbers. Null and empty texts have no bytes. Of repeated keys the row
    that was gathered first is the earlier one; null keys come last. Other columns do not
    matter; an empty table gives no row.
    """
    held, told = _marked(docs, key, text, most)
    schema = T.StructType(
        [T.StructField("key", T.StringType())]
        + [T.StructField(n, T.LongType(), False) for n in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType(), False)]
    )

    def run(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        made: dict[str, list[Any]] = {f.name: [] for f in schema}
        for data in ours["texts"].to_pylist():
            block = Block(data)
            gone, offsets = _kept(block, theirs, most)
            starts = gone & ~np.concatenate([[False], gone[:-1]])
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, starts))
            raw = block.runs.data
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)):
                n = int(removed[b] - removed[a])
                left = raw[a:b][~gone[a:b]].tobytes() if n else block.joined[a:b]
                made["key"].append(block.keys[k])
                made["n_bytes"].append(b - a)
                made["n_removed"].append(n)
                made["n_spans"].append(int(spans[b] - spans[a]))
                made["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        W.release()
        return pa.table({c: pa.array(v, pa.string() if c in ("key", "kept_sha256") else pa.int64()) for c, v in made.items()})

    kind = docs.select(named(key)).schema[0].dataType
    out = held.select("block", "texts").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
    return out.select(F.col("key").cast(kind).alias(key), *schema.names[1:])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MANY) -> DataFrame:
    """`docs` with repeats cut out of the texts; all rows and columns stay.

    A character goes if all of its bytes go. Texts without a repeat stay as they are, null
    texts too.
    """
    others = [c for c in docs.columns if c != text]
    held, told = _marked(docs, key, text, most, others)
    arrow = to_arrow_schema(docs.schema)

    def run(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        made = []
        for data in ours["texts"].to_pylist():
            block = Block(data)
            gone, offsets = _kept(block, theirs, most)
            raw, texts = block.runs.data, []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)):
                if not gone[a:b].any():
                    texts.append(None if block.null[k] else block.joined[a:b].decode())
                    continue
                own = raw[a:b]
                starts = np.flatnonzero((own & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(gone[a:b], starts)
                left = ~np.repeat(whole, np.diff(np.concatenate([starts, [b - a]])))
                texts.append(own[left].tobytes().decode())
            columns = dict(zip(others, block.rest.columns, strict=True)) | {text: pa.array(texts, pa.string())}
            made.append(pa.table([columns[f.name].cast(f.type) for f in arrow], schema=arrow))
        W.release()
        return pa.concat_tables(made) if made else arrow.empty_table()

    return held.select("block", "texts").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, docs.schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 100 bytes remove from all documents."""
    return removals(read(spark, sf_dir, "documents"))
