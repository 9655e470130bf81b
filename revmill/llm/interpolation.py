"""Deleted interpolation: word bigrams, unigrams and a floor, mixed by how often the context occurs.

Texts are gathered into compressed blocks that are stored once. Each block asks for the
counts of its different n-grams (64-bit hashes, dealt out by hash); its own training
counts travel with the question, so one exchange both counts and answers. The mixture
weights of each context-frequency bucket come from expectation-maximisation on held-out
training blocks, whose own counts are deleted from the estimates they are scored by.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.llm import words as W
from revmill.llm.blocks import BITS, gathered, opened, pack, split_up, unpack, unpack_hashes
from revmill.llm.tables import fold, named, read, stored

FOLDS, HELD_OUT = 7, 2
#: Of the training documents those with this remainder give the held-out counts of the weights.
WEIGHING = 3
#: Bytes of asked hashes that one task answers, on average.
ANSWER_BYTES = 8 << 20
#: Context-frequency buckets: powers of two of the context's count.
BUCKETS = 24
#: Estimates are put into cells of this many steps to a factor of two for the weights.
CELLS = 4
ROUNDS = 40
_TRAIN, _WEIGH, _TEST = 0, 1, 2
_U = np.uint64
#: Hash of the end of a text, which is also the context of a first word.
_END = _U(0x0123456789ABCDEF)


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored blocks whose kind is training, weighing or test."""
    remainder = fold(key, FOLDS)
    kind = F.when(remainder == HELD_OUT, _TEST).when(remainder == WEIGHING, _WEIGH).otherwise(_TRAIN)
    return gathered(docs, key, text, kind)


def _tokens(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: (texts, tokens of each, word hashes with ends, hashes of the context and word)."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < W.BLOCK_BYTES):
            size += len(texts[last]) + 1
            last += 1
        run = texts[first:last]
        joined = b"\n".join(run) + b"\n"
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in run])])
        starts, _, hashes = W.word_hashes(joined, W.spaced())
        at = np.searchsorted(starts, offsets[1:])
        words = np.insert(hashes, at, _END) >> _U(64 - BITS)
        counts = np.diff(np.concatenate([[0], at])) + 1
        before = np.concatenate([[_END >> _U(64 - BITS)], words[:-1]])
        pairs = W.chained(before, words) >> _U(64 - BITS)
        yield len(run), counts, words, pairs
        first = last


def _asked(texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Different words and different pairs of a block with their counts."""
    words, pairs = [], []
    for _, _, w, p in _tokens(texts):
        words.append(w)
        pairs.append(p)
    return tuple(np.unique(np.concatenate(x), return_counts=True) for x in (words, pairs))


def questions(held: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, kind, order, hashes, counts) of each block: its different n-grams by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for order, (hashes, counts) in enumerate(_asked(opened(data)[1]), 1):
                    full, asked, mine = split_up(hashes, counts, buckets)
                    same = [[block] * len(full), [kind] * len(full), [order] * len(full)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int32()),
                            *(pa.array(x, t) for x, t in zip(same, (pa.int64(), pa.int32(), pa.int32()), strict=True)),
                            pa.array(asked, pa.binary()),
                            pa.array(mine, pa.binary()),
                        ],
                        ["bucket", "block", "kind", "order", "hashes", "counts"],
                    )

    schema = "bucket int, block long, kind int, order int, hashes binary, counts binary"
    return held.select("block", "kind", "texts").mapInArrow(run, schema)


def answers(asked: DataFrame) -> DataFrame:
    """(block, kind, order, bucket, total, weigh, known, seen): counts for each question, stored.

    `total` counts all training texts, `weigh` (for weighing blocks) only the weighing
    ones. A row of block -1 has the known different n-grams and all n-grams of its bucket.
    """
    schema = "block long, kind int, order int, bucket int, total binary, weigh binary, known long, seen long"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, order = key[0].as_py(), key[1].as_py()
        kinds, questions = rows["kind"].to_pylist(), rows["hashes"].to_pylist()
        mine = rows["counts"].to_pylist()
        train = [k for k, kind in enumerate(kinds) if kind != _TEST]
        # Counts of one kind after another, added to the sorted hashes known so far.
        held, total, weigh = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, len(train), 64):
            group = train[start : start + 64]
            hashes = [unpack_hashes(questions[k]) for k in group]
            counts = [unpack(mine[k], "<u4").astype(np.int64) for k in group]
            weighs = [c if kinds[k] == _WEIGH else np.zeros_like(c) for k, c in zip(group, counts, strict=True)]
            together = np.concatenate([held, *hashes])
            order_of = np.argsort(together, kind="stable")
            together = together[order_of]
            first = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1]])) if len(together) else np.empty(0, np.int64)
            sums = [np.concatenate(x)[order_of] for x in ([total, *counts], [weigh, *weighs])]
            total, weigh = (np.add.reduceat(x, first) if len(first) else x for x in sums)
            held = together[first]
        made: dict[str, list[Any]] = {n: [] for n in ("block", "kind", "total", "weigh")}
        for k, question in enumerate(questions):
            hashes = unpack_hashes(question)
            at = np.minimum(np.searchsorted(held, hashes), max(len(held) - 1, 0))
            found = held[at] == hashes if len(held) else np.zeros(len(hashes), dtype=bool)
            made["block"].append(rows["block"][k].as_py())
            made["kind"].append(kinds[k])
            for name, counts in (("total", total), ("weigh", weigh)):
                of = np.where(found, counts[at], 0) if len(held) else np.zeros(len(hashes), np.int64)
                made[name].append(pack(of.astype("<u4")) if name == "total" or kinds[k] == _WEIGH else None)
        n = len(questions) + 1
        W.release()
        return pa.table(
            {
                "block": pa.array([*made["block"], -1], pa.int64()),
                "kind": pa.array([*made["kind"], -1], pa.int32()),
                "order": pa.array([order] * n, pa.int32()),
                "bucket": pa.array([bucket] * n, pa.int32()),
                "total": pa.array([*made["total"], None], pa.binary()),
                "weigh": pa.array([*made["weigh"], None], pa.binary()),
                "known": pa.array([0] * (n - 1) + [int((total > 0).sum())], pa.int64()),
                "seen": pa.array([0] * (n - 1) + [int(total.sum())], pa.int64()),
            }
        )

    return stored(asked.groupBy("bucket", "order").applyInArrow(run, schema), "answers")


class _Counts:
    """What a block was told of its n-grams: words and pairs in the order of their hashes."""

    def __init__(self, texts: list[bytes], told: pa.Table, column: str):
        told = told.select(["order", "bucket", column])
        rows = sorted(zip(*(told[c].to_pylist() for c in told.column_names), strict=True))
        self.words, self.pairs = (
            np.concatenate([unpack(data, "<u4") for o, _, data in rows if o == order]).astype(np.int64) for order in (1, 2)
        )
        hashes = [(w, p) for _, _, w, p in _tokens(texts)]
        self.word_keys, self.pair_keys = (np.unique(np.concatenate(x)) for x in zip(*hashes, strict=True))

    def of(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (
            self.words[np.searchsorted(self.word_keys, words)],
            self.pairs[np.searchsorted(self.pair_keys, pairs)],
        )


def _before(of_word: np.ndarray, counts: np.ndarray, ends: int) -> np.ndarray:
    """Count of each token's context: the word before it, or the end for a text's first token."""
    context = np.concatenate([[ends], of_word[:-1]])
    context[np.cumsum(counts)[:-1]] = ends
    return context


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unknown context, else 1 + the binary logarithm of its count, BUCKETS - 1 at most."""
    out = np.zeros(len(context), dtype=np.int64)
    known = context > 0
    out[known] = np.minimum(np.log2(context[known]).astype(np.int64) + 1, BUCKETS - 1)
    return out


def _estimates(word, pair, context, total: int, distinct: int) -> np.ndarray:
    """Probabilities of each token by bigram, unigram and the floor 1 / (V + 1)."""
    return np.column_stack(
        [pair / np.maximum(context, 1), word / max(total, 1), np.full(len(word), 1 / (distinct + 1))]
    )


def cells(held: DataFrame, told: DataFrame, total: int, distinct: int) -> DataFrame:
    """(bucket, bigram, unigram, n): weighing tokens by context bucket and rounded log estimates.

    The estimates leave out the weighing texts' own counts. At most BUCKETS times a few
    thousand cells, whatever the input.
    """

    def step(p: np.ndarray) -> np.ndarray:
        out = np.full(len(p), -1, dtype=np.int64)
        out[p > 0] = np.round(-np.log2(p[p > 0]) * CELLS).astype(np.int64)
        return out

    def run(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found: dict[tuple[int, int, int], int] = {}
        for data in ours["texts"].to_pylist():
            texts = opened(data)[1]
            every, own = _Counts(texts, theirs, "total"), _Counts(texts, theirs, "weigh")
            for _, counts, words, pairs in _tokens(texts):
                word, pair = (a - b for a, b in zip(every.of(words, pairs), own.of(words, pairs), strict=True))
                ends = int(word[np.cumsum(counts) - 1][0])
                context = _before(word, counts, ends)
                p = _estimates(word, pair, context, total, distinct)
                table = np.column_stack([_bucket(context), step(p[:, 0]), step(p[:, 1])])
                kinds, n = np.unique(table, axis=0, return_counts=True)
                for row, m in zip(map(tuple, kinds.tolist()), n.tolist(), strict=True):
                    found[row] = found.get(row, 0) + m
        rows = list(zip(*found, strict=True)) or [(), (), ()]
        arrays = [pa.array(x, pa.int32()) for x in rows] + [pa.array(list(found.values()), pa.int64())]
        return pa.Table.from_arrays(arrays, ["cell", "bigram", "unigram", "n"])

    ours = held.where(F.col("kind") == _WEIGH).select("block", "texts")
    theirs = told.where(F.col("kind") == _WEIGH).select("block", "order", "bucket", "total", "weigh")
    made = ours.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(run, "cell int, bigram int, unigram int, n long")
    return made.groupBy("cell", "bigram", "unigram").agg(F.sum("n").alias("n"))


def weights(rows: list[tuple[int, int, int, int]], distinct: int) -> np.ndarray:
    """Mixture weights (bigram, unigram, floor) of each bucket by expectation-maximisation.

    A bucket without held-out tokens takes the weights of all of them; the floor keeps a
    little weight, so that every token has a probability.
    """
    out = np.full((BUCKETS, 3), 1 / 3)
    if not rows:
        return out
    data = np.array(rows, dtype=np.int64)
    p = np.where(data[:, 1:3] < 0, 0.0, 2.0 ** (-data[:, 1:3] / CELLS))
    p = np.column_stack([p, np.full(len(p), 1 / (distinct + 1))])

    def maximised(at: np.ndarray) -> np.ndarray:
        share, n = np.full(3, 1 / 3), data[at, 3]
        for _ in range(ROUNDS):
            each = p[at] * share
            share = (n[:, None] * each / each.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        share = np.maximum(share, [0.0, 0.0, 1e-6])
        return share / share.sum()

    out[:] = maximised(np.arange(len(data)))
    for bucket in np.unique(data[:, 0]):
        out[bucket] = maximised(np.flatnonzero(data[:, 0] == bucket))
    # Without a known context there is no bigram.
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())] if out[0, 1:].sum() else [0.0, 0.5, 0.5]
    return out


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of `docs`.

    A null or empty text has one token, the end. Without training texts all counts are
    zero and only the floor is left. An empty table gives no row.
    """
    spark = docs.sparkSession
    kind = docs.select(named(key)).schema[0].dataType
    held = blocks(docs, key, text)
    size = held.agg(F.sum(F.octet_length("texts")), F.count("*")).first()
    # A compressed block asks for about twice its bytes of hashes.
    buckets = max(1, int(2 * (size[0] or 0) // ANSWER_BYTES))
    told = answers(questions(held, buckets))
    summary = told.where("block = -1 AND order = 1").agg(F.sum("known"), F.sum("seen")).first()
    distinct, total = int(summary[0] or 0), int(summary[1] or 0)
    weighed = told.where("block >= 0")
    rows = [tuple(r) for r in cells(held, weighed, total, distinct).collect()] if total else []
    mix = spark.sparkContext.broadcast(weights(rows, distinct))
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("held_out", T.BooleanType(), False)]
        + [T.StructField(n, T.LongType(), False) for n in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType(), False) for n in ("base_score", "score")]
    )

    def run(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        made: dict[str, list[Any]] = {f.name: [] for f in schema}
        for kind, data in zip(ours["kind"].to_pylist(), ours["texts"].to_pylist(), strict=True):
            keys, texts = opened(data)
            every = _Counts(texts, theirs, "total")
            made["key"] += keys
            made["held_out"] += [kind == _TEST] * len(keys)
            for _, counts, words, pairs in _tokens(texts):
                word, pair = every.of(words, pairs)
                starts = np.cumsum(counts) - counts
                context = _before(word, counts, int(word[starts[0] + counts[0] - 1]))
                p = (_estimates(word, pair, context, total, distinct) * mix.value[_bucket(context)]).sum(axis=1)
                base = np.log10((word + 1) / (total + distinct + 1))
                made["n_tokens"] += counts.tolist()
                made["n_known"] += np.add.reduceat((word > 0).astype(np.int64), starts).tolist()
                made["base_score"] += np.add.reduceat(base, starts).tolist()
                made["score"] += np.add.reduceat(np.log10(p), starts).tolist()
        made["train_tokens"] = [total] * len(made["key"])
        W.release()
        return pa.table({c: pa.array(v) if c != "key" else pa.array(v, pa.string()) for c, v in made.items()})

    ours = held.select("block", "kind", "texts").groupBy("block")
    theirs = weighed.select("block", "order", "bucket", "total").groupBy("block")
    out = ours.cogroup(theirs).applyInArrow(run, schema)
    return out.select(F.col("key").cast(kind).alias(key), *schema.names[1:])


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of the training documents."""
    return scored(read(spark, sf_dir, "documents"))
