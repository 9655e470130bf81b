"""Quality scores from histogram gradient-boosted trees over statistics of a document.

Statistics are counted over whole texts in numpy, block by block. Training cuts each
statistic into at most BINS bins, grows complete trees level by level from per-bin sums
of gradients and Hessians, and keeps all trees in three flat arrays; scoring walks every
tree for all documents of a batch at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.llm import words as W
from revmill.llm.tables import fold, mapped, named, read, training_labels

#: Labelled documents that a fit reads at most, those with the smallest hashes of their keys.
FIT_DOCUMENTS = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAST = 64, 4, 60, 0.15, 1.0, 8
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
STATISTICS = (
    "bytes words lines lower upper digit space mark shout symbol control high word_mean word_spread long_words "
    "distinct_words top_word repeated_word distinct_pairs distinct_lines top_line line_words marked_words upper_words"
).split()
_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _SHOUT, _SYMBOL, _CONTROL, _HIGH = range(9)


def _classes() -> np.ndarray:
    table = np.full(256, _CONTROL, dtype=np.int64)
    table[0x21:0x7F] = _SYMBOL
    table[0x61:0x7B], table[0x41:0x5B], table[0x30:0x3A] = _LOWER, _UPPER, _DIGIT
    table[[0x20, 0x0A]] = _SPACE
    table[[ord(c) for c in ".,;:?'\"-()"]] = _MARK
    table[ord("!")], table[0x80:] = _SHOUT, _HIGH
    return table


_CLASS = _classes()


def _lines() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[0x0A] = False
    return table


_LINE = _lines()


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: how many different hashes, and how often the most frequent stands there."""
    different, most = np.zeros(n), np.zeros(n)
    if len(hashes):
        keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.concatenate([first, [len(keys)]]))
        of = (keys[first] >> np.uint64(40)).astype(np.int64)
        different = np.bincount(of, minlength=n).astype(float)
        np.maximum.at(most, of, counts)
    return different, most


def _block(joined: bytes, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    raw = np.frombuffer(joined, dtype=np.uint8)
    size = np.diff(offsets) - 1
    owner = np.repeat(np.arange(n), size + 1)
    kinds = np.bincount(owner * 9 + _CLASS[raw], minlength=n * 9).reshape(n, 9).astype(float)
    kinds[:, _SPACE] -= 1  # the newline that joins texts
    starts, ends, hashes = W.word_hashes(joined, W.spaced())
    of, length = owner[starts], (ends - starts).astype(float)
    words = np.bincount(of, minlength=n).astype(float)
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    mean = np.bincount(of, length, n) * per_word
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) * per_word - mean**2, 0))
    last, first = _CLASS[raw[ends - 1]], _CLASS[raw[starts]]
    marked = np.bincount(of, (last == _SHOUT) | (last == _SYMBOL), n)
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    upper = np.bincount(of, (first == _UPPER) & ((_CLASS[second] == _UPPER)), n)
    same = of[1:] == of[:-1]
    again = np.bincount(of[1:], same & (hashes[1:] == hashes[:-1]), n) if len(of) else np.zeros(n)
    different, most = _distinct(of, hashes, n)
    pairs, _ = _distinct(of[1:][same], W.chained(hashes[:-1], hashes[1:])[same], n)
    line_starts, line_ends = W.bounds(raw, _LINE)
    line_of = owner[line_starts]
    lines = np.bincount(line_of, minlength=n).astype(float)
    line_kinds, line_most = _distinct(line_of, W.hashes(raw, line_starts, line_ends), n)
    per_line = 1 / np.maximum(lines, 1)
    shares = kinds * per_byte[:, None]
    return np.column_stack(
        [size, words, lines, shares, mean, spread, np.bincount(of, length > 15, n) * per_word]
        + [different * per_word, most * per_word, again * per_word, pairs / np.maximum(words - 1, 1)]
        + [line_kinds * per_line, line_most * per_line, words * per_line, marked * per_word, upper * per_word]
    )


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row per text, columns as in STATISTICS; a null or empty text has zeros."""
    parts = [_block(joined, offsets) for _, _, joined, offsets in W.blocks(texts)]
    return np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))


class Trees:
    """Complete trees in flat arrays: node k of a tree has the children 2k+1 and 2k+2."""

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.cut, self.leaf = start, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row; a value over a node's cut goes right."""
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        node = np.zeros((len(x), trees), dtype=np.int64)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(depth):
            right = x[rows, self.feature[tree, node]] > self.cut[tree, node]
            node = 2 * node + 1 + right
        total = self.start + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _cuts(column: np.ndarray) -> np.ndarray:
    """Bin bounds between quantiles, as values halfway between neighbours that occur."""
    values = np.unique(column)
    between = (values[1:] + values[:-1]) / 2
    if len(between) > BINS - 1:
        wanted = np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])
        between = np.unique(between[np.minimum(np.searchsorted(between, wanted), len(between) - 1)])
    return between


def fit(x: np.ndarray, label: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss; without rows of both labels the score is the label's rate."""
    inner = (1 << DEPTH) - 1
    share = (label.sum() + 0.5) / (len(label) + 1)
    start = float(np.log(share / (1 - share)))
    feature, cut = np.zeros((TREES, inner), dtype=np.int64), np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, inner + 1))
    if len(np.unique(label)) < 2:
        return Trees(start, feature, cut, leaf)
    cuts = [_cuts(x[:, f]) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    bins = max(len(c) for c in cuts) + 1
    total = np.full(len(x), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = p - label, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            at = node - first
            best = np.full(width, 1e-6)
            for f, bounds in enumerate(cuts):
                if not len(bounds):
                    continue
                key, shape = at * bins + binned[:, f], width * bins
                g, h, c = (
                    np.bincount(key, w, shape).reshape(width, bins).cumsum(axis=1) for w in (gradient, hessian, None)
                )
                sums = [(a[:, : len(bounds)], a[:, -1:]) for a in (g, h, c)]
                (gl, ga), (hl, ha), (cl, ca) = sums
                gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
                gain[(cl < LEAST) | (ca - cl < LEAST)] = 0
                k = gain.argmax(axis=1)
                value = gain[np.arange(width), k]
                better = np.flatnonzero(value > best)
                best[better] = value[better]
                feature[t, first + better], cut[t, first + better] = f, bounds[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > cut[t, node])
        ends = node - inner
        g, h = np.bincount(ends, gradient, inner + 1), np.bincount(ends, hessian, inner + 1)
        leaf[t] = -RATE * g / (h + L2)
        total += leaf[t, ends]
    return Trees(start, feature, cut, leaf)


def training_statistics(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the training rows; only they come to the driver, no text."""
    known = training_labels(labels, "quality", FOLDS, HELD_OUT, FIT_DOCUMENTS)
    rows = docs.select(named("doc_id").alias("doc_key"), named("text").alias("text"))
    rows = rows.join(F.broadcast(known), F.col("doc_key") == F.col("label_key"))
    fields = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()), False)])

    def prepare():
        return lambda texts: {"x": list(statistics(texts))}

    made = mapped(rows, ["doc_key", "label"], "text", prepare, fields)
    # Copies of a key count once, and the fit does not depend on the order in which tasks end.
    made = made.groupBy("doc_key").agg(F.min(F.struct("label", "x")).alias("row"))
    table = made.select("doc_key", "row.label", "row.x").toArrow().sort_by("doc_key")
    x = np.array(table["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return x, table["label"].to_numpy().astype(float)


def fit_on(docs: DataFrame, labels: DataFrame) -> Trees:
    """Fits on labelled documents outside the held-out fold; reads FIT_DOCUMENTS of them at most."""
    return fit(*training_statistics(docs, labels))


def scored(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row; null and empty texts score by their zero statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def prepare():
        return lambda texts: {"score": shared.value.score(statistics(texts))}

    fields = T.StructType([T.StructField("score", T.DoubleType(), False)])
    return mapped(docs, [key], text, prepare, fields).select(
        named(key),
        (fold(key, FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit_on(docs, read(spark, sf_dir, "labels")))
