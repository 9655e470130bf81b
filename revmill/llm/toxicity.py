"""Compression-distance toxicity: what dictionaries of toxic words save beside an ordinary one.

The ordinary dictionary is trained on windows of ordinary texts. The toxic ones hold every
word that tells toxic texts, one dictionary for each whole bit of evidence: a selection of
words by their labelled rows decides what can be recognised. Every different word of a
document is compressed, spelled twice, inside a fixed carrier that all dictionaries hold;
it is toxic if a toxic dictionary shortens it to what a held word costs. A document's
distance is the sum of the bits of such words beside those of the surest word. A step
function, calibrated on labelled rows that did not choose the words, makes it a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import zstandard as Z
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.llm import words as W
from revmill.llm.tables import fold, free_name, mapped, named, read, training_labels

WINDOW_WORDS = 8
#: Documents that a fit reads at most, those with the smallest hashes of their keys.
FIT_DOCUMENTS = 12_000
#: Longer documents do not train; they are scored whole like any other.
FIT_BYTES = 1 << 18
ORDINARY_BYTES, FIT_WINDOWS = 8_192, 100_000
#: Share of the words of the toxic dictionary that may be there by chance.
CHANCE = 0.05
STEPS = 20
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Words of a text are taken from so many bytes at a time; a worker remembers the bits
#: of words of so many bytes and forgets them all when there are more.
PART_BYTES, KNOWN_BYTES = 1 << 20, 1 << 25
_ALPHABETS = [bytes(b ^ other for b in range(256)) for other in (0, 0x55, 0x2A, 0x7F)]
_HEAD, _FOOT = b"[a fixed carrier holds ", b" and all dictionaries hold it]"
#: Bytes of words, lower-cased; all others as a space.
_SPELLED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if W.alphanumeric()[b] else 0x20 for b in range(256))


def _windows(joined: bytes, offsets: np.ndarray, size: int) -> list[list[bytes]]:
    """Windows of `size` words of each joined text, lower-cased."""
    data = W.lowered()[np.frombuffer(joined, dtype=np.uint8)]
    starts, ends = W.bounds(data, W.spaced())
    text, at = data.tobytes(), np.searchsorted(starts, offsets)
    out = []
    for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        begin = starts[first:last:size].tolist()
        stop = ends[[min(i + size, last) - 1 for i in range(first, last, size)]].tolist() if last > first else []
        out.append([text[a:b] for a, b in zip(begin, stop, strict=True)])
    return out


def _twice(word: bytes) -> bytes:
    """A word in two alphabets: what is only longer or shorter by a letter differs in two places.

    Short words are spelled in four, or a saving would not show.
    """
    return b"\1".join(word.translate(table) for table in _ALPHABETS[: 2 if len(word) > 3 else 4]) + b"\2"


def _compressor(content: bytes):
    """Compression with a dictionary that is within reach as a whole, however long it is."""
    content += _HEAD + _FOOT
    reach = max(14, (len(content) + 4096).bit_length())
    options = Z.ZstdCompressionParameters.from_level(
        3, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=5, strategy=Z.STRATEGY_LAZY2,
        window_log=reach, hash_log=reach, chain_log=reach, search_log=6,
    )
    shared = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=options)
    return Z.ZstdCompressor(dict_data=shared, compression_params=options).compress


class Distance:
    """An ordinary dictionary, words by bits of evidence, and the steps from distance to score."""

    def __init__(self, ordinary: bytes, levels: dict[int, list[bytes]], scores: list[float], window: int = WINDOW_WORDS):
        self.ordinary, self.levels, self.scores, self.window = ordinary, levels, scores, window
        self._ready = False

    def __getstate__(self) -> dict[str, Any]:
        return {"ordinary": self.ordinary, "levels": self.levels, "scores": self.scores, "window": self.window}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__init__(**state)

    def _prepare(self) -> None:
        self._alone = _compressor(self.ordinary)
        self._all = self._reader([w for words in self.levels.values() for w in words])
        self._by_bits = [(bits, self._reader(words)) for bits, words in sorted(self.levels.items(), reverse=True)]
        # Words that no toxic dictionary holds: seen again, they are passed by.
        self._plain: set[bytes] = set()
        self._known = 0
        self._ready = True

    def _reader(self, words: list[bytes]):
        """Whether a word costs what a word of the dictionary does, and less than with the ordinary one alone."""
        both = _compressor(b" " + b" ".join(map(_twice, words)) + b" " + self.ordinary)
        most = max((len(both(self._carried(w))) for w in words), default=0)
        return lambda carried: len(both(carried)) <= most and len(both(carried)) < len(self._alone(carried))

    def _carried(self, word: bytes) -> bytes:
        return _HEAD + _twice(word) + _FOOT

    def _word(self, word: bytes) -> int:
        """Bits of the surest dictionary that holds a word, or 0."""
        carried = self._carried(word)
        return next((bits for bits, held in self._by_bits if held(carried)), 0) if self._all(carried) else 0

    def distances(self, texts: list[str | None]) -> np.ndarray:
        """Bits of the different words of each text, 1 for twice the surest word's or more; 0 without any."""
        out = np.zeros(len(texts))
        if not self.levels:
            return out
        if not self._ready:
            self._prepare()
        for k, text in enumerate(texts):
            found: dict[bytes, int] = {}
            for words in _parts(text):
                for word in set(words) - self._plain - found.keys():
                    if bits := self._word(word):
                        found[word] = bits
                    else:
                        self._plain.add(word)
                        self._known += len(word) + 100
                if self._known > KNOWN_BYTES:
                    self._plain, self._known = set(), 0
            out[k] = sum(found.values())
        return np.minimum(out / (2 * max(self.levels)), 1.0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores, 0 to 1."""
        step = np.minimum((self.distances(texts) * STEPS).astype(int), STEPS - 1)
        return np.asarray(self.scores)[step]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples; of the samples themselves if they are too few to train on."""
    plain = b" ".join(samples)[-size:]
    try:
        return Z.train_dictionary(size, samples).as_bytes()
    except Z.ZstdError:
        return plain


def _parts(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in order, lower-cased, those of about PART_BYTES at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_SPELLED)
    first = 0
    while first < len(data):
        end = len(data) if first + PART_BYTES >= len(data) else data.find(b" ", first + PART_BYTES)
        end = len(data) if end < 0 else end
        yield data[first:end].split()
        first = end


def _by_chance(k: int, n: int, share: float) -> float:
    """Chance that `k` or more of `n` rows are toxic when `share` of all rows are."""
    up, down = math.log(share), math.log1p(-share)
    ways = (math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * up + (n - j) * down for j in range(k, n + 1))
    return math.fsum(map(math.exp, ways))


def _telling(texts: list[str], label: np.ndarray) -> dict[int, list[bytes]]:
    """Words of which at least THRESHOLD of the rows are toxic, too many to be so by chance, by bits of evidence.

    However rare a word is beside others, it is one of them if its own rows show it; at
    most CHANCE of all chosen are expected to be there by chance. Rows in which a word
    stands between the same neighbours count once, so that copies of a row are no evidence.
    Only words of toxic texts are counted, so that what is held follows those.
    """
    rows: tuple[Counter, Counter] = Counter(), Counter()
    pairs = [0, 0]
    for toxic in (1, 0):
        for i in np.flatnonzero((label != 0) == bool(toxic)):
            words = {w for part in _parts(texts[i]) for w in part}
            pairs[toxic] += len(words)
            rows[toxic].update(words if toxic else words & rows[1].keys())
    maybe = {w for w, n in rows[1].items() if n > 1 and n >= THRESHOLD * (n + rows[0][w])}
    between: tuple[dict, dict] = {w: set() for w in maybe}, {w: set() for w in maybe}
    for text, y in zip(texts, label.tolist(), strict=True):
        for words in _parts(text):
            for before, word, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
                if word in maybe:
                    between[y != 0][word].add(hash((before, after)))
    share = max(float((label != 0).mean()), pairs[1] / max(sum(pairs), 1))
    chances = []
    for word in maybe:
        ours, theirs = (min(rows[y][word], len(between[y][word])) for y in (1, 0))
        if share < 1 and ours >= THRESHOLD * (ours + theirs):
            bits = math.log2((ours + 0.5) / (theirs + 0.5) * (1 - share) / share)
            chances.append((_by_chance(ours, ours + theirs, share), word, max(int(bits), 1)))
    chances.sort()
    sure = [k for k, (p, *_) in enumerate(chances, 1) if p * len(rows[1]) <= CHANCE * k]
    levels: dict[int, list[bytes]] = {}
    for _, word, bits in chances[: max(sure, default=0)]:
        levels.setdefault(bits, []).append(word)
    return levels


def _steps(distance: np.ndarray, label: np.ndarray) -> list[float]:
    """Rising rates of label 1 by step of distance: neighbours are pooled until they rise.

    A step without rows is as the next one with rows, or the last.
    """
    step = np.minimum((distance * STEPS).astype(int), STEPS - 1)
    pools: list[list[float]] = []
    for k in range(STEPS):
        rows = label[step == k]
        pools.append([float(rows.sum()), float(len(rows)), 1])
        if len(pools) > 1 and not pools[-2][1]:
            pools[-2:] = [[pools[-1][0], pools[-1][1], pools[-2][2] + 1]]
        while len(pools) > 1 and pools[-1][1] and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    if len(pools) > 1 and not pools[-1][1]:
        pools[-2][2] += pools.pop()[2]
    base = (float(label.sum()) + 0.5) / (len(label) + 1.0)
    return [(n + base) / (m + 1.0) for n, m, k in pools for _ in range(int(k))]


def fit(rows: Iterable[tuple[str | None, int]], window: int = WINDOW_WORDS) -> Distance:
    """Dictionaries and steps from (text, label) rows; without rows of both labels the score is the label's rate."""
    rows = [(text or "", int(label)) for text, label in rows]
    if not rows:
        return Distance(b"", {}, [0.0] * STEPS, window)
    texts, label = [t for t, _ in rows], np.array([y for _, y in rows])
    rate = [float((label.sum() + 0.5) / (len(label) + 1.0))] * STEPS
    ordinary = _sampled([t for t, y in rows if not y], window)
    levels = _telling(texts, label) if ordinary else {}
    if not levels:
        return Distance(b"", {}, rate, window)
    model = Distance(_trained(ordinary, ORDINARY_BYTES), levels, rate, window)
    del ordinary
    # Rows that chose a word would speak for it: each half is judged by the words of the other.
    half, distance = np.arange(len(texts)) % 2, np.zeros(len(texts))
    for k in (0, 1):
        mine, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        words = _telling([texts[i] for i in other], label[other])
        distance[mine] = Distance(model.ordinary, words, rate, window).distances([texts[i] for i in mine])
    model.scores = _steps(distance, label)
    return model


def _sampled(texts: list[str], window: int) -> list[bytes]:
    """At most FIT_WINDOWS windows of texts, each as likely as another."""
    rng, windows, order = np.random.default_rng(0), [], np.empty(0)
    for _, _, joined, offsets in W.blocks(texts):
        more = [w for doc in _windows(joined, offsets, window) for w in doc]
        windows, order = windows + more, np.concatenate([order, rng.random(len(more))])
        if len(windows) > FIT_WINDOWS:
            kept = np.sort(np.argpartition(order, FIT_WINDOWS)[:FIT_WINDOWS])
            windows, order = [windows[i] for i in kept], order[kept]
    return windows


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str | None, int]]:
    """At most FIT_DOCUMENTS labelled rows from outside the held-out fold, in the order of their keys."""
    known = training_labels(labels, "toxic", FOLDS, HELD_OUT, FIT_DOCUMENTS)
    rows = docs.select(
        named("doc_id").alias("doc_key"), F.coalesce(named("text").cast("string"), F.lit("")).alias("text")
    ).where(F.octet_length("text") <= FIT_BYTES)
    chosen = rows.join(F.broadcast(known), F.col("doc_key") == F.col("label_key"))
    # Copies of a key count once, and the fit does not depend on the order in which tasks end.
    chosen = chosen.groupBy("doc_key").agg(F.min(F.struct("text", "label")).alias("row"))
    table = chosen.select("doc_key", "row.text", "row.label").toArrow().sort_by("doc_key")
    return list(zip(table["text"].to_pylist(), table["label"].to_pylist(), strict=True))


def fit_on(docs: DataFrame, labels: DataFrame) -> Distance:
    """Fits on labelled documents outside the held-out fold; reads FIT_DOCUMENTS of them at most."""
    return fit(training_rows(docs, labels))


def _scorer(docs: DataFrame, model: Distance, name: str):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        return lambda texts: {name: shared.value.score(texts)}

    return prepare, T.StructType([T.StructField(name, T.DoubleType(), False)])


def scored(docs: DataFrame, model: Distance, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row; null and empty texts get the score of no saving."""
    prepare, fields = _scorer(docs, model, "score")
    return mapped(docs, [key], text, prepare, fields).select(
        named(key),
        (fold(key, FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Distance, text: str = "text") -> DataFrame:
    """Rows of `docs` that are not predicted toxic, with all columns."""
    name = free_name(docs, "toxicity")
    prepare, fields = _scorer(docs, model, name)
    kept = mapped(docs, [c for c in docs.columns if c != text] + [text], text, prepare, fields)
    return kept.where(named(name) < THRESHOLD).select(*[named(c) for c in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit_on(docs, read(spark, sf_dir, "labels")))
