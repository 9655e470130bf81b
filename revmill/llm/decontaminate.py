"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton recognises every run of words that some item holds. Training texts stream
through it word by word; at each word it knows the longest run ending there that stands
in an item. A run of a window's length (or a whole shorter item) is a hit; hit words are
counted, and can be cut out.

Words are compared by a 64-bit hash. Runs of words that no item has, or that are shorter
than any window, cannot hit and do not enter the automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.llm import words as W
from revmill.llm.tables import free_name, mapped, named, read, stored

WINDOW = 10
#: Bytes of items in one automaton, on average: what a broadcast holds is a fixed multiple
#: of it. More items make more automata, and texts pass them one after another.
SHARD_BYTES = 1 << 20
#: A document goes if more than this share of its words is hit.
MOST_COVERED = 0.5
SPANS = T.ArrayType(
    T.StructType([T.StructField("first", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False
)
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("word_spans", SPANS, False),
        T.StructField("item_ids", T.ArrayType(T.StringType(), False), False),
    ]
)


class Automaton:
    """Every run of words of the items; states know which items hold their windows."""

    def __init__(self, items: Iterable[tuple[str, np.ndarray]], window: int = WINDOW):
        items = [(key, hashes) for key, hashes in items if len(hashes)]
        self.window = window
        self.vocabulary = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *(h for _, h in items)]))
        self.shortest = min((len(h) for _, h in items), default=window)
        self.shortest = min(self.shortest, window)
        self._seen = np.zeros(1 << 16, dtype=bool)
        self._seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self._next: list[dict[int, int]] = [{}]
        self._length, self._link = [0], [-1]
        numbered = [(key, np.searchsorted(self.vocabulary, h).tolist()) for key, h in items]
        for _, numbers in numbered:
            last = 0
            for number in numbers:
                last = self._extend(last, number)
        self._name_items(numbered)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self._length.append(length)
        self._link.append(link)
        self._next.append(after)
        return len(self._length) - 1

    def _split(self, above: int, number: int) -> int:
        """The state of the run `above` + `number` by itself, apart from longer runs with it."""
        target = self._next[above][number]
        if self._length[target] == self._length[above] + 1:
            return target
        copy = self._state(self._length[above] + 1, self._link[target], dict(self._next[target]))
        self._link[target] = copy
        while above >= 0 and self._next[above].get(number) == target:
            self._next[above][number] = copy
            above = self._link[above]
        return copy

    def _extend(self, last: int, number: int) -> int:
        if number in self._next[last]:
            return self._split(last, number)
        made = self._state(self._length[last] + 1, 0, {})
        above = last
        while above >= 0 and number not in self._next[above]:
            self._next[above][number] = made
            above = self._link[above]
        if above >= 0:
            self._link[made] = self._split(above, number)
        return made

    def _name_items(self, numbered: list[tuple[str, list[int]]]) -> None:
        """Items by the state of a window, and whole items shorter than a window by theirs."""
        length, link, window = self._length, self._link, self.window
        self._window_of = [-1] * len(length)
        for state in sorted(range(len(length)), key=length.__getitem__):
            if length[state] >= window:
                above = link[state]
                self._window_of[state] = state if length[above] < window else self._window_of[above]
        self._items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for key, numbers in numbered:
            state = 0
            for number in numbers:
                state = self._next[state][number]
                if self._window_of[state] >= 0:
                    self._items.setdefault(self._window_of[state], set()).add(key)
            if len(numbers) < window:
                whole.setdefault(state, []).append((len(numbers), key))
        self._whole: dict[int, list[tuple[int, str]]] = {}
        if whole:
            for state in sorted(range(1, len(length)), key=length.__getitem__):
                if found := whole.get(state, []) + self._whole.get(link[state], []):
                    self._whole[state] = found

    def _follow(self, numbers: list[int], first: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        """Adds hits in consecutive known words: (first word, word after the last) and the items."""
        after, length, link, window = self._next, self._length, self._link, self.window
        state = longest = 0
        for i, number in enumerate(numbers, first + 1):
            while state and number not in after[state]:
                state = link[state]
                longest = length[state]
            if number in after[state]:
                state = after[state][number]
                longest += 1
            if longest >= window:
                spans.append((i - longest, i))
                items |= self._items[self._window_of[state]]
            if state in self._whole:
                for n, key in self._whole[state]:
                    if n <= longest:
                        spans.append((i - n, i))
                        items.add(key)

    def scan(self, texts: Sequence[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: its words, the word spans hit (merged, in order) and the items found."""
        out: list[tuple[int, list[tuple[int, int]], set[str]]] = []
        for first, end, joined, offsets in W.blocks(texts):
            starts, _, hashes = W.word_hashes(joined, W.alphanumeric())
            at = np.searchsorted(starts, offsets)
            found = [(int(at[k + 1] - at[k]), [], set()) for k in range(end - first)]
            for a, b in self._runs(hashes, at):
                numbers = np.searchsorted(self.vocabulary, hashes[a:b])
                known = numbers < len(self.vocabulary)
                known[known] = self.vocabulary[numbers[known]] == hashes[a:b][known]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
                doc = int(np.searchsorted(at, a, side="right")) - 1
                for c, d in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
                    if d - c >= self.shortest:
                        self._follow(numbers[c:d].tolist(), a + c - int(at[doc]), found[doc][1], found[doc][2])
            out += [(n, merged(spans), items) for n, spans, items in found]
        return out

    def _runs(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words within a text that an item may have, long enough for the shortest window."""
        if not len(hashes) or not len(self.vocabulary):
            return []
        maybe = self._seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        begins = np.zeros(len(hashes) + 1, dtype=bool)
        begins[at] = True
        before = np.concatenate([[False], maybe[:-1]])
        after = np.concatenate([maybe[1:], [False]])
        first = np.flatnonzero(maybe & (begins[:-1] | ~before))
        last = np.flatnonzero(maybe & (begins[1:] | ~after)) + 1
        long = last - first >= self.shortest
        return list(zip(first[long].tolist(), last[long].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> list[Automaton]:
    """One automaton per SHARD_BYTES of items. Null texts hold no words; a null id counts as empty text."""
    items = benchmark.select(
        F.coalesce(named(key).cast("string"), F.lit("")).alias("key"),
        F.coalesce(named(text).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    out = []
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(shards)) == shard).collect()
        out.append(
            Automaton(
                ((r["key"], W.word_hashes(r["text"].encode() + b"\n", W.alphanumeric())[2]) for r in rows), window
            )
        )
    return out


def located(docs: DataFrame, found_by: list[Automaton], keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, then n_words, word_spans (int64 pairs) and item_ids of each document."""
    spark = docs.sparkSession
    names = [[free_name(docs, f"{f}_of_{k}") for f in FOUND.names] for k in range(len(found_by))]
    for k, automaton in enumerate(found_by):
        shared = spark.sparkContext.broadcast(automaton)

        def prepare(shared=shared, names=names[k]):
            def compute(texts: list[str | None]) -> dict[str, Any]:
                counts, spans, items = zip(*shared.value.scan(texts), strict=True)
                spans = [[{"first": a, "end": b} for a, b in s] for s in spans]
                return dict(zip(names, (counts, spans, [sorted(i) for i in items]), strict=True))

            return compute

        fields = T.StructType([T.StructField(n, f.dataType, False) for n, f in zip(names[k], FOUND, strict=True)])
        more = [c for group in names[:k] for c in group]
        last = k == len(found_by) - 1
        docs = mapped(docs, [*keep, *([] if last or text in keep else [text]), *more], text, prepare, fields)
        docs = docs if last else stored(docs, "located")
    return docs.select(
        *[named(c) for c in keep if c not in FOUND.names],
        named(names[0][0]).alias("n_words"),
        F.concat(*[named(n[1]) for n in names]).alias("word_spans"),
        F.array_distinct(F.concat(*[named(n[2]) for n in names])).alias("item_ids"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW):
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), a row per row of `docs`.

    Null and empty texts have no words. Without items nothing is hit. Repeated rows get
    a row each; other columns do not matter.
    """
    found = located(docs, automata(benchmark, window=window), [key], text)
    words = F.flatten(F.transform("word_spans", lambda s: F.sequence(s["first"], s["end"] - 1)))
    return found.select(
        named(key),
        "n_words",
        F.size(F.array_distinct(words)).cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("item_ids"), ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("word_spans") > 0).alias("contaminated"),
    )


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text bytes without the words of spans that do not overlap."""
    starts, ends, _ = W.word_hashes(data + b"\n", W.alphanumeric())
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*parts, data[at:]])


def _without(automaton: Automaton, text: str) -> tuple[str, float]:
    """The text without hit spans, cut until none is left, and the share of its words that went."""
    data, total, left = text.encode("utf-8", "surrogatepass"), 0, 0
    while True:
        [(n, spans, _)] = automaton.scan([data.decode("utf-8", "surrogatepass")])
        total = total or n
        left = n
        if not spans:
            return data.decode("utf-8", "surrogatepass"), (total - left) / max(total, 1)
        data = _cut(data, spans)


def _cut_by_all(docs: DataFrame, found_by: list[Automaton], text: str, most: float) -> DataFrame:
    """`docs` cut by the union of what all automata find in the same text, until none finds anything."""
    columns = docs.columns
    plain = [f"column_{k}" for k in range(len(columns))]
    body = plain[columns.index(text)]

    @F.udf(T.StringType())
    def cut(value, spans):
        joined = merged([(s["first"], s["end"]) for s in spans])
        return _cut(value.encode("utf-8", "surrogatepass"), joined).decode("utf-8", "surrogatepass")

    left = docs.select(*[named(c).alias(p) for c, p in zip(columns, plain, strict=True)], F.lit(None).cast("long").alias("total"))
    clean = None
    while True:
        found = stored(located(left, found_by, [*plain, "total"], body), "decontaminated")
        found = found.withColumn("total", F.coalesce("total", "n_words"))
        over = (F.col("total") - F.col("n_words")) / F.greatest("total", F.lit(1)) > most
        done = found.where((F.size("word_spans") == 0) & ~over).select(*plain)
        clean = done if clean is None else clean.unionAll(done)
        # More is only ever cut: a document over the share is over it in the end.
        hit = found.where((F.size("word_spans") > 0) & ~over)
        if hit.isEmpty():
            return clean.select(*[F.col(p).alias(c) for c, p in zip(columns, plain, strict=True)])
        left = hit.select(*[cut(p, "word_spans").alias(p) if p == body else p for p in plain], "total")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most: float = MOST_COVERED
) -> DataFrame:
    """`docs` without benchmark passages, all columns kept.

    Spans of hit words are cut out of the text, again until nothing is hit; a document
    goes if over `most` of its words are cut. Documents without a hit stay as they are,
    null texts too. How many automata the items make does not show in the result.
    """
    spark, columns = docs.sparkSession, docs.columns
    found_by = automata(benchmark, window=window)
    if len(found_by) > 1:
        return _cut_by_all(docs, found_by, text, most)
    clean, share = free_name(docs, "clean_text"), free_name(docs, "covered")
    fields = T.StructType([T.StructField(clean, T.StringType()), T.StructField(share, T.DoubleType())])
    shared = spark.sparkContext.broadcast(found_by[0])

    def prepare():
        def compute(texts: list[str | None]) -> dict[str, Any]:
            out, shares = list(texts), [0.0] * len(texts)
            for i, (_, spans, _) in enumerate(shared.value.scan(texts)):
                if spans:
                    out[i], shares[i] = _without(shared.value, texts[i])
            return {clean: out, share: shares}

        return compute

    made = mapped(docs, columns, text, prepare, fields).where(named(share) <= most)
    return made.select(*[named(clean).alias(c) if c == text else named(c) for c in columns])


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in all documents."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
