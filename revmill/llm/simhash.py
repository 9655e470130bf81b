"""SimHash near-duplicates with a hierarchical index in Gray order.

A fingerprint holds, for each of 64 bits, what more than half of a text's shingle hashes
have there. Different fingerprints are sorted by Gray rank, where neighbours share long
bit patterns, and cut into ranges of equal size. Over every range stands a tree: the bits
that all fingerprints below a node agree on are factored into the node, and only the rest
is compared further down. A search adds up differences on the way and drops a whole group
as soon as there are too many. The upper nodes of all ranges make one small tree of the
same kind that sends a fingerprint only to the ranges that can hold a partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.llm.components import components
from revmill.llm.tables import free_name, mapped, named, read, stored

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Different fingerprints in a range, and ranges at most: what is broadcast has
#: at most RANGES times UPPER nodes.
RANGE, RANGES, UPPER = 200_000, 4_096, 16
FAN = 8
#: Node visits held in memory at once.
VISITS = 1 << 20
_SHINGLES = 1 << 16
_U = np.uint64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles, repeats included; 0 without words."""
    if not text:
        return 0
    words = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return 0
    at = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 0x20)
    starts = np.concatenate([[0], at + 1])
    ends = np.concatenate([at, [len(words)]])
    size = min(size, len(starts))
    starts, ends = starts[: len(starts) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), _SHINGLES):
        hashes = [digest(words[a:b], SEED) for a, b in zip(starts[k : k + _SHINGLES], ends[k : k + _SHINGLES], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], name: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Columns `keep` of each row and its fingerprint as a bigint of the same bits."""
    fields = T.StructType([T.StructField(name, T.LongType(), False)])

    def prepare():
        return lambda texts: {name: np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)}

    return mapped(docs, keep, text, prepare, fields)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(shift)
    return rank


class GrayTree:
    """Nodes over codes in Gray order; each knows the bits all of its group share.

    `keys` are codes (or, with `masks`, patterns whose other bits are open) in Gray order.
    """

    def __init__(self, keys: np.ndarray, masks: np.ndarray | None = None):
        shared = np.full(len(keys), ~_U(0)) if masks is None else masks
        self.levels = [(keys & shared, shared)]
        while len(self.levels[-1][0]) > FAN:
            self.levels.append(above(*self.levels[-1], FAN))
        # What a node compares is what its parent has not compared yet.
        for k in range(len(self.levels) - 1):
            value, mask = self.levels[k]
            parent = np.repeat(self.levels[k + 1][1], FAN)[: len(mask)]
            self.levels[k] = value, mask & ~parent

    def search(self, codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in `codes`, position in the keys) of all pairs with at most `most` differing bits."""
        if not len(self.levels[0][0]):
            return
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        step = max(1, VISITS // (FAN * width))
        for first in range(0, len(codes), step):
            who = np.arange(first, min(first + step, len(codes)))
            node = np.tile(np.arange(width), len(who))
            yield from self._descend(codes, np.repeat(who, width), node, np.zeros(len(node), np.uint8), top, most)

    def _descend(self, codes, who, node, differing, level, most):
        value, mask = self.levels[level]
        differing = differing + np.bitwise_count((codes[who] ^ value[node]) & mask[node])
        near = differing <= most
        who, node, differing = who[near], node[near], differing[near]
        if not level:
            if len(who):
                yield who, node
            return
        below = len(self.levels[level - 1][0])
        step = VISITS // FAN
        for k in range(0, len(who), step):
            child = (node[k : k + step, None] * FAN + np.arange(FAN)).ravel()
            there = child < below
            yield from self._descend(
                codes,
                np.repeat(who[k : k + step], FAN)[there],
                child[there],
                np.repeat(differing[k : k + step], FAN)[there],
                level - 1,
                most,
            )


def above(value: np.ndarray, mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes over each `size` neighbours: the bits that all of them fix alike."""
    at = np.arange(0, len(value), size)
    every, some = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value, at)
    mask = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
    return every & mask, mask


def _signed_rank(codes: np.ndarray) -> np.ndarray:
    """Gray rank as a signed number of the same order."""
    return (gray_rank(codes.view(np.uint64)) ^ (_U(1) << _U(63))).view(np.int64)


def _ranked(classes: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("code", T.LongType(), False), T.StructField("rank", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed_rank(codes))], ["code", "rank"])

    return classes.select("code").mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the given pairs connect: every node with the least of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], least)
        np.minimum.at(after, label[right], least)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links(classes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b): pairs of different codes that connect all codes with at most `most` differing bits.

    Within a range only as many pairs come out as connect what was found there, so a dense
    group does not give all of its pairs.
    """
    spark = classes.sparkSession
    ranked = stored(_ranked(classes), "ranked")
    count = ranked.count()
    ranges = min(RANGES, max(1, -(-count // RANGE)))
    wanted = [k / ranges for k in range(1, ranges)]
    cuts = ranked.agg(F.percentile_approx("rank", wanted, 100 * ranges)).first()[0] if wanted else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))
    span = T.StructField("span", T.IntegerType(), False)
    code = T.StructField("code", T.LongType(), False)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = np.searchsorted(bounds, batch.column(1).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans)], ["code", "span"])

    dealt = stored(ranked.mapInArrow(deal, T.StructType([code, span])), "dealt")

    def upper(key: tuple, rows: pa.Table) -> pa.Table:
        codes = rows["code"].to_numpy().view(np.uint64)
        codes = codes[np.argsort(gray_rank(codes))]
        value, mask = above(codes, np.full(len(codes), ~_U(0)), -(-len(codes) // UPPER))
        made = {"span": pa.array([key[0].as_py()] * len(value), type=pa.int32()), "first": np.arange(len(value))}
        return pa.table(made | {"value": value.view(np.int64), "mask": mask.view(np.int64)})

    nodes = dealt.groupBy("span").applyInArrow(upper, "span int, first long, value long, mask long")
    table = nodes.toArrow().sort_by([("span", "ascending"), ("first", "ascending")])
    owner = table["span"].to_numpy()
    patterns = tuple(table[c].to_numpy().view(np.uint64) for c in ("value", "mask"))
    router = spark.sparkContext.broadcast((GrayTree(*patterns), owner))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = router.value
        for batch in batches:
            codes, own = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for who, node in tree.search(codes, most):
                # Of two codes the one in the earlier range looks for the other.
                pairs = np.unique((who << 32 | of[node])[of[node] >= own[who]])
                who, spans = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[who].view(np.int64)), pa.array(spans), pa.array(spans == own[who])],
                    ["code", "span", "own"],
                )

    sent = dealt.mapInArrow(send, T.StructType([code, span, T.StructField("own", T.BooleanType(), False)]))

    def pairs(rows: pa.Table) -> pa.Table:
        codes, own = rows["code"].to_numpy().view(np.uint64), rows["own"].to_numpy(zero_copy_only=False)
        # A search may come to a range over several upper nodes: each code counts once.
        held, asking = np.unique(codes[own]), np.unique(codes)
        held = held[np.argsort(gray_rank(held))]
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for who, node in GrayTree(held).search(asking, most):
            other = asking[who] != held[node]
            found = asking[who][other].view(np.int64), held[node][other].view(np.int64)
            a, b = _forest(np.concatenate([a, found[0]]), np.concatenate([b, found[1]]))
        return pa.table({"a": a, "b": b})

    return sent.groupBy("span").applyInArrow(pairs, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MOST_BITS
) -> DataFrame:
    """(key, code, component, component_id) of each row.

    `code` is the fingerprint, `component` the least code and `component_id` the smallest
    key of all rows whose fingerprints are linked, directly or over others, by at most
    `most` differing bits. Null, empty and wordless texts have fingerprint 0. A null key
    is no smallest key unless the component has no other. An empty table gives no row.
    """
    prints = stored(with_fingerprint(docs, [key], "code", text, size).withColumnRenamed(key, "row_key"), "fingerprints")
    classes = stored(prints.groupBy("code").agg(F.min("row_key").alias("least_key")), "classes")
    tied = components(links(classes, most)).select(F.col("a").alias("code"), F.col("b").alias("component"))
    grouped = classes.join(tied, "code", "left").withColumn("component", F.coalesce("component", "code"))
    least = grouped.groupBy("component").agg(F.min("least_key").alias("component_id"))
    members = stored(grouped.select("code", "component").join(least, "component"), "members")
    return prints.join(members, "code").select(
        F.col("row_key").alias(key), "code", "component", "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MOST_BITS
) -> DataFrame:
    """One row of every component, with all columns: that of the smallest key, of copies of it any one.

    Texts are read for their fingerprints once; what goes is told by the keys that go, so
    `docs` stays where it is while those fit a broadcast. Only rows of a key that stands
    in several are told apart by a second fingerprint.
    """
    told, code, kept_code, kept_key = (free_name(docs, n) for n in ("told_key", "code_of_row", "kept_code", "kept_key"))
    found = stored(near_duplicates(docs, key, text, size, most), "near_duplicates")
    fates = found.groupBy(named(key).alias(told)).agg(
        F.count("*").alias("copies"), F.first("component_id").alias("component_id")
    )
    fates = fates.where((F.col("copies") > 1) | ~named(told).eqNullSafe(F.col("component_id")))
    fates = stored(fates.select(told, "copies"), "fates")
    same_key = named(key).eqNullSafe(named(told))
    left = docs.join(fates.select(told), same_key, "left_anti")
    several = fates.where("copies > 1").select(told)
    if several.isEmpty():
        return left
    first = found.where(F.col("component_id").eqNullSafe(named(key))).join(several, same_key, "left_semi")
    # One code of the component that the smallest key has, if it stands in several rows.
    chosen = first.groupBy("component").agg(F.min("code").alias(kept_code), F.first(named(key)).alias(kept_key))
    chosen = stored(chosen.select(kept_code, kept_key), "chosen")
    rows = docs.join(several, same_key, "left_semi")
    coded = with_fingerprint(rows, [*[c for c in docs.columns if c != text], text], code, text, size)
    same = named(code).eqNullSafe(named(kept_code)) & named(key).eqNullSafe(named(kept_key))
    single = coded.join(chosen, same, "left_semi").dropDuplicates([key, code])
    return left.unionByName(single.select(*[named(c) for c in docs.columns]))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
