"""A trie of conversations by their common first turns, summed up bottom to top in bands of depths.

A node is a sequence of first turns that conversations share. Totals of subtrees go up
in bands of HEIGHT depths: a node is repeated only for its ancestors in its own band,
so no row has more than HEIGHT copies. The tops of bands are a trie of their own,
HEIGHT times lower, that is summed up the same way; then the total of each top goes to
the band above it. Rounds grow with the logarithm of the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revmill.llm.tables import read, stored

#: Depths in a band.
HEIGHT = 8
#: Conversations that start alike: the first turns of one of FAMILY neighbours are shared by all.
FAMILY = 100
MOST_SHARED = 6
#: Ids of a span whose members are joined into one text.
SPAN = 4096
EMPTY = hashlib.sha256().hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns in order, from 0; equal turn numbers by role, then text.

    Null roles and texts are empty; rows without conv_id take no part.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def shared_start(conv_id: str = "conv_id") -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return (F.crc32(F.encode(F.col(conv_id).cast("string"), "UTF-8")) % MOST_SHARED).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text): the turns of every rebuilt conversation, and depth 0 without a turn.

    Conversation c has the first h turns of conversation c - c % FAMILY, then its own
    from the h-th on; h follows from its id. The family's first turns are at most
    MOST_SHARED - 1 rows that go to at most FAMILY conversations.
    """
    turns = ordered_turns(conversations)
    ids = turns.where("place = 0").select("conv_id", shared_start().alias("h"))
    top = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = turns.withColumn("h", shared_start()).where("place >= h")
    first = turns.where((F.col("place") < MOST_SHARED - 1) & (F.col("conv_id") % FAMILY == 0))
    first = first.withColumnRenamed("conv_id", "family")
    taken = ids.where("h > 0").withColumn("family", top).join(first, "family").where("place < h")
    # A family's turns come before its members' own: a shorter family leaves a gap in the places.
    rows = own.select("conv_id", "place", "role", "text").unionByName(taken.select("conv_id", "place", "role", "text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("place")).alias("depth")
    none = ids.select("conv_id", F.lit(0).alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return rows.select("conv_id", place, "role", "text").unionByName(none)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n_turns, points, up): rows of `rebuilt` with the keys of the node and those above it.

    A node's key is its depth and 128 bits of hash over all turns so far: each turn is hashed with its
    place, and the hashes are put together by XOR along the conversation, which Spark
    does in one sorted pass with memory for one row. `up` holds the last keys down to
    the node itself, at most HEIGHT + 1, the top of its band or of the band above first.
    """
    hashed = turns.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.length("text")).cast("long").alias("points"),
        *[
            F.when(F.col("depth") == 0, F.lit(0).cast("long"))
            .otherwise(F.xxhash64(F.lit(seed), F.col("depth"), "role", F.lit(seed), "text"))
            .alias(name)
            for name, seed in (("x", 11), ("y", 2_903))
        ],
    )
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = hashed.select(
        "conv_id",
        "depth",
        "points",
        F.struct(F.col("depth"), F.bit_xor("x").over(along).alias("x"), F.bit_xor("y").over(along).alias("y")).alias("key"),
    )
    whole = Window.partitionBy("conv_id")
    return keyed.select("conv_id", "depth", F.max("depth").over(whole).alias("n_turns"), "points", "key", _up(1))


def _up(step: int) -> Column:
    """Keys of a conversation's nodes from the band's top, or the one before, down to this row."""
    back = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(-HEIGHT, 0)
    keys = F.collect_list("key").over(back)
    level = (F.col("depth") / step).cast("int")
    wanted = F.when((level % HEIGHT == 0) & (level > 0), F.lit(HEIGHT + 1)).otherwise(level % HEIGHT + 1)
    return F.slice(keys, -wanted, wanted).alias("up")


def nodes(rows: DataFrame) -> DataFrame:
    """(key, conv_id, n_convs, leaf, saved, up) of each node: members, the smallest of them, and its own amounts."""
    members = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("n_turns").alias("longest"),
        F.first("points").alias("points"),
        F.first("up").alias("up"),
    )
    return members.select(
        "key",
        "conv_id",
        "n_convs",
        (F.col("longest") == F.col("key.depth")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
        "up",
    )


def _within(rows: DataFrame, above: Column) -> DataFrame:
    """(key, n_leaves, saved_tokens, n_children) added up over the listed ancestors."""
    parts = rows.select(F.explode(above).alias("top"), "leaf", "saved", "parent")
    return parts.groupBy(F.col("top").alias("key")).agg(
        F.sum("leaf").alias("leaf"),
        F.sum("saved").alias("saved"),
        F.sum((F.col("top") == F.col("parent")).cast("long")).alias("n_children"),
    )


def _parent() -> Column:
    """The key before a node's own; the root has none."""
    return F.when(F.size("up") > 1, F.element_at("up", F.when(F.size("up") > 1, -2).otherwise(-1)))


def _band(up: str = "up", step: int = 1) -> Column:
    """The part of `up` in the node's own band, the node included."""
    level = (F.col("key.depth") / step).cast("int")
    return F.slice(up, -(level % HEIGHT + 1), level % HEIGHT + 1)


def summed(rows: DataFrame, tree: DataFrame, deepest: int, step: int = 1) -> DataFrame:
    """(key, leaf, saved, n_children) over whole subtrees, for nodes at every `step`-th depth.

    `tree` has each node's own amounts. Nodes go to the ancestors in their band; if
    there are bands below the first, their tops are summed up as a tree themselves, and
    the total of each top goes to the band above it.
    """
    tree = tree.withColumn("parent", _parent())
    local = _within(tree, _band(step=step))
    if deepest // step < HEIGHT:
        return local
    local = stored(local, "band_totals")
    wide = step * HEIGHT
    tops = rows.where(F.col("depth") % wide == 0).select("conv_id", "depth", "key")
    tops = tops.select("key", _up(wide)).groupBy("key").agg(F.first("up").alias("up"))
    own = local.where(F.col("key.depth") % wide == 0).select("key", "leaf", "saved")
    whole = summed(rows, tops.join(own, "key"), deepest, wide)
    below = whole.where("key.depth > 0").select("key", "leaf", "saved")
    lifted = below.join(tree.select("key", "up", "parent"), "key")
    lifted = _within(lifted, F.slice("up", 1, HEIGHT))
    return (
        local.unionByName(lifted)
        .groupBy("key")
        .agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.sum("n_children").alias("n_children"))
    )


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes where conversations end: the digest of their ids in order.

    Ids of a span of SPAN are joined in Spark; the texts of a node then pass one task
    in order, one at a time, through the hash, which cannot be taken in parts.
    """
    span = F.floor(F.col("conv_id") / SPAN)
    spans = rows.where("depth = n_turns").groupBy("key", span.alias("span"))
    texts = spans.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for key, ids in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), batch.column(3).to_pylist(), strict=True):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield _rows(done)
        if now is not None:
            yield _rows([(*now, digest.hexdigest())])

    placed = texts.repartition("key").sortWithinPartitions("key", "span").select("key.depth", "key.x", "key.y", "ids")
    made = placed.mapInArrow(run, "depth int, x long, y long, ends_sha256 string")
    return made.select(F.struct("depth", "x", "y").alias("key"), "ends_sha256")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    arrays = [pa.array(c, type=k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["depth", "x", "y", "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations.

    Columns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Needs conv_id, turn, role, text; other
    columns take no part. Turns with the same number are in the order of role and text,
    so repeated rows are repeated turns. Rows without conv_id take no part; an empty table
    has no nodes.
    """
    rows = stored(paths(rebuilt(conversations)), "paths")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    tree = stored(nodes(rows), "nodes")
    totals = summed(rows, tree.select("key", "leaf", "saved", "up"), deepest)
    known = tree.select("key", "conv_id", "n_convs", _parent().alias("parent"))
    parents = tree.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        known.join(totals, "key")
        .join(ends(rows), "key", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id",
            F.col("key.depth").cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaf").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
    )


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS own FROM turns GROUP BY conv_id
), starts AS (
    SELECT *, xor(list_reduce(
        [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
        lambda crc, byte: list_reduce(
            [xor(crc, byte)] || CAST(range(8) AS BIGINT[]),
            lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
        )
    ), 4294967295) % 6 AS h
    FROM lists
), whole AS (
    SELECT s.conv_id, coalesce(list_slice(f.own, 1, s.h), []) || list_slice(s.own, s.h + 1, len(s.own)) AS path
    FROM starts s LEFT JOIN lists f ON f.conv_id = s.conv_id - s.conv_id % 100
), members AS (
    SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM whole
), nodes AS (
    SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        max(len(path)) = depth AS leaf,
        string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth) AS ending
    FROM members GROUP BY 1, 2
), amounts AS (
    SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node[depth].text) END AS saved FROM nodes
), totals AS (
    SELECT list_slice(node, 1, above) AS node, above AS depth,
        count(*) FILTER (depth = above + 1) AS n_children,
        count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS above FROM amounts) GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
    t.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(n.ending, '')) AS ends_sha256
FROM amounts n
JOIN totals t ON t.node = n.node AND t.depth = n.depth
LEFT JOIN amounts p ON p.depth = n.depth - 1 AND p.node = list_slice(n.node, 1, n.depth - 1)
"""
