"""Quota, dedup, shuffling and ranking against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from revmill.functions.order import order_key
from revmill.operators import pool
from revmill.operators.ranking import ranked, slices


def key_of(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest() + key


def test_quotas_give_the_remainder_to_the_first():
    assert pool.quotas("abcdefgh", 10) == dict(zip("abcdefgh", [2, 2, 1, 1, 1, 1, 1, 1]))
    assert pool.quotas("ab", 1) == {"a": 1, "b": 0}


def rows_with_a_hot_category(n=3000):
    rng = random.Random(1)
    return [(f"r{i}", "hot" if rng.random() < 0.6 else rng.choice("abc"), i * 7) for i in range(n)]


@pytest.mark.parametrize("order", [None, "ord"])
def test_take_quota_is_the_first_rows_of_each_category(spark, order):
    rows = rows_with_a_hot_category()
    quota = {"hot": 700, "a": 13, "b": 0, "c": 10**6}
    df = spark.createDataFrame(rows, "review_id string, category string, ord bigint").repartition(5)
    got = {r.review_id for r in pool.take_quota(df, quota, order=order).collect()}
    expected = set()
    for category, n in quota.items():
        mine = [r for r in rows if r[1] == category]
        mine.sort(key=lambda r: r[2] if order else key_of(42, r[0]))
        expected |= {r[0] for r in mine[:n]}
    assert got == expected


def test_take_quota_keeps_copies_of_the_last_key(spark):
    df = spark.createDataFrame([("x", "a")] * 50 + [("y", "a")], "review_id string, category string")
    first = min("xy", key=lambda k: key_of(42, k))
    got = [r.review_id for r in pool.take_quota(df, {"a": 1}).collect()]
    assert got == [first] * (50 if first == "x" else 1)


def test_dedup_keeps_the_smallest_order_and_breaks_ties(spark):
    rows = [("k", 3, "c"), ("k", 1, "b"), ("k", 1, "a"), ("l", 9, None), (None, 2, "n"), (None, 1, "m")]
    df = spark.createDataFrame(rows, "review_id string, ord int, text string").repartition(4)
    got = {tuple(r) for r in pool.dedup(df, "review_id", "ord").collect()}
    assert got == {("k", 1, "a"), ("l", 9, None), (None, 1, "m")}


def test_positions_are_a_permutation_in_hash_order(spark):
    ids = [f"r{i}" for i in range(2500)]
    df = spark.createDataFrame([(i,) for i in ids], "review_id string")
    got = {r.review_id: r.position for r in pool.shuffled_positions(df, seed=5).collect()}
    expected = sorted(ids, key=lambda i: key_of(5, i))
    assert got == {key: place for place, key in enumerate(expected, 1)}
    order = [r.review_id for r in pool.shuffle(df, seed=5).collect()]
    assert order == expected


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_result_does_not_depend_on_partitions(spark, partitions):
    rows = rows_with_a_hot_category()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "review_id string, category string, ord bigint")
        taken = pool.take_quota(df.repartition(int(partitions)), {"hot": 100, "a": 50})
        digest = hashlib.md5("".join(sorted(r.review_id for r in taken.collect())).encode())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = []
    for category, n in {"hot": 100, "a": 50}.items():
        ids = sorted((r[0] for r in rows if r[1] == category), key=lambda i: key_of(42, i))
        expected += ids[:n]
    assert digest.hexdigest() == hashlib.md5("".join(sorted(expected)).encode()).hexdigest()


def test_a_cut_between_copies_is_an_error(spark):
    df = spark.createDataFrame([("x", 0)] * 4, "id string, g int").withColumn("k", order_key(1, "id"))
    cut = lambda sizes: sizes.withColumn("a", F.lit(2)).withColumn("b", F.col("n"))
    with pytest.raises(Exception, match="between copies"):
        slices(df, ["g"], "k", ["a", "b"], cut).collect()


def test_take_first_needs_enough_rows(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"))
    got = {r.id for r in pool.take_first(df, 4, "id").collect()}
    assert got == set(sorted(map(str, range(10)), key=lambda i: key_of(42, i))[:4])
    with pytest.raises(Exception, match="cannot take 11 rows"):
        pool.take_first(df, 11, "id").collect()
    assert pool.take_first(df, 11, "id", complete=False).count() == 10


def test_ranked_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string")
    assert ranked(df, "k").count() == 0


def test_pool_goes_below_n_when_duplicates_fall_in_the_quota(spark):
    text = " ".join(["w"] * 30)
    rows = [("A", "u", 1, text, i) for i in range(5)] + [("A", f"u{i}", 2, text, 5 + i) for i in range(5)]
    rows += [("A", "late", 1669766400000, text, 100), ("A", "short", 3, "w", 101)]
    raw = spark.createDataFrame(
        rows, "category string, user_id string, timestamp bigint, text string, doc_id int"
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in ("parent_asin", "title")],
             F.lit(1.0).alias("rating"))
    built = pool.build_human_pool(raw, ["A"], 7, order="doc_id").collect()
    assert sorted(r.review_id for r in built) == ["A_u0_2", "A_u1_2", "A_u_1"]


def test_profile(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "x"), ("b", "x y z")], "category string, text string")
    assert [tuple(r) for r in pool.value_counts(df, "category").collect()] == [("b", 2), ("a", 1)]
    assert tuple(pool.word_stats(df).first()) == (1, 3, 2.0)
    assert [r.text for r in pool.head(df, 2, "text").collect()] == ["x", "x y"]


def test_positions_with_an_outlier_and_negative_ones(spark):
    """Clustered positions are told apart, however far one of them lies."""
    places = [*range(-50, 4000), 2**50, -(2**40)]
    rows = [(f"r{i}", "hot", p) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, "review_id string, category string, ord bigint").repartition(3)
    got = {r.ord for r in pool.take_quota(df, {"hot": 1234}, order="ord").collect()}
    assert got == set(sorted(places)[:1234])
    # What is sorted in the end is one value: all its digits have been counted before.
    from revmill.operators.ranking import INTEGER_LEVELS, integer_key

    assert INTEGER_LEVELS[-1] == 16
    keys = [r[0] for r in df.orderBy("ord").select(integer_key("ord")).collect()]
    assert keys == sorted(keys) and all(len(k) == 16 for k in keys)


def test_quota_table_of_the_categories_that_occur(spark):
    df = spark.createDataFrame([(c,) for c in "ddbbca"], "category string")
    got = sorted(tuple(r) for r in pool.spread(df, 10).collect())
    assert got == [(0, "a", 3), (1, "b", 3), (2, "c", 2), (3, "d", 2)]
