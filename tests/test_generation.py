"""Requests and responses."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revmill.operators import generation
from revmill.schema import PROMPT_TEMPLATE


def python_prompt(title, category, rating, target):
    return PROMPT_TEMPLATE.format(
        product_title=title or "this product",
        category=category.replace("_", " "),
        rating=5 if not rating or math.isnan(rating) else int(round(rating)),
        target_word_count=target,
    )


@pytest.mark.parametrize("rating", [None, 0.0, 0.5, 1.5, 2.5, 3.5, 4.4, 4.5, 5.0, float("nan")])
@pytest.mark.parametrize("title", [None, "", "A {curly} title"])
def test_prompt(spark, rating, title):
    df = spark.createDataFrame(
        [(title, "Home_and_Kitchen", rating, 77)],
        "title string, category string, rating double, target_wc int",
    )
    got = df.select(generation.prompt()).first()[0]
    assert got == python_prompt(title, "Home_and_Kitchen", rating, 77)


def test_token_budget(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 3, 77)], "target_wc int")
    assert [r[0] for r in df.select(generation.token_budget("target_wc")).collect()] == [0, 2, 7, 192]


def test_messages(spark):
    row = spark.createDataFrame([("hi",)], "prompt string").select(generation.messages()).first()[0]
    assert [tuple(m) for m in row] == [("user", "hi")]


def human(spark, n=600):
    # Product "P0" has a third of the rows; some rows have no product.
    def product(i):
        return None if i % 50 == 7 else "P0" if i % 3 == 0 else f"P{i % 90}"

    rows = [
        (f"r{i:04}", product(i), "Cat", 1.0 + i % 5, f"t{i}", " ".join(["w"] * (20 + i % 40 * (i % 3))))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "review_id string, parent_asin string, category string, rating double, title string, text string",
    )


def test_seed_products_are_distinct_first_reviews(spark):
    rows = human(spark)
    products = {r.parent_asin for r in rows.select("parent_asin").distinct().collect()}
    got = generation.seed_products(rows, len(products), 3).collect()
    assert {r.parent_asin for r in got} == products and len(got) == len(products)
    assert generation.seed_products(rows, 10, 3).count() == 10
    with pytest.raises(Exception, match="cannot take"):
        generation.seed_products(rows, len(products) + 1).collect()


def test_drawn_lengths_follow_the_pool(spark):
    rows = human(spark)
    pool = Counter(len(r.text.split()) for r in rows.collect())
    bins = generation.length_bins(rows).orderBy("wc").collect()
    assert [(b.wc, b.stop - b.start) for b in bins] == sorted(pool.items())
    draws = generation.draw_length(
        spark.range(60_000).select(F.col("id").cast("string").alias("parent_asin")),
        generation.length_bins(rows),
    )
    drawn = Counter({r.target_wc: r["count"] for r in draws.groupBy("target_wc").count().collect()})
    assert sum(drawn.values()) == 60_000 and set(drawn) == set(pool)
    for wc, n in pool.items():
        share = n / 600
        assert abs(drawn[wc] / 60_000 - share) < 5 * math.sqrt(share / 60_000)


def test_lengths_are_not_cut_and_may_be_missing(spark):
    texts = [(" ".join(["w"] * n),) for n in (5, 20, 30, 500, 900)]
    bins = generation.length_bins(spark.createDataFrame(texts, "text string"))
    assert sorted(b.wc for b in bins.collect()) == [5, 20, 30, 500, 900]
    keys = spark.range(400).select(F.col("id").cast("string").alias("parent_asin"))
    drawn = {r.target_wc for r in generation.draw_length(keys, bins).collect()}
    assert drawn == {5, 20, 30, 500, 900}
    none = generation.draw_length(keys, bins.limit(0)).collect()
    assert {(r.parent_asin, r.target_wc) for r in none} == {
        (r.parent_asin, r.target_wc) for r in generation.draw_lognormal(keys).collect()
    }


def test_lognormal_lengths(spark):
    draws = generation.draw_lognormal(
        spark.range(40_000).select(F.col("id").cast("string").alias("parent_asin"))
    )
    row = draws.select(F.log(F.col("target_wc") + 0.5).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(row[0] - 4.0) < 0.02 and abs(row[1] - 0.6) < 0.02


def test_requests_and_responses(spark):
    rows = human(spark)
    requests = generation.requests(rows, 12, ["g1", "g2"]).cache()
    assert requests.count() == 24 and requests.select("request_id").distinct().count() == 24
    by_product = requests.groupBy("parent_asin").agg(F.count_distinct("prompt").alias("n"))
    assert {r.n for r in by_product.collect()} == {1}
    ids = sorted(r.request_id for r in requests.collect())
    answers = [(i, None, "boom") if k % 5 == 0 else (i, f" text {k}\n", None) for k, i in enumerate(ids)]
    responses = spark.createDataFrame(answers[:-1], "request_id string, text string, error string")
    reviews = generation.ingest(requests, responses).collect()
    good = {i for i, text, error in answers[:-1] if error is None}
    assert {r.review_id for r in reviews} == good
    assert all(r.text == r.text.strip() and r.label == 1 and r.timestamp is None for r in reviews)
    pending = {r.request_id for r in generation.pending(requests, responses).collect()}
    assert pending == set(ids) - good
