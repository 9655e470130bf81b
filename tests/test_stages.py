"""The whole run on hand-made JSON lines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from revmill.operators import splits
from revmill.plans import stages
from revmill.schema import CUTOFF_MS, GENERATORS, REVIEW
from revmill.sources import reviews

WORDS = "good bad soap book lamp blue works broke love again price daily gift small".split()


def write_raw(folder):
    rng = random.Random(4)
    folder.mkdir()
    for category in ("Books", "Pet_Supplies"):
        lines = []
        for i in range(300):
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(15, 60)))
            lines.append(json.dumps({
                "timestamp": CUTOFF_MS + rng.randrange(-10**9, 10**8), "text": text, "title": f"T {i}",
                "user_id": f"u{i}", "parent_asin": f"{category[0]}{i % 120}", "rating": rng.choice([None, 1, 4.5]),
            }))
        (folder / f"{category}.jsonl").write_text("\n".join([*lines, "{bad", ""]))


def test_end_to_end(spark, tmp_path):
    write_raw(tmp_path / "raw")
    path = lambda name: str(tmp_path / name)
    human = stages.build_pool(spark, path("raw"), path("human"), 301, categories=["Books", "Pet_Supplies"])
    sizes = {r.category: r["count"] for r in human.groupBy("category").count().collect()}
    assert sizes == {"Books": 151, "Pet_Supplies": 150}

    requests = stages.write_requests(spark, path("human"), path("requests"), 60)
    assert requests.count() == 240
    answers = requests.select(
        "request_id",
        F.concat(F.lit(" furthermore overall "), "prompt", F.lit("\n")).alias("text"),
        F.when(F.crc32("request_id") % 20 == 0, F.lit("limit")).alias("error"),
    )
    open_ = stages.write_generated(requests, answers, path("generated"))
    failed = answers.where("error IS NOT NULL").count()
    assert 0 < failed == open_.count()

    meta = stages.build_splits(spark, path("human"), path("generated"), path("splits"), reserve=60)
    rows = {r.rotation: r for r in meta.collect()}
    assert [rows[r].held_out for r in range(4)] == GENERATORS
    total = sum(r.n_test_crossgen - 60 for r in rows.values())
    assert total == 240 - failed

    found = stages.run_baseline(spark, path("splits"), path("tfidf.json"))
    assert found.count() == 8 and found.where("f1 > 0.9 AND auc > 0.9").count() == 8
    table = stages.write_report(spark, [path("tfidf.json")], path("summary"))
    assert [r.model for r in table.collect()] == ["TF-IDF + LR"]


def test_one_rotation_is_rebuilt_beside_the_others(spark, tmp_path):
    write_raw(tmp_path / "raw")
    path = lambda name: str(tmp_path / name)
    stages.build_pool(spark, path("raw"), path("human"), 300, categories=["Books", "Pet_Supplies"])
    requests = stages.write_requests(spark, path("human"), path("requests"), 40)
    answers = requests.select("request_id", F.col("prompt").alias("text"), F.lit(None).cast("string").alias("error"))
    stages.write_generated(requests, answers, path("generated"))
    build = lambda **only: stages.build_splits(
        spark, path("human"), path("generated"), path("splits"), reserve=50, **only
    )
    files = lambda r: sorted(reviews.read_splits(spark, path("splits"), [r]).inputFiles())
    first = build(rotation=3).collect()
    assert [(r.rotation, r.held_out, r.n_train) for r in first] == [(3, "qwen", 192)]
    whole = sorted(tuple(r) for r in build().collect())
    before = {r: files(r) for r in range(4)}
    assert all(0 < len(before[r]) <= 40 for r in before)
    again = build(rotation=2).collect()
    assert [r.rotation for r in again] == [2]
    assert all(files(r) == before[r] for r in (0, 1, 3)) and files(2) != before[2]
    stored = reviews.read_meta(spark, path("splits_meta"))
    assert sorted(tuple(r) for r in stored.collect()) == whole
    counted = splits.rotation_meta(reviews.read_splits(spark, path("splits")))
    assert sorted(tuple(r) for r in counted.select(stored.columns).collect()) == whole


def test_a_generator_that_is_not_listed_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", "other")], "review_id string, generator string")
    for field in REVIEW:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    with pytest.raises(Exception, match="not listed: other"):
        reviews.write_generated(rows, str(tmp_path / "generated"))
