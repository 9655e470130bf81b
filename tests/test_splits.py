"""Invariants of the leave-one-generator-out splits."""

import pytest
from pyspark.sql import functions as F

from revmill.operators import splits
from revmill.schema import GENERATORS, HUMAN, REVIEW
from revmill.sources import committed
from revmill.sources import reviews as source

SIZES = {"gpt5mini": 50, "granite": 33, "gemma": 9, "qwen": 41}


def table(spark, sizes):
    rows = [
        (f"{g}{i}", "c", f"P{i % 20}", 1.0, "t", "x", None, int(g != HUMAN), g)
        for g, n in sizes.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows, REVIEW).repartition(6)


@pytest.fixture(scope="module")
def built(spark):
    return splits.logo_splits(table(spark, {HUMAN: 400}), table(spark, SIZES), reserve=150).cache()


def test_sizes(built):
    meta = {r.rotation: r for r in splits.rotation_meta(built).collect()}
    assert sorted(meta) == [0, 1, 2, 3]
    for r, held_out in enumerate(GENERATORS):
        rest = [n for g, n in SIZES.items() if g != held_out]
        train = sum(int(n * 0.8) for n in rest)
        val = sum(int(n * 0.1) for n in rest)
        assert meta[r].held_out == held_out
        assert meta[r].train_gens == ",".join(g for g in GENERATORS if g != held_out)
        assert meta[r].n_train == 2 * train
        assert meta[r].n_val == 2 * val
        assert meta[r].n_test_indist == 2 * (sum(rest) - train - val)
        assert meta[r].n_test_crossgen == 150 + SIZES[held_out]


def test_balance_holdout_and_completeness(built):
    rows = built.select("rotation", "split", "generator", "review_id", "label").collect()
    for r, held_out in enumerate(GENERATORS):
        here = [x for x in rows if x.rotation == r]
        ids = [x.review_id for x in here]
        assert len(ids) == len(set(ids))
        for split in ("train", "val_indist", "test_indist"):
            labels = [x.label for x in here if x.split == split]
            assert labels.count(0) == labels.count(1)
        assert {x.split for x in here if x.generator == held_out} == {"test_crossgen"}
        for g, n in SIZES.items():
            assert sum(x.generator == g for x in here) == n


def test_rotations_shuffle_humans_differently(built):
    reserved = [
        {x.review_id for x in built.where(f"rotation = {r} AND split = 'test_crossgen' AND label = 0").collect()}
        for r in range(4)
    ]
    assert all(len(s) == 150 for s in reserved) and len(set(map(frozenset, reserved))) == 4


def test_no_leakage_by_review_but_by_product(built):
    shared = {(r.key, r.rotation): r.shared for r in splits.leakage(built, ["review_id", "parent_asin"]).collect()}
    assert all(shared["review_id", r] == 0 for r in range(4))
    assert all(shared["parent_asin", r] == 20 for r in range(4))
    splits.assert_no_leakage(built)
    leaked = built.unionByName(
        built.where("rotation = 2 AND split = 'train'").limit(3).withColumn("split", F.lit("test_crossgen"))
    )
    with pytest.raises(ValueError, match="2: 3"):
        splits.assert_no_leakage(leaked)


def test_too_few_humans(spark):
    human, ai = table(spark, {HUMAN: 200}), table(spark, SIZES)
    check = {r.rotation: (r.need, r.pool, r.shortfall) for r in splits.balance_check(human, ai, 150).collect()}
    assert check[0] == (83, 50, 33) and check[2] == (124, 50, 74)
    with pytest.raises(Exception, match="not enough human reviews to balance rotation"):
        splits.logo_splits(human, ai, reserve=150).collect()


def test_reserve_may_exceed_the_pool(spark):
    parts = splits.reserve_human(table(spark, {HUMAN: 30}), 100).groupBy("rotation", "part").count()
    assert {(r.rotation, r.part, r["count"]) for r in parts.collect()} == {(r, "reserve", 30) for r in range(4)}


def test_one_rotation_equals_its_part_of_all(spark, built):
    one = splits.logo_splits(table(spark, {HUMAN: 400}), table(spark, SIZES), 150, rotation=2)
    key = lambda df: {(r.split, r.review_id) for r in df.collect()}
    assert key(one) == key(built.where("rotation = 2"))


def test_split_indist_sizes(spark):
    df = splits.each_rotation(table(spark, {"gpt5mini": 19, "qwen": 1}))
    sizes = splits.split_indist(df).groupBy("rotation", "generator", "split").count().collect()
    got = {(r.generator, r.split): r["count"] for r in sizes if r.rotation == 0}
    assert got == {
        ("gpt5mini", "train"): 15,
        ("gpt5mini", "val_indist"): 1,
        ("gpt5mini", "test_indist"): 3,
        ("qwen", "test_indist"): 1,
    }


def test_write_and_read_one_split(spark, built, tmp_path):
    path = str(tmp_path / "splits")
    source.write_splits(built, path)
    back = source.read_split(spark, path, 1, "val_indist")
    assert {r.review_id for r in back.collect()} == {
        r.review_id for r in built.where("rotation = 1 AND split = 'val_indist'").collect()
    }
    files = back.inputFiles()
    assert files and all("/rotation=1/split=val_indist/" in f for f in files)


def held(table):
    return {(r.rotation, r.split): r.n for r in table.groupBy("rotation", "split").agg(F.count("*").alias("n")).collect()}


def test_a_rebuild_leaves_nothing_of_the_one_before(spark, built, tmp_path):
    path = str(tmp_path / "splits")
    source.write_splits(built, path)
    whole = held(source.read_splits(spark, path))
    files = set(source.read_splits(spark, path, [1]).inputFiles())
    # Rotation 0 is built again without validation rows: its old ones must go, the others stay as they are.
    source.write_splits(built.where("rotation = 0 AND split <> 'val_indist'"), path, [0])
    assert held(source.read_splits(spark, path)) == {k: n for k, n in whole.items() if k != (0, "val_indist")}
    assert source.read_split(spark, path, 0, "val_indist").collect() == []
    assert set(source.read_splits(spark, path, [1]).inputFiles()) == files
    # A rotation that gives no row at all is gone, and so are rotations that a whole build has no more.
    source.write_splits(built.where("rotation = 9"), path, [2])
    assert {r for r, _ in held(source.read_splits(spark, path))} == {0, 1, 3}
    source.write_splits(built.where("rotation < 2"), path)
    assert held(source.read_splits(spark, path)) == {k: n for k, n in whole.items() if k[0] < 2}
    source.write_splits(built.where("rotation > 9"), path)
    assert source.read_splits(spark, path).collect() == []


def test_a_failed_write_changes_nothing(spark, built, tmp_path):
    path = str(tmp_path / "splits")
    source.write_splits(built, path)
    before = sorted(tuple(r) for r in source.read_splits(spark, path).collect())
    broken = built.withColumn("title", F.when(F.col("split") == "val_indist", F.raise_error(F.lit("lost"))).otherwise("t"))
    with pytest.raises(Exception, match="lost"):
        source.write_splits(broken, path)
    assert sorted(tuple(r) for r in source.read_splits(spark, path).collect()) == before
    # Data that was written but never committed does not count either.
    built.where("rotation = 0").write.partitionBy("rotation", "split").parquet(f"{path}/data/run=lost")
    assert sorted(tuple(r) for r in source.read_splits(spark, path).collect()) == before


def test_vacuum_removes_what_no_commit_names(spark, built, tmp_path):
    path = tmp_path / "splits"
    source.write_splits(built, str(path))
    source.write_splits(built.where("rotation = 3"), str(path), [3])
    before = sorted(tuple(r) for r in source.read_splits(spark, str(path)).collect())
    count = lambda: len(list((path / "data").rglob("split=*")))
    assert count() == 20
    removed = committed.vacuum(spark, str(path))
    assert len(removed) == 1 and removed[0].endswith("/rotation=3") and count() == 16
    assert sorted(tuple(r) for r in source.read_splits(spark, str(path)).collect()) == before


def test_reading_what_was_never_written(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        source.read_splits(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no folder"):
        committed.write(spark.createDataFrame([("a/b", 1)], "k string, v int"), str(tmp_path / "odd"), ["k"])


def test_labelling_moves_no_text(spark, tmp_path):
    """Only ids and generators are shuffled on the way to the cuts."""
    path = str(tmp_path / "reviews")
    source.write_reviews(table(spark, {HUMAN: 400, **SIZES}), path)
    rows = source.scan_reviews(spark, path)
    df = splits.logo_splits(rows.where("label = 0"), rows.where("label = 1"), 150)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    with_text = [line for line in scans if "text" in line.split("ReadSchema")[0].split("Batched")[0]]
    assert len(scans) > 2 and len(with_text) == 2
    top = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in top


def test_combine_is_a_seeded_order(spark):
    a, b = table(spark, {"gemma": 5}), table(spark, {HUMAN: 5})
    one = [r.review_id for r in splits.combine(a, b).collect()]
    two = [r.review_id for r in splits.combine(b, a).collect()]
    assert one == two and len(one) == 10
    assert one != [r.review_id for r in splits.combine(a, b, seed=1).collect()]
