"""Metrics against pair counts, and the tables over many runs."""

import itertools
import random

import pytest

from revmill.operators import metrics, report
from revmill.schema import GENERATORS, METRICS
from revmill.sources import results


def pair_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    wins = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def plain_f1(rows):
    tp = sum(y == 1 and p >= 0.5 for y, p in rows)
    wrong = sum((y == 1) != (p >= 0.5) for y, p in rows)
    return 2 * tp / (2 * tp + wrong) if tp else 0.0


def scored_rows(labels_follow_generator, n=600, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "big" if i % 3 else rng.choice(["m1", "m2"])
        g = rng.choice(["human", "human", "g1", "g2", "g3"])
        y = int(g != "human") if labels_follow_generator else rng.randrange(2)
        p = round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.25))), rng.choice([1, 2, 6]))
        rows.append((group, g, y, p))
    # A third of all rows on one score.
    return [(m, g, y, 0.5 if i % 3 == 0 else p) for i, (m, g, y, p) in enumerate(rows)]


SCHEMA = "model string, generator string, label int, p double"


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_metrics_are_exact(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = scored_rows(True)
        got = metrics.metrics(spark.createDataFrame(rows, SCHEMA).repartition(9), ["model"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.model for r in got} == {"big", "m1", "m2"}
    for r in got:
        mine = [(y, p) for m, _, y, p in rows if m == r.model]
        assert r.auc == pytest.approx(pair_auc(mine), abs=1e-12)
        assert r.f1 == pytest.approx(plain_f1(mine), abs=1e-12)
        assert r.n == len(mine)


@pytest.mark.parametrize("follows", [True, False])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_per_generator_is_the_generator_plus_all_humans(spark, follows, coalesce):
    rows = scored_rows(follows, seed=3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = metrics.per_generator(spark.createDataFrame(rows, SCHEMA).repartition(5), ["model"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 12
    for r in got:
        mine = [(y, p) for m, g, y, p in rows if m == r.model and g in (r.generator, "human")]
        expected = pair_auc(mine)
        assert r.auc == (None if expected is None else pytest.approx(expected, abs=1e-12))
        assert r.f1 == pytest.approx(plain_f1(mine), abs=1e-12)
        assert r.n == len(mine)
        if follows and r.generator == "human":
            assert (r.f1, r.auc) == (0.0, None)


def test_per_generator_without_humans(spark):
    rows = [("m", "g1", 1, 0.9), ("m", "g1", 0, 0.1), ("m", "g2", 1, 0.2), ("m", "g2", 0, 0.7)]
    got = {r.generator: r.auc for r in metrics.per_generator(spark.createDataFrame(rows, SCHEMA), ["model"]).collect()}
    assert got == {"g1": 1.0, "g2": 0.0}


def test_one_class_and_no_positive_call(spark):
    df = spark.createDataFrame([("a", "human", 0, 0.1), ("a", "human", 0, 0.2), ("b", "g", 1, 0.4)], SCHEMA)
    got = {r.model: (r.f1, r.auc, r.n) for r in metrics.metrics(df, ["model"]).collect()}
    assert got == {"a": (0.0, None, 2), "b": (0.0, None, 1)}


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("a", "g", 1, 0.5), ("a", "g", 1, 0.49)], SCHEMA)
    assert [r.pred for r in metrics.predict(df).collect()] == [1, 0]
    assert tuple(metrics.confusion(df, ["model"]).first()) == ("a", 1, 0, 1, 0)
    assert metrics.f1(df, ["model"]).first().f1 == pytest.approx(2 / 3)


def test_humans_are_not_copied(spark):
    """No join at all in the plan: the pairs across are running sums."""
    df = metrics.per_generator(spark.createDataFrame(scored_rows(True), SCHEMA), ["model"])
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_best_step_is_the_earliest_of_the_best(spark):
    df = spark.createDataFrame(
        [("a", 600, 0.9), ("a", 400, 0.9), ("a", 200, 0.8), ("b", 200, 0.0), ("b", 400, 0.0)],
        "run string, step int, f1 double",
    )
    assert {tuple(r) for r in report.best_step(df).collect()} == {("a", 400, 0.9), ("b", 200, 0.0)}


def metric_table(spark):
    rows = []
    for model in ("tfidf_lr", "base", "both"):
        for rotation in range(4):
            if (model, rotation) == ("both", 2):
                continue
            for split, f1 in (("test_indist", 0.8), ("test_crossgen", 0.6)):
                auc = None if (model, rotation, split) == ("base", 1, "test_crossgen") else 0.75
                rows.append((model, rotation, split, None, f1 + rotation / 100, auc, 10))
                rows.append((model, rotation, split, "human", 0.0, None, 5))
    return spark.createDataFrame(rows, METRICS)


def test_averages_carry_missing_values_but_skip_missing_runs(spark):
    whole = metric_table(spark).where("generator IS NULL")
    got = {(r.model, r.split): (r.f1, r.auc, r.rotations) for r in report.rotation_average(whole).collect()}
    assert got["base", "test_crossgen"] == (pytest.approx(0.615), None, 4)
    assert got["both", "test_indist"] == (pytest.approx(0.8 + 4 / 300), pytest.approx(0.75), 3)


def test_comparison_heldout_gap_and_pending(spark):
    whole = metric_table(spark).where("generator IS NULL")
    table = report.comparison(whole)
    rows = table.orderBy("position").collect()
    assert [r.model for r in rows] == ["TF-IDF + LR", "DeBERTa-FT base", "DeBERTa-FT both"]
    assert rows[0].f1_crossgen == pytest.approx(0.615) and rows[1].auc_crossgen is None
    assert report.gap(table).orderBy("position").first().gap == pytest.approx(0.2)
    pivot = {r.variant: tuple(r)[1:] for r in report.heldout(whole).collect()}
    assert report.heldout(whole).columns == ["variant", *GENERATORS]
    assert pivot["base"] == pytest.approx((0.6, 0.61, 0.62, 0.63))
    assert pivot["both"][2] is None and pivot["contrastive"] == (None,) * 4
    pending = {tuple(r) for r in report.pending_runs(whole).collect()}
    assert len(pending) == 9 and ("both", 2) in pending and ("base", 0) not in pending


def test_metrics_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "metrics")
    results.write_metrics(metric_table(spark), path)
    back = results.read_metrics(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, metric_table(spark).collect()))


def test_reads_a_metrics_file_with_nan(spark, tmp_path):
    file = tmp_path / "baseline.json"
    file.write_text(
        '{\n "rotation_1": {"test_indist": {"f1": 0.5, "auc": NaN, "n": 3},\n'
        ' "test_crossgen": {"f1": 1.0, "auc": 0.25, "n": 4}}}'
    )
    got = {tuple(r) for r in results.read_metrics(spark, str(file), "tfidf_lr").collect()}
    assert got == {
        ("tfidf_lr", 1, "test_indist", None, 0.5, None, 3),
        ("tfidf_lr", 1, "test_crossgen", None, 1.0, 0.25, 4),
    }


def test_metrics_document_is_readable_elsewhere(spark, tmp_path):
    import json

    results.write_metrics(metric_table(spark), str(tmp_path / "m"))
    (part,) = (tmp_path / "m").glob("part-*")
    document = json.loads(part.read_text())
    cell = document["base"]["rotation_1"]["test_crossgen"]
    assert cell["n"] == 10 and cell["auc"] != cell["auc"]
    assert document["base"]["rotation_0"]["test_indist_per_generator"]["human"]["n"] == 5


def test_summary_file(spark, tmp_path):
    path = tmp_path / "summary"
    results.write_summary(report.comparison(metric_table(spark).where("generator IS NULL")), str(path))
    (part,) = path.glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "Model,F1 in-dist,F1 cross-gen,AUC in-dist,AUC cross-gen"
    assert [line.split(",")[0] for line in lines[1:]] == ["TF-IDF + LR", "DeBERTa-FT base", "DeBERTa-FT both"]


def test_variants(spark):
    rows = {r.name: tuple(r.losses) for r in report.variants(spark).collect()}
    assert rows["both"] == (1.0, 0.5, 0.3) and len(rows) == 4


def test_variant_weights(spark):
    meta = spark.createDataFrame([(0, "gpt5mini", 12000)], "rotation int, held_out string, n_train bigint")
    row = report.variant_weights(meta).where("variant = 'adversarial'").first()
    assert (row.n_train, row.ce, row.contrastive, row.adversarial) == (12000, 1.0, 0.0, 0.3)


def test_models_that_are_not_listed_come_last(spark):
    rows = [(m, 0, s, 0.5, 0.5) for m in ("zeta", "both", "alpha") for s in ("test_indist", "test_crossgen")]
    table = report.comparison(
        spark.createDataFrame(rows, "model string, rotation int, split string, f1 double, auc double")
    )
    names = [r.model for r in table.orderBy("position").collect()]
    assert names[1:] == ["alpha", "zeta"] and names[0] not in ("both", None)


def test_a_split_that_is_no_test_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame(
        [("m", 0, "val_indist", None, 0.5, 0.5, 3)],
        "model string, rotation int, split string, generator string, f1 double, auc double, n bigint",
    )
    with pytest.raises(Exception, match="no test split: val_indist"):
        results.write_metrics(rows, str(tmp_path / "m"))
