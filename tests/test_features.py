"""Features, losses and linear models against numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revmill.functions.vectors import l2_normalize, negative_log_softmax, softmax
from revmill.operators import features, linear, losses


def test_label_map_and_unseen_generators(spark):
    train = spark.createDataFrame([("qwen",), ("human",), ("gemma",), ("qwen",)], "generator string")
    mapping = {r.generator: r.gen_label for r in features.label_map(train).collect()}
    assert mapping == {"human": 0, "gemma": 1, "qwen": 2}
    rows = spark.createDataFrame([("qwen",), ("granite",), ("human",)], "generator string")
    got = {r.generator: (r.gen_label, r.gen_known) for r in features.encode_generator(rows, features.label_map(train)).collect()}
    assert got == {"qwen": (2, True), "granite": (0, False), "human": (0, True)}


def test_label_maps_of_groups(spark):
    rows = [(0, "human"), (0, "qwen"), (1, "gemma"), (1, "qwen")]
    labels = features.label_map(spark.createDataFrame(rows, "rotation int, generator string"), ["rotation"])
    assert sorted(tuple(r) for r in labels.collect()) == [
        (0, "human", 0), (0, "qwen", 1), (1, "gemma", 1), (1, "human", 0), (1, "qwen", 2)
    ]


@pytest.mark.parametrize("partitions", [1, 3, 20])
def test_places_in_a_total_order(spark, partitions):
    df = spark.range(500).selectExpr("id", "id % 7 AS n").repartition(partitions)
    got = {r.id: r.position for r in features.numbered(df, F.desc("n"), F.asc("id")).collect()}
    order = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert got == {i: k for k, i in enumerate(order, 1)}


def test_a_key_in_two_rows_is_an_error(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "z")], "review_id string, text string")
    with pytest.raises(Exception, match="two rows with the key a"):
        features.encode_tokens(df, features.word_vocabulary(df)).collect()
    with pytest.raises(Exception, match="two rows with the key a"):
        features.tfidf_apply(df, features.tfidf_fit(df, min_df=1)).collect()


def test_the_whole_vocabulary_has_numbers(spark):
    text = " ".join(f"w{i}" for i in range(3000)) + " w7 w7 w3"
    df = spark.createDataFrame([("a", text)], "review_id string, text string")
    ids = {r.word: r.id for r in features.word_vocabulary(df).collect()}
    assert len(ids) == 3000 and ids["w7"] == 2 and ids["w3"] == 3 and sorted(ids.values()) == list(range(2, 3002))


def test_token_ids(spark):
    texts = [("a", "the cat the dog"), ("b", "The bird"), ("c", ""), ("d", None), ("e", "the " * 9)]
    df = spark.createDataFrame(texts, "review_id string, text string")
    vocabulary = features.word_vocabulary(df, 2)
    ids = {r.word: r.id for r in vocabulary.collect()}
    assert ids == {"the": 2, "bird": 3}
    got = {r.review_id: (r.input_ids, r.attention_mask) for r in features.encode_tokens(df, vocabulary, 5).collect()}
    assert got["a"] == ([2, 1, 2, 1, 0], [1, 1, 1, 1, 0])
    assert got["b"] == ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0])
    assert got["c"] == got["d"] == ([0] * 5, [0] * 5)
    assert got["e"] == ([2] * 5, [1] * 5)


def test_mean_pool(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [100.0, 100.0], 0), (2, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "doc int, embedding array<float>, mask int")
    got = {r.doc: r.pooled for r in features.mean_pool(df, "doc").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_scaling_uses_the_population_deviation(spark):
    x = np.array([[1, 5, 2], [3, 5, 4], [8, 5, 0]], dtype=float)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "embedding array<float>")
    scale = features.scale_fit(df)
    std = x.std(axis=0)
    std[std == 0] = 1
    got = np.array([r.embedding for r in features.scale_apply(df, scale).collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) / std)


CORPUS = [
    "the red fox and the red hen",
    "the red fox",
    "a hen, a hen and a fox",
    "",
    "unrelated words only here",
    "fox fox fox the the",
]


def plain_tfidf(texts, min_df, max_features):
    import re

    docs = []
    for text in texts:
        w = re.findall(r"(?u)\b\w\w+\b", text.lower())
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df, total = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        total.update(d)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    out = []
    for d in docs:
        v = {t: (1 + math.log(n)) * idf[t] for t, n in d.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return idf, out


@pytest.mark.parametrize("max_features", [3, 50_000])
def test_tfidf(spark, max_features):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(CORPUS)], "review_id string, text string")
    idf, weights = plain_tfidf(CORPUS, 2, max_features)
    vocabulary = features.tfidf_fit(df, 2, max_features)
    assert {r.term: pytest.approx(r.idf) for r in vocabulary.collect()} == idf
    got = {i: {} for i in range(len(CORPUS))}
    rows = features.tfidf_apply(df, vocabulary).collect()
    assert {int(r.review_id) for r in rows} == set(got)
    for r in rows:
        if r.term is None:
            assert r.weight == 0.0
        else:
            got[int(r.review_id)][r.term] = r.weight
    assert all(got[i] == pytest.approx(weights[i]) for i in got)


def test_weights_are_made_where_the_texts_are_read(spark, tmp_path):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(CORPUS)], "review_id string, text string")
    df.write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    plan = features.tfidf_apply(df, features.tfidf_fit(df, 2))._jdf.queryExecution().executedPlan().toString()
    # The vocabulary is one row that is broadcast; nothing of the documents moves.
    assert plan.count("Exchange SinglePartition") <= 1 and "hashpartitioning" not in plan, plan
    assert "EvalPython" not in plan and "SortMergeJoin" not in plan


def test_weights_without_a_vocabulary_or_rows(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "review_id string, text string")
    nothing = features.tfidf_fit(df.where("false"), 2)
    assert {tuple(r) for r in features.tfidf_apply(df, nothing).collect()} == {("a", None, 0.0), ("b", None, 0.0)}
    assert features.tfidf_apply(df.where("false"), features.tfidf_fit(df, 1)).collect() == []


def test_tfidf_vectors_equal_the_long_form(spark):
    df = spark.createDataFrame(
        [(str(i), t, i % 2) for i, t in enumerate(CORPUS)], "review_id string, text string, label int"
    )
    model = linear.fit_tfidf_lr(df, min_df=2)
    terms = model.vectorizer.vocabulary
    _, weights = plain_tfidf(CORPUS, 2, 50_000)
    for r in model.features(df).collect():
        got = {terms[i]: v for i, v in zip(r.features.indices, r.features.values)}
        assert got == pytest.approx(weights[int(r.review_id)])


def newton_logistic(x, y, c=1.0, steps=60):
    """Minimum of |w|^2 / 2 + C * log loss, intercept not penalised."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(x1.shape[1])
    penalty[-1, -1] = 0
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x1 @ w))
        gradient = penalty @ w + c * x1.T @ (p - y)
        hessian = penalty + c * (x1 * (p * (1 - p))[:, None]).T @ x1
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_embedding_lr_reaches_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) * [1, 5, 0.2, 1] + [0, 3, 0, 0]
    y = (x @ [1, 0.2, 2, 0] + rng.normal(size=200) > 0.5).astype(int)
    rows = [(row.tolist(), int(label)) for row, label in zip(x, y)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int")
    model = linear.fit_embedding_lr(df)
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    w = newton_logistic(scaled, y)
    assert np.allclose(model.classifier.coefficients.toArray(), w[:-1], atol=2e-3)
    assert model.classifier.intercept == pytest.approx(w[-1], abs=2e-3)
    p = [r.p for r in model.score(df).collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-(scaled @ w[:-1] + w[-1]))), atol=1e-3)


def test_tfidf_lr_reaches_the_optimum(spark):
    texts = [f"{a} {b} {a}" for a in ("red", "blue", "green") for b in ("fox", "hen", "owl")] * 3
    labels = [int("red" in t or "owl" in t) if i % 7 else 0 for i, t in enumerate(texts)]
    df = spark.createDataFrame(
        [(str(i), t, y) for i, (t, y) in enumerate(zip(texts, labels))],
        "review_id string, text string, label int",
    )
    model = linear.fit_tfidf_lr(df)
    terms = model.vectorizer.vocabulary
    _, weights = plain_tfidf(texts, 2, 50_000)
    x = np.array([[w.get(t, 0.0) for t in terms] for w in weights])
    w = newton_logistic(x, np.array(labels))
    expected = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    got = {int(r.review_id): r.p for r in model.score(df).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], expected, atol=1e-3)


def test_generator_probe_on_separable_vectors(spark):
    rng = np.random.default_rng(1)
    centres = {"human": [0, 0], "g1": [6, 0], "g2": [0, 6]}
    rows = [
        ((rng.normal(size=2) + c).tolist(), g) for g, c in centres.items() for _ in range(60)
    ]
    df = spark.createDataFrame(rows, "embedding array<double>, generator string")
    got = {r.generator: r for r in linear.generator_probe(df, df).collect()}
    assert {g: r.n for g, r in got.items()} == {g: 60 for g in centres}
    assert all(r.accuracy > 0.95 and r.cross_entropy < 0.2 for r in got.values())


def test_softmax_and_cross_entropy_are_stable(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 0.0], 1), ([-2.0, 0.5, 1.0], 0)], "l array<double>, y int")
    rows = df.select(softmax("l").alias("p"), negative_log_softmax("l", "y").alias("n"), "l", "y").collect()
    for r in rows:
        x = np.array(r.l) - max(r.l)
        p = np.exp(x) / np.exp(x).sum()
        assert np.allclose(r.p, p) and r.n == pytest.approx(-(x - np.log(np.exp(x).sum()))[r.y])


def plain_supcon(x, y, t=0.07):
    total, anchors = 0.0, 0
    for i in range(len(y)):
        logits = [float(np.dot(x[i], x[j])) / t for j in range(len(y))]
        top = max(logits)
        others = sum(math.exp(s - top) for j, s in enumerate(logits) if j != i)
        mine = [s - top - math.log(others + 1e-12) for j, s in enumerate(logits) if j != i and y[j] == y[i]]
        if mine:
            total, anchors = total - sum(mine) / len(mine), anchors + 1
    return total / anchors if anchors else 0.0


def test_supcon(spark):
    rng = np.random.default_rng(2)
    batches = {0: [0, 1, 0, 1, 1, 0, 0], 1: [0, 1], 2: [1], 3: [1, 1, 1], 4: [0, 0, 1]}
    rows, expected = [], {}
    for b, labels in batches.items():
        x = rng.normal(size=(len(labels), 5))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        expected[b] = plain_supcon(x, labels)
        rows += [(b, v.tolist(), y) for v, y in zip(x, labels)]
    df = spark.createDataFrame(rows, "batch_id int, z array<double>, y int").repartition(3)
    got = {r.batch_id: r.loss for r in losses.supcon(df, "z", "y").collect()}
    assert got == pytest.approx(expected) and got[1] == got[2] == 0.0
    plan = losses.supcon(df, "z", "y")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    with pytest.raises(Exception, match="more than 3 rows"):
        losses.supcon(df, "z", "y", size=3).collect()


def test_training_batches(spark):
    df = spark.range(50).withColumnRenamed("id", "vec_id")
    sizes = losses.training_batches(df, "vec_id", 16).groupBy("batch_id").count()
    assert {(r.batch_id, r["count"]) for r in sizes.collect()} == {(0, 16), (1, 16), (2, 16), (3, 2)}


def test_weighted_loss_leaves_out_zero_weights(spark):
    parts = spark.createDataFrame([(7, 2.0, 3.0, 5.0)], "batch_id int, ce double, contrastive double, adversarial double")
    got = {r.variant: tuple(r)[2:] for r in losses.weighted_loss(parts).collect()}
    assert got["base"] == (2.0, None, None, 2.0)
    assert got["contrastive"] == (2.0, 3.0, None, 3.5)
    assert got["adversarial"] == (2.0, None, 5.0, 3.5)
    assert got["both"] == (2.0, 3.0, 5.0, 5.0)


def test_cross_entropy_per_batch(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 1), (0, [0.0, 0.0], 0), (1, [0.0, math.log(3)], 1)], "batch_id int, l array<double>, y int")
    got = {r.batch_id: r.loss for r in losses.cross_entropy(df, "l", "y").collect()}
    assert got == pytest.approx({0: math.log(2), 1: math.log(4 / 3)})


def test_no_python_rows_on_the_tfidf_path(spark):
    texts = [(f"r{i}", f"good soap number {i % 5}" if i % 2 else f"bad lamp number {i % 5}", i % 2) for i in range(60)]
    rows = spark.createDataFrame(texts, "review_id string, text string, label int")
    model = linear.fit_tfidf_lr(rows)
    scored = model.score(rows)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    vocabulary = features.tfidf_fit(rows)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in vocabulary
    assert all((r.p >= 0.5) == (r.label == 1) for r in scored.collect())


def test_the_tfidf_fit_is_the_optimum_of_all_its_rows(spark):
    """The gradient of the penalised loss over all training rows vanishes at the fit."""
    words = "soap lamp book blue works broke love again price daily gift small".split()
    rng = np.random.default_rng(5)
    texts = [(" ".join(rng.choice(words, 12)) + (" fine" if i % 3 else " bad"), int(i % 3 > 0) ^ int(i % 10 == 0)) for i in range(300)]
    train = spark.createDataFrame(texts, "text string, label int")
    model = linear.fit_tfidf_lr(train)
    rows = model.features(train.withColumn("id", F.monotonically_increasing_id())).collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows], dtype=float)
    weights = model.classifier.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ weights + model.classifier.intercept)))
    assert len(rows) == 300 and np.allclose(np.linalg.norm(x, axis=1), 1)
    assert np.abs(x.T @ (p - y) + weights).max() / 300 < 1e-5 and abs((p - y).mean()) < 1e-5


def test_shared_counts_are_those_of_each_group(spark):
    texts = ["a1 b2 c3 a1", "a1 b2", "c3 c3 d4", "a1 b2 c3 a1", None, "b2 d4 a1 b2"]
    rows = [(f"r{k}", text, k % 2, r) for k, text in enumerate(texts) for r in range(3) if (k + r) % 3 or r == 0]
    df = spark.createDataFrame(rows, "review_id string, text string, label int, rotation int")
    shared = features.term_counts(df, "rotation", [0, 1, 2], min_df=1)
    for r in range(3):
        alone = features.term_counts(df.where(F.col("rotation") == r), min_df=1)
        mine = linear.of_rotation(shared, r)
        assert sorted(map(tuple, mine.select(alone.columns).collect())) == sorted(map(tuple, alone.collect()))


@pytest.mark.parametrize("family", ["binomial", "multinomial"])
def test_the_largest_gradient_tells_an_optimum_from_a_short_fit(spark, family):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2 if family == "binomial" else 3, 200)
    x = rng.normal(size=(200, 5)) + y[:, None] * [1, 0, 0.5, 0, -1]
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "embedding array<double>, label int")
    good, short = (linear.fit_embedding_lr(df, max_iter=n, family=family) for n in (2000, 2))
    gradients = []
    for model in (good, short):
        found = linear.largest_gradient(model.classifier, model.features(df))
        z = (x - x.mean(0)) / x.std(0)
        w, b = model.classifier.coefficientMatrix.toArray(), model.classifier.interceptVector.toArray()
        s = z @ w.T + b
        p = 1 / (1 + np.exp(-s)) if family == "binomial" else np.exp(s) / np.exp(s).sum(1, keepdims=True)
        miss = p - (y[:, None] == np.arange(1 if family == "binomial" else 0, p.shape[1] + (family == "binomial")))
        by_hand = max(np.abs(miss.T @ z / 200 + w / 200).max(), np.abs(miss.mean(0)).max())
        assert found == pytest.approx(by_hand, abs=1e-9)
        gradients.append(found)
    assert gradients[0] < 1e-4 < 1e-2 < gradients[1]


def test_frequent_and_rare_words_get_the_same_ids(spark, monkeypatch):
    """Head and tail meet anywhere in the vocabulary; long words are found by their digest."""
    rng = np.random.default_rng(3)
    names = [f"{'long' * (k % 9)}w{k}" for k in range(300)]
    texts = [(f"r{k}", " ".join(rng.choice(names, 40, p=1 / np.arange(1, 301) / (1 / np.arange(1, 301)).sum()))) for k in range(60)]
    df = spark.createDataFrame([*texts, ("none", None), (None, "nothing known")], "review_id string, text string")
    vocabulary = features.word_vocabulary(df.limit(40))
    ids = {r.word: r.id for r in vocabulary.collect()}
    expected = {k: [ids.get(w, 1) for w in t.split()] for k, t in texts} | {"none": [], None: [1, 1]}
    for head, long_word in ((20_000, 64), (5, 12), (0, 0)):
        monkeypatch.setattr(features, "HEAD", head)
        monkeypatch.setattr(features, "LONG_WORD", long_word)
        rows = features.encode_tokens(df, vocabulary, 50).collect()
        assert {r.review_id: r.input_ids[: sum(r.attention_mask)] for r in rows} == expected


def test_token_ids_place_texts_once(spark):
    """One exchange of word lists, used twice; frequent words never move again."""
    df = spark.createDataFrame([("a", "x y"), ("b", "z"), (None, "only rare")], "review_id string, text string")
    encoded = features.encode_tokens(df, features.word_vocabulary(df))
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(_key" in line]
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan
    encoded.collect()
    final = encoded._jdf.queryExecution().executedPlan().toString()
    assert exchanges and "ReusedExchange" in final
