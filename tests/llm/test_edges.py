"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import hashlib

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from revmill.llm import (
    chat,
    decontaminate,
    interpolation,
    lengths,
    neighbours,
    packing,
    quality,
    repeats,
    simhash,
    toxicity,
)
from revmill.llm.tokens import word_bpe
from tests.llm import brute

CLASHES = "score held_out component code row_key text_of_row key_of_row length piece n_words kept_0 covered a.b".split()
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("lang", "source")]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)
LONG = "a long line of words that never ends and goes on " * 30_000
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Same text in both rows, of some words."),
    (5, "Same text in both rows, of some words."), (6, LONG), (7, "é" * 150), (8, "é" * 150),
    (None, "without a key"), (None, None), (9, "<|endoftext|> \x00 \x1c don't"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None, "s", len(t or ""), *[f"x{i}" for i in range(len(CLASHES))]) for k, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, (k + 1) % 2) for k in range(1, 9)] + [(None, 1, 1), (4, None, None), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, None), (2, ""), (None, "a long line of words that never ends and goes on a long"), (3, "one"), (3, "one")]
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(docs, labels, benchmark):
    return {
        "language_model": lambda d: interpolation.scored(d),
        "quality": lambda d: quality.scored(d, quality.fit_on(d, labels)),
        "simhash": lambda d: simhash.near_duplicates(d),
        "repeats": lambda d: repeats.removals(d),
        "toxicity": lambda d: toxicity.scored(d, toxicity.fit_on(d, labels)),
        "matches": lambda d: decontaminate.matches(d, benchmark),
        "lengths": lambda d: lengths.encoded_lengths(d, word_bpe()),
    }


@pytest.mark.parametrize("name", "language_model quality simhash repeats toxicity matches lengths".split())
def test_a_row_per_row_and_none_for_none(docs, labels, benchmark, name):
    operator = operators(docs, labels, benchmark)[name]
    rows = operator(docs).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((k for k, _ in TEXTS), key=str)
    assert operator(docs.limit(0)).collect() == []


def test_values_of_awkward_texts(docs, benchmark):
    by = lambda rows: sorted((tuple(r) for r in rows), key=str)
    expected = [(k, *m) for (k, _), m in zip(TEXTS, brute.matches(TEXTS, [("", "a long line of words that never ends and goes on a long"), (3, "one")]))]
    assert by(decontaminate.matches(docs, benchmark).collect()) == by(expected)
    scores = by(r[:5] for r in interpolation.scored(docs).collect())
    assert scores == by((k, *m[:4]) for (k, _), m in zip(TEXTS, brute.base_scores(TEXTS)))
    unique = {k: t for k, t in TEXTS if k is not None and k != 5}
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats.removals(docs).collect()}
    assert {k: found[k] for k in unique} == brute.repeats(unique.items())
    prints = {(r["doc_id"], r["code"] & ((1 << 64) - 1)) for r in simhash.near_duplicates(docs).collect()}
    assert prints == {(k, brute.fingerprint(t)) for k, t in TEXTS}


def test_near_duplicates_keep_one_row_of_a_repeated_key(docs):
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    keys = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # Null, empty and blank texts share fingerprint 0; 7 and 8 are copies.
    assert sorted(keys, key=str) == [1, 4, 5, 6, 7, 9, None]


def test_near_duplicates_go_without_a_second_fingerprint(spark):
    rows = [(k, f"text {k // 2} of some words that stand here twice", f"extra {k}") for k in range(40)]
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, code string")
    kept = simhash.without_near_duplicates(docs)
    least = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(
        ((k, t, x) for k, t, x in [*rows, (None, None, None)] if (k, k) in least), key=str
    )
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "hashpartitioning" not in plan


def test_a_repeated_key_over_components_stays_where_it_is_the_smallest(spark):
    rows = [(3, "one text of its own words"), (3, "a second one, quite unlike the first"), (1, "a second one, quite unlike the first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.without_near_duplicates(docs).collect()) == sorted([rows[0], rows[2]])


def test_repeats_need_whole_numbers_as_keys(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole numbers, but doc_id is string"):
        repeats.removals(docs)


def test_packing_of_awkward_texts(docs):
    rows = packing.pack_documents(docs, word_bpe()).collect()
    assert len({r["doc_id"] for r in rows}) == len({k for k, _ in TEXTS})
    assert sum(r["start"] == 0 for r in rows) == len(TEXTS)
    assert packing.pack_documents(docs.limit(0), word_bpe()).collect() == []


def test_stages_keep_columns_and_survive_nothing(spark, docs, labels, benchmark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() <= len(TEXTS), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, float(k)]) for k in range(0, 60)] + [(60, None), (80, [0.0, 0.0]), (100, [nan, 1.0])]
    rows += [(120, [inf, 0.0]), (140, [None, 1.0]), (160, []), (180, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(200, [1.0, 5.0]), (200, [1.0, 5.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = {}
    for r in neighbours.search(table).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = [(k, [1.0, float(k)]) for k in range(60)] + [(200, [1.0, 5.0])]
    assert found == brute.nearest(good)
    assert neighbours.search(table.limit(0)).collect() == []


def test_records_of_no_layout_and_null_turns(spark):
    rows = [(1, None), (2, "{bad"), (3, "[]"), (4, '{"other": 1}'), (5, '{"messages": []}'), (6, '{"turn":null,"role":null,"text":null}')]
    records = spark.createDataFrame(rows, "id long, record string")
    made = {r["id"]: (r["layout"], len(r["turns"])) for r in chat.canonical(records, "id", "record").collect()}
    assert made == {1: (None, 0), 2: (None, 0), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: ("turn_row", 1)}
    assert chat.canonical(records.limit(0), "id", "record").collect() == []


def test_formatted_conversations_with_repeats_ties_nulls_and_clashes(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "<|im_end|>"),
        (2, None, None, None), (2, 3, "assistant", "é\U0001f600" * 50_000), (2, 3, "a%\nb", "x"), (None, 0, "user", "no key"),
    ]
    table = spark.createDataFrame(
        [(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, formatted string, key int"
    ).repartition(4)
    outputs = chat.formatted_turns(table, "conv_id")
    found = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(outputs, "conv_id").collect()}
    wanted = {}
    for key in {r[0] for r in rows}:
        # Equal turns are ordered by the marked text.
        own = [(-1 if t is None else t, chat.formatted(r or "", x or "")[0], r or "", x or "") for k, t, r, x in rows if k == key]
        own.sort()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        turns = sha("".join(f"{r}\n{x}\n" for _, _, r, x in own))
        wanted[key] = (len(own), turns, len(loss), sha(loss), sum(len(f) for _, f, *_ in own))
    assert found == wanted
    nothing = chat.formatted_turns(table.limit(0), "conv_id")
    assert chat.digests(nothing, "conv_id").collect() == []
