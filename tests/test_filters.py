"""Filters, projections and text expressions on hand-made rows."""

import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from revmill.functions import text as tx
from revmill.operators import filters
from revmill.schema import CUTOFF_MS, REVIEW
from revmill.sources import reviews as source


def test_cutoff_is_strict_and_drops_null_and_zero(spark):
    stamps = [None, 0, CUTOFF_MS - 1, CUTOFF_MS, CUTOFF_MS + 1, -5]
    df = spark.createDataFrame([(t,) for t in stamps], "timestamp bigint")
    kept = [r.timestamp for r in filters.before_cutoff(df).collect()]
    assert kept == [CUTOFF_MS - 1, -5]


# Every character that Python splits at, and some that look like spaces.
BLANKS = [c for c in range(0x110000) if chr(c).isspace()]
OTHERS = [0x00, 0x08, 0x0E, 0x1B, 0x21, 0x7F, 0xAD, 0x180E, 0x200B, 0x2060, 0xFEFF, 0x1F600, 0x301]


def test_words_are_those_of_python(spark):
    marks = [chr(c) for c in BLANKS + OTHERS]
    texts = [f"{m}one{m}{m}two {m}" for m in marks] + ["", "".join(marks), "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", tx.word_count("text").alias("n"), tx.words("text").alias("w"), tx.strip("text").alias("s")
    )
    for row in df.collect():
        assert row.w == row.text.split() and row.n == len(row.w)
        assert row.s == row.text.strip()


def test_missing_text_has_no_words(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(tx.word_count("text")).first()[0] == 0
    assert df.select(tx.text_default("text")).first()[0] == ""


def test_word_band_is_inclusive(spark):
    sizes = [0, 19, 20, 21, 400, 401]
    df = spark.createDataFrame([(n, " ".join(["x"] * n)) for n in sizes], "n int, text string")
    assert [r.n for r in filters.word_band(df).collect()] == [20, 21, 400]


def test_tokens_and_pairs(spark):
    letters = [0xC7, 0xE9, 0x130, 0x4E2D, 0x2167, 0xB2, 0xBD, 0x301, 0x203F, 0x200D]
    text = "It's a_b 12 x " + " ".join(f"q{chr(c)}r {chr(c)}{chr(c)}" for c in letters)
    words = re.findall(r"(?u)\b\w\w+\b", text.lower())
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(tx.tokens("text").alias("w")).select("w", tx.with_pairs(F.col("w")).alias("t")).first()
    assert row.w == words
    assert row.t == words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("text", ["", "x", "word"])
def test_pairs_of_short_texts(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(tx.tokens("text").alias("w"))
    assert df.select(tx.with_pairs(F.col("w"))).first()[0] == ([text] if len(text) > 1 else [])


def test_review_key_and_human_rows(spark):
    raw = spark.createDataFrame(
        [("Books", "u1", 5, "t", None, 4.0, "B1"), ("Books", None, 7, None, "T", None, None)],
        "category string, user_id string, timestamp bigint, text string, title string, "
        "rating double, parent_asin string",
    )
    rows = filters.as_human(raw).orderBy("timestamp").collect()
    assert [r.review_id for r in rows] == ["Books_u1_5", "Books__7"]
    assert [r.text for r in rows] == ["t", ""]
    assert all(r.label == 0 and r.generator == "human" for r in rows)
    assert filters.as_human(raw).columns == REVIEW.names


def test_generated_rows(spark):
    df = spark.createDataFrame(
        [("gemma", "B1", "Books", 4.0, "T", chr(0x3000) + "\x1c hello \n")],
        "generator string, parent_asin string, category string, rating double, title string, text string",
    )
    rows = filters.as_generated(df, 7)
    row = rows.first()
    assert (row.review_id, row.text, row.timestamp, row.label) == ("gemma_B1_7", "hello", None, 1)
    assert sorted(rows.columns) == sorted(REVIEW.names)


def test_feature_columns(spark):
    df = spark.createDataFrame([("a", None, 1)], "review_id string, text string, label bigint")
    out = filters.feature_columns(df)
    assert out.first() == ("a", "", 1) and out.schema["label"].dataType.simpleString() == "int"


def test_json_scan_skips_bad_lines(spark, tmp_path):
    (tmp_path / "Books.jsonl").write_text(
        '{"timestamp": 5, "text": "a b", "user_id": "u", "rating": 4}\n'
        "\n{bad\n[1, 2]\n"
        '{"timestamp": null, "parent_asin": "B"}\n'
        '{"timestamp": 7.0, "rating": "5.0", "user_id": 12}\n{"timestamp": 8, "rating": "abc"}\n',
        encoding="utf8",
    )
    folder = tmp_path / "Pet_Supplies.jsonl"
    folder.mkdir()
    (folder / "part-00000.json").write_text('{"timestamp": 6}\n')
    rows = source.scan_reviews_json(spark, str(tmp_path)).orderBy("category", "timestamp").collect()
    got = [(r.category, r.timestamp, r.text, r.rating, r.parent_asin, r.user_id) for r in rows]
    # The array parses, so it is a row without fields.
    assert sorted(got, key=str) == sorted([
        ("Books", None, None, None, None, None),
        ("Books", None, None, None, "B", None),
        ("Books", 5, "a b", 4.0, None, "u"),
        ("Books", 7, None, 5.0, None, "12"),
        ("Books", 8, None, None, None, None),
        ("Pet_Supplies", 6, None, None, None, None),
    ], key=str)
    table = source.scan_reviews_json(spark, str(tmp_path))
    assert table.count() == 6
    assert all(table.select(c).collect() and len(table.select(c).collect()) == 6 for c in table.columns)


LINES = [
    '{"timestamp": 5, "rating": 4}', '{"rating": NaN, "text": "x"}', '{"rating": -Infinity}', '{"rating": 1, "rating": 2.5}',
    '{"timestamp": 5, "timestamp": null}', '{"deep": ' + "[" * 1_500 + "]" * 1_500 + ', "rating": 3}',
    '{"timestamp": 1669766400000, "x": NaN, "title": "a \\"NaN\\" b"}', '{"timestamp": 16e2, "x": Infinity}',
    '{"digits": ' + "9" * 2_000 + ', "rating": 6}', '{"text": {"rating": NaN}, "rating": 7}', "[1, 2]", '  {"rating": 8}\t',
    '{"rating": 4} x', '{"rating": 4} {}', '{"rating": 4}]x[', '{"rating": 4},{"rating": 5}', "{bad", "{'rating': 1}",
    '{"rating": INF}', '{"rating": 01}', '{"text": "tab\there"}', '{"rating": 4', '"cut', "nul", '{"a": NaN} {"b": NaN}',
    '{"rating": 4},"end of line"', "", "   ",
]


def test_every_line_that_python_parses_is_a_row(spark, tmp_path):
    import json

    def parsed(text):
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    (tmp_path / "Books.jsonl").write_text("\n".join(LINES), encoding="utf8")
    observed = Observation("scan")
    table = source.scan_reviews_json(spark, str(tmp_path), observed)
    good = [p for p in map(parsed, LINES) if p is not None]
    fields = [p if isinstance(p, dict) else {} for p in good]
    number = lambda x: None if x is None or x != x else float(x)
    expected = [(p.get("timestamp"), number(p.get("rating")), p.get("title")) for p in fields]
    found = [tuple(r) for r in table.select("timestamp", "rating", "title").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    bad = [x for x in LINES if x.strip() and parsed(x) is None]
    assert observed.get == {"lines": len(good) + len(bad), "rejected": len(bad)}
    assert all(table.select(c).count() == len(good) for c in table.columns)
    rejects = source.scan_rejected_json(spark, str(tmp_path)).collect()
    assert sorted(r["value"] for r in rejects) == sorted(bad)
    reasons = {r["value"]: r["reason"] for r in rejects}
    assert reasons['{"rating": 4} x'] == reasons['{"rating": 4} {}'] == "text after the value"
    assert reasons["{bad"] == reasons['{"rating": 4'] == "cut off"
    assert reasons["nul"] == "no object" and reasons['{"rating": 01}'] == "not JSON"
    assert {(r["category"], r["file"].endswith("Books.jsonl")) for r in rejects} == {("Books", True)}


def test_null_typed_timestamp_column_reads_as_bigint(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(
        pa.table({"review_id": ["a"], "timestamp": pa.nulls(1), "label": pa.array([1], pa.int32())}),
        tmp_path / "g.parquet",
    )
    df = source.scan_reviews(spark, str(tmp_path / "g.parquet"))
    assert df.schema == REVIEW
    assert df.select("review_id", "timestamp").first() == ("a", None)
