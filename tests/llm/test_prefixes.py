"""The conversation trie against a walk over every prefix."""

import random

import pytest
from pyspark.sql import functions as F

from revmill.llm import prefixes
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def check(spark, turns):
    made = prefixes.trie(spark.createDataFrame(turns, SCHEMA))
    assert made.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert rows(made) == sorted(brute.trie(turns), key=str)


def test_whole_table(spark):
    turns = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(prefixes.op11_conversation_prefix_trie(spark, "/root/testdata/sf0.01")) == sorted(brute.trie(turns), key=str)


def test_awkward_rows(spark):
    turns = [(0, 0, "user", "a"), (0, None, "system", None), (0, 5, None, "é🙂"), (0, 5, None, "é🙂"), (1, 1, "user", ""), (None, 0, "user", "x")]
    turns += [(c, t, "user", f"turn {t}") for c in (100, 101, 102, 250, -1, -100, -7, 2**62) for t in range(3)]
    turns += [(301 + k, 0, "user", "alone") for k in range(20)]
    check(spark, turns)


def test_deep_conversations_pass_several_bands(spark):
    """Ends on both sides of every band's border, three levels of bands."""
    draw = random.Random(2)
    turns = []
    for c in range(100, 150):
        n = draw.choice([1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 127, 130, 520 if c == 107 else 40])
        fork = draw.choice([3, 8, 16, 64, 1000])
        turns += [(c, t, "user", "same" if t < fork else f"own {c} {t}") for t in range(n)]
    check(spark, turns)


def test_copies_in_many_spans(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SPAN", 7)
    check(spark, [(c, t, "user", f"t{t}") for c in range(-30, 170) for t in range(2)])


def test_clashing_columns_and_empty_table(spark):
    turns = [(c, t, "user", f"t{t}") for c in range(5) for t in range(2)]
    frame = spark.createDataFrame(turns, SCHEMA)
    for name in "depth key up h place family parent leaf span".split():
        frame = frame.withColumn(name, F.lit("x"))
    assert rows(prefixes.trie(frame)) == sorted(brute.trie(turns), key=str)
    assert prefixes.trie(frame.limit(0)).collect() == []


@pytest.mark.parametrize("height", [2, 3])
def test_height_does_not_show(spark, monkeypatch, height):
    monkeypatch.setattr(prefixes, "HEIGHT", height)
    draw = random.Random(height)
    check(spark, [(c, t, draw.choice("us"), draw.choice("ab")) for c in range(40) for t in range(draw.randint(1, 30))])
