"""Cross-tokenizer alignment against whole-text encoding and a two-pointer walk."""

import random

import numpy as np
import pytest

from revmill.llm import alignment
from tests.llm import brute

FILES = alignment.tokenizer_files()
AWKWARD = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "a   b  ", "x \n  y", "tab\t end\x1c of \x85 it", "don't we'll  I'd",
    "U+2581 ▁ in the text", "<|endoftext|> <s> </s> <0x41>", "日本語のテキスト、と English 混在", "é" * 50, "\x00 null \x00",
    "12345 678,90 $$$$ ***", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 300, "🙂🙃 👩‍👩‍👧 emoji", "  nbsp x 　y", "same", "same",
]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def expected(keyed):
    found = brute.alignment([t for _, t in keyed], *FILES)
    return sorted(((k, *x) for (k, _), x in zip(keyed, found)), key=str)


def test_awkward_texts(spark):
    keyed = [*enumerate(AWKWARD), (3, "a repeated key"), (None, "no key")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in keyed], "doc_id long, text string, code string, block int")
    assert rows(alignment.aligned(docs, *FILES)) == expected(keyed)
    assert alignment.aligned(docs.limit(0), *FILES).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    keyed = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    query = alignment.op13_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    assert rows(query) == expected(keyed)


def test_random_white_space(spark):
    draw = random.Random(5)
    parts = ["a", "Bc", "é", " ", " ", " ", "\n", "\t", ".", "'s", "9", " ", "the", "​", "_"]
    keyed = [(k, "".join(draw.choices(parts, k=draw.randint(1, 30)))) for k in range(400)]
    assert rows(alignment.aligned(spark.createDataFrame(keyed, "doc_id long, text string"), *FILES)) == expected(keyed)


def test_stretches_and_blocks_do_not_show(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    keyed = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    texts, aligner = [t for _, t in keyed], alignment.Aligner(*FILES, remembered=50)
    monkeypatch.setattr(alignment, "STRETCH", 40)
    found = brute.alignment(texts, *FILES)
    block = alignment._Block(0)
    for key, text in keyed:
        block.add([key], [text], aligner)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in block.rows] == [(*x[:4], x[6]) for x in found]


def test_planes_count_and_return():
    rng = np.random.default_rng(3)
    codes, docs, counts = alignment.tallied(
        rng.integers(0, 40, 4_000), rng.integers(0, 300, 4_000).astype(np.int32), rng.integers(1, 9, 4_000)
    )
    different, pair = np.unique(codes, return_inverse=True)
    post = alignment.planes(pair, docs, counts)
    held, links = alignment.popcounts(post, len(different))
    assert held.tolist() == np.bincount(pair).tolist()
    assert links.tolist() == np.bincount(pair, weights=counts).astype(int).tolist()
    scores = rng.integers(0, 1 << 40, (len(different), 2))
    plain = np.zeros((300, 2), dtype=np.int64)
    for p, d, n in zip(pair, docs, counts):
        plain[d] += n * scores[p]
    assert (alignment.returned(post, scores, 300) == plain).all()


def test_pair_counts_over_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "the cat the dog" if k % 2 else "the cat") for k in range(40)], "doc_id long, text string")
    index = alignment.postings(docs.repartition(4), *FILES)
    assert index.count() == 4
    by = {(r["a_id"], r["b_id"]): (r["n_docs"], r["n_links"], r["best"]) for r in alignment.pair_counts(index).collect()}
    assert sorted(by.values()) == [(20, 20, True), (40, 40, True), (40, 60, True)]


@pytest.mark.parametrize("text", ["x" * 200_000, "ab " * 700_000])
def test_long_texts(text):
    block, aligner = alignment._Block(0), alignment.Aligner(*FILES)
    block.add([1], [text], aligner)
    assert block.rows[0][:4] == brute.alignment([text], *FILES)[0][:4]
