"""SimHash links, nearest neighbours and chat formatting against plain Python versions and SQL."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from revmill.llm import chat, neighbours, simhash
from revmill.llm.components import components
from tests.llm import brute
from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def test_simhash_of_all_documents(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = {k: brute.fingerprint(t) for k, t in table}
    label = brute.components(prints.values())
    least = {}
    for key, code in prints.items():
        least[label[code]] = min(key, least.get(label[code], key))
    rows = entry.queries()["op5_simhash"](spark, SF).collect()
    assert {tuple(r) for r in rows} == {(k, f"{c:016x}", least[label[c]]) for k, c in prints.items()}


@pytest.mark.parametrize("size", [64, 100_000])
def test_links_of_dense_groups(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "RANGE", size)
    rng = np.random.default_rng(1)
    codes = {0, (1 << 64) - 1}
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            codes.add(base ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)))
    expected = brute.components(codes)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    classes = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    found = {r["a"]: r["b"] for r in components(simhash.links(classes)).collect()}
    groups = {}
    for c in codes:
        groups.setdefault(found.get(signed(c), signed(c)), set()).add(c)
    truth = {}
    for c, least in expected.items():
        truth.setdefault(least, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (141, 142), (142, 141)]
    found = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {k: 100 for k in range(101, 141)} | {k: 7 for k in range(200, 260)} | {142: 141}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_nearest_neighbours_of_a_small_table_are_exact(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected, found = brute.nearest(vectors), {}
    for r in entry.queries()["op2_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == expected.keys()
    for key, near in expected.items():
        assert [k for k, _ in found[key]] == [k for k, _ in near]
        assert np.allclose([s for _, s in found[key]], [s for _, s in near], rtol=1e-12)


def recall(spark, x, **options):
    """(share of the true neighbours found, entries passed) by queries against brute force in numpy."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found, passed = {}, 0
    for r in neighbours.search(rows.repartition(8), **options).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        passed = r["n_passed"]
    hits = 0
    for q in range(0, len(x), neighbours.QUERY_EVERY):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-scores, neighbours.NEAREST)[: neighbours.NEAREST].tolist()))
    assert len(found) == -(-len(x) // neighbours.QUERY_EVERY)
    return hits / (len(found) * neighbours.NEAREST), passed


def test_recall_without_a_least_number_of_candidates(spark):
    """Entries passed are what the sampled queries need, and the others find as much."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    expected = brute.nearest([(r["vec_id"], r["embedding"]) for r in table.collect()])
    found = {}
    for r in neighbours.search(table, enough=1).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[k] & {i for i, _ in near}) for k, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_recall_with_production_settings_on_many_vectors(spark):
    rng = np.random.default_rng(3)
    found, passed = recall(spark, rng.normal(size=(18_000, 16)))
    assert found >= 0.9
    assert passed < 18_000


def test_clustered_vectors_pass_few_entries(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, 18_000)] + 0.1 * rng.normal(size=(18_000, 32))
    found, passed = recall(spark, x)
    assert found >= 0.9
    assert passed < 1_800


def test_walks_are_spread_over_tasks(spark):
    different = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("query")).distinct()
    spread = different.repartition(neighbours.shuffled(different), F.xxhash64("query"))
    assert spread.select(F.spark_partition_id()).distinct().count() == neighbours.shuffled(different)


def test_equal_vectors_are_one_entry_with_its_smallest_ids(spark):
    rows = [(k, [1.0, 2.0]) for k in range(500)] + [(1000 + k, [2.0, float(k % 3)]) for k in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in neighbours.search(table).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == brute.nearest(rows)


def test_pairs_come_in_the_order_of_their_sum():
    rng = np.random.default_rng(0)
    index = neighbours.MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    index.counts[:] = rng.integers(0, 3, (6, 5))
    query = rng.normal(size=8)
    sums = (index.first @ query[:4])[:, None] + (index.second @ query[4:])[None, :]
    for enough in (1, 7, 20, 1000):
        found = {(i, j) for i, js in index.walk(query, enough).items() for j in js}
        wanted, total = set(), 0
        for place in np.argsort(-sums, axis=None):
            if total >= enough:
                break
            i, j = divmod(int(place), 5)
            if index.counts[i, j]:
                wanted.add((i, j))
                total += index.counts[i, j]
        assert found == wanted


def test_chat_equals_sql(spark):
    name = "op4_chat_formatting"
    verdict, _ = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict is None, verdict


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<<||>", "<|im_end|><|im_start|>assistant ok", "\\|<", "a\nb<|im_end|>\n"])
def test_escapes_are_undone(text):
    assert chat.unescaped(chat.escaped(text)) == text
    output, start, end = chat.formatted("assistant", text)
    assert chat.unescaped(output[start:end]) == text
    assert chat.read_back(output + chat.formatted("us\ner%0A<|", text)[0]) == [("assistant", text), ("us\ner%0A<|", text)]


def test_layouts_become_the_same_turns(spark):
    ask, answer = "What is it?", "A test."
    records = [
        {"messages": [{"role": "user", "content": ask}, {"role": "assistant", "content": answer}]},
        {"id": 3, "conversations": [{"from": "human", "value": ask}, {"from": "gpt", "value": answer}]},
        {"instruction": ask, "output": answer}, {"instruction": ask, "input": "", "output": answer},
        {"prompt": ask, "completion": answer}, {"prompt": ask, "response": answer}, {"question": ask, "answer": answer},
        {"data": {"prompt": ask, "response": answer}, "meta": {"x": [1, 2]}}, {"instruction": ask, "context": None, "response": answer},
    ]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id long, record string")
    made = chat.canonical(rows, "id", "record").collect()
    assert all([(t["role"], t["text"]) for t in r["turns"]] == [("user", ask), ("assistant", answer)] for r in made)
    assert len({r["fingerprint"] for r in made}) == len(records)
    assert chat.paths({"a": [{"b": 1}, {"c": {}}], "d": None}) == {"a[].b", "a[].c", "d"}


def test_a_long_conversation_passes_turn_by_turn(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} " * 50) for k in range(3000)] + [(2, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    out = {r["conv_id"]: r for r in chat.digests(chat.formatted_turns(turns, "conv_id"), "conv_id").collect()}
    import hashlib

    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3000])
    assert out[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert out[1]["n_turns"] == 3000 and out[2]["n_turns"] == 1 and out[2]["loss_chars"] == 0
