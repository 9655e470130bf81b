"""The pipeline's stages and end against plain Python versions."""

import os
import re

import numpy as np
import pytest

import corpus_pipeline
from revmill.llm.tables import read, stored
from tests.llm import brute

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_stages_take_effect(spark):
    docs, seen = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(texts(docs))
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    seen.append(texts(docs))
    raw, calm, single, cut, clean = seen
    # Toxic: the labelled words go, other texts stay as they are.
    bad = re.compile(r"\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b", re.I)
    assert {k for k in raw if not bad.search(raw[k] or "")} == calm.keys() and all(raw[k] == t for k, t in calm.items())
    # Near-duplicates: the smallest key of each component.
    prints = {k: brute.fingerprint(t) for k, t in calm.items()}
    label, least = brute.components(prints.values()), {}
    for key in sorted(prints):
        least.setdefault(label[prints[key]], key)
    assert single == {k: calm[k] for k in least.values()}
    # Repeats: nothing left but what starts first; unharmed texts stay.
    removed = brute.repeats(single.items())
    assert cut.keys() == single.keys()
    assert all(cut[k] == single[k] for k in cut if not removed[k][1])
    assert all(len(cut[k].encode()) < len(single[k].encode()) for k in cut if removed[k][1] > 8)
    # Benchmark: no hit is left, clean texts stay.
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    before = dict(zip(cut, brute.matches(cut.items(), items)))
    assert not any(m[4] for m in brute.matches(clean.items(), items))
    assert all(clean.get(k) == t for k, t in cut.items() if not before[k][4])
    counts = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    assert all(counts[k] == len(t) for k, t in clean.items())
    # Packing: every document left, whole.
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} == clean.keys()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-np.sum(list(fill.values())) // 2048) + 1


def test_run_is_the_stages_in_a_row(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    assert corpus_pipeline.run(spark, SF).count() > 100
