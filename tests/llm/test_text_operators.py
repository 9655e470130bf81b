"""The text operators against plain Python versions over whole tables."""

import math
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from revmill.llm import decontaminate, interpolation, lengths, packing, quality, repeats, tokens, toxicity
from revmill.llm import words as W
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, name):
    return {r["doc_id"]: r for r in entry.queries()[name](spark, SF).collect()}


def test_word_hashes_are_places_independent():
    starts, ends, hashes = W.word_hashes("Foo bar\tfoo  BAR x foo\n".encode(), W.spaced())
    assert hashes[0] == hashes[2] == hashes[4] and len(starts) == len(ends) == 5
    assert len(set(hashes.tolist())) == 3


def test_language_model(spark, table):
    found = rows_of(spark, "op1_language_model")
    for (key, _), expected in zip(table, brute.base_scores(table)):
        row = found[key]
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == expected[:4]
        assert row["base_score"] == pytest.approx(expected[4])
    held = [r for r in found.values() if r["held_out"]]
    # The mixture is better than the base on texts it has not seen.
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_mixture_weights_follow_the_better_estimate():
    # In bucket 3 the bigram is always right, in bucket 5 it never is.
    rows = [(3, 0, 40, 100), (5, -1, 12, 100)]
    mix = interpolation.weights(rows, 1000)
    assert mix[3][0] > 0.99 and mix[5][0] < 1e-3 and mix[5][1] > 0.9
    assert np.allclose(mix.sum(axis=1), 1) and mix[0][0] == 0


def mixture_scores(rows):
    """Log10 probabilities of texts by a mixture of Counter estimates, weights by plain expectation-maximisation."""
    split = [[*re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    folds = [zlib.crc32(str(k).encode()) % 7 for k, _ in rows]
    train = [t for t, f in zip(split, folds) if f != 2]
    weighing = [t for t, f in zip(split, folds) if f == 3]
    ones, twos = (lambda texts: Counter(w for t in texts for w in t)), (lambda texts: Counter(p for t in texts for p in zip([None, *t], t)))
    word, pair = ones(train), twos(train)
    total, floor = sum(word.values()), 1 / (len(word) + 1)

    def estimates(text, word, pair):
        for before, w in zip([None, *text], text):
            context = word[before]
            bucket = min(int(math.log2(context)) + 1, 23) if context > 0 else 0
            yield bucket, pair[before, w] / max(context, 1), word[w] / max(total, 1)

    rest, rest_pairs = word - ones(weighing), pair - twos(weighing)
    rough = lambda p: 2 ** (-round(-math.log2(p) * 4) / 4) if p > 0 else 0.0
    seen = [(b, (rough(x), rough(y), floor)) for t in weighing for b, x, y in estimates(t, rest, rest_pairs)]

    def learned(tokens):
        share = [1 / 3] * 3
        for _ in range(40):
            parts = [[a * b for a, b in zip(share, p)] for p in tokens]
            share = [sum(q[k] / sum(q) for q in parts) / len(parts) for k in range(3)]
        share[2] = max(share[2], 1e-6)
        return [x / sum(share) for x in share]

    everything = learned([p for _, p in seen])
    mix = {b: learned([p for c, p in seen if c == b]) if any(c == b for c, _ in seen) else everything for b in range(24)}
    mix[0] = [0.0, *(x / (mix[0][1] + mix[0][2]) for x in mix[0][1:])]
    return [
        sum(math.log10(sum(m * p for m, p in zip(mix[b], (x, y, floor)))) for b, x, y in estimates(t, word, pair))
        for t in split
    ]


def test_scores_of_the_model_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"W{k}" for k in range(40)])
    rows = [(k, " ".join(words[np.minimum(rng.geometric(0.15, rng.integers(0, 60)), 39)])) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "never seen before"), (503, "w1 w2 w3")]
    out = interpolation.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = {r["doc_id"]: r["score"] for r in out.collect()}
    assert found == pytest.approx(dict(zip([k for k, _ in rows], mixture_scores(rows))), rel=1e-9)


def test_probabilities_stay_below_one(spark):
    docs = [(k, t) for k, t in enumerate(["a b a c", "a b b", "c a b", "b a", "a c c a b", "b c"] * 4)]
    probes = [(1000 + k, w) for k, w in enumerate(["a", "b", "c", "zzz"])]
    held = [p for p in probes if brute.fold(p[0], 7) == 2]
    out = interpolation.scored(spark.createDataFrame(docs + probes, "doc_id long, text string"))
    assert out.where("score > 0").count() == 0 and out.count() == len(docs) + 4 and len(held) <= 4


def test_repeats(spark, table):
    found = {k: tuple(r)[1:] for k, r in rows_of(spark, "op6_suffix_dedup").items()}
    assert found == brute.repeats(table)


def test_repeats_with_many_runs_under_a_token(spark):
    rng = np.random.default_rng(3)
    line = "a line that very many texts of this table hold somewhere in their middle, word by word the same; " * 2
    texts = []
    for k in range(120):
        text = "".join(rng.choice(list("ab \nc"), rng.integers(0, 300)))
        if k % 3 == 0:
            text += line + "".join(rng.choice(list("xyz"), 150))
        if k % 7 == 0:
            text += "ab" * int(rng.integers(40, 200))
        if k % 11 == 0:
            text += "é" * int(rng.integers(0, 120))
        texts.append((k, text))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats.removals(docs, most=5).collect()}
    assert found == brute.repeats(texts)


def test_cut_texts_have_no_repeat_left_out(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cut = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs).collect()}
    expected = brute.repeats(table)
    assert cut.keys() == dict(table).keys()
    for key, text in table:
        n, removed, _, _ = expected[key]
        left = len((cut[key] or "").encode())
        # Characters that go in part stay whole.
        assert n - removed <= left <= n - removed + 6 * expected[key][2]
        assert removed or cut[key] == text


def test_multikey_sort_orders_and_classes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    group = rng.integers(0, 3, 500)
    order, label = repeats.multikey_sort(group, text, start, np.full(500, 20))
    data = [(int(g), text[s : s + 20].tobytes()) for g, s in zip(group, start)]
    for a in range(0, 500, 7):
        for b in range(500):
            assert (label[a] == label[b]) == (data[a] == data[b])
    assert len(set(label[order].tolist())) == len(set(data))


def test_decontamination(spark, table):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = rows_of(spark, "op10_benchmark_decontamination")
    for (key, _), expected in zip(table, brute.matches(table, items)):
        assert tuple(found[key])[1:] == expected


def test_short_items_and_several_automata(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 40)
    items = [(1, "red green"), (2, "Blue"), (3, "a b c d e f g h i j k l"), (4, "b c d e f g h i j k"), (5, "...")]
    docs = [(1, "red, GREEN and blue!"), (2, "x a b c d e f g h i j k y"), (3, "b c d e"), (4, None), (5, "red\ngreen red")]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    found = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.matches(*frames).collect()}
    assert found == {k: m for (k, _), m in zip(docs, brute.matches(docs, items))}
    clean = decontaminate.decontaminated(*frames, most=1.0)
    assert all(not m[4] for m in brute.matches([tuple(r) for r in clean.collect()], items))
    kept = {r["doc_id"] for r in decontaminate.decontaminated(*frames, most=0.5).collect()}
    assert kept == {3, 4}


def test_the_number_of_automata_does_not_show_in_the_texts(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(8)]
    body = dict(items)
    items.append((8, " ".join([*body[0].split()[:6], *body[1].split()[6:]])))
    filler = " ".join(f"f{j}" for j in range(28))
    docs = [(1, f"{body[0]} {filler}"), (2, f"{body[1]} {body[2]} {filler}"), (3, None), (4, filler)]
    # A third of the words by each of two items, and a passage that a cut of another joins.
    docs += [(10 + 8 * i + k, f"{body[i]} x y z {body[k]} {filler[:30]}") for i in range(8) for k in range(8)]
    docs += [(90 + i, f"{filler} {' '.join(body[0].split()[:6])} {body[i]} {' '.join(body[0].split()[6:])} {filler}") for i in range(1, 8)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    made = []
    for size in (1 << 20, 200):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        made.append({r["doc_id"]: r["text"] for r in decontaminate.decontaminated(*frames).collect()})
    assert made[0] == made[1] and {1, 3, 4, 91} <= made[0].keys() and not made[0].keys() & set(range(10, 74))


def test_encoder_equals_the_tokenizer(table):
    plain = Tokenizer.from_file(tokens.word_bpe())
    extra = ["a\x1cb <|endoftext|>x don't  ", "é é ́x\r\nA B ñ", "ΑΣ ΣΑΣ.", None, "", " ", "Straße İI ÿ Ÿ", "it's.It'S we'LL ... 12a3", "ﬁ é."]
    texts = [t for _, t in table] + extra
    ours = tokens.Encoder(tokens.word_bpe(), remembered=500).encode(texts)
    assert [x.tolist() for x in ours] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_counts(spark, table):
    plain = Tokenizer.from_file(tokens.word_bpe())
    sizes = [len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in table]
    rows = {r["length"]: r for r in entry.queries()["op9_token_counts"](spark, SF).collect()}
    assert sorted(rows) == sorted(set(sizes))
    for size, r in rows.items():
        assert r["n_docs"] == sizes.count(size) and r["total_tokens"] == sum(sizes)
        assert r["n_longer"] == sum(s > size for s in sizes) and r["n_shorter"] == sum(s < size for s in sizes)
        assert r["truncated_tokens"] == sum(min(s, size) for s in sizes)
        assert r["dropped_tokens"] == sum(max(s - size, 0) for s in sizes)
        assert r["tokens_longer"] == sum(s for s in sizes if s > size)


def test_limits_and_quantiles(spark):
    sizes = [1, 5, 5, 9, 2000, 1024, 1023, 3000]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(s,) for s in sizes], "length long"))).cache()
    limits = [0, 1, 4, 5, 1023, 1500, 5000, None]
    asked = spark.createDataFrame([(x,) for x in limits], "context long")
    found = {r["context"]: (r["n_cut"], r["truncated_tokens"]) for r in lengths.at_limits(sums, asked).collect()}
    assert found == {x: (sum(s > x for s in sizes), sum(min(s, x) for s in sizes)) for x in limits if x is not None}
    qs = spark.createDataFrame([(q,) for q in (0.01, 0.25, 0.5, 1.0)], "q double")
    ordered = sorted(sizes)
    expected = {q: ordered[max(0, int(np.ceil(q * len(sizes))) - 1)] for q in (0.01, 0.25, 0.5, 1.0)}
    assert {r["q"]: r["length"] for r in lengths.quantiles(sums, qs).collect()} == expected


def test_packing(spark, table):
    import zlib

    plain = Tokenizer.from_file(tokens.word_bpe())
    rows = entry.queries()["op8_best_fit_packing"](spark, SF).collect()
    ids = {k: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for k, t in table}
    cut = {(k, n): ids[k][n * 2048 : (n + 1) * 2048] for k in ids for n in range(-(-len(ids[k]) // 2048))}
    assert {(r["doc_id"], r["piece"]) for r in rows} == cut.keys() and len(rows) == len(cut)
    bins = {}
    for r in rows:
        own = cut[r["doc_id"], r["piece"]]
        assert (r["start"], r["length"], r["ids_crc32"]) == (r["piece"] * 2048, len(own), zlib.crc32(own.tobytes()))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_local_search_empties_sequences():
    # Best fit leaves three sequences; one exchange of 5 for 4 + 1 room makes it two.
    sizes = np.array([6, 5, 5, 4])
    bins = [[0], [1, 3], [2]]
    assert len(packing.local_search(bins, sizes, 10)) == 2
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 60, 200)
        start = [[i] for i in range(200)]
        out = packing.local_search(start, sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(200))
        assert all(sizes[b].sum() <= 100 for b in out) and len(out) < 120
        best = packing.local_search(packing.best_fit(sizes, 100), sizes, 100)
        assert len(best) <= len(packing.best_fit(sizes, 100)) <= -(-sizes.sum() // 100) + 2


@pytest.mark.parametrize(("mix", "bins"), [(0, 703), (1, 840), (2, 838)])
def test_search_beats_best_fit(mix, bins):
    """Mixes on which best fit leaves room: 711, 865 and 854 sequences."""
    rng = np.random.default_rng(1)
    mixes = [[(300, 1101, 2000)], [(600, 901, 2000)], [(400, 701, 1000), (900, 1301, 1000)]]
    sizes = [np.concatenate([rng.integers(*part) for part in parts]) for parts in mixes][mix]
    start = packing.best_fit(sizes, 2048)
    found = packing.local_search(start, sizes, 2048)
    assert sorted(i for b in found for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 2048 for b in found)
    squares = [sum(int(sizes[b].sum()) ** 2 for b in bins_) for bins_ in (start, found)]
    assert len(found) <= bins < len(start) and squares[0] < squares[1]


def test_search_ends_where_no_exchange_helps():
    """Afterwards no move, one-for-one or two-for-one exchange of any two sequences raises the squared fill."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(20, 70, 60)
    found = packing.local_search([[i] for i in range(60)], sizes, 100)
    fill = [int(sizes[b].sum()) for b in found]
    room = sum(100 - f for f in fill)
    sets = lambda b: [(), *((i,) for i in b), *((i, j) for i in b for j in b if i < j)]
    for k, one in enumerate(found):
        for d, other in enumerate(found):
            for some in sets(other)[1:]:
                for back in sets(one):
                    gain = int(sizes[list(some)].sum()) - int(sizes[list(back)].sum()) if back else int(sizes[list(some)].sum())
                    allowed = k != d and len(some) + len(back) < 4 and 0 < gain <= 100 - fill[k]
                    assert room < 100 or not (allowed and fill[d] < fill[k] + gain)


def test_the_encoder_lets_rare_words_go():
    encoder, fresh = tokens.Encoder(tokens.word_bpe(), remembered=40), tokens.Encoder(tokens.word_bpe())
    for k in range(30):
        texts = [f"the The, cat {k}x word{k} a{k}b; été-{k} " * 3, "the cat sat. on the mat!", None]
        assert [a.tolist() for a in encoder.encode(texts)] == [a.tolist() for a in fresh.encode(texts)]
        assert len(encoder._entry) < 80 and "the" in encoder._entry


@pytest.mark.parametrize("name, label, folds, held, limit", [("op3_quality", "quality", 5, 0, 0.9), ("op7_toxicity", "toxic", 3, 1, 0.85)])
def test_classifiers_on_held_out_rows(spark, name, label, folds, held, limit):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = entry.queries()[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (brute.fold(r["doc_id"], folds) == held) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in judged]) >= limit


def test_toxic_words_are_found_and_clean_texts_are_not(spark):
    model = toxicity.fit_on(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))
    clean = "the sea of that on and for the land with all that it has been to the ones over there. " * 5
    scores = model.score([clean, clean + "You pathetic Idiot, what a clown. " + clean, "", None])
    assert scores[1] >= toxicity.THRESHOLD > max(scores[0], scores[2], scores[3])


def test_trees_learn_an_interaction_and_batch_size_does_not_matter():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x, y)
    score = trees.score(x)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.97
    assert np.array_equal(score[:7], trees.score(x[:7]))
    texts = ["One two.", None, "", "AAA!! AAA!! $$$", "x" * 3_000_000]
    together = quality.statistics(texts)
    assert np.array_equal(together, np.concatenate([quality.statistics([t]) for t in texts]))


def test_a_long_tail_of_rarer_toxic_words_is_learned():
    rng = np.random.default_rng(3)
    plain = [f"w{i}x" for i in range(300)]
    rare = [f"qu{a}{b}z" for a in "aeiou" for b in "bdfgklmn"]
    rows = [(" ".join(rng.choice(plain, 60)), 0) for _ in range(1200)]
    rows += [(" ".join([*rng.choice(plain, 50), "trash", *rng.choice(plain, 9)]), 1) for _ in range(300)]
    rows += [(" ".join([*rng.choice(plain, 50), *rng.choice(rare, 4, replace=False), *rng.choice(plain, 6)]), 1) for _ in range(100)]
    model = toxicity.fit(rows)
    scores = model.score([" ".join([*rng.choice(plain, 30), word, *rng.choice(plain, 900)]) for word in [*rare, "trash"]])
    assert np.mean(scores >= toxicity.THRESHOLD) > 0.9
    assert max(model.score([" ".join(rng.choice(plain, 900)) for _ in range(100)])) < toxicity.THRESHOLD


def test_every_learned_toxic_word_is_recognised_and_no_other():
    rng = np.random.default_rng(4)
    words = list({bytes(rng.choice(list(b"bcdfghjklmnpqrstvwxzaeiou"), rng.integers(1, 11)).tolist()) for _ in range(4000)})
    held, others = words[::2], words[1::2]
    model = toxicity.Distance(b" and the other of that is on it with all for them " * 100, {4: held[:900], 7: held[900:]}, [0.0] * 20)
    assert min(model.distances([w.decode() for w in held])) > 0
    assert max(model.distances([w.decode() for w in others])) == 0


def test_one_short_toxic_word_counts_wherever_it_stands(spark):
    model = toxicity.fit_on(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))
    rng, rows = np.random.default_rng(5), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    clean = [t for (t,) in rows.select("text").limit(200).collect() if t and model.score([t])[0] < 0.5]
    for word in ("moron", "scum", "trash", "loser", "clown", "idiot"):
        for text in clean[:60]:
            at = text.split()
            at.insert(rng.integers(len(at) + 1), word)
            assert model.score([" ".join(at)])[0] >= toxicity.THRESHOLD


def test_word_hashes_do_not_depend_on_where_a_word_stands_or_a_stretch_ends():
    long = "z" * (2 * W.BLOCK_BYTES + 7)
    words = [*(f"w{i % 5000}" for i in range(200_000)), long, "w1", long, "y" * W.BLOCK_BYTES, "w2"]
    together = W.word_hashes(" ".join(words).encode() + b"\n", W.spaced())[2]
    alone = {w: W.word_hashes(w.encode() + b"\n", W.spaced())[2].tolist() for w in set(words)}
    assert together.tolist() == [h for w in words for h in alone[w]]
    assert len({h for (h,) in alone.values()}) == len(alone)


def test_a_very_long_text_takes_memory_of_its_own_size():
    text = b"some words here " * (32 << 16) + b"\n"
    tracemalloc.start()
    found = W.word_hashes(text, W.spaced())[2]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3 * (32 << 16) and peak < 12 * len(text)
