"""Which tokens of two tokenizers stand for the same bytes, and how usual that is in a corpus.

A byte-level BPE (A) and a piece BPE with byte fallback (B) cut the same bytes. Where
tokens of both end, a group ends; the A and B tokens of a group are linked. The inverted
index holds, for a block of documents and an id pair, a bitmap of the documents that
hold the pair for each binary digit of how often they do (its multiplicity planes),
without the empty words. OR over the planes is the bitmap of documents; the bits of it
are counted, the counts of all blocks add up to the pair's count, and counts go back
to the blocks, whose planes return a score to each document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revmill.llm.tables import named, read, stored
from revmill.llm.words import release

#: Bytes of text in a block, about, and characters that are cut up together.
BLOCK_BYTES = 8 << 20
STRETCH = 1 << 20
#: Different units a task keeps at hand before it starts afresh. Results do not depend on it.
REMEMBERED = 400_000
#: Units that are encoded as one text.
TOGETHER = 2_000
#: Bits of a B id in the code of an id pair, and of a document's number in its block.
B_BITS, DOC_BITS = 16, 20
#: A space between two characters that are no white space: neither tokenizer joins anything across it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLOCK = "block long, docs binary, planes binary, codes array<long>, held array<int>, links array<long>"


def units(text: str) -> Iterator[list[str]]:
    """The text in pieces, about STRETCH characters at a time: each, after a space, is encoded by itself."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = cut.start() if cut else len(text)
        yield _CUT.split(text[at:end])
        at = end + 1


class Aligned(NamedTuple):
    """What units hold, in order: how many A and B tokens, groups and links each, all links as codes, the groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    codes: np.ndarray
    groups: list[str]


class Aligner:
    """Groups and links of units, each different unit encoded once."""

    def __init__(self, byte_bpe: str, piece_bpe: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_bpe)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self._a_bytes = _byte_level(json.loads(self._a.to_str()))
        self._b_bytes = [_piece(self._b.id_to_piece(k)) for k in range(self._b.vocab_size())]
        self._a_size = np.array([len(t) for t in self._a_bytes])
        self._b_size = np.array([len(t) for t in self._b_bytes])
        self._names = [str(k) for k in range(max(len(self._a_bytes), len(self._b_bytes)))]
        self._remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self._entry: dict[str, int] = {}
        self._groups: list[str] = []
        self._numbers = [np.zeros((0, 4), dtype=np.int32)]
        self._ends = [np.zeros(0, dtype=np.int64)]
        self._flat = [np.zeros(0, dtype=np.int64)]

    def look_up(self, split: list[str]) -> Aligned:
        """All of the units. One that does not come back byte for byte has no group."""
        if len(self._entry) > self._remembered:
            self._forget()
        at = np.fromiter(map(self._entry.get, split, repeat(-1)), dtype=np.int64, count=len(split))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            unknown = [split[k] for k in missing]
            self._learn(list(dict.fromkeys(unknown)))
            at[missing] = [self._entry[u] for u in unknown]
        if len(self._flat) > 1:
            self._numbers, self._ends = [np.concatenate(self._numbers)], [np.concatenate(self._ends)]
            self._flat = [np.concatenate(self._flat)]
        numbers = self._numbers[0][at].astype(np.int64)
        counts = numbers[:, 3]
        before = np.cumsum(counts) - counts
        codes = self._flat[0][np.repeat(self._ends[0][at] - counts - before, counts) + np.arange(counts.sum())]
        return Aligned(*numbers.T, codes, [self._groups[k] for k in at.tolist()])

    def _learn(self, new: list[str]) -> None:
        """Units are encoded as one text, as neither tokenizer joins anything across the cuts.

        Those that white space begins or ends, and those with U+2581, which B reads as a
        space, are encoded by themselves.
        """
        odd = [u for u in new if not u or u[0].isspace() or u[-1].isspace() or "▁" in u]
        apart = set(odd)
        plain = [u for u in new if u not in apart]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            joined = " ".join(some)
            if not self._add(some, self._a.encode(" " + joined, add_special_tokens=False).ids, self._b.encode(joined)):
                odd += some
        for unit in odd:
            if not self._add([unit], self._a.encode(" " + unit, add_special_tokens=False).ids, self._b.encode(unit)):
                self._remember([unit], *(np.zeros(n, dtype=np.int64) for n in (1, 1, 1, 1, 0)), [""])

    def _add(self, some: list[str], a: list[int], b: list[int]) -> bool:
        """Remember units that have these ids, one after another; False if the bytes are not theirs."""
        joined = (" " + " ".join(some)).encode("utf-8")
        if not b"".join(map(self._a_bytes.__getitem__, a)) == joined == b"".join(map(self._b_bytes.__getitem__, b)):
            return False
        flat_a, flat_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        end_a, end_b = np.cumsum(self._a_size[flat_a]), np.cumsum(self._b_size[flat_b])
        # Every token has at least a byte, so ends rise, and units end where both do.
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        in_a, in_b = np.bincount(of_a, minlength=len(both)), np.bincount(of_b, minlength=len(both))
        before_a, before_b, links_before = (np.concatenate([[0], np.cumsum(n)]) for n in (in_a, in_b, in_a * in_b))
        wide = in_b[of_a]
        partner = np.repeat(before_b[of_a] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        codes = np.repeat(flat_a << B_BITS, wide) | flat_b[partner]
        ends = np.cumsum([len(u.encode("utf-8")) + 1 for u in some])
        last = np.searchsorted(both, ends, side="right")
        first = np.concatenate([[0], last[:-1]])
        n_a, n_b, n_links = (n[last] - n[first] for n in (before_a, before_b, links_before))
        ids_a, ids_b = [self._names[k] for k in a], [self._names[k] for k in b]
        from_a, from_b = before_a.tolist(), before_b.tolist()
        texts = [
            f"{','.join(ids_a[from_a[g] : from_a[g + 1]])}|{','.join(ids_b[from_b[g] : from_b[g + 1]])}"
            for g in range(len(both))
        ]
        groups = [";".join(texts[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        self._remember(some, n_a, n_b, last - first, n_links, codes, groups)
        return True

    def _remember(self, some: list[str], n_a, n_b, n_groups, n_links, codes: np.ndarray, groups: list[str]) -> None:
        fits = np.array([bool(g) for g in groups])
        done = int(self._ends[-1][-1]) if len(self._ends[-1]) else 0
        self._entry.update(zip(some, range(len(self._groups), len(self._groups) + len(some)), strict=True))
        self._groups += groups
        self._numbers.append((np.stack([n_a, n_b, n_groups, n_links], axis=1) * fits[:, None]).astype(np.int32))
        self._ends.append(done + np.cumsum(n_links * fits))
        self._flat.append(codes)


def _byte_level(spec: dict) -> list[bytes]:
    """Bytes of every id of a byte-level BPE.

    Its entries spell a byte by a visible letter: itself where it is one, else the next
    letter from U+0100 on, in the order of the bytes.
    """
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    letter = {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
    entries = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(entries.values()) + 1)
    for entry, k in entries.items():
        out[k] = bytes(letter[c] for c in entry) if all(c in letter for c in entry) else entry.encode("utf-8")
    return out


def _piece(piece: str) -> bytes:
    """Bytes of a piece: U+2581 is a space, <0xHH> a byte."""
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode("utf-8")


def tallied(codes: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, document) pairs in order, each once, with their counts added up."""
    both = codes << DOC_BITS | docs
    order = np.argsort(both, kind="stable")
    both = both[order]
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    counts = np.add.reduceat(counts[order], new) if len(new) else counts
    return both[new] >> DOC_BITS, both[new] & ((1 << DOC_BITS) - 1), counts


class Postings(NamedTuple):
    """Planes of a block: word `word` of plane `plane` of the pair of number `pair` has bits `bits`."""

    pair: np.ndarray
    plane: np.ndarray
    word: np.ndarray
    bits: np.ndarray


def planes(pair: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> Postings:
    """Multiplicity planes of (pair, document, count) in order; empty words are left out."""
    parts = []
    for k in range(int(counts.max(initial=0)).bit_length()):
        has = np.flatnonzero(counts >> k & 1)
        of, word = pair[has], docs[has] >> 6
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (word[1:] != word[:-1]))[: len(of)])
        bits = np.left_shift(np.uint64(1), (docs[has] & 63).astype(np.uint64))
        parts.append((of[new], np.full(len(new), k), word[new], np.bitwise_or.reduceat(bits, new)))
    if not parts:
        return Postings(*(np.zeros(0, dtype=t) for t in (np.int32, np.int8, np.int32, np.uint64)))
    pairs, plane, words, bits = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Postings(pairs.astype(np.int32), plane.astype(np.int8), words.astype(np.int32), bits)


def popcounts(post: Postings, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: documents that hold it, by OR over its planes, and its links, by their weights."""
    order = np.lexsort((post.word, post.pair))
    of, word = post.pair[order], post.word[order]
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (word[1:] != word[:-1]))[: len(of)])
    docs, links = np.zeros(n_pairs, dtype=np.int64), np.zeros(n_pairs, dtype=np.int64)
    if len(new):
        merged = np.bitwise_or.reduceat(post.bits[order], new)
        np.add.at(docs, of[new], np.bitwise_count(merged).astype(np.int64))
        np.add.at(links, post.pair, np.bitwise_count(post.bits).astype(np.int64) << post.plane.astype(np.int64))
    return docs, links


def returned(post: Postings, scores: np.ndarray, n_docs: int) -> np.ndarray:
    """Each document's sum over its links of their pair's row of whole numbers in `scores`."""
    out = np.zeros((n_docs, scores.shape[1]), dtype=np.int64)
    for bit in range(64):
        has = np.flatnonzero(post.bits >> np.uint64(bit) & np.uint64(1))
        weights = scores[post.pair[has]] << post.plane[has].astype(np.int64)[:, None]
        np.add.at(out, (post.word[has].astype(np.int64) << 6) + bit, weights)
    return out


def _packed(arrays: Sequence[np.ndarray]) -> bytes:
    table = pa.table({str(k): x for k, x in enumerate(arrays)})
    return _zipped(table)


def _zipped(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


class _Block:
    """Documents that are waiting to become a block."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.keys: list = []
        self.rows: list[tuple] = []
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._loose = 0

    def add(self, keys: list, texts: list[str | None], aligner: Aligner) -> None:
        """Short texts, looked up together, or one text of any length."""
        if len(texts) > 1:
            split = [_CUT.split(t) if t else [] for t in texts]
            found = [(range(len(texts)), split, aligner.look_up(list(chain.from_iterable(split))))]
        else:
            found = (([0], [stretch], aligner.look_up(stretch)) for stretch in units(texts[0] or ""))
        first = len(self.rows)
        sums = np.zeros((len(texts), 4), dtype=np.int64)
        digests, fits, parts = [hashlib.sha256() for _ in texts], [bool(t) for t in texts], []
        for which, split, got in found:
            ends = np.cumsum([len(u) for u in split]).tolist()
            totals = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(np.stack(got[:4], axis=1), axis=0)])
            for k, end, stretch in zip(which, ends, split, strict=True):
                groups = got.groups[end - len(stretch) : end]
                fits[k] = fits[k] and all(groups)
                if fits[k]:
                    digests[k].update((";" * bool(sums[k, 2]) + ";".join(groups)).encode())
                    sums[k] += totals[end] - totals[end - len(stretch)]
            owner = np.repeat(np.repeat(np.array(which), [len(u) for u in split]), got.n_links)
            codes, docs, counts = tallied(got.codes, owner + first, np.ones(len(owner), dtype=np.int64))
            parts.append((codes, docs, counts))
        good = np.array(fits)
        for codes, docs, counts in parts:
            whole = good[docs - first]
            self._parts.append((codes[whole], docs[whole], counts[whole]))
            self._loose += len(docs)
            if self._loose > 4_000_000:
                self._parts, self._loose = [tallied(*self._all())], 0
        self.keys += keys
        self.rows += [
            (*n, digest.hexdigest()) if fit else (0, 0, 0, 0, "")
            for n, digest, fit in zip(sums.tolist(), digests, fits, strict=True)
        ]
        self.size += sum(len(t or "") + 64 for t in texts)

    def _all(self) -> list[np.ndarray]:
        if not self._parts:
            return [np.zeros(0, dtype=np.int64)] * 3
        return [np.concatenate(x) for x in zip(*self._parts, strict=True)]

    def row(self, kind: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
        codes, docs, counts = tallied(*self._all())
        different, pair = np.unique(codes, return_inverse=True)
        post = planes(pair, docs, counts)
        held, links = popcounts(post, len(different))
        columns = list(zip(*self.rows, strict=True))
        keys = pa.array(self.keys, type=kind)
        rows = pa.table([keys, *map(pa.array, columns)], names=["key", "n_a", "n_b", "n_groups", "n_links", "sha"])
        values = [self.number, _zipped(rows), _packed(post), different, held, links]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str | None]]]:
    """Rows in runs of about STRETCH bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 64
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), STRETCH)))
        part = batch.slice(at, n)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()
        at += n


def postings(docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored inverted index, a row per block.

    `codes` are the block's id pairs (A id * 2**B_BITS + B id), `held` and `links` how many
    of its documents hold each and how often it is linked; `planes` and `docs` are packed.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        aligner, block = Aligner(byte_bpe, piece_bpe), _Block(number)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for keys, texts in _runs(batch):
                block.add(keys, texts, aligner)
                if block.size >= BLOCK_BYTES:
                    yield block.row(kind, arrow)
                    number += 1
                    block = _Block(number)
        if block.rows:
            yield block.row(kind, arrow)
        aligner = block = None
        release()

    rows = docs.select(named(key).alias("key_of_row"), named(text).cast("string").alias("text_of_row"))
    return stored(rows.mapInArrow(run, _BLOCK), "postings")


def pair_counts(index: DataFrame) -> DataFrame:
    """(code, a_id, b_id, n_docs, n_links, best) of every id pair that is linked.

    n_docs is how many documents hold it; best tells that no other pair of its A id is
    held by more. The pairs of one A id are at most as many as there are B ids.
    """
    counts = (
        index.select(F.inline(F.arrays_zip("codes", "held", "links")))
        .groupBy("codes")
        .agg(F.sum("held").alias("n_docs"), F.sum("links").alias("n_links"))
        .select(
            F.col("codes").alias("code"),
            F.shiftright("codes", B_BITS).cast("int").alias("a_id"),
            F.col("codes").bitwiseAND((1 << B_BITS) - 1).cast("int").alias("b_id"),
            "n_docs",
            "n_links",
        )
    )
    most = F.max("n_docs").over(Window.partitionBy("a_id"))
    return counts.withColumn("best", F.col("n_docs") == most)


def document_scores(index: DataFrame, counts: DataFrame, kind: T.DataType, key: str = "doc_id") -> DataFrame:
    """A row per document: its tokens, groups, links, links of best pairs, and the counts over its links.

    A block asks for the counts of its different pairs, one row for each, whatever
    number of documents holds them; its planes hand them on to the documents.
    """
    schema = T.StructType(
        [T.StructField(key, kind)]
        + [T.StructField(n, T.LongType(), False) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        + [T.StructField("groups_sha256", T.StringType(), False)]
    )
    arrow = to_arrow_schema(schema)

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for docs, packed in zip(blocks["docs"], blocks["planes"], strict=True):
            rows, parts = _opened(docs.as_py()), _opened(packed.as_py())
            post = Postings(*(parts[str(k)].to_numpy() for k in range(4)))
            order = np.argsort(answers["code"].to_numpy())
            best = answers["best"].to_numpy().astype(np.int64)[order]
            scores = np.stack([best, answers["n_docs"].to_numpy()[order]], axis=1)
            sums = returned(post, scores, len(rows))
            values = [rows[n] for n in ("key", "n_a", "n_b", "n_groups", "n_links")]
            values += [pa.array(sums[:, 0]), pa.array(sums[:, 1]), rows["sha"]]
            made.append(pa.table([pc.cast(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow))
        return pa.concat_tables(made) if made else arrow.empty_table()

    asked = index.select(F.col("block").alias("asked_by"), F.explode("codes").alias("code"))
    answers = asked.join(counts.select("code", "n_docs", "best"), "code").select("asked_by", "code", "n_docs", "best")
    whole = index.select("block", "docs", "planes")
    return whole.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(run, schema)


def aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row per row of `docs`.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte,
    have zeros and an empty groups_sha256. Rows count by themselves, with repeated or
    null keys too; other columns take no part, whatever their names. An empty table
    gives no row. Texts of any length are cut up a stretch at a time.
    """
    index = postings(docs, byte_bpe, piece_bpe, key, text)
    counts = stored(pair_counts(index), "pair_counts")
    return document_scores(index, counts, docs.select(named(key)).schema[0].dataType, key)


def tokenizer_files() -> tuple[str, str]:
    """Places of the byte BPE and the piece BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned by the two public tokenizers."""
    return aligned(read(spark, sf_dir, "documents"), *tokenizer_files())
