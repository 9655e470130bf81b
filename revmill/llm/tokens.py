"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

#: Words whose ids a worker keeps at hand before it lets the rarer ones go. Results do not depend on it.
REMEMBERED = 600_000
#: Words that are looked up together.
TOGETHER = 200_000
END = 0
#: Lines of letters and end marks, which normalising and splitting treat alike wherever they stand, or of anything.
_PLAIN = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)|.*)$", re.M)


class Encoder:
    """Encodes texts as the word BPE file does, with `add_special_tokens=False`.

    The file's normaliser and splitter work on either side of a space by themselves,
    so the ids of a text are those of its space-separated words in order. Words of
    plain letters and end marks are lower-cased and split here, which leaves fewer
    different ones; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._split = Tokenizer.from_file(path)
        self._split.normalizer = normalizers.Sequence([])
        self._split.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # Ids that end a word.
        last = [k for entry, k in self._split.get_vocab().items() if entry.endswith("</w>")]
        self._last = np.zeros(self._split.get_vocab_size(), dtype=bool)
        self._last[last] = True
        self._remembered = remembered
        self._forget()

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """One uint32 array per text; a null text is empty."""
        out: list[np.ndarray] = []
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            words = text.replace("\n", " ").split(" ") if text else []
            waiting.append(words)
            size += len(words)
            if size >= TOGETHER:
                out += self._arrays(waiting)
                waiting, size = [], 0
        return out + self._arrays(waiting)

    def with_end(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The same, each followed by id 0."""
        end = np.array([END], dtype="<u4")
        return [np.concatenate([ids, end]) for ids in self.encode(texts)]

    def _forget(self) -> None:
        """Entry k has ids `flat[start[k] : start[k + 1]]`; entry 0 is the empty word."""
        self._entry: dict[str, int] = {"": 0}
        self._start = [np.zeros(2, dtype=np.int64)]
        self._flat = [np.zeros(0, dtype="<u4")]
        self._uses = np.ones(1, dtype=np.int32)

    def _shrink(self) -> None:
        """Keep a quarter at most: the words that were looked up most often, more than once."""
        order = np.argsort(-self._uses[1:], kind="stable")[: self._remembered // 4] + 1
        kept = np.concatenate([[0], np.sort(order[self._uses[order] > 1])])
        words = list(self._entry)
        flat, counts = self._gather(kept)
        self._entry = {words[k]: place for place, k in enumerate(kept.tolist())}
        self._start, self._flat = [np.concatenate([[0], np.cumsum(counts)])], [flat]
        self._uses = np.ones(len(kept), dtype=np.int32)

    def _add(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        first = len(self._entry)
        self._entry.update(zip(words, range(first, first + len(words)), strict=True))
        self._start.append(self._start[-1][-1] + np.cumsum(counts))
        self._flat.append(flat)

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after another, and how many each has."""
        if len(self._start) > 1:
            self._start, self._flat = [np.concatenate(self._start)], [np.concatenate(self._flat)]
        start = self._start[0][entries]
        counts = self._start[0][entries + 1] - start
        before = np.cumsum(counts) - counts
        return self._flat[0][np.repeat(start - before, counts) + np.arange(counts.sum())], counts

    def _arrays(self, split: list[list[str]]) -> list[np.ndarray]:
        if len(self._entry) > self._remembered:
            self._shrink()
        words = list(chain.from_iterable(split))
        entries = np.fromiter(map(self._entry.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(entries < 0).tolist()
        if missing:
            unknown = [words[i] for i in missing]
            self._learn(list(set(unknown)))
            entries[missing] = [self._entry[w] for w in unknown]
        self._uses.resize(len(self._entry), refcheck=False)
        self._uses += np.bincount(entries, minlength=len(self._entry)).astype(np.int32)
        flat, counts = self._gather(entries)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, split)])]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Add different unknown words; what is plain is matched, lower-cased and encoded all at once."""
        known = self._entry
        parts = _PLAIN.findall("\n".join(words))
        stems = "\n".join([stem for stem, _ in parts]).lower().split("\n")
        ends = [end for _, end in parts]
        new = [part for part in dict.fromkeys(chain(stems, ends)) if part not in known]
        if new:
            ids = np.asarray(self._split.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
            self._add(new, ids, np.diff(np.flatnonzero(self._last[ids]), prepend=-1))
        both = [k for k, word in enumerate(words) if stems[k] and word not in known]
        if both:
            places = np.array([[known[stems[k]], known[ends[k]]] for k in both])
            flat, counts = self._gather(places.ravel())
            self._add([words[k] for k in both], flat, counts.reshape(-1, 2).sum(axis=1))
        other = [word for k, word in enumerate(words) if not stems[k] and word not in known]
        if other:
            made = [e.ids for e in self._whole.encode_batch_fast(other, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(made), dtype="<u4")
            self._add(other, flat, np.array([len(ids) for ids in made]))


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """The encoder of this Python worker: workers are used again, and words come again from task to task."""
    return Encoder(path)


def word_bpe() -> str:
    """Place of the 49k word BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
