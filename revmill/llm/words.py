"""Words of many texts at once: byte classes, word bounds and 64-bit word hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed together: arrays of eight times as many stay in cache.
BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=None)
def spaced() -> np.ndarray:
    """True for bytes of a word when words are `[^\\x20\\x09-\\x0D]+`."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


@lru_cache(maxsize=None)
def alphanumeric() -> np.ndarray:
    """True for bytes of a word when words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


@lru_cache(maxsize=None)
def lowered() -> np.ndarray:
    """Byte table that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def release() -> None:
    """Give freed memory back to the machine: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library gives memory back by itself
        pass


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)

    def up(x: int) -> np.ndarray:
        out = np.full(n, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(_BASE), up(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(left * _U(0xD6E8FEB86659FD93) + right + _U(1))


def blocks(texts: Sequence[str | None], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about `most` bytes: (first, end, bytes joined by newlines, start of each text).

    A null text is empty. A text longer than `most` is a run of its own.
    """
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if parts and size + len(data) > most:
            yield first, i, *_joined(parts)
            first, parts, size = i, [], 0
        parts.append(data)
        size += len(data) + 1
    if parts:
        yield first, first + len(parts), *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[bytes, np.ndarray]:
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    return b"\n".join(parts) + b"\n", np.concatenate([[0], np.cumsum(lengths)])


def bounds(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in lower-cased bytes; a newline must end the data."""
    inside = table[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands.

    Words are hashed in stretches of BLOCK_BYTES, so that a very long text or word takes
    no more working memory than a block.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    up, down = _powers(BLOCK_BYTES)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        end = int(np.searchsorted(ends, base + BLOCK_BYTES, side="right"))
        if end == first:
            out[first] = _long_word(data[base : int(ends[first])], up)
            first += 1
            continue
        held = data[base : int(ends[end - 1])]
        total = np.zeros(len(held) + 1, dtype=np.uint64)
        np.cumsum((held.astype(np.uint64) + _U(1)) * up[: len(held)], out=total[1:])
        start = starts[first:end] - base
        out[first:end] = (total[ends[first:end] - base] - total[start]) * down[start]
        first = end
    return mix(out)


def _long_word(word: np.ndarray, up: np.ndarray) -> int:
    """The sum that `hashes` mixes, of a word longer than a stretch."""
    total = 0
    for at in range(0, len(word), len(up)):
        part = word[at : at + len(up)].astype(np.uint64) + _U(1)
        total += int((part * up[: len(part)]).sum()) * pow(_BASE, at, 1 << 64)
    return total % (1 << 64)


def word_hashes(joined: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of joined texts, A-Z lower-cased."""
    data = lowered()[np.frombuffer(joined, dtype=np.uint8)]
    starts, ends = bounds(data, table)
    return starts, ends, hashes(data, starts, ends)
