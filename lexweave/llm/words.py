"""Word hashes of many texts at once, for use inside Arrow tasks.

A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of prefix sums, so a
batch of texts needs a few passes of numpy and no loop over words. Separators are ASCII bytes, hence
working on UTF-8 bytes is exact. Two different words share a hash with a chance of about 2**-58.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Bytes of text that are hashed at a time, so that the arrays stay within some 20 MB; a longer text is taken alone.
CHUNK = 1 << 18

_ALL = np.arange(256)
#: [^\x20\x09-\x0D]+
BLANKS = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, on lower-cased text
NOT_ALNUM = (_ALL <= 0x2F) | ((_ALL >= 0x3A) & (_ALL <= 0x60)) | ((_ALL >= 0x7B) & (_ALL <= 0x7F))
_LOWERED = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The batch's first column of a name, spelt in any case."""
    return batch.column([x.lower() for x in batch.schema.names].index(name))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(2 * n, CHUNK + 2) if n > CHUNK + 2 else CHUNK + 2
        with np.errstate(over="ignore"):
            _powers, _inverses = (np.cumprod(np.array([1] + [x] * (n - 1), np.uint64), dtype=np.uint64) for x in (_BASE, _BASE_INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[bounds[i]:bounds[i + 1]], where each text's words begin among them, the hashes of the words' heads, and the words' places in data."""
    _grow(len(data) + 1)
    low = _LOWERED.astype(np.uint8)[data]
    word = ~separators[low]
    before = np.empty(len(word), bool)
    before[0] = False
    before[1:] = word[:-1]
    before[bounds[:-1][bounds[:-1] < len(word)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(word), bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=prefix[1:])
        hashes = mix((prefix[ends] - prefix[starts]) * _inverses[starts])
        parts = np.zeros((len(heads), len(starts)), np.uint64)
        for k, size in enumerate(heads):
            whole = ends - starts > size
            at = starts[whole]
            parts[k, whole] = mix((prefix[at + size] - prefix[at]) * _inverses[at] + np.uint64(size))
    return hashes, np.searchsorted(starts, bounds), parts, starts


def hashed(text: pa.Array, separators: np.ndarray = BLANKS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the number of the first, the word hashes, and each text's bounds in them.

    Texts are lower-cased (A-Z only) first; null counts as empty.
    """
    for at, hashes, bounds, _ in hashed_with_heads(text, separators, ()):
        yield at, hashes, bounds


def _chunks(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the number of the first, the UTF-8 bytes, and each text's bounds in them; null counts as empty."""
    text = text.cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def hashed_with_heads(text: pa.Array, separators: np.ndarray, heads: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """As hashed, with a row of hashes for each of the heads: of a word's first so many bytes, 0 for words that aren't longer."""
    for at, data, bounds in _chunks(text):
        if len(data):
            hashes, cuts, parts, _ = _hash(data, bounds, separators, heads)
        else:
            hashes, cuts, parts = np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros((len(heads), 0), np.uint64)
        yield at, hashes, cuts, parts


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
