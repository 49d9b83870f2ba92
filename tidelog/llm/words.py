"""Words of whole texts and their 64-bit hashes, without a Python step for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MASK = (1 << 64) - 1
#: Bytes whose words are hashed at once.
SLICE = 1 << 18
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Lower-cases A-Z; what isn't a digit, an ASCII letter or a byte over 127 becomes a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Lower-cases A-Z; only space and the bytes 9 to 13 part words.
SPACE_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))

_random = np.random.default_rng(20240229)
BYTE_CODES = _random.integers(1, MASK, 256, np.uint64, endpoint=True)
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024), STEP, np.uint64))])
    return _powers[:n]


@dataclass
class Words:
    """hashes of all words of some texts; text k has words first[k] to first[k + 1]."""

    hashes: np.ndarray
    first: np.ndarray


def hash_words(texts: list[bytes], table: bytes) -> Words:
    """The words' hashes. `table` maps bytes as bytes.translate does; spaces part words. All bytes are read, SLICE or a word more at a time."""
    data = b" " + b" ".join(texts).translate(table) + b" "
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data) - 1:
        end = data.index(b" ", min(at + SLICE, len(data) - 1))
        first, some = slice_words(np.frombuffer(data, np.uint8, end + 1 - at, at))
        starts.append(first + at)
        hashes.append(some)
        at = end
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return Words(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins))


def slice_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a slice that begins and ends with a space."""
    letter = buf != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    chars = buf[letter]
    places = np.arange(len(chars)) - np.repeat(offsets, lengths)
    codes = BYTE_CODES[chars] * powers(int(lengths.max(initial=0)))[places]
    return starts, mix(np.add.reduceat(codes, offsets)) if len(offsets) else np.zeros(0, np.uint64)


GRAM_CODES = _random.integers(1, MASK, 64, np.uint64, endpoint=True) | np.uint64(1)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on, for all but the last k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k * int(STEP) & MASK, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * GRAM_CODES[j]
    return mix(total)
