"""Sets of word shingles as sorted 64-bit hashes, in numpy.

Words are runs of anything but ``[\\x20\\x09-\\x0D]`` with A-Z in lower case. A set holds the
distinct hashes of ``k`` words in a row; of a text with fewer words, of its words as one.
"""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
PART = 4 << 20  # characters worked on at once
SMALL = 1 << 20  # the same where a part's arrays and words take some thirty times as much


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more at the end)."""
    raw = [t.encode().lower() for t in texts]  # of bytes: A-Z only
    data = b"\n".join(raw) + b"\n" + bytes(8)
    codes = np.frombuffer(data, np.uint8)
    blank = BLANK[codes]
    blank[-8:] = True
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = ends - starts
    eight = np.ndarray(len(codes) - 7, "<u8", data, strides=(1,))  # eight bytes from each place
    hashes = mixed(sizes.astype(np.uint64))
    live = np.arange(len(starts))
    done = 0
    while len(live):
        left = sizes[live] - done
        chunk = eight[starts[live] + done]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        hashes[live] = mixed(hashes[live] * np.uint64(0x9E3779B97F4A7C15) + chunk)
        done += 8
        live = live[left > 8]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return hashes, np.searchsorted(starts, offsets)


def joined(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` word hashes in a row."""
    n = max(len(hashes) - k + 1, 0)
    out = hashes[:n]
    for i in range(1, k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def parts(texts: list[str], most: int = SMALL):
    """Runs of texts of bounded size together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int):
    """Shingle hashes of each text in order, and the place of their first words."""
    every = joined(hashes, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield every[a : b - k + 1], a
        elif b > a:  # fewer words than a shingle: all as one, told apart by their number
            yield mixed(joined(hashes[a:b], b - a) + np.uint64(b - a)), a
        else:
            yield every[:0], a


def sets(texts: list[str], k: int):
    """The sorted set of each text."""
    for some in parts(texts):
        hashes, bounds = word_hashes(some)
        for found, _ in shingles(hashes, bounds, k):
            yield np.unique(found)
