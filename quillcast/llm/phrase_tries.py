"""Phrases that occur together more often than their parts would by chance, for each language.

Level by level, from words to the longest phrases: candidates of a length are phrases in the
text all of whose parts are frequent. They go into double-array tries, broadcast in blocks of
some ``BLOCK`` phrases; in each task numpy moves the states of all places of many texts
on by one word at a time, and counts the places at each accepting state. Sums over all tasks
are the frequencies, and frequent candidates are the base of the next level. Where there are
several blocks, the places are dealt to them first, so each is looked at once.

What keeps candidates few are hashed counters, 2**``COUNTERS`` of them, of which each task passes
on those that it has met: a candidate whose counter stays below the least frequency can't reach it.
Before a level is counted the texts are cut down to stretches of phrases in busy counters, and after it to
stretches of frequent phrases, both found by a bitmap of 2**``bits`` bits, more for many phrases. What the
bitmap lets through is looked up among the busy counters as well, as a bitmap passes on a share of all
phrases, of which there are many more than frequent ones.
What counters and bitmaps let through by chance is counted exactly by the tries, so they change no result.

Words are kept as 64-bit hashes. Two words of one language under one hash would be told
apart by their texts when words are counted, and everything is hashed anew with another seed.

A-Z count as lower case; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+`` in a
piece. Null and empty texts have no words; a null language is ``und``. Repeated documents
count each time. Very long texts are taken whole. Equal scores go by frequency, then by the
phrase in byte order. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillcast.llm.common import forget, staged
from quillcast.llm.shingle_sets import PART, mixed

LEAST = 100
LONGEST = 5
TOP = 2000
COVERED = 100  # percent of a phrase's occurrences inside one longer phrase
BLOCK = 500_000  # phrases of a broadcast trie; some 50 MB
BITS = 23  # of a bit's number in a bitmap, at least: 1 MB
MOST_BITS = 28  # at most, however many phrases there are: 32 MB
COUNTERS = 42  # bits of a counter's number
BUSY = 1 << 23  # counters that are looked up beside the bitmap, at most: 64 MB
SLOTS = 10  # bits of the range of hashes that is merged as one row
SLOT = 1024  # counts that are summed as one row
HELD = 500_000  # candidates or words that a task holds before it merges them or passes them on
BYTES = 32 << 20  # of words likewise, where they are long
SLICE = 1 << 16  # words that are told at once
PLACES = 1 << 22  # whose counters a task holds before it passes them on
PIECE = 1 << 20  # characters that are cut into words at once where no words are gathered
SEEDS = 8
WORDS = 1 << 20  # words whose places are worked on at once
WIDE = 8  # followers beyond which a state is placed by itself

KIND = np.zeros(256, np.int8)  # of bytes: 0 in a word, 1 between words, 2 between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) bytes of all words, and the number of piece ends before each."""
    kind = KIND[data]
    edge = np.diff(np.r_[True, kind > 0, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, np.cumsum(kind == 2, dtype=np.int32)[starts]


def hashes_of(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of stretches of ``data``, which ends in eight bytes to spare; never 0."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mixed(sizes.astype(np.uint64) + np.uint64(seed << 32))
    live, done = np.arange(len(starts)), 0
    while len(live):
        left = sizes[live] - done
        chunk = eight[starts[live] + done]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        out[live] = mixed(out[live] * np.uint64(0x9E3779B97F4A7C15) + chunk)
        done += 8
        live = live[left > 8]
    return np.where(out == 0, np.uint64(1), out)


def texts_by_language(batch: pa.RecordBatch, size: int = PART) -> Iterator[tuple[str, list[str]]]:
    """Languages and texts of a batch, in runs of some ``size`` characters or one text."""
    lang = batch.column(0).dictionary_encode()
    codes = lang.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(lang.dictionary.to_pylist()):
        texts = batch.column(1).filter(pa.array(codes == code))
        held, n = [], 0
        for text in texts:
            held.append(text.as_py())
            n += len(held[-1])
            if n >= size:
                yield name, held
                held, n = [], 0
        if held:
            yield name, held


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of some texts, their words' places, pieces and where each text's words begin."""
    raw = [t.encode().lower() for t in texts]  # of bytes: A-Z only
    data = b"\n".join(raw) + b"\n" + bytes(8)
    starts, ends, pieces = word_places(np.frombuffer(data, np.uint8)[:-8])
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return data, starts, ends, pieces, np.searchsorted(starts, offsets)


def distinct_words(data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, n: np.ndarray):
    """``hashes, n, sizes`` and bytes of the distinct words of ``data``, with the sums of ``n``, in order of hashes.

    One word stands for each hash; others that share it follow at the end with a count of 0, as
    they have to be seen as well.
    """
    order = np.argsort(hashes, kind="stable")
    new = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]][: len(order)]
    begin = np.flatnonzero(new)
    first, same = order[begin], np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    odd = unlike(data, starts, ends, first[same])
    kept = np.r_[first, odd]
    sums = np.add.reduceat(n[order], begin) if len(begin) else n[:0]
    sizes = ends[kept] - starts[kept]
    edges = pa.py_buffer(np.stack([starts, ends], 1).astype(np.int64))  # words, and what stands between them
    every = pa.Array.from_buffers(pa.large_binary(), max(2 * len(starts) - 1, 0), [None, edges, pa.py_buffer(data)])
    raw = every.take(pa.array(2 * kept)).buffers()[2] if len(kept) else None
    raw = np.frombuffer(raw, np.uint8, sizes.sum()) if raw else np.zeros(0, np.uint8)
    return hashes[kept], np.r_[sums, np.zeros(len(odd), np.int64)], sizes, raw


class Words:
    """Distinct words of some languages with their counts, merged whenever ``HELD`` and as many as there were have come."""

    def __init__(self):
        self.lists: dict = {}
        self.new, self.before = 0, HELD

    def add(self, lang: str, *words: np.ndarray) -> None:
        self.lists.setdefault(lang, []).append(words)
        self.new += len(words[0])
        if self.new > self.before:
            self.lists = {lang: [found] for lang, found in self.merged()}
            self.new, self.before = 0, max(HELD, self.held())

    def merged(self) -> list:
        out = []
        for lang, some in self.lists.items():
            hashes, n, sizes, raw = (np.concatenate(x) for x in zip(*some))
            ends = np.cumsum(sizes)
            out.append((lang, distinct_words(raw.tobytes() + bytes(8), ends - sizes, ends, hashes, n)))
        return out

    def held(self) -> int:
        return sum(len(x[0]) for some in self.lists.values() for x in some)

    def full(self) -> bool:
        return self.held() > 2 * HELD or sum(len(x[3]) for some in self.lists.values() for x in some) > BYTES


def packed_words(found: Words) -> Iterator[pa.RecordBatch]:
    """A row for each language and range of hashes."""
    for lang, (hashes, n, sizes, raw) in found.merged():
        slots = bucket(hashes, SLOTS)
        if len(slots) and (np.diff(slots) < 0).any():  # words that share a hash stand at the end
            order, ends = np.argsort(slots, kind="stable"), np.cumsum(sizes)
            raw = np.concatenate([raw[ends[k] - sizes[k] : ends[k]] for k in order.tolist()])
            hashes, n, sizes, slots = hashes[order], n[order], sizes[order], slots[order]
        slots, begin, each = np.unique(slots, return_index=True, return_counts=True)
        offsets = np.r_[0, np.cumsum(sizes)][np.r_[begin, len(sizes)]].astype(np.int32)
        columns = [
            pa.repeat(pa.scalar(lang, pa.string()), len(slots)),
            pa.array(slots.astype(np.int32)),
            lists(hashes.view(np.int64), each),
            lists(n, each),
            lists(sizes.astype(np.int32), each),
            pa.Array.from_buffers(pa.binary(), len(slots), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "slot", "hashes", "n", "sizes", "raw"])


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, hash, word, n`` of all words.

    A task passes its words on as a row for each language and range of hashes.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Words()
        for batch in batches:
            for lang, texts in texts_by_language(batch, PIECE):
                data, starts, ends, _, _ = cut(texts)
                hashes = hashes_of(data, starts, ends - starts, seed)
                found.add(lang, *distinct_words(data, starts, ends, hashes, np.ones(len(hashes), np.int64)))
                if found.full():
                    yield from packed_words(found)
                    found = Words()
        yield from packed_words(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Words()
        for batch in batches:
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                hashes, n, sizes = (batch.column(c)[k].values.to_numpy() for c in ("hashes", "n", "sizes"))
                raw = np.frombuffer(batch.column("raw")[k].as_buffer(), np.uint8)
                found.add(lang, hashes.view(np.uint64), n, sizes.astype(np.int64), raw)
        for lang, (hashes, n, sizes, raw) in found.merged():
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                edge = ends[start] - sizes[start]
                end = min(max(start + 1, int(np.searchsorted(ends, edge + BYTES, "right"))), start + SLICE)
                offsets = (np.r_[edge, ends[start:end]] - edge).astype(np.int32)
                parts = [None, pa.py_buffer(offsets), pa.py_buffer(raw[edge : ends[end - 1]])]
                columns = [
                    pa.repeat(pa.scalar(lang, pa.string()), end - start),
                    pa.array(hashes[start:end].view(np.int64)),
                    pa.Array.from_buffers(pa.string(), end - start, parts),
                    pa.array(n[start:end]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "hash", "word", "n"])
                start = end

    packed = "lang string, slot int, hashes array<bigint>, n array<bigint>, sizes array<int>, raw binary"
    rows = docs.mapInArrow(gather, packed).repartition("lang", "slot")
    return rows.mapInArrow(merge, "lang string, hash bigint, word string, n bigint")


def unlike(data: bytes, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The words that are not the same bytes as the word ``other`` that their hash stands for."""
    sizes = ends - starts
    odd = sizes != sizes[other]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    live, done = np.flatnonzero(~odd & (other != np.arange(len(other)))), 0
    while len(live):
        left = sizes[live] - done
        apart = eight[starts[live] + done] ^ eight[starts[other[live]] + done]
        short = left < 8
        apart[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        odd[live[apart != 0]] = True
        done += 8
        live = live[(left > 8) & (apart == 0)]
    return np.flatnonzero(odd)


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def among(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bucket(hashes, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(rows: DataFrame, bits: int) -> np.ndarray:
    """A bit for each bucket (column ``bucket``): at most 2**(bits - 6) rows come to the driver."""
    bit = F.expr("shiftleft(1L, cast(bucket & 63 as int))")
    slots = rows.groupBy(F.expr("bucket >> 6").alias("slot")).agg(F.bit_or(bit).alias("bits"))
    told = slots.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[told["slot"].to_numpy()] = told["bits"].to_numpy()
    return out.astype("<i8").view(np.uint8)


class Busy:
    """Busy counters: their bitmap, and their numbers in order unless they are more than ``BUSY``."""

    def __init__(self, counters: DataFrame, bits: int):
        n = counters.count()
        bits = enough_bits(n, bits)
        self.bitmap = bitmap_of(counters.select(F.shiftright("bucket", COUNTERS - bits).alias("bucket")), bits)
        self.numbers = np.sort(counters.toArrow()["bucket"].to_numpy()) if 0 < n <= BUSY else None

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = among(self.bitmap, hashes)
        if self.numbers is not None:
            at = np.flatnonzero(found)
            asked = bucket(hashes[at], COUNTERS)
            near = np.minimum(np.searchsorted(self.numbers, asked), len(self.numbers) - 1)
            found[at] = self.numbers[near] == asked
        return found


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def phrase_rows(langs: list[str], lang: np.ndarray, phrases: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    """``lang, words`` and more columns."""
    n, size = phrases.shape
    names = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(langs, pa.string()))
    columns = [names.cast(pa.string()), lists(phrases.ravel().view(np.int64), np.full(n, size))]
    return pa.RecordBatch.from_arrays([*columns, *more], names=["lang", "words", "n"][: 2 + len(more)])


def own_seed(lang: str) -> np.uint64:
    raw = lang.encode()
    return hashes_of(raw + bytes(8), np.array([0]), np.array([len(raw)]), 1)[0]


def phrase_hashes(columns: list[np.ndarray], own) -> np.ndarray:
    """Hashes of phrases given by their first words, second words and so on, under their languages' seeds."""
    out = columns[0]
    for words in columns[1:]:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words)
    return mixed(out ^ own)


def stretches(
    words: np.ndarray, starts: np.ndarray, size: int, bounds: np.ndarray, whole: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in which phrases of ``size`` words begin at each of ``starts`` in a row, a 0 after each.

    Unless they are to be ``whole``, a phrase that has no neighbour is left out, as no longer one
    is around it. Also gives the length of each text's part, whose words lie between ``bounds``.
    """
    after = np.diff(starts) == 1
    first, last = np.r_[True, ~after][: len(starts)], np.r_[~after, True][: len(starts)]
    alone = first & last & (not whole)
    starts, last = starts[~alone], last[~alone]
    ends = np.cumsum(np.where(last, size + 1, 1))
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    out[ends[~last] - 1] = words[starts[~last]]
    for j in range(size):
        out[ends[last] - 1 - size + j] = words[starts[last] + j]
    return out, np.diff(np.r_[0, ends][np.searchsorted(starts, bounds)])


def word_stretches(docs: DataFrame, frequent, seed: int) -> DataFrame:
    """``lang, words``: hashes of the words of each text that are in the bitmap and beside another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for lang, texts in texts_by_language(batch, PIECE):
                data, starts, ends, pieces, bounds = cut(texts)
                hashes = hashes_of(data, starts, ends - starts, seed)
                kept = np.flatnonzero(among(known, phrase_hashes([hashes], own_seed(lang))))
                # places with a gap at each end of a piece, so that neighbours are neighbours in it
                places = pieces + np.arange(len(pieces))
                spread = np.zeros(places[-1] + 1 if len(places) else 0, np.uint64)
                spread[places] = hashes
                edges = np.r_[places, len(spread)][bounds]
                words, sizes = stretches(spread, places[kept], 1, edges)
                yield text_rows([lang], np.zeros(len(sizes), np.int32), words, sizes)

    return docs.mapInArrow(run, "lang string, words array<bigint>")


def text_rows(langs: list[str], lang: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """``lang, words`` of texts that have any."""
    some = sizes > 0
    names = pa.DictionaryArray.from_arrays(pa.array(lang[some].astype(np.int32)), pa.array(langs, pa.string()))
    return pa.RecordBatch.from_arrays(
        [names.cast(pa.string()), lists(words.view(np.int64), sizes[some])], names=["lang", "words"]
    )


def some_places(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Places]:
    """The places of all texts, of some ``WORDS`` words or one text at a time."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + WORDS, "right")))
            yield Places(batch.slice(start, end - start), size)
            start = end


class Places:
    """The stretches of some texts in a row, and the places where ``size`` words stand together."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        lang = batch.column(0).dictionary_encode()
        self.langs, self.text_lang = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
        self.words = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.bounds = np.r_[0, np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))]
        live = self.words != 0  # the last word of each text is 0
        for _ in range(size - 1):
            live[:-1] &= live[1:]
        self.at, self.size = np.flatnonzero(live), size
        self.lang = np.repeat(self.text_lang, np.diff(self.bounds))[self.at]

    def columns(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.words[at + j] for j in range(self.size)]

    def hashes(self) -> np.ndarray:
        own = np.array([own_seed(x) for x in self.langs], np.uint64)
        return phrase_hashes(self.columns(self.at), own[self.lang])


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    n = np.concatenate(counts)[order]
    return every[begin], np.add.reduceat(n, begin) if len(begin) else n


def busy_counters(texts: DataFrame, size: int, least: int) -> DataFrame:
    """``bucket``: numbers of the counters that at least ``least`` places of phrases of ``size`` words fall into.

    A task passes on the counters it has met, not all, as a row for each range of them.
    """

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        every.sort()
        begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        found, n = every[begin], np.diff(np.r_[begin, len(every)])
        low = COUNTERS - SLOTS
        each = np.diff(np.searchsorted(found, np.arange((1 << SLOTS) + 1) << low))
        slots = np.flatnonzero(each)
        columns = [
            pa.array(slots.astype(np.int32)),
            lists(found.astype(np.uint32).view(np.int32), each[slots]),
            lists(n.astype(np.int32), each[slots]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "counters", "n"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for places in some_places(batches, size):
            held.append(bucket(places.hashes(), COUNTERS))
            n += len(held[-1])
            if n >= PLACES:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, new = [], [], 0
        for batch in batches:
            each = np.diff(batch.column(1).offsets.to_numpy())
            high = np.repeat(batch.column(0).to_numpy().astype(np.int64) << (COUNTERS - SLOTS), each)
            keys.append(high | batch.column(1).flatten().to_numpy().view(np.uint32))
            counts.append(batch.column(2).flatten().to_numpy().astype(np.int64))
            new += len(keys[-1])
            if new > PLACES:
                keys, counts = ([x] for x in summed(keys, counts))
                new = 0
        if keys:
            found, n = summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(found[n >= least])], names=["bucket"])

    rows = texts.mapInArrow(tell, "slot int, counters array<int>, n array<int>").repartition("slot")
    return rows.mapInArrow(add, "bucket bigint")


def enough_bits(phrases: int, bits: int) -> int:
    """Bits of a bitmap's numbers with which one other hash in sixteen or fewer is let through."""
    return max(bits, min((16 * phrases).bit_length(), MOST_BITS))


def distinct_rows(rows: np.ndarray) -> np.ndarray:
    hashes = phrase_hashes(list(rows.T), np.uint64(0))
    order = np.argsort(hashes)
    hashes, found = hashes[order], rows[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]][: len(found)]
    if ((found[1:] != found[:-1]).any(1) & ~new[1:]).any():  # phrases that share a hash
        found = rows[np.lexsort(rows.T[::-1])]
        new = np.r_[True, (found[1:] != found[:-1]).any(1)]
    return found[new]


class Distinct:
    """Distinct phrases under some names, merged whenever as many as ``HELD`` have come."""

    def __init__(self):
        self.lists: dict = {}
        self.new = 0

    def add(self, name, phrases: np.ndarray) -> None:
        self.lists.setdefault(name, []).append(phrases)
        self.new += len(phrases)
        if self.new > HELD:
            self.lists = {name: [found] for name, found in self.merged()}
            self.new = 0

    def merged(self) -> list:
        return [(name, distinct_rows(np.concatenate(some))) for name, some in self.lists.items()]

    def held(self) -> int:
        return sum(len(x) for some in self.lists.values() for x in some)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return bucket(hashes, 30) % blocks


def candidates(texts: DataFrame, size: int) -> DataFrame:
    """``lang, words, bucket``: the distinct phrases of ``size`` words in the stretches, and 30 bits of their hashes.

    A task passes its phrases on as a row for each language and range of hashes.
    """

    def packed(found: Distinct) -> Iterator[pa.RecordBatch]:
        for lang, phrases in found.merged():
            slots = bucket(phrase_hashes(list(phrases.T), own_seed(lang)), SLOTS)
            phrases = phrases[np.argsort(slots, kind="stable")]
            slots, n = np.unique(slots, return_counts=True)
            columns = [
                pa.repeat(pa.scalar(lang, pa.string()), len(slots)),
                pa.array(slots.astype(np.int32)),
                lists(phrases.ravel().view(np.int64), n * size),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "slot", "words"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Distinct()
        for places in some_places(batches, size):
            words = np.stack(places.columns(places.at), 1)
            for code in np.unique(places.lang):
                found.add(places.langs[code], distinct_rows(words[places.lang == code]))
            if found.held() > 2 * HELD:
                yield from packed(found)
                found = Distinct()
        yield from packed(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Distinct()
        for batch in batches:
            words = batch.column(2)
            ends = np.cumsum(np.r_[0, np.diff(words.offsets.to_numpy())]) // size
            phrases = words.flatten().to_numpy().view(np.uint64).reshape(-1, size)
            for k, lang in enumerate(batch.column(0).to_pylist()):
                found.add(lang, phrases[ends[k] : ends[k + 1]])
        for lang, phrases in found.merged():
            at = bucket(phrase_hashes(list(phrases.T), own_seed(lang)), 30)
            yield phrase_rows([lang], np.zeros(len(phrases), np.int32), phrases, pa.array(at))

    rows = texts.mapInArrow(gather, "lang string, slot int, words array<bigint>").repartition("lang", "slot")
    return rows.mapInArrow(merge, "lang string, words array<bigint>, n bigint").withColumnRenamed("n", "bucket")


class Trie:
    """Phrases of one length in a double array: from state s by symbol c to ``base[s] + c`` if its ``check`` is s.

    Words are numbered by how many phrases have them, and a word's number is read as one to
    three symbols of 8 bits, so a state has at most 256 followers and the array stays dense.
    """

    def __init__(self, langs: np.ndarray, phrases: np.ndarray):
        self.langs, lang = np.unique(langs, return_inverse=True)
        self.phrase_langs, self.phrases = lang.astype(np.int32), phrases
        self.words, which, n = np.unique(phrases, return_inverse=True, return_counts=True)
        rank = np.empty(len(n), np.int32)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
        self.numbers, which = rank, which.reshape(phrases.shape)
        self.shifts = range((max(len(n) - 1, 1).bit_length() - 1) // 8 * 8, -1, -8)
        self.room = len(self.langs)  # cells in use begin with a root for each language
        self.base, self.check = np.zeros(self.room, np.int32), np.full(self.room, -2, np.int32)
        state, rng = lang.astype(np.int64), np.random.default_rng(len(phrases))
        for j in range(phrases.shape[1]):
            for shift in self.shifts:
                state = self.grow(state, symbols(rank[which[:, j]], shift), rng)
        self.base, self.check = self.base[: self.room], self.check[: self.room]
        self.phrase_of = np.full(self.room, -1, np.int32)
        self.phrase_of[state] = np.arange(len(phrases), dtype=np.int32)

    def reserve(self, cells: int) -> None:
        if cells > len(self.check):
            more = max(cells - len(self.check), len(self.check) // 2)
            self.base = np.r_[self.base, np.zeros(more, np.int32)]
            self.check = np.r_[self.check, np.full(more, -1, np.int32)]

    def grow(self, state: np.ndarray, symbol: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Add the next symbol of all phrases; the states they lead to."""
        pairs, where = np.unique(state * 512 + symbol, return_inverse=True)
        parent, symbol = pairs // 512, pairs % 512
        begin = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]][: len(parent)])
        fan = np.diff(np.r_[begin, len(parent)])
        bases = np.zeros(len(begin), np.int64)
        wide = np.flatnonzero(fan > WIDE)
        for k in wide[np.argsort(-fan[wide], kind="stable")]:
            bases[k] = self.fitting(symbol[begin[k] : begin[k] + fan[k]])
            self.check[bases[k] + symbol[begin[k] : begin[k] + fan[k]]] = parent[begin[k]]
            self.room = max(self.room, int(bases[k]) + 257)
        node = np.repeat(np.arange(len(begin)), fan)
        self.scatter(node, parent, symbol, np.flatnonzero(fan[node] <= WIDE), bases, rng)
        self.base[parent[begin]] = bases
        return (bases[node] + symbol)[where]

    def scatter(self, node, parent, symbol, left, bases: np.ndarray, rng: np.random.Generator) -> None:
        """Bases for many states at once: each tries a place, those without a clash keep it, the others try again."""
        room = max(self.room, int(1.5 * ((self.check[: self.room] != -1).sum() + len(left)))) + 512
        while len(left):
            self.reserve(room)
            tried = rng.integers(0, room - 257, len(bases))
            cells = tried[node[left]] + symbol[left]
            owner = np.full(room, -1, np.int64)
            owner[cells] = node[left]
            clash = (owner[cells] != node[left]) | (self.check[cells] != -1)
            failed = np.zeros(len(bases), bool)
            failed[node[left[clash]]] = True
            fits = ~failed[node[left]]
            done = left[fits]
            bases[node[done]] = tried[node[done]]
            self.check[cells[fits]] = parent[done]
            self.room = max(self.room, int(cells[fits].max(initial=0)) + 257)
            if 4 * len(done) < len(left):
                room += room // 8
            left = left[~fits]

    def fitting(self, symbol: np.ndarray) -> int:
        """The first base in the last few thousand cells where all symbols find a free cell, else one past them."""
        start = max(self.room - 4096, 0)
        self.reserve(self.room + 600)
        free = np.flatnonzero(self.check[start : self.room] == -1) + start - symbol[0]
        free = free[free >= 0]
        fits = (self.check[free[:, None] + symbol] == -1).all(1)
        return int(free[fits.argmax()]) if fits.any() else self.room

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those in no phrase."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.numbers[at], -1)

    def counts(self, places: Places) -> np.ndarray:
        """How often each phrase stands there: all places advance together, symbol by symbol."""
        index = {x: k for k, x in enumerate(self.langs.tolist())}
        root = np.array([index.get(x, -1) for x in places.langs], np.int32)
        state = root[places.lang]
        at, state, numbers = places.at[state >= 0], state[state >= 0], self.numbered(places.words)
        for j in range(places.size):
            known = numbers[at + j] >= 0
            at, state = at[known], state[known]
            for shift in self.shifts:
                target = self.base[state] + symbols(numbers[at + j], shift)
                known = self.check[np.minimum(target, self.room - 1)] == state
                known &= target < self.room
                at, state = at[known], target[known]
        return np.bincount(self.phrase_of[state], minlength=len(self.phrases))


def symbols(numbers: np.ndarray, shift: int) -> np.ndarray:
    """Eight bits of words' numbers, from 1 on."""
    return ((numbers >> shift) & 255) + 1


def counted(texts: DataFrame, size: int, trie, least: int) -> DataFrame:
    """``lang, words, n`` of a trie's phrases that stand in the texts ``least`` times.

    A task's counts are a row for each ``SLOT`` phrases, and so is their sum: rows of single
    counts would be as many as phrases times tasks. All sums together are no larger than the trie.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = trie.value
        totals = np.zeros(len(held.phrases), np.int64)
        for places in some_places(batches, size):
            totals += held.counts(places)
        totals = np.r_[totals, np.zeros(-len(totals) % SLOT, np.int64)].reshape(-1, SLOT)
        slots = np.flatnonzero(totals.any(1))
        columns = [pa.array(slots.astype(np.int32)), lists(totals[slots].ravel(), np.full(len(slots), SLOT))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = trie.value, {}
        for batch in batches:
            counts = batch.column(1).flatten().to_numpy().reshape(-1, SLOT)
            for slot, row in zip(batch.column(0).to_pylist(), counts):
                totals[slot] = totals.get(slot, 0) + row
        for slot, row in totals.items():
            found = np.flatnonzero(row >= least)
            at = slot * SLOT + found
            yield phrase_rows(held.langs.tolist(), held.phrase_langs[at], held.phrases[at], pa.array(row[found]))

    counts = texts.mapInArrow(count, "slot int, counts array<bigint>").repartition("slot")
    return counts.mapInArrow(add, "lang string, words array<bigint>, n bigint")


def phrase_buckets(frequent: DataFrame, bits: int) -> DataFrame:
    """``bucket`` of phrases of one length (column ``words``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column(0).dictionary_encode()
            own = np.array([own_seed(x) for x in lang.dictionary.to_pylist()], np.uint64)
            words = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            hashes = phrase_hashes(list(words.T), own[lang.indices.to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([pa.array(bucket(hashes, bits))], names=["bucket"])

    return frequent.select("lang", "words").mapInArrow(run, "bucket bigint")


def frequent_bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    bits = enough_bits(frequent.count(), bits)
    return bitmap_of(phrase_buckets(frequent, bits), bits)


def phrase_stretches(texts: DataFrame, size: int, known) -> DataFrame:
    """``lang, words``: the texts cut down to stretches of phrases in the bitmap, or all phrases in busy counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in some_places(batches, size):
            busy = isinstance(known.value, Busy)
            hashes = places.hashes()
            kept = places.at[known.value.has(hashes) if busy else among(known.value, hashes)]
            words, sizes = stretches(places.words, kept, size, places.bounds, whole=busy)
            yield text_rows(places.langs, places.text_lang, words, sizes)

    return texts.mapInArrow(run, "lang string, words array<bigint>")


def dealt(texts: DataFrame, size: int, blocks: int) -> DataFrame:
    """``lang, words, block``: stretches of the phrases of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in some_places(batches, size):
            block = block_of(places.hashes(), blocks)
            order = np.argsort(block, kind="stable")
            found, begin = np.unique(block[order], return_index=True)
            for k, at in zip(found.tolist(), np.split(places.at[order], begin[1:])):
                words, sizes = stretches(places.words, at, size, places.bounds, whole=True)
                rows = text_rows(places.langs, places.text_lang, words, sizes)
                yield rows.append_column("block", pa.repeat(pa.scalar(k, pa.int32()), rows.num_rows))

    return texts.mapInArrow(run, "lang string, words array<bigint>, block int")


def frequencies(
    texts: DataFrame, size: int, least: int, folder: str, block: int, bits: int
) -> tuple[DataFrame, DataFrame]:
    """``lang, words, n`` of all phrases of ``size`` words that stand in the stretches ``least`` times.

    Also gives the texts cut down to stretches of phrases that may be among them.
    """
    spark, sc = texts.sparkSession, texts.sparkSession.sparkContext
    counters = staged(busy_counters(texts, size, least), folder, f"busy-{size}")
    busy = sc.broadcast(Busy(counters, bits))
    texts = staged(phrase_stretches(texts, size, busy), folder, f"places-{size}")
    busy.unpersist()
    asked = staged(candidates(texts, size), folder, f"asked-{size}")
    blocks = max(1, math.ceil(asked.count() / block))
    if blocks > 1:
        by_block = dealt(texts, size, blocks)
        by_block.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/dealt-{size}")
        by_block = spark.read.schema(by_block.schema).parquet(f"{folder}/dealt-{size}")
    found = []
    for k in range(blocks):
        some = asked.where(F.col("bucket") % blocks == k).toArrow()
        if not len(some):
            continue
        words = some["words"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(some), size)
        trie = sc.broadcast(Trie(np.array(some["lang"].to_pylist()), words))
        own = texts if blocks == 1 else by_block.where(F.col("block") == k).select("lang", "words")
        found.append(staged(counted(own, size, trie, least), folder, f"frequent-{size}-{k}"))
        trie.unpersist()
    forget(spark, folder, f"busy-{size}", f"asked-{size}", f"dealt-{size}")
    if not found:
        return spark.createDataFrame([], "lang string, words array<bigint>, n bigint"), texts
    return reduce(DataFrame.unionByName, found), texts


def counted_words(docs: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """``lang, hash, word, n`` of all words, under a seed by which no two words of a language share a hash."""
    for seed in range(SEEDS):
        words = staged(word_counts(docs, seed), folder, f"words-{seed}")
        if words.groupBy("lang", "hash").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
            return words, seed
        forget(docs.sparkSession, folder, f"words-{seed}")
    raise ValueError(f"words share hashes under {SEEDS} seeds")


def frequent_phrases(docs: DataFrame, folder: str, least: int, longest: int, block: int = BLOCK, bits: int = BITS):
    """Frequent words (``lang, hash, word, n``), words per language, and all frequent phrases (``lang, words, n``)."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    words, seed = counted_words(docs, folder)
    totals = staged(words.groupBy("lang").agg(F.sum("n").alias("n")), folder, "totals")
    known = staged(words.where(F.col("n") >= least), folder, "known")
    frequent = known.select("lang", F.array("hash").alias("words"), "n")
    levels = [frequent]
    bitmap = sc.broadcast(frequent_bitmap(frequent, bits))
    texts = staged(word_stretches(docs, bitmap, seed), folder, "texts-1")
    bitmap.unpersist()
    for size in range(2, longest + 1):
        frequent, places = frequencies(texts, size, least, folder, block, bits)
        levels.append(frequent)
        forget(spark, folder, f"texts-{size - 1}")
        if size < longest:
            bitmap = sc.broadcast(frequent_bitmap(frequent, bits))
            texts = staged(phrase_stretches(places, size, bitmap), folder, f"texts-{size}")
            bitmap.unpersist()
        forget(spark, folder, f"places-{size}")
    return known, totals, staged(reduce(DataFrame.unionByName, levels), folder, "phrases")


def uncovered(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases of two words and more without one around them that stands ``percent`` as often."""
    size = F.size("words")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m)),
        )
    )
    inside = phrases.where(size > 2).select("lang", F.explode(inner).alias("words"), F.col("n").alias("around"))
    inside = inside.groupBy("lang", "words").agg(F.max("around").alias("around"))
    kept = F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(percent) * F.col("n"))
    return phrases.where(size > 1).join(inside, ["lang", "words"], "left").where(kept).select("lang", "words", "n")


def scored(chosen: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, words, a, l, r, n, score`` of the cut with the lowest score, the first of equal ones.

    Products are decimals of 38 digits: exact for up to 10**17 words in a language.
    """
    size = F.size("words")
    cuts = chosen.select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("right", F.slice("words", F.col("k") + 1, size - F.col("k")))
    side = lambda name, n: phrases.select("lang", F.col("words").alias(name), F.col("n").alias(n))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    lowest = met.groupBy("lang", "words", "a", "n").agg(best)
    return lowest.select("lang", "words", "a", "best.l", "best.r", "n", "best.score")


def named(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``phrase``, their words' texts with spaces."""
    placed = rows.select("lang", "words", F.posexplode("words").alias("at", "hash"))
    texts = placed.join(known.select("lang", "hash", "word"), ["lang", "hash"])
    in_order = F.array_sort(F.collect_list(F.struct("at", "word")))  # a few words of one phrase
    phrase = F.concat_ws(" ", F.transform(in_order, lambda x: x["word"])).alias("phrase")
    return rows.join(texts.groupBy("lang", "words").agg(phrase), ["lang", "words"])


def collocations(
    docs: DataFrame,
    folder: str,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    percent: int = COVERED,
    block: int = BLOCK,
    bits: int = BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    ``a`` is a phrase's frequency, ``l`` and ``r`` those of its two parts, ``n`` the language's
    words, and the score ``floor(1000 * a * n / (l * r))``.
    """
    language = F.coalesce(F.col(lang), F.lit("und")).alias("lang")
    texts = docs.select(language, F.coalesce(F.col(text), F.lit("")).alias("text"))
    known, totals, phrases = frequent_phrases(texts, folder, least, longest, block, bits)
    chosen = staged(uncovered(phrases, percent), folder, "chosen")
    told = staged(scored(chosen, phrases, totals), folder, "scored")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named(told, known).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
