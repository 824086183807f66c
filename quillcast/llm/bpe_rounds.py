"""Byte-pair encoding in numpy, many words at once, and decoding.

The symbols of all new words of a batch stand in one flat array. Each round finds the
rank of every adjacent pair by binary search over the sorted pair keys, takes the lowest
rank of each word, merges all its occurrences from left to right, and lets go of words
without a pair. Encoded words are remembered within a task.

It follows the file format of the tokenizers library for BPE with an end-of-word suffix,
byte-level symbols and special strings; those in a text become their ids, as the library
does by default. Decoding joins the tokens by a space, as that library does for a file
without a decoder.

Null texts count as empty, empty ones have no ids and decode to an empty text. Repeated
rows are encoded each, further columns dropped, and an empty table gives no rows. Texts
are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillcast.llm import word_text
from quillcast.llm.common import few_rows
from quillcast.llm.remembered import WORDS
from quillcast.llm.shingle_sets import parts

NO_RANK = np.iinfo(np.int64).max
IDS = pa.list_(pa.int32())
LONG = 64  # characters; longer cuts are not remembered


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class RoundsEncoder:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.file = file
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.ints = list(range(len(self.tokens)))  # one object for each id, however often it is remembered
        self.numerals = [str(i) for i in range(len(self.tokens))]
        self.known: dict[str, tuple[int, ...]] = {"\n" + s: (i,) for s, i in special.items()}
        self.older: dict[str, tuple[int, ...]] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """Only for letters that Python doesn't know, so most tasks never load it."""
        return Tokenizer.from_file(self.file)

    def ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place, by binary search over the pair keys."""
        right = np.minimum(at + 1, len(symbols) - 1)
        pair = symbols[at] << 32 | symbols[right]
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = (self.keys[found] == pair) & (right > at) & (word[at] == word[right])
        return np.where(hit, self.by_key[found], NO_RANK)

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of every word. Words must not be empty."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), sizes)
        ranks = self.ranks(symbols, word, np.arange(len(symbols)))
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            best = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            over = best == NO_RANK
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            symbols, word, ranks, best = symbols[~over], word[~over], ranks[~over], best[~over]
            if not len(symbols):
                break
            chosen = np.flatnonzero(ranks == best)
            # of occurrences that overlap every second one is merged, from the left
            place = np.arange(len(chosen))
            first = np.r_[True, np.diff(chosen) > 1]
            chosen = chosen[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            symbols[chosen] = self.merged[ranks[chosen]]
            stay = np.ones(len(symbols), bool)
            stay[chosen + 1] = False
            at = (np.cumsum(stay) - 1)[chosen]
            symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
            changed = np.union1d(at, np.maximum(at - 1, 0))
            ranks[changed] = self.ranks(symbols, word, changed)
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        flat = list(map(self.ints.__getitem__, flat[np.argsort(owner, kind="stable")]))
        bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(raw)))].tolist()
        return [tuple(flat[a:b]) for a, b in zip(bounds, bounds[1:])]

    def learn(self, cuts: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Cuts of texts with their ids."""
        pieces = [word_text.words(c, lambda: self.library) for c in cuts]
        distinct = list(set(chain.from_iterable(pieces)))
        if distinct:
            ids = dict(zip(distinct, self.merge(distinct)))
            for c, p in zip(cuts, pieces):
                yield c, ids[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(ids.get, p)))

    def cuts(self, text: str) -> list[str]:
        """Cuts of a text; special strings behind a line end, which is in no other cut."""
        if "<|" not in text:
            return word_text.cuts(text)
        parts = self.cut_special.split(text)
        return [c for i, part in enumerate(parts) for c in (["\n" + part] if i % 2 else word_text.cuts(part))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Only cuts that the task has not met lately are merged."""
        cut = [self.cuts(t) for t in texts]
        if len(self.known) > WORDS:
            self.older, self.known = self.known, {"\n" + s: (i,) for s, i in self.special.items()}
        new = set().union(*cut) - self.known.keys()
        met = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in met)
        self.known.update(self.learn(list(new - met)))
        ids = [list(chain.from_iterable(map(self.known.get, c))) for c in cut]
        for c in new:
            if len(c) > LONG:
                del self.known[c]
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def hexed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id of each row with its token ids."""
    kind = docs.schema[id_column].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RoundsEncoder(file)
        for batch in few_rows(batches):
            ids = [pa.array(encoder.encode(some), IDS) for some in parts(batch.column(1).to_pylist())]
            column = pa.chunked_array(ids, IDS).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "ids"])

    return texts_of(docs, id_column, text).mapInArrow(encoded, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, file: str, id_column: str = "doc_id") -> DataFrame:
    """Id of each row with the text of its token ids; null ids give an empty text."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RoundsEncoder(file)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_column).alias("doc_id"), "ids")
    return rows.mapInArrow(decoded, f"doc_id {kind}, text string")


def round_trips(docs: DataFrame, file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, number of token ids, and digests of the ids and of the text decoded from them.

    Both directions run in one task, so ids do not travel.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RoundsEncoder(file)
        for batch in few_rows(batches):
            sizes, of_ids, of_texts = [], [], []
            for some in parts(batch.column(1).to_pylist()):
                ids = encoder.encode(some)
                sizes.extend(map(len, ids))
                of_ids.extend(hexed(" ".join([encoder.numerals[i] for i in d])) for d in ids)
                of_texts.extend(hexed(encoder.decode(d)) for d in ids)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.string()) for c in (of_ids, of_texts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return texts_of(docs, id_column, text).mapInArrow(digests, schema)


def texts_of(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
