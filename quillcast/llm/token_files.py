"""Token ids in grammar-compressed binary shards.

Documents go to files in the order of their ids: rows are dealt to tasks by ranges of the
id and sorted there. Each task cuts its ids into shards of about a million and compresses
each by pair replacement: the most frequent adjacent pairs become new symbols, again and
again, and the shard keeps its rules, the number of ids that each rule stands for, the
remaining symbols, and where its documents begin. From the numbers of ids one document is
found and expanded without the rest of its shard.

A shard is a row of a Parquet table; its byte fields are little-endian unsigned 16-bit
(symbols and rules) or 64-bit (documents) integers. Ids must be below ``FIRST_RULE``.

Null texts count as empty and give the end id alone, as empty ones do. Equal ids keep
their rows, in any order among themselves. Rows without an id come first. An empty table
gives an empty file. Further columns are dropped. A document longer than a shard is not
split; memory grows with the longest text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer, pre_tokenizers

from quillcast.llm import word_text
from quillcast.llm.remembered import Remembered
from quillcast.llm.shingle_sets import PART, parts

END_ID = 1
END = END_ID.to_bytes(2, "little")
SHARD_IDS = 1 << 20
FIRST_RULE = 50_000
MOST_SYMBOLS = 1 << 16
NO_RULE = np.uint16(MOST_SYMBOLS - 1)  # no rank is as large
BITS = 20
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
SHARD = (
    "part int, shard int, n_ids bigint, rules binary, lengths binary, body binary, "
    "doc_ids binary, no_id binary, doc_starts binary"
)


class WordEncoder:
    """Ids by the tokenizers library, which is asked once for each word. Ids are kept as two bytes."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(file)
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.last = np.zeros(self.library.get_vocab_size() + 1, bool)
        for token, i in self.library.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        # the same model for words that are cut already
        self.model = Tokenizer(self.library.model)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        self.known = Remembered(None)

    def learn(self, cuts: list[str]) -> None:
        """Ask for many cuts at once; ids whose token has a word end part the words."""
        pieces = [(c,) if c.isalpha() else word_text.words(c, lambda: self.library) for c in cuts]
        distinct = list(set(chain.from_iterable(pieces)))
        ids: dict[str, bytes] = {}
        for i in range(0, len(distinct), 500):
            some = distinct[i : i + 500]
            flat = self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ends = (np.flatnonzero(self.last[flat]) + 1).tolist()
            raw = np.array(flat, "<u2").tobytes()
            ids.update(zip(some, [raw[2 * a : 2 * b] for a, b in zip([0, *ends], ends)]))
        found = [ids[p[0]] if len(p) == 1 else b"".join(map(ids.get, p)) for p in pieces]
        self.known.young.update(zip(cuts, found))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id. Each distinct cut is looked up once; the rest is done by numbers."""
        known = self.known
        if len(known.young) > known.size:
            known.old, known.young = known.young, {}
        get = known.young.get
        cut = [[] if "<|" in t else word_text.cuts(t) for t in texts]
        flat = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        # no cut is empty or has a line end, and one long text is read and cut faster than many short ones
        every = pa.ListArray.from_arrays([0, len(flat.dictionary)], flat.dictionary)
        distinct = pa.compute.binary_join(every, "\n")[0].as_py().split("\n") if len(flat) else []
        values = list(map(get, distinct))
        new = {c for c, v in zip(distinct, values) if v is None}
        met = new & known.old.keys()
        known.young.update((c, known.old[c]) for c in met)
        self.learn(list(new - met))
        values = [get(c) if v is None else v for c, v in zip(distinct, values)]
        for c in new:
            if len(c) > known.longest:
                del known.young[c]
        # an end behind each text's cuts
        which = np.full(len(flat) + len(texts), len(values))
        ends = np.cumsum([len(c) + 1 for c in cut])
        at_cut = np.ones(len(which), bool)
        at_cut[ends - 1] = False
        which[at_cut] = flat.indices.to_numpy()
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 2
        sizes, ids = np.r_[sizes, 1], np.frombuffer(b"".join(values) + END, "<u2")
        first, each = (np.cumsum(sizes) - sizes)[which], sizes[which]
        until = np.cumsum(each)
        ids = ids[np.repeat(first - until + each, each) + np.arange(until[-1] if len(until) else 0)]
        bounds = [0, *until[ends - 1].tolist()]
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i, t in enumerate(texts):
            if "<|" in t:  # it may hold special strings
                out[i] = np.array([*self.library.encode(t, add_special_tokens=False).ids, END_ID], "<u2")
        return out


@lru_cache(1)
def encoder_of(file: str) -> WordEncoder:
    """One for the tasks that a Python worker runs in turn, so known words serve the next task."""
    return WordEncoder(file)


def ranked_pairs(symbols: np.ndarray, most: int, least: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the most frequent adjacent pairs, best first, and the rank of each place's pair.

    Pairs are counted by their hash. Of several pairs of one hash one is counted and the
    others wait for the next turn, which hashes otherwise, so no pairs are sorted.
    """
    keys = symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:]
    bins = (keys * FACTORS[turn % len(FACTORS)]) >> np.uint32(32 - BITS)
    often = np.flatnonzero((np.bincount(bins, minlength=1 << BITS) >= least)[bins])
    stands = np.zeros(1 << BITS, np.uint32)
    stands[bins[often]] = keys[often]
    same = often[stands[bins[often]] == keys[often]]
    counts = np.bincount(bins[same], minlength=1 << BITS)
    found = np.flatnonzero(counts >= least)
    found = found[np.argsort(-counts[found], kind="stable")[:most]]
    rank_of = np.full(1 << BITS, NO_RULE, np.uint16)
    rank_of[found] = np.arange(len(found))
    ranks = np.full(len(keys), NO_RULE, np.uint16)
    ranks[same] = rank_of[bins[same]]
    return stands[found], ranks


def compress(ids: np.ndarray, rounds: int = 4, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (two symbols each), ids that each rule stands for, and the remaining symbols.

    A round replaces many pairs at once. Where occurrences overlap the more frequent pair
    goes first, and of equal ones the left; the next round counts anew.
    """
    body = ids.astype(np.uint16)
    rules, lengths = np.zeros((0, 2), np.uint16), np.ones(FIRST_RULE, np.int64)
    for turn in range(rounds):
        if len(body) < 2:
            break
        room = MOST_SYMBOLS - FIRST_RULE - len(rules)
        found, rank = ranked_pairs(body, min(room, (MOST_SYMBOLS - FIRST_RULE) // rounds + 1), least, turn)
        if not len(found):
            break
        before, after = np.r_[NO_RULE, rank[:-1]], np.r_[rank[1:], NO_RULE]
        free = rank < before
        # of a pair that overlaps itself every second one, from the left of its run
        again = np.flatnonzero((rank == before) & (rank != NO_RULE))
        if len(again):
            first = np.r_[True, np.diff(again) > 1]
            start = np.maximum.accumulate(np.where(first, again - 1, 0))
            free[again] = free[start] & ((again - start) % 2 == 0)
        chosen = np.flatnonzero(free & (rank <= after))
        pairs = np.stack([found >> np.uint32(16), found & np.uint32(0xFFFF)], 1).astype(np.uint16)
        body[chosen] = FIRST_RULE + len(rules) + rank[chosen]
        stay = np.ones(len(body), bool)
        stay[chosen + 1] = False
        body = body[stay]
        lengths = np.r_[lengths, lengths[pairs].sum(1)]
        rules = np.concatenate([rules, pairs])
    return rules, lengths[FIRST_RULE:], body


def expand(rules: np.ndarray, body: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: all rules are opened by one level until none is left."""
    while len(rules) and (is_rule := body >= FIRST_RULE).any():
        sizes = 1 + is_rule
        first = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), np.uint16)
        out[first] = body
        opened = rules[body[is_rule] - FIRST_RULE]
        out[first[is_rule]], out[first[is_rule] + 1] = opened[:, 0], opened[:, 1]
        body = out
    return body


def part_of(rules: np.ndarray, lengths: np.ndarray, body: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard, expanding only the symbols that cover them."""
    sizes = np.where(body < FIRST_RULE, 1, np.r_[lengths, 1][np.minimum(np.maximum(body.astype(np.int64) - FIRST_RULE, 0), len(lengths))])
    ends = np.cumsum(sizes)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    base = ends[a] - sizes[a] if a < len(ends) else 0
    return expand(rules, body[a:b])[start - base : stop - base]


def write_tokens(docs: DataFrame, path: str, file: str, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode documents, end each by ``END_ID``, and write shards in ascending id order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(file), TaskContext.get().partitionId()
        number, ids, names, held = 0, [], [], 0

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            rules, lengths, body = compress(flat)
            starts = np.cumsum([0, *map(len, ids[:-1])])
            row = {
                "part": part,
                "shard": number,
                "n_ids": len(flat),
                "rules": rules.astype("<u2").tobytes(),
                "lengths": lengths.astype("<u8").tobytes(),
                "body": body.astype("<u2").tobytes(),
                "doc_ids": np.array([n or 0 for n in names], "<i8").tobytes(),
                "no_id": np.array([n is None for n in names], np.uint8).tobytes(),
                "doc_starts": starts.astype("<u8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], WRITTEN)

        for batch in batches:
            names_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, found in zip(names_of, chain.from_iterable(map(encoder.encode, parts(texts, PART)))):
                ids.append(found)
                names.append(name)
                held += len(found)
                if held >= SHARD_IDS:
                    yield shard()
                    number, ids, names, held = number + 1, [], [], 0
        if ids:
            yield shard()

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(shards, SHARD).write.parquet(path)


WRITTEN = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64())]
    + [(c, pa.binary()) for c in ("rules", "lengths", "body", "doc_ids", "no_id", "doc_starts")]
)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: id, ids of all documents before it, number of ids and their crc32.

    Only numbers of ids go beyond a task: they are summed over the shards of a file, then
    over the files.
    """
    written = spark.read.schema(SHARD).parquet(path)
    sizes = written.select("part", "shard", "n_ids")
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    in_all = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
        .join(parts.withColumn("base", F.coalesce(F.sum("total").over(in_all), F.lit(0))), "part")
        .select("part", "shard", (F.col("base") + F.col("before")).alias("base"))
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
                ids = expand(rules, np.frombuffer(row["body"], "<u2")).astype("<u4")
                starts = np.frombuffer(row["doc_starts"], "<u8").astype(np.int64)
                ends = np.r_[starts[1:], row["n_ids"]]
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                names = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["no_id"], np.uint8).astype(bool))
                n = len(starts)
                columns = [np.full(n, row["part"], np.int32), np.full(n, row["shard"], np.int32), starts, ends - starts]
                yield pa.RecordBatch.from_arrays(
                    [names, *map(pa.array, columns), pa.array(sums, pa.int64())],
                    ["doc_id", "part", "shard", "inner", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id bigint, part int, shard int, inner bigint, n_tokens bigint, ids_crc32 bigint"
    found = written.mapInArrow(documents, schema)
    return found.join(bases, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
