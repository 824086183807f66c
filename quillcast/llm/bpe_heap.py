"""Token counts of a sentence-piece BPE model, without any token ids.

Symbols of a word form a linked list; a heap holds the adjacent pairs that are pieces,
lowest rank first and then leftmost. Each pop merges one pair and looks at the two new
neighbours. The count is the number of initial symbols less the merges; a character that
is no piece counts as its UTF-8 bytes.

No piece holds the space mark behind another character, so texts are counted word by
word, and words of a task are remembered.

Null texts count as empty, empty ones have no tokens. Repeated rows are counted each.
Further columns, whatever their names, are dropped. An empty table gives no rows. A text
is taken whole however long it is; memory grows with the longest text of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from quillcast.llm.remembered import Remembered

MARK = "▁"


class PieceCounter:
    """Counts tokens of texts for one model file."""

    def __init__(self, model_file: str):
        model = SentencePieceProcessor(model_file=model_file)
        pieces = [
            (model.id_to_piece(i), model.get_score(i))
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        order = {score: rank for rank, score in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.rank = {piece: order[score] for piece, score in pieces}
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.words, self.parts = Remembered(self.word), Remembered(self.merged)

    def words_of(self, text: str) -> list[str]:
        """The text in parts across which nothing merges: a part begins at space marks."""
        text = MARK + text.replace(" ", MARK)
        apart = text.replace(MARK, " " + MARK).replace("\n", " \n ")
        if MARK + MARK in text:  # runs of marks stay together; two passes for an odd number
            apart = apart.replace(f"{MARK} {MARK}", MARK + MARK).replace(f"{MARK} {MARK}", MARK + MARK)
        return apart.split(" ")

    def count(self, text: str) -> int:
        return sum(self.words.of(self.words_of(text))) if text else 0

    def word(self, word: str) -> int:
        """Tokens of a word, cut where no piece holds the two characters side by side."""
        pairs = list(map(add, word, word[1:]))
        if self.neighbours.issuperset(pairs):
            return self.parts.one(word)
        total, start = 0, 0
        for i, pair in enumerate(pairs, 1):
            if pair not in self.neighbours:
                total += self.parts.one(word[start:i])
                start = i
        return total + self.parts.one(word[start:])

    def merged(self, part: str) -> int:
        """Initial symbols less the merges that the heap gives."""
        n = len(part)
        if n == 1:
            return 1 if part in self.rank else len(part.encode())
        rank = self.rank.get
        symbols = list(part)  # each is a piece, as it stands beside another one in a piece
        before, after = list(range(-1, n)), list(range(1, n + 1))
        heap = [(r, i, pair) for i, pair in enumerate(map(add, symbols, symbols[1:])) if (r := rank(pair)) is not None]
        heapify(heap)
        symbols.append("")
        left_over = n
        while heap:
            _, left, pair = heappop(heap)
            right = after[left]
            if not symbols[left] or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = pair, ""
            left_over -= 1
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                if (r := rank(new := pair + symbols[follower])) is not None:
                    heappush(heap, (r, left, new))
            previous = before[left]
            if previous >= 0 and (r := rank(new := symbols[previous] + pair)) is not None:
                heappush(heap, (r, previous, new))
        return left_over


def token_counts(docs: DataFrame, model_file: str, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, UTF-8 bytes and tokens of every text, and whether it has more than ``limit``."""
    kind = docs.schema[id_column].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file)
        for batch in batches:
            texts = batch.column(1)
            counts = [counter.count(t) for t in texts.to_pylist()]
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
