"""Short codes of vectors: a codebook for each part of a vector, fitted with adaptive distance bounds.

Components become integers, vectors are cut into equal parts, and each part is replaced by
the index of the nearest of the entries of its codebook. Codebooks begin as the parts of the
first vectors; each round assigns all parts and moves each entry to the floor of their mean.

Between rounds a table keeps for each part its entry with an upper bound of the distance, the
``b`` closest entries in order with a lower bound each, and one bound for all others. When
entries have moved, bounds are widened by how far; a part whose upper bound is below its
rivals' bounds keeps its entry unseen. The others measure their own entry, then those of the
list whose bound reaches that far, and all entries only where the outer bound does too.
Bounds are whole numbers rounded away from certainty and distances are exact integers,
so the codes are those of comparing everything, ties to the lower index included. ``b`` is
adapted for each part after each round: down to the longest stretch of a list that was
needed, and up where many parts had to look at all entries.

Only codebooks, sums by entry and two figures a part pass the driver; they do not grow with the input.

Vectors that are null, or hold a null, a NaN or an infinity, are dropped. Vectors begin the
codebooks in order of id, then components; without an id they come last. Repeated rows each
count. Fewer vectors than entries make smaller codebooks, an empty table gives no rows.
Vectors of different lengths, a length that the parts don't divide, and components too
large for exact distances in 64 bits raise a ValueError. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillcast.llm.common import forget, staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
FIRST, FEWEST, MOST = 8, 16, 4  # of the entries, lists begin with one in so many, and keep between such shares
OFTEN = 0.1  # share of parts without help from their list above which lists grow
SLICE = 4096  # vectors compared with all entries at once

BOUNDS = (
    "v array<bigint>, code array<smallint>, upper array<bigint>, near array<smallint>, "
    "low array<bigint>, outer array<bigint>, used array<smallint>, error bigint"
)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` in 64 bits."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if len(scaled) and np.abs(scaled).max() >= 2**31:
        raise ValueError("components are too large for exact distances")
    return scaled.astype(np.int64)


def floor_root(squares: np.ndarray) -> np.ndarray:
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares)


def measured(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def all_measured(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries, as a matrix product where doubles hold them."""
    if not x.size or not book.size:
        return np.zeros((len(x), len(book)), np.int64)
    most = int(max(np.abs(x).max(), np.abs(book).max()))
    if x.shape[1] * 4 * most * most >= 2**62:
        raise ValueError("components are too large for exact distances")
    if x.shape[1] * 4 * most * most < 2**53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([measured(x, np.broadcast_to(entry, x.shape)) for entry in book], 1)


class Part:
    """What is known of one part of some vectors: its entry, and bounds of distances."""

    def __init__(self, n: int, b: int):
        self.code = np.zeros(n, np.int64)
        self.upper = np.zeros(n, np.int64)
        self.near = np.full((n, b), -1, np.int64)
        self.low = np.zeros((n, b), np.int64)
        self.outer = np.zeros(n, np.int64)
        self.used = np.zeros(n, np.int64)

    def scan(self, rows: np.ndarray, x: np.ndarray, book: np.ndarray) -> None:
        """Compare some rows with all entries."""
        b = self.near.shape[1]
        for start in range(0, len(rows), SLICE):
            some = rows[start : start + SLICE]
            squares = all_measured(x[some], book)
            order = np.argsort(squares, axis=1, kind="stable")[:, : b + 1]
            roots = floor_root(np.take_along_axis(squares, order, 1))
            self.code[some] = order[:, 0]
            self.upper[some] = ceil_root(squares[np.arange(len(some)), order[:, 0]])
            self.near[some], self.low[some] = order[:, :b], roots[:, :b]
            self.outer[some] = roots[:, b] if roots.shape[1] > b else np.iinfo(np.int64).max // 4

    def widen(self, moves: np.ndarray) -> None:
        """Bounds that hold after entries have moved, in order again from the outer one inwards."""
        self.upper += moves[self.code]
        most, left = np.zeros(len(self.code), np.int64), np.arange(len(self.code))
        for entry in np.argsort(-moves):  # the longest move of an entry outside each list
            listed = (self.near[left] == entry).any(1)
            most[left[~listed]] = moves[entry]
            left = left[listed]
            if not len(left):
                break
        self.outer = np.maximum(self.outer - most, 0)
        gone = np.where(self.near < 0, most[:, None], moves[self.near])  # -1: no entry, so as the outer bound
        low = np.maximum(self.low - gone, 0)
        ordered = np.minimum.accumulate(np.c_[low, self.outer][:, ::-1], axis=1)[:, ::-1]
        self.low = np.ascontiguousarray(ordered[:, :-1])

    def resize(self, b: int) -> None:
        """Lists of ``b`` entries; the outer bound takes in what is cut off."""
        n, was = self.near.shape
        if b < was:
            self.outer = np.minimum(self.outer, self.low[:, b])
            self.near, self.low = self.near[:, :b].copy(), self.low[:, :b].copy()
        elif b > was:
            self.near = np.c_[self.near, np.full((n, b - was), -1)]
            self.low = np.c_[self.low, np.repeat(self.outer[:, None], b - was, 1)]

    def settle(self, x: np.ndarray, book: np.ndarray, moves: np.ndarray, b: int) -> None:
        """The nearest entries after a move, and lists of ``b``."""
        self.widen(moves)
        rival = self.near != self.code[:, None]
        first = rival.argmax(1)[:, None]
        bound = np.where(rival.any(1), np.take_along_axis(self.low, first, 1)[:, 0], self.outer)
        self.used[:] = 0
        unsure = np.flatnonzero(self.upper >= bound)
        own = measured(x[unsure], book[self.code[unsure]])
        self.upper[unsure] = ceil_root(own)
        still = self.upper[unsure] >= bound[unsure]
        rows, own = unsure[still], own[still]
        lost = self.outer[rows] <= self.upper[rows]
        self.used[rows[lost]] = self.near.shape[1] + 1
        self.ask(rows[~lost], own[~lost], x, book)
        self.resize(b)
        self.scan(rows[lost], x, book)

    def ask(self, rows: np.ndarray, own: np.ndarray, x: np.ndarray, book: np.ndarray) -> None:
        """Compare some rows with the entries of their lists that may be nearer than their own."""
        near, low, code = self.near[rows], self.low[rows], self.code[rows]
        reach = low <= self.upper[rows][:, None]
        self.used[rows] = reach.sum(1)
        at = near == code[:, None]
        i, j = np.nonzero(reach & ~at)
        squares = np.full(near.shape, np.iinfo(np.int64).max)
        squares[at] = np.broadcast_to(own[:, None], near.shape)[at]
        squares[i, j] = measured(x[rows[i]], book[near[i, j]])
        least = np.minimum(squares.min(1, initial=np.iinfo(np.int64).max), own)
        tied = np.where(squares == least[:, None], near, len(book)).min(1, initial=len(book))
        code = np.where(own == least, np.minimum(code, tied), tied)
        known = reach | at
        low[known] = floor_root(squares[known])
        rank = np.where(near == code[:, None], -1, low)  # its own entry stays in the list whatever is cut off
        order = np.argsort(rank, axis=1, kind="stable")
        self.near[rows], self.low[rows] = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
        self.code[rows], self.upper[rows] = code, ceil_root(least)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an array of lists."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), kind))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array of lists of one length as a matrix."""
    if len(column) and not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError(f"vectors must have {width} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assigned(
    table: DataFrame, books: list[np.ndarray], moves: list[np.ndarray] | None, was: list[int], b: list[int], scale: int
) -> DataFrame:
    """The state of all vectors for these codebooks, from raw vectors or the state before."""
    parts, width = len(books), sum(book.shape[1] for book in books)
    ends = np.cumsum([0] + [book.shape[1] for book in books])
    schema = StructType([*table.schema.fields[:2], *StructType.fromDDL(BOUNDS).fields])

    def known(batch: pa.RecordBatch) -> list[Part]:
        get = lambda name, n: matrix(batch.column(name), n).astype(np.int64)
        code, upper, outer = get("code", parts), get("upper", parts), get("outer", parts)
        near, low, at = get("near", sum(was)), get("low", sum(was)), np.cumsum([0, *was])
        found = []
        for p in range(parts):
            part = Part(len(code), 0)
            part.code, part.upper, part.outer = code[:, p].copy(), upper[:, p].copy(), outer[:, p].copy()
            part.near, part.low = near[:, at[p] : at[p + 1]].copy(), low[:, at[p] : at[p + 1]].copy()
            found.append(part)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = matrix(batch.column(2), width)
            v = whole(raw.ravel(), scale).reshape(n, width) if moves is None else raw
            state = [Part(n, size) for size in b] if moves is None else known(batch)
            error = np.zeros(n, np.int64)
            for p, part in enumerate(state):
                x = v[:, ends[p] : ends[p + 1]]
                if moves is None:
                    part.scan(np.arange(n), x, books[p])
                else:
                    part.settle(x, books[p], moves[p], b[p])
                error += measured(x, books[p][part.code])
            of = lambda name: np.stack([getattr(part, name) for part in state], 1)
            side = lambda name: np.concatenate([getattr(part, name) for part in state], 1)
            columns = [
                lists(v, pa.int64()),
                lists(of("code"), pa.int16()),
                lists(of("upper"), pa.int64()),
                lists(side("near"), pa.int16()),
                lists(side("low"), pa.int64()),
                lists(of("outer"), pa.int64()),
                lists(of("used"), pa.int16()),
                pa.array(error),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return table.mapInArrow(run, schema)


def entry_sums(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``part, entry, place, total``: sums of the parts of each entry by component, their number at place 0."""
    parts, width = len(books), sum(book.shape[1] for book in books)
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(book), size + 1), np.int64) for book in books]
        for batch in batches:
            v, code = matrix(batch.column(0), width), matrix(batch.column(1), parts).astype(np.int64)
            if not len(v):
                continue
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                sorted_codes = code[order, p]
                starts = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
                x = np.c_[np.ones(len(v), np.int64), v[:, p * size : (p + 1) * size]][order]
                totals[p][sorted_codes[starts]] += np.add.reduceat(x, starts, axis=0)
        for p, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), lists(total[used], pa.int64())],
                names=["part", "entry", "totals"],
            )

    sums = state.select("v", "code").mapInArrow(run, "part int, entry int, totals array<bigint>")
    placed = sums.select("part", "entry", F.posexplode("totals").alias("place", "total"))
    return placed.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def moved(books: list[np.ndarray], sums: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codebooks of the floors of means, and how far each entry went at most; unused entries stay."""
    totals: dict = {}
    for row in sums.collect():  # entries times components
        totals.setdefault((row.part, row.entry), {})[row.place] = row.total
    new = [book.copy() for book in books]
    for (part, entry), total in totals.items():
        new[part][entry] = [total[place] // total[0] for place in range(1, len(total))]
    return new, [ceil_root(measured(a, b)) for a, b in zip(books, new)]


def bounded(size: int, entries: int) -> int:
    return min(max(size, -(-entries // FEWEST)), -(-entries // MOST))


def adapted(state: DataFrame, b: list[int], entries: int) -> list[int]:
    """Sizes of the lists for the next round, from how far they were read in this one."""
    figures = []
    for p, size in enumerate(b):
        used = F.col("used")[p]
        figures += [F.max(F.when(used <= size, used)), F.avg((used > size).cast("int"))]
    told = state.agg(*figures).first()
    sizes = []
    for p, size in enumerate(b):
        most, share = told[2 * p] or 0, told[2 * p + 1] or 0.0
        sizes.append(bounded(2 * size if share > OFTEN else min(size, most), entries))
    return sizes


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in order, as decimals with commas."""
    text = ",".join(",".join(map(str, book.ravel().tolist())) for book in books if book.size)
    return hashlib.sha256(text.encode()).hexdigest()


def compressed(
    vectors: DataFrame,
    folder: str,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``row_id, code, error, label_error, codebooks_sha256`` of all vectors kept, and the final codebooks."""
    spark = vectors.sparkSession
    if not 0 < entries <= 1 << 15:
        raise ValueError("a codebook holds 1 to 32768 entries")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & ~bad)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    kind = rows.schema["id"].dataType.simpleString()
    if not first:
        schema = f"`{row_id}` {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return spark.createDataFrame([], schema), []
    width = len(first[0].vector)
    if width % parts or any(len(r.vector) != width for r in first):
        raise ValueError(f"vectors must have one length that {parts} parts divide")
    start = whole(np.array([r.vector for r in first], np.float64).ravel(), scale).reshape(len(first), width)
    books = [start[:, p * (width // parts) : (p + 1) * (width // parts)] for p in range(parts)]

    b = [bounded(len(first) // FIRST, len(first))] * parts
    state, moves, was = rows, None, b
    for k in range(rounds + 1):
        state = staged(assigned(state, books, moves, was, b, scale), folder, f"state-{k}")
        if k:
            forget(spark, folder, f"state-{k - 1}")
        if k < rounds:
            books, moves = moved(books, entry_sums(state, books))
            was, b = b, adapted(state, b, len(first)) if k else b
    digits = max(2, len(f"{entries - 1:x}"))
    hexed = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), digits, "0"))
    done = state.select("id", "label", F.concat_ws("", hexed).alias("code"), "error")
    of_label = staged(done.groupBy("label").agg(F.sum("error").alias("label_error")), folder, "labels")
    of_label = of_label.withColumnRenamed("label", "of_label")
    told = done.join(of_label, F.col("label").eqNullSafe(F.col("of_label")))
    sha = F.lit(digest(books)).alias("codebooks_sha256")
    return told.select(F.col("id").alias(row_id), "code", "error", "label_error", sha), books
