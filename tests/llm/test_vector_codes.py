"""Vector codes against a plain comparison of everything with everything."""

import hashlib
import math
import random

import numpy as np
import pytest
from quillcast.llm import queries, vector_codes
from quillcast.llm.common import scratch
from conftest import SF_DIR

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, id string, v int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes, errors and codebooks of rows of id, vector and label, in Python integers."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if fine(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    size = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * size : (p + 1) * size]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for e, xs in groups.items():
                books[p][e] = tuple(sum(col) // len(xs) for col in zip(*xs))
    found = []
    for i, v, y in kept:
        best = [nearest(cut(v)[p], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), y))
    total = {}
    for _, _, e, y in found:
        total[y] = total.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, code, e, total[y], sha) for i, code, e, y in found], books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", "clash", 1) for i, v, y in rows], VECTORS).repartition(3)


def agree(spark, rows, **args):
    found, books = vector_codes.compressed(frame(spark, rows), scratch(spark), **args)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, want_books = plain(rows, **args)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert [[tuple(c) for c in book.tolist()] for book in books] == want_books


def clustered(n, dims, seed, spread=0.1, centres=40):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [
        (i, [x + rng.gauss(0, spread) for x in rng.choice(middle)], rng.choice([None, 0, 1, 2]))
        for i in rng.sample(range(10 * n), n)
    ]


@pytest.mark.parametrize(("n", "dims", "entries", "spread"), [(500, 8, 32, 0.1), (400, 16, 64, 1.0), (60, 4, 256, 0.2)])
def test_codes_are_those_of_comparing_all(spark, n, dims, entries, spread):
    agree(spark, clustered(n, dims, n, spread), entries=entries)


def test_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 60), [rng.choice([-0.002, 0.0, 0.001, 0.5]) for _ in range(8)], 1) for _ in range(200)]
    rows += [rows[0]] * 30 + [(None, [0.25] * 8, None), (None, [0.25] * 8, 2)]
    rows += [(1000, None, 1), (-1, [0.0] * 7 + [None], 1), (-2, [math.nan] * 8, 1), (-3, [math.inf] + [0.0] * 7, None)]
    rows += [(-4, [0.0] * 7 + [-math.inf], 1)]
    agree(spark, rows, entries=16)


def test_one_vector_empty_tables_and_empty_vectors(spark):
    agree(spark, [(5, [0.1, -0.2, 0.3, -0.4], None)])
    agree(spark, [])
    agree(spark, [(1, None, 3)])
    agree(spark, [(1, [], 3), (2, [], 3)])


def test_lengths_and_sizes_that_cannot_be(spark):
    for rows in ([(1, [0.0] * 8, 0), (2, [0.0] * 4, 0)], [(1, [0.0] * 6, 0)], [(1, [1e30] * 4, 0)]):
        with pytest.raises(Exception, match="vectors must have|too large"):
            vector_codes.compressed(frame(spark, rows), scratch(spark))[0].collect()


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    agree(spark, [(i, [rng.uniform(-5e5, 5e5) for _ in range(8)], 0) for i in range(40)], entries=8, rounds=2, scale=1000)


def test_bounds_hold_and_spare_comparisons():
    """A part settled after moves knows what a scan knows, and most parts are not measured."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (64, 6))
    x = (centres[rng.integers(0, 64, 3000)] + rng.normal(0, 10, (3000, 6))).astype(np.int64)
    book = centres.astype(np.int64)
    part, b = vector_codes.Part(len(x), 8), 8
    part.scan(np.arange(len(x)), x, book)
    for size, step in ((8, 4), (3, 4), (12, 60), (12, 2), (1, 30), (6, 5)):
        new = book + rng.integers(-step, step + 1, book.shape)
        moves = vector_codes.ceil_root(vector_codes.measured(book, new))
        part.settle(x, new, moves, size)
        book = new
        squares = vector_codes.all_measured(x, book)
        assert (part.code == squares.argmin(1)).all()
        assert (part.upper**2 >= squares.min(1)).all()
        assert part.near.shape == (len(x), size)
        for z in range(size):
            at = part.near[:, z]
            true = squares[np.arange(len(x)), at]
            assert ((part.low[:, z] ** 2 <= true) | (at < 0)).all()
        listed = np.zeros(squares.shape, bool)
        i, z = np.nonzero(part.near >= 0)
        listed[i, part.near[i, z]] = True
        beyond = np.where(listed, np.iinfo(np.int64).max, squares).min(1)
        assert (part.outer**2 <= beyond).all()
        if step < 10:
            assert (part.used == 0).mean() > 0.5


def test_roots_are_exact():
    squares = np.array([0, 1, 2, 3, 4, 2**52 - 1, (2**26 + 1) ** 2, (2**26 + 1) ** 2 - 1, 2**60 - 1, 2**60])
    assert vector_codes.floor_root(squares).tolist() == [math.isqrt(x) for x in squares.tolist()]
    assert vector_codes.ceil_root(squares).tolist() == [math.isqrt(x - 1) + 1 if x else 0 for x in squares.tolist()]


def test_registered_query(spark):
    found = queries.QUERIES["op13_vector_codes"](spark, SF_DIR)
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    want, _ = plain([(r.vec_id, r.embedding, r.label) for r in rows])
    assert sorted(map(tuple, found.collect())) == sorted(want)
