"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from quillcast.llm import phrase_tries, queries
from quillcast.llm.common import scratch
from conftest import SF_DIR

DOC = "doc_id bigint, text string, lang string, words string, hash string, n int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain(rows, least, longest=5, top=2000, percent=100):
    f, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    key = lang, tuple(words[i : i + m])
                    f[key] = f.get(key, 0) + 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in cands.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = lang, words[i : i + m]
                if inner in cands and 100 * a >= percent * cands[inner]:
                    covered.add(inner)
    found = {}
    for (lang, words), a in cands.items():
        if (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, phrases in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def found(spark, rows, **args):
    docs = spark.createDataFrame([(i, t, x, "clash", "clash", 0) for i, (t, x) in enumerate(rows)], DOC).repartition(3)
    got = phrase_tries.collocations(docs, scratch(spark), **{"bits": 16, **args})
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return [tuple(r) for r in got.collect()]


def agree(spark, rows, least, **args):
    want = plain(rows, least, **{k: v for k, v in args.items() if k not in ("block", "bits")})
    assert sorted(found(spark, rows, least=least, **args)) == sorted(want)
    return want


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    marks = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "; ", " ! ", "?", ":"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        yield "".join(w + rng.choice(marks) for w in words), rng.choice(["en", "en", "de", None, ""])


WORDS = ["the", "The", "of", "a", "É", "é", "漢字", "longer-than-eight-bytes", "longer-than-eight-bites", "x\x00y", "x", "|"]


@pytest.mark.parametrize(("block", "bits"), [(7, 10), (phrase_tries.BLOCK, 6), (phrase_tries.BLOCK, phrase_tries.BITS)])
def test_phrases_against_plain_counts(spark, block, bits):
    rows = list(texts(1, 300, WORDS + [f"w{i}" for i in range(40)]))
    rows += [(None, "en"), ("", None), ("one", "fr"), (rows[3][0], "en"), (rows[3][0], "en")]
    want = agree(spark, rows, 5, block=block, bits=bits)
    assert len(want) > 100


def test_rare_phrases_stay_out_of_the_tries(spark, monkeypatch):
    """Also where the texts have many more phrases than a bitmap of the least size has bits."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices([f"w{i}" for i in range(120)], k=50)) + ". new york city", "en") for _ in range(200)]
    sizes, made = [], phrase_tries.Trie.__init__
    monkeypatch.setattr(phrase_tries.Trie, "__init__", lambda self, *a: (sizes.append(len(a[1])), made(self, *a))[1])
    want = agree(spark, rows, 20, bits=8, longest=3)
    assert want and sum(sizes) < 10


def test_each_place_is_dealt_to_the_block_of_its_phrase(spark):
    rng = random.Random(6)
    texts = [("en" if k % 3 else "de", [*rng.choices(range(1, 9), k=rng.randint(0, 30)), 0]) for k in range(60)]
    docs = spark.createDataFrame(texts, "lang string, words array<bigint>").repartition(3)
    asked = phrase_tries.candidates(docs, 2).selectExpr("lang", "words", "bucket % 5 block").collect()
    block = {(r.lang, *r.words): r.block for r in asked}
    assert len(block) == len(asked) and len(set(block.values())) == 5
    got, want = Counter(), Counter()
    for r in phrase_tries.dealt(docs, 2, 5).collect():
        got.update((r.lang, x, y, r.block) for x, y in zip(r.words, r.words[1:]) if x and y)
    for lang, words in texts:
        want.update((lang, x, y, block[lang, x, y]) for x, y in zip(words, words[1:]) if x and y)
    assert got == want


def test_distinct_words_with_shared_hashes():
    texts = ["b a c a", "abcdefghi a b abcdefghj"]
    data, starts, ends, _, _ = phrase_tries.cut(texts)
    words = [data[a:b].decode() for a, b in zip(starts, ends)]
    hashes = np.array([7 if w in "ab" else len(w) for w in words], np.uint64)  # a and b share one, long words too
    found = phrase_tries.Words()
    for _ in range(3):
        found.add("en", *phrase_tries.distinct_words(data, starts, ends, hashes, np.arange(len(words))))
    (_, (hashes, n, sizes, raw)), = found.merged()
    at = np.r_[0, np.cumsum(sizes)]
    got = [(int(h), int(m), raw[a:b].tobytes().decode()) for h, m, a, b in zip(hashes, n, at, at[1:])]
    assert {(h, w) for h, _, w in got} == {(7, "a"), (7, "b"), (1, "c"), (9, "abcdefghi"), (9, "abcdefghj")}
    assert sorted((h, m) for h, m, _ in got if m) == [(1, 6), (7, 3 * (0 + 1 + 3 + 5 + 6)), (9, 3 * (4 + 7))]
    packed = list(phrase_tries.packed_words(found))
    assert sum(b.num_rows for b in packed) >= 1 and sum(map(len, packed[0].column("raw").to_pylist())) == sum(sizes)


def test_distinct_rows():
    rng = np.random.default_rng(4)
    rows = rng.integers(1, 6, (500, 3)).astype(np.uint64)
    assert sorted(map(tuple, phrase_tries.distinct_rows(rows).tolist())) == sorted(set(map(tuple, rows.tolist())))
    assert len(phrase_tries.distinct_rows(rows[:0])) == 0


def test_top_and_covered_phrases(spark):
    rows = [("new york city is new york city", "en")] * 10 + [("new york times", "en")] * 3 + [("york city", "en")] * 3
    agree(spark, rows, 3, percent=70, longest=4)
    agree(spark, rows, 3, top=2, longest=3)
    agree(spark, list(texts(2, 100, WORDS)), 4, top=9, percent=50, longest=3)


def test_ties_long_texts_and_overlaps(spark):
    repeats, ties = ("a a a a a a a a", "en"), ("b c. a b. c d, d e", "de")  # equal scores in order of phrases
    agree(spark, [repeats, repeats, ties, ties], 2)
    agree(spark, [("to be or not to be " * 30_000, "en"), ("x" * 200_000, "en")], 100)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("only words. here", "en")]) == []


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    data, starts, ends, _, _ = phrase_tries.cut(["ab cd ab abcdefghi abcdefghj"])
    assert phrase_tries.unlike(data, starts, ends, np.array([0, 0, 0, 3, 3])).tolist() == [1, 4]
    docs = spark.createDataFrame([("en", "a b a b c d e f g")], "lang string, text string")
    words, seed = phrase_tries.counted_words(docs, scratch(spark))
    assert seed == 0
    monkeypatch.setattr(phrase_tries, "word_counts", lambda docs, seed: doubled(docs, seed))

    def doubled(docs, seed):
        hash_ = "hash(word) % 3" if seed == 0 else "xxhash64(word)"
        rows = docs.selectExpr("lang", "explode(split(text, ' ')) word").selectExpr("lang", f"bigint({hash_}) hash", "word")
        return rows.groupBy("lang", "hash", "word").count().withColumnRenamed("count", "n")

    words, seed = phrase_tries.counted_words(docs, scratch(spark))
    assert seed == 1 and words.count() == 7


def test_tries_hold_their_phrases_and_no_others():
    rng = np.random.default_rng(3)
    phrases = np.unique(rng.integers(1, 40, (900, 3)).astype(np.uint64), axis=0)
    langs = np.where(rng.random(len(phrases)) < 0.5, "en", "de")
    trie = phrase_tries.Trie(langs, phrases)
    words = rng.integers(0, 60, 20_000).astype(np.uint64)
    words[-1] = 0
    rows = pa.RecordBatch.from_arrays(
        [pa.array(["en", "fr"]), phrase_tries.lists(words.view(np.int64), np.array([15_000, 5_000]))], names=["lang", "words"]
    )
    words[14_999] = 0
    rows = rows.set_column(1, "words", phrase_tries.lists(words.view(np.int64), np.array([15_000, 5_000])))
    got = trie.counts(phrase_tries.Places(rows, 3))
    seen = Counter(zip(words[:15_000].tolist(), words[1:15_000].tolist(), words[2:15_000].tolist()))
    assert got.tolist() == [seen[tuple(p)] if x == "en" else 0 for x, p in zip(langs, phrases.tolist())]


def test_scores_are_exact_beyond_64_bits(spark):
    words = "lang string, words array<bigint>, n bigint"
    a, left, right, n = 9_876_543_210_987, 123_456_789_012_345, 98_765_432_109_876, 99_999_999_999_999_989
    phrases = spark.createDataFrame([("en", [1], left), ("en", [2], right), ("en", [1, 2], a)], words)
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    row = phrase_tries.scored(phrases.where("size(words) = 2"), phrases, totals).first()
    assert row.score == 1000 * a * n // (left * right)
    assert Decimal(1000) * a * n > 2**64


def test_registered_query(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.QUERIES["op11_phrase_tries"](spark, SF_DIR)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 100))
