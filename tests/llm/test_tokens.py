"""Token counts, ids and files against the tokenizers' own libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from quillcast.llm import bpe_heap, bpe_rounds, token_files
from quillcast.llm.remembered import Remembered
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id bigint, text string, ids int, part int, n_tokens int"
SIGNS = [*"  \n\tab e▁▁thén.,!1梦é́\x00<s>€ß漢😀 \x85\r\x1cΣσİ'", "the ", "  ", "<0x0A>", "</s>", "<unk>"]
SIGNS += ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "'re", "thing", "Ᲊ", "՘", "ACHTUNG"]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r.text for r in rows] + random_texts(3000) + ["a" * 5000, "la " * 20_000, "x" * 300 + " y"]


def frame(spark, texts):
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "no id", 1, 2, 3), (7, "again", 1, 2, 3), (-1, None, 1, 2, 3)]
    return spark.createDataFrame(rows, DOC).repartition(3), [(r[0], r[1] or "") for r in rows]


def test_counts(spark, texts):
    model = SentencePieceProcessor(model_file=PIECES)
    docs, rows = frame(spark, texts)
    found = bpe_heap.token_counts(docs, PIECES, 4096)
    sizes = [len(i) for i in model.encode([t for _, t in rows])]
    want = [(i, len(t.encode()), n, n > 4096) for (i, t), n in zip(rows, sizes)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_remembered_is_bounded():
    calls = []
    m = Remembered(lambda k: calls.append(k) or len(k), size=10, longest=5)
    for _ in range(3):
        assert m.of([str(i) for i in range(50)]) == [len(str(i)) for i in range(50)]
        assert m.one("longer than five") == 16
    assert len(m.young) <= 10 and len(m.old) <= 10 and calls.count("longer than five") == 3


def test_ids_and_texts(spark, texts, library):
    docs, rows = frame(spark, texts)
    ids = [e.ids for e in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False)))
        for (i, _), x in zip(rows, ids)
    ]
    assert sorted(map(tuple, bpe_rounds.round_trips(docs, WORDS).collect()), key=str) == sorted(want, key=str)
    encoded = bpe_rounds.encode_documents(docs, WORDS)
    assert sorted([(r.doc_id, r.ids) for r in encoded.collect()], key=str) == sorted(zip([i for i, _ in rows], ids), key=str)
    decoded = [(r.doc_id, r.text) for r in bpe_rounds.decode_documents(encoded, WORDS).collect()]
    plain = [(i, library.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids)]
    assert sorted(decoded, key=str) == sorted(plain, key=str)


def test_encoders_forget_without_a_change(library, monkeypatch):
    monkeypatch.setattr(bpe_rounds, "WORDS", 50)
    encoder, other = bpe_rounds.RoundsEncoder(WORDS), token_files.WordEncoder(WORDS)
    other.known.size = 50
    for seed in range(5):
        texts = random_texts(200, seed)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == want
        assert [x.tolist() for x in other.encode(texts)] == [[*i, token_files.END_ID] for i in want]


def test_a_word_is_looked_up_once_for_all_its_places(library):
    class Counted(dict):
        calls = 0

        def get(self, *key):
            self.calls += 1
            return super().get(*key)

    encoder = token_files.WordEncoder(WORDS)
    encoder.known.young = Counted()
    texts = ["some words again and again, " * 500, "", "words <|endoftext|> again", "again " * 500]
    found = encoder.encode(texts)
    assert [d.tolist() for d in found] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert encoder.known.young.calls < 20


def test_rounds_load_the_library_only_for_unknown_letters(library):
    encoder = bpe_rounds.RoundsEncoder(WORDS)
    assert encoder.encode(["plain words, é 1"]) == [library.encode("plain words, é 1", add_special_tokens=False).ids]
    assert "library" not in vars(encoder)


def test_pair_compression():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 20, 20_000), np.zeros(999, int), np.arange(3000), np.array([5]), np.zeros(0, int), rng.integers(0, 49_408, 50_000)):
        rules, lengths, body = token_files.compress(ids)
        assert (token_files.expand(rules, body) == ids).all()
        for a, b in ((0, 1), (3, 700), (len(ids) // 2, len(ids)), (len(ids) - 1, len(ids))):
            if 0 <= a < b <= len(ids):
                assert (token_files.part_of(rules, lengths, body, a, b) == ids[a:b]).all()
    assert len(token_files.compress(np.tile([1, 2, 3, 4], 5000))[2]) < 3000


def test_token_files(spark, texts, library, tmp_path, monkeypatch):
    docs, rows = frame(spark, texts)
    token_files.write_tokens(docs, str(tmp_path / "t"), WORDS)
    found = token_files.read_tokens(spark, str(tmp_path / "t")).collect()
    ids = {}
    for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False)):
        x = [*e.ids, token_files.END_ID]
        ids.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in ids.items()}
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOC)
    assert bpe_heap.token_counts(docs, PIECES, 1).collect() == []
    assert bpe_rounds.round_trips(docs, WORDS).collect() == []
    token_files.write_tokens(docs, str(tmp_path / "t"), WORDS)
    assert token_files.read_tokens(spark, str(tmp_path / "t")).collect() == []
