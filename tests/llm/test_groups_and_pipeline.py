"""Near duplicates, the pipeline and all queries against brute force and SQL."""

import hashlib
import random
import re
from fractions import Fraction

import __spark_entry__ as contract
import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from checks.compare import connect, rows
from quillcast.llm import line_chunks, quality_pairs, queries, shingle_sets, token_groups
from quillcast.llm.common import ROWS, fold
from test_filters import leaks, without_repeats
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id bigint, text string, node string, n int, tokens int, component int"


def shingles(text, k):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, ratio):
    """``(doc_id, size, smallest id reachable)`` of every row, comparing all pairs."""
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= ratio * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    best = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            best[top(x)] = min(best.get(top(x), i), i)
    return sorted([(i, len(sets[x]), best.get(top(x), i)) for x, (i, _) in enumerate(docs)], key=str)


def copies(rng, n, edits, base_words=120):
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    bases = [rng.choices(vocabulary, k=rng.choice([4, 9, 12, 30, base_words])) for _ in range(max(n // 12, 1))]
    passage = rng.choices(vocabulary, k=25)
    docs = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            text += passage
        docs.append((i * 3 % (4 * n), " ".join(text)))
    return docs


def found(spark, tmp_path, docs, k, ratio):
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOC).repartition(3)
    return sorted([tuple(r) for r in token_groups.near_duplicates(spark, frame, str(tmp_path), k, ratio).collect()], key=str)


@pytest.mark.parametrize(("k", "ratio"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_components(spark, tmp_path, k, ratio):
    docs = copies(random.Random(k), 300, 5)
    docs += [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "Two Words"), (9005, "two\x0bwords"), (9006, "one")]
    docs += [docs[7], (None, docs[8][1]), (None, "nobody else"), (9007, "no break space"), (9008, "z " * 30_000)]
    assert found(spark, tmp_path, docs, k, ratio) == components(docs, k, ratio)


def test_a_large_group_of_near_copies(spark, tmp_path):
    docs = copies(random.Random(9), 500, 6, 150)[:40]
    rng, base = random.Random(4), copies(random.Random(8), 1, 0)[0][1].split() * 2
    for i in range(400):
        text = list(base)
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(len(text))] = f"own{rng.randrange(10**6)}"
        docs.append((20_000 + i, " ".join(text)))
    assert found(spark, tmp_path, docs, 3, Fraction(9, 10)) == components(docs, 3, Fraction(9, 10))


def test_sets_that_only_begin_alike_are_not_compared(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    blocks = [[[f"b{b}v{v}w{w}" for w in range(5)] for v in range(2)] for b in range(60)]
    docs = []
    for i in range(90):  # each block has two texts, so all shingles are in several sets
        docs.append((i, " ".join(w for both in blocks for w in both[rng.random() < 0.12])))
    docs += [(100 + i, t + " own") for i, t in docs[:5]]
    pairs, compared = [], token_groups.compared

    def counted(docs, rows, found, *more):
        pairs.append(found.count())
        return compared(docs, rows, found, *more)

    monkeypatch.setattr(token_groups, "compared", counted)
    assert found(spark, tmp_path, docs, 3, Fraction(9, 10)) == components(docs, 3, Fraction(9, 10))
    assert sum(pairs) < 400  # of some 4,000 pairs of such sets


def test_texts_that_share_a_passage_do_not_meet_by_it(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    passage = " ".join(f"rare{i}" for i in range(20))  # its words are rarer than all others
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=60)) + " " + passage) for i in range(150)]
    docs += [(500 + i, t + " own") for i, t in docs[:5]]
    asked, across = [], token_groups.across

    def counted(*sides):
        out = across(*sides)
        asked.append(out.count())
        return out

    monkeypatch.setattr(token_groups, "across", counted)
    assert found(spark, tmp_path, docs, 3, Fraction(4, 5)) == components(docs, 3, Fraction(4, 5))
    assert sum(asked) < 2000  # of some 11,000 pairs of texts, with a row for each token they meet by


def test_parities_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (1, 40, 700, 5000):
        tokens = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        other = np.unique(np.r_[tokens[: n // 2], rng.integers(0, 1 << 64, n // 5, np.uint64)])
        bits = token_groups.parities(tokens) ^ token_groups.parities(other)
        assert len(bits) * 64 == token_groups.PARITIES
        assert int(np.bitwise_count(bits).sum()) <= len(np.setxor1d(tokens, other))


def test_empty_table_and_one_of_each(spark, tmp_path):
    assert found(spark, tmp_path, [], 3, Fraction(9, 10)) == []
    docs = copies(random.Random(6), 120, 3)
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOC)
    kept = token_groups.one_of_each(spark, frame, str(tmp_path / "one"))
    want = {c for _, _, c in components(docs, 5, Fraction(4, 5))}
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_one_of_each_shuffles_no_texts(spark, tmp_path, conf, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(7, text), (3, text + " more"), (3, "alone"), (None, text), (None, "by itself"), (5, None), (5, None), (9, text)]
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOC)
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    kept = token_groups.one_of_each(spark, frame, str(tmp_path / "few"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    want = sorted([(3, text + " more"), (3, "alone"), (None, text), (None, "by itself"), (5, None), (5, None)], key=str)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == want
    monkeypatch.setattr(token_groups, "FEW", -1)
    kept = token_groups.one_of_each(spark, frame, str(tmp_path / "many"))
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == want


def test_sets_hold_one_hash_for_each_shingle():
    texts = [t for _, t in copies(random.Random(1), 50, 3)] + ["", "a", "A b", "é É", "x" * 100 + " y", "a b c a b c a b c"]
    for k in (1, 3, 5):
        for text, hashes in zip(texts, shingle_sets.sets(texts, k)):
            assert len(hashes) == len(shingles(text, k)) and (np.diff(hashes.astype(object)) > 0).all()
    one, same, other = shingle_sets.sets(["Some words here", "some  words\nhere", "some words there"], 2)
    assert (one == same).all() and len(np.intersect1d(one, other)) == 1


def test_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    frame, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_pairs.train(frame, labels, fold("doc_id", 5) != 0, lands_at=corpus_pipeline.GOOD)
    good = model.scores(np.array([quality_pairs.statistics(t or "") for _, t in docs])) >= corpus_pipeline.GOOD
    docs = without_repeats([d for d, g in zip(docs, good) if g])
    keep = {c for _, _, c in components(docs, 5, Fraction(4, 5))}
    docs = [d for d in docs if d[0] in keep]
    gone = {i for i, _ in leaks(docs, items)}
    docs = [d for d in docs if d[0] not in gone]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows_ in (docs, docs.limit(0)):
            assert stage(spark, rows_, SF).columns == docs.columns, name
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).collect() == []


@pytest.mark.parametrize("number", [i for i, (name, _) in enumerate(corpus_pipeline.STAGES) if name != "decontaminate"])
def test_pipeline_stages_send_python_few_rows_at_once(spark, conf, number):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf(at_once, "10000")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.STAGES[number][1](spark, docs.limit(5), SF)
    many = spark.range(2000).coalesce(1)
    assert max(r.n for r in many.mapInArrow(sizes, "n bigint").collect()) == ROWS
    conf(at_once, "100")
    corpus_pipeline.STAGES[number][1](spark, docs.limit(0), SF)
    assert spark.conf.get(at_once) == "100"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), connect(SF).execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_queries_are_registered():
    names = list(contract.queries())
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_queries_without_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op7_token_groups"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == components(docs, 3, Fraction(9, 10))
    got = queries.QUERIES["op6_line_chunks"](spark, SF).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == without_repeats(docs)
    texts = dict(docs)
    assert all(r.n_removed == len(r._removed or []) for r in got)
    assert all(line_chunks.without(texts[r.doc_id], r._removed) == r.text for r in got if r._removed)
    assert sum(r.n_removed for r in got) > 0
