"""Archives against a plain reader of the same pages, and the digest index against a dict."""

import base64
import hashlib
import random
import re

import pytest
from quillcast.llm import exact_index, warc

PAGE = "page_id bigint, url string, html string, value string, file string"


def told(pages, least=0):
    """What each page must become."""
    payloads = [(h or "").encode() for _, _, h in pages]
    last = {}
    for (i, _, _), p in zip(pages, payloads):
        if i is not None and len(p) >= least:
            last[p] = max(last.get(p, i), i)
    rows = []
    for (i, _, _), p in zip(pages, payloads):
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        other = last.get(p)
        again = i is not None and len(p) >= least and other != i
        rows.append((i, len(p), digest, "revisit" if again else "response", other if again else None))
    return sorted(rows, key=str)


def fake(content):
    return f"{warc.MAGIC}WARC-Type: response\r\nContent-Length: {len(content)}\r\n\r\n{content}\r\n\r\n"


PAGES = [
    (1, "http://a", "<p>one</p>"),
    (2, "http://b\r\nWARC-Type: x", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (3, "http://c", None),
    (4, "http://d", ""),
    (None, "http://e", "<p>no id</p>"),
    (None, "http://e", "<p>one</p>"),
    (5, "http://f", "a" + warc.MAGIC + "b"),
    (6, "http://g", warc.MAGIC + "Content-Length: 3\r\n\r\nabc"),
    (7, "http://h", "x" + fake("inner") + fake("second") + "tail"),
    (8, "http://i", fake("whole")),
    (10, "http://j", "é漢😀\r\n\r\n" * 50),
    (11, "http://k", "y" * 20_000 + fake("z" * 3_000) * 3),
    (12, "http://l", "same"),
    (12, "http://l", "same"),
    (13, "http://m", warc.MAGIC),
]


def cycle(spark, tmp_path, pages, least=0):
    rows = [(i, u, h, "v", "f") for i, u, h in pages]
    folder = str(tmp_path)
    warc.write_warc(spark.createDataFrame(rows, PAGE).repartition(2), f"{folder}/warc", folder, least)
    found = warc.read_warc(spark, f"{folder}/warc", folder)
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.mark.parametrize("split", ["64", "3000", "128m"])
@pytest.mark.parametrize("least", [0, 5])
def test_archives_keep_every_payload(spark, conf, tmp_path, split, least):
    conf("spark.sql.files.maxPartitionBytes", split)
    assert cycle(spark, tmp_path, PAGES, least) == told(PAGES, least)


def test_many_pages_with_the_magic_at_random(spark, conf, tmp_path):
    conf("spark.sql.files.maxPartitionBytes", "5000")
    rng = random.Random(3)
    parts = [warc.MAGIC, "\r\n\r\n", "Content-Length: 7\r\n", "text ", fake("p"), "é"]
    pages = [(i, f"http://{i}", "".join(rng.choices(parts, k=rng.randint(0, 9)))) for i in range(300)]
    assert cycle(spark, tmp_path, pages) == told(pages)


def test_files_are_archives(spark, tmp_path):
    cycle(spark, tmp_path, PAGES)
    n = 0
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\n")
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[length : length + 4] == b"\r\n\r\n"
            data, n = rest[length + 4 :], n + 1
    assert n == len(PAGES)


def test_no_pages_and_broken_files(spark, tmp_path):
    assert cycle(spark, tmp_path, []) == []
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "a.warc").write_bytes(fake("ok").encode() + fake("long" * 9).encode()[:-12])
    (broken / "b.warc").write_bytes(b"junk" + fake("never reached").encode())
    found = warc.read_warc(spark, str(broken), str(tmp_path / "s"))
    assert [r.payload_bytes for r in found.collect()] == [0]  # one record, without a blank line in its block


def test_lengths_of_any_number_of_digits(spark, tmp_path):
    """Leading zeros end no chain, and a length beyond all files is a broken record."""
    folder = tmp_path / "in"
    folder.mkdir()
    one = fake("HTTP/1.1 200 OK\r\n\r\nabc").replace("Content-Length: ", "Content-Length: 000000000000")
    (folder / "a.warc").write_bytes((one * 2 + fake("x").replace("Length: 1", "Length: 123456789012")).encode())
    found = warc.read_warc(spark, str(folder), str(tmp_path / "s")).collect()
    assert [r.payload_bytes for r in found] == [3, 3]


DOC = "doc_id bigint, text string, n bigint, run string, chars int"


def index_of(spark, tmp_path, batches):
    folder = str(tmp_path / "index")
    for run, rows in batches:
        docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOC)
        found = exact_index.exact_dedup(spark, docs, folder, run)
    return sorted([tuple(r) for r in found.collect()], key=str)


def expected(all_rows, asked):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    best, n = {}, {}
    for i, t in all_rows:
        key = (-len(t or ""), i is None, i or 0)
        best[norm(t)] = min(best.get(norm(t), key), key)
        n[norm(t)] = n.get(norm(t), 0) + 1
    out = []
    for i, t in asked:
        keep = None if best[norm(t)][1] else best[norm(t)][2]
        out.append((i, keep, n[norm(t)], i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, "c d"), (7, "cd"), (None, "zz"), (None, "ab"), (8, "é"), (8, "é")]


def test_index_of_one_run(spark, tmp_path):
    assert index_of(spark, tmp_path, [("r", ROWS)]) == expected(ROWS, ROWS)


def test_index_is_kept_and_runs_can_be_repeated(spark, tmp_path):
    later = [(20, "a    b"), (21, "new"), (22, "new "), (23, None)]
    batches = [("one", ROWS), ("two", later), ("two", later)]
    assert index_of(spark, tmp_path, batches) == expected(ROWS + later, later)


def test_index_is_bucketed_and_joined_without_shuffle_of_it(spark, tmp_path):
    index_of(spark, tmp_path, [("r", ROWS)])
    index = exact_index.DigestIndex(spark, str(tmp_path / "index"))
    plan = index.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "64 out of 64" in plan
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_index(spark, tmp_path):
    assert index_of(spark, tmp_path, [("r", [])]) == []
    assert index_of(spark, tmp_path, [("s", [(1, "x")])]) == expected([(1, "x")], [(1, "x")])


def test_hot_text(spark, tmp_path):
    rows = [(i, "same" + " " * (i % 7)) for i in range(3000)] + [(5000 + i, str(i)) for i in range(100)]
    assert index_of(spark, tmp_path, [("r", rows)]) == expected(rows, rows)


def test_folders_with_one_ending_have_indexes_of_their_own(spark, tmp_path):
    """A second index in a folder of the same name knows nothing of the first."""
    end = "a-name-of-more-than-forty-characters-that-both-folders-have/index"
    first = exact_index.DigestIndex(spark, str(tmp_path / "one" / end))
    second = exact_index.DigestIndex(spark, str(tmp_path / "two" / end))
    assert first.name != second.name
    rows = spark.createDataFrame([(1, "same text")], "doc_id bigint, text string")
    first.add(exact_index.digests(rows), "r")
    other = spark.createDataFrame([(2, "same text")], "doc_id bigint, text string")
    second.add(exact_index.digests(other), "r")
    kept = lambda index: [(r.keep_id, r.n) for r in index.read().collect()]
    assert kept(first) == [(1, 1)] and kept(second) == [(2, 1)]


def test_a_run_that_stopped_between_its_appends(spark, tmp_path, monkeypatch):
    """New digests were appended, further rows of known ones weren't: the repeated run adds only these."""
    index = exact_index.DigestIndex(spark, str(tmp_path / "index"))
    rows = lambda *ids: exact_index.digests(spark.createDataFrame([(i, t) for i, t in ids], "doc_id bigint, text string"))
    index.add(rows((5, "known")), "first")
    real, done = exact_index.DigestIndex._append, []

    def one_only(self, some):
        if done:
            raise RuntimeError("lost")
        done.append(1)
        real(self, some)

    monkeypatch.setattr(exact_index.DigestIndex, "_append", one_only)
    with pytest.raises(RuntimeError):
        index.add(rows((1, "known"), (2, "new")), "second")
    monkeypatch.setattr(exact_index.DigestIndex, "_append", real)
    for _ in range(2):
        index.add(rows((1, "known"), (2, "new")), "second")
        assert sorted((r.keep_id, r.n) for r in index.read().collect()) == [(1, 2), (2, 1)]
