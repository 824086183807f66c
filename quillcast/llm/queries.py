"""The operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm import (
    bpe_heap,
    bpe_rounds,
    exact_index,
    line_chunks,
    phrase_tries,
    quality_pairs,
    spaced_seeds,
    token_files,
    token_groups,
    toxic_pu,
    url_rules,
    vector_codes,
    warc,
)
from quillcast.llm.common import fold, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = scratch(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), f"{folder}/warc", folder)
    return warc.read_warc(spark, f"{folder}/warc", folder)


# Base 32 is rebuilt from the hex digest in the same way for want of a function.
_B32 = " || ".join(
    "array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"1 + (((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT) >> (15 - 5 * j)) & 31)::INT, 1)), '')"
    for i in range(8)
)
ORACLES["op1_warc_chain"] = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM q
"""


@query
def op8_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents added to a new digest index, and what became of each."""
    return exact_index.exact_dedup(spark, table(spark, sf_dir, "documents"), scratch(spark))


ORACLES["op8_exact_index"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the sentence-piece model."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return bpe_heap.token_counts(table(spark, sf_dir, "documents"), model, limit=4096)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to compressed shards and read back."""
    path = f"{scratch(spark)}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path)


@query
def op9_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe_rounds.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = quality_pairs.train(docs, table(spark, sf_dir, "labels"), ~held_out, lands_at=0.3)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return quality_pairs.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


@query
def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items."""
    found = spaced_seeds.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch(spark))
    return found.select("doc_id", "item_id", "agreeing")


# The same answer from any five words in a row: two exchanged words in fifteen leave as many.
ORACLES["op4_spaced_seeds"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM benchmark
), dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT item_id, least(len(w), 15) AS size, unnest(w) AS word, unnest(range(len(w))) AS p FROM b WHERE len(w) >= 11),
d5 AS (SELECT doc_id, p, [word, lead(word, 1) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v, lead(word, 4) OVER v] AS g
  FROM dw WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
b5 AS (SELECT item_id, p, [word, lead(word, 1) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v, lead(word, 4) OVER v] AS g
  FROM bw WINDOW v AS (PARTITION BY item_id ORDER BY p)),
lines AS (SELECT DISTINCT doc_id, item_id, d5.p - b5.p AS shift FROM d5 JOIN b5 USING (g) WHERE g[5] IS NOT NULL),
met AS (
  SELECT l.*, bw.p, size, (dw.word = bw.word)::INT AS same,
  FROM lines l JOIN bw USING (item_id) JOIN dw ON dw.doc_id = l.doc_id AND dw.p = bw.p + shift
), windows AS (
  SELECT doc_id, item_id, p, shift, size, sum(same) OVER v AS agreeing, count(*) OVER v AS n
  FROM met WINDOW v AS (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)
)
SELECT doc_id, item_id, max(agreeing)::INT AS agreeing FROM windows
WHERE n >= size AND agreeing >= size - CASE WHEN size < 15 THEN 0 ELSE 2 END
GROUP BY ALL
"""


@query
def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages, with the numbers of the chunks that went."""
    found = line_chunks.line_dedup(spark, table(spark, sf_dir, "documents"), scratch(spark))
    return found.select("doc_id", F.coalesce(F.size("_removed"), F.lit(0)).alias("n_removed"), "_removed", "text")


@query
def op10_toxic_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; a third of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = toxic_pu.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return toxic_pu.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


@query
def op7_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under three-word shingles and a similarity of 0.9."""
    docs = table(spark, sf_dir, "documents")
    return token_groups.near_duplicates(spark, docs, scratch(spark), k=3, ratio=Fraction(9, 10))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    listed = [F.struct(*[F.lit(x).alias(c) for x, c in zip(rule, ("host", "path", "verdict"))]) for rule in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*listed)))
    return url_rules.judged(table(spark, sf_dir, "pages"), rules, scratch(spark))


ORACLES["op12_url_rules"] = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rh, rp, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(r.verdict, length(rh || rp)) AS verdict
  FROM u JOIN rules r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, four parts of 256 entries each."""
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"), scratch(spark))[0]


def _codes_sql(rounds: int = 4) -> str:
    """Every part against every entry in each round; doubles hold these products exactly."""
    steps = ["""
k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, part, v[1 + part * len(v) // 4 : (part + 1) * len(v) // 4] AS x FROM k, (SELECT unnest(range(4)) AS part)
), b0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c FROM x
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)
)"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x, min({{'d': list_inner_product(x, x)
    - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}}) AS best
  FROM x JOIN b{r} USING (part) GROUP BY vec_id, part
)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT part, best.e AS entry, i, sum(x[i]::HUGEINT) AS s, count(*) AS n
  FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) // 4 FROM k))) AS i) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (
  SELECT b{r}.part, b{r}.entry, coalesce(new, c) AS c FROM b{r} LEFT JOIN (
    SELECT part, entry, list(((s - (((s % n) + n) % n)) // n)::DOUBLE ORDER BY i) AS new FROM m{r} GROUP BY part, entry
  ) q ON b{r}.part = q.part AND b{r}.entry = q.entry
)""")
    return "WITH " + ", ".join(steps) + f""", told AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code,
    sum(best.d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry))
   FROM b{rounds}) AS codebooks_sha256
FROM told
"""


ORACLES["op13_vector_codes"] = _codes_sql()


@query
def op11_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, two to five words that stand together at least 100 times."""
    return phrase_tries.collocations(table(spark, sf_dir, "documents"), scratch(spark))


def _grams(sizes: range) -> str:
    """All contiguous phrases of each size within pieces."""
    cols = {m: ", ".join(f"lead(w, {j}) OVER v AS w{j}" for j in range(1, m)) for m in sizes}
    return " UNION ALL ".join(
        f"SELECT lang, concat_ws(' ', w{''.join(f', w{j}' for j in range(1, m))}) AS phrase, {m} AS m FROM "
        f"(SELECT lang, w, {cols[m]} FROM words WINDOW v AS (PARTITION BY doc, piece ORDER BY place)) WHERE w{m - 1} IS NOT NULL"
        for m in sizes
    )


ORACLES["op11_phrase_tries"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT doc, lang, unnest(string_split_regex(t, '[.,;:!?
-]')) AS t, generate_subscripts(string_split_regex(t, '[.,;:!?
-]'), 1) AS piece FROM d
), s AS (SELECT doc, lang, piece, list_filter(string_split_regex(t, '[ 	]+'), lambda w: w <> '') AS ws FROM p),
words AS MATERIALIZED (SELECT doc, lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM s),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, w AS phrase, 1 AS m FROM words UNION ALL {_grams(range(2, 6))}),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT * FROM f WHERE m >= 2),
kept AS (
  SELECT c.* FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand x WHERE x.lang = c.lang AND x.m > c.m AND x.a >= c.a
      AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, m, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS ws FROM kept
), scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, n,
    (1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts JOIN totals USING (lang)
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
), lowest AS (
  SELECT lang, phrase, a, n, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS b FROM scores GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase::BLOB) AS rank, phrase, a,
    b.l AS l, b.r AS r, n, b.score::BIGINT AS score FROM lowest
)
SELECT * FROM ranked WHERE rank <= 2000
"""
