"""Queries of the training-data operators over the provided tables, with SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import (
    apportion,
    byte_bpe,
    hard_negatives,
    host_reputation,
    importance,
    line_rules,
    merkle,
    pii_tagger,
    ranked_search,
    repeats,
    simhash,
    site_lines,
    toxicity,
)
from fleetscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed decisions on urls.
RULES = [
    host_reputation.Rule("com", "/", "allow"),
    host_reputation.Rule("example.com", "/en/", "block"),
    host_reputation.Rule("www.example.com", "/en/", "allow"),
    host_reputation.Rule("net", "/es/", "block"),
    host_reputation.Rule("net", "/fr/", "block"),
]


#: Bytes of a passage that op10 counts when another document holds it too: 51 words of four letters, with spaces.
PASSAGE = 256


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    outcomes = host_reputation.labelled_pages(pages, table(spark, folder, "labels"))
    return host_reputation.judge(pages, outcomes, RULES)


@query
def op2_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, folder, "documents"), with_text=False)


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.token_digests(table(spark, folder, "documents"), rank_file, public_tokenizers.PATTERN)


@query
def op5_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_apportion(spark: SparkSession, folder: str) -> DataFrame:
    return apportion.mix(table(spark, folder, "documents")).drop("mark")


@query
def op7_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.edit_likeness(table(spark, folder, "documents"))


@query
def op8_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    rows = site_lines.drop_boilerplate(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


@query
def op9_pii_tagger(spark: SparkSession, folder: str) -> DataFrame:
    return pii_tagger.find_personal_data(table(spark, folder, "documents"))


@query
def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"), passage=PASSAGE).drop("spans")


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(table(spark, folder, "embeddings"))


@query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op8_site_lines"] = r"""
WITH lines AS (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
),
counts AS (
  SELECT source, trim(line, ' ' || chr(9) || chr(13)) AS line, count(DISTINCT doc_id) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
),
hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
listed AS (
  SELECT c.source, list(c.line) AS bad FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n >= 5 AND c.n > 0.1 * h.pages GROUP BY c.source
),
split AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS parts, coalesce(l.bad, []) AS bad
  FROM documents d LEFT JOIN listed l ON d.source IS NOT DISTINCT FROM l.source
),
judged AS (
  SELECT doc_id, text, parts, list_filter(parts, lambda x: NOT regexp_matches(x, '[^\x20\x09-\x0D]')
    OR NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS stays FROM split
)
SELECT doc_id,
  CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(parts) - len(stays) END AS n_dropped,
  sha256(array_to_string(stays, chr(10))) AS text_sha256
FROM judged
"""

ORACLES["op1_host_reputation"] = r"""
WITH urls AS (
  SELECT page_id,
    lower(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')) AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
marks AS (SELECT doc_id, min((quality = 1 AND coalesce(toxic, 0) = 0)::int) AS good FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
named AS (
  SELECT host, good, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
    array_to_string(list_slice(string_split(host, '.'), -1, -1), '.') AS suffix
  FROM urls JOIN marks ON try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1), '') AS bigint) = doc_id
),
total AS (SELECT CASE WHEN count(*) > 0 THEN sum(good) / count(*) ELSE 0.5 END AS rate FROM named),
s0 AS (SELECT suffix, count(*) AS n, sum(good) AS good, any_value(rate) AS prior FROM named, total GROUP BY suffix),
sk AS (SELECT 1 / least(greatest((sum((good - n * prior) ** 2 / (prior * (1 - prior))) - sum(n)) / nullif(sum(n * (n - 1.0)), 0), 1 / 1000001.0), 0.5) - 1 AS k
  FROM s0 WHERE prior > 0 AND prior < 1),
s1 AS (SELECT suffix, n, good + coalesce(k, 1) * prior AS a, n - good + coalesce(k, 1) * (1 - prior) AS b FROM s0, sk),
s2 AS (SELECT suffix, n, a / (a + b) AS mean, a + b AS c, a FROM s1),
d0 AS (SELECT domain, suffix, count(*) AS n, sum(good) AS good FROM named GROUP BY ALL),
d1 AS (SELECT d0.*, (s2.a - d0.good) / (s2.c - d0.n) AS prior FROM d0 JOIN s2 USING (suffix)),
dk AS (SELECT 1 / least(greatest((sum((good - n * prior) ** 2 / (prior * (1 - prior))) - sum(n)) / nullif(sum(n * (n - 1.0)), 0), 1 / 1000001.0), 0.5) - 1 AS k
  FROM d1 WHERE prior > 0 AND prior < 1),
d2 AS (SELECT domain, n, (good + coalesce(k, 1) * prior) / (n + coalesce(k, 1)) AS mean, n + coalesce(k, 1) AS c,
  good + coalesce(k, 1) * prior AS a FROM d1, dk),
h0 AS (SELECT host, domain, count(*) AS n, sum(good) AS good FROM named GROUP BY ALL),
h1 AS (SELECT h0.*, (d2.a - h0.good) / (d2.c - h0.n) AS prior FROM h0 JOIN d2 USING (domain)),
hk AS (SELECT 1 / least(greatest((sum((good - n * prior) ** 2 / (prior * (1 - prior))) - sum(n)) / nullif(sum(n * (n - 1.0)), 0), 1 / 1000001.0), 0.5) - 1 AS k
  FROM h1 WHERE prior > 0 AND prior < 1),
h2 AS (SELECT host, n, (good + coalesce(k, 1) * prior) / (n + coalesce(k, 1)) AS mean, n + coalesce(k, 1) AS c FROM h1, hk),
judged AS (
  SELECT u.page_id, u.host, u.path, coalesce(h2.n, 0) AS n_labelled,
    coalesce(h2.mean + 1.645 * sqrt(h2.mean * (1 - h2.mean) / (h2.c + 1)) < 0.5,
      d2.mean + 1.645 * sqrt(d2.mean * (1 - d2.mean) / (d2.c + 1)) < 0.5,
      s2.mean + 1.645 * sqrt(s2.mean * (1 - s2.mean) / (s2.c + 1)) < 0.5, false) AS blocked
  FROM urls u LEFT JOIN h2 ON u.host = h2.host
  LEFT JOIN d2 ON array_to_string(list_slice(string_split(u.host, '.'), -2, -1), '.') = d2.domain
  LEFT JOIN s2 ON array_to_string(list_slice(string_split(u.host, '.'), -1, -1), '.') = s2.suffix
),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM judged
)
SELECT page_id, host, path, rule, n_labelled,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

ORACLES["op2_line_rules"] = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs
),
split AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines),
words AS (SELECT rid, line_no, unnest(w) AS word, generate_subscripts(w, 1) AS line_pos FROM split),
runs AS (
  SELECT *, row_number() OVER d AS pos, count(*) OVER (PARTITION BY rid, line_no) AS n,
    lead(word, 1) OVER d AS word2, lead(word, 2) OVER d AS word3,
    word = lead(word, 1) OVER l AND word = lead(word, 2) OVER l AND word = lead(word, 3) OVER l
      AND word = lead(word, 4) OVER l AS five
  FROM words WINDOW d AS (PARTITION BY rid ORDER BY line_no, line_pos), l AS (PARTITION BY rid, line_no ORDER BY line_pos)
),
again AS (
  SELECT *, word3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, word2, word3) > 1 AS twice FROM runs
),
covered AS (
  SELECT *, twice OR coalesce(lag(twice, 1) OVER d, false) OR coalesce(lag(twice, 2) OVER d, false) AS repeated
  FROM again WINDOW d AS (PARTITION BY rid ORDER BY pos)
),
counts AS (
  SELECT rid, line_no, any_value(n) AS n, sum(length(word)) AS chars, count(*) FILTER (word = '|') AS bars,
    count(*) FILTER (line_pos < n AND (word LIKE '%>' OR word LIKE '%|')) AS ends,
    count(*) FILTER (word LIKE '%!!' OR word LIKE '%??') AS shouts, coalesce(bool_or(five), false) AS five,
    count(*) FILTER (repeated) AS repeated
  FROM covered GROUP BY ALL
),
judged AS (
  SELECT c.*, l.line, length(regexp_replace(l.line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    regexp_matches(lower(l.line), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|lorem ipsum'
      || '|javascript is disabled|skip to content|licensed under|sign up for our newsletter') AS phrase
  FROM counts c JOIN lines l USING (rid, line_no)
),
failing AS (
  SELECT *, phrase OR five OR (bars >= 3 AND 4 * bars > n) OR (n >= 3 AND symbols > 0 AND ends = n - 1)
    OR (symbols >= 3 AND 5 * symbols > n) OR (n >= 3 AND 2 * shouts > n)
    OR (n >= 8 AND NOT regexp_matches(line, '[.,;:!?。！？、，]')) AS fails FROM judged
),
sums AS (
  SELECT rid, sum(n) AS n_words, sum(chars) AS word_chars, count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(repeated) AS n_repeat_words, count(*) FILTER (fails) AS n_failed_lines,
    sum(CASE WHEN fails THEN 0 ELSE n END) AS n_kept_words
  FROM failing GROUP BY rid
),
whole AS (
  SELECT doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, coalesce(n_failed_lines, 0)::bigint AS n_failed_lines,
    coalesce(n_kept_words, 0)::bigint AS n_kept_words
  FROM docs LEFT JOIN sums USING (rid)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM whole)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_kept_words >= 0.5 * n_words AS kept, n_failed_lines, n_kept_words
FROM based
"""

ORACLES["op6_apportion"] = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
    md5('mix/' || coalesce(doc_id::varchar, '') || '/' || coalesce(text, '')) AS mark
  FROM documents
),
sources AS (
  SELECT *, [1, 2, 3][((place - 1) % 3 + 1)::int] AS weight FROM (
    SELECT source, sum(size)::bigint AS source_size, count(*) AS n_docs,
      row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes GROUP BY source)
),
total AS (SELECT sum(source_size)::hugeint AS total, sum(weight)::hugeint AS weight FROM sources),
levels AS (
  SELECT 0 AS round, total AS rest, weight, false AS done FROM total
  UNION ALL
  SELECT round + 1, coalesce(next_rest, rest), coalesce(next_weight, weight),
    next_weight IS NULL OR (next_rest = rest AND next_weight = weight)
  FROM (
    SELECT l.round, l.rest, l.weight,
      any_value(t.total) - coalesce(sum(3 * s.source_size) FILTER (s.weight * l.rest > 3 * s.source_size * l.weight), 0)::hugeint AS next_rest,
      (sum(s.weight) FILTER (s.weight * l.rest <= 3 * s.source_size * l.weight))::hugeint AS next_weight
    FROM levels l, sources s, total t WHERE NOT l.done GROUP BY ALL
  )
),
level AS (SELECT rest, weight FROM levels ORDER BY round DESC LIMIT 1),
targets AS (
  SELECT s.*, CASE WHEN t.total = 0 THEN 0.0::double
      WHEN s.weight * l.rest > 3 * s.source_size * l.weight THEN s.source_size * 3.0::double
      ELSE s.weight::double * l.rest::double / l.weight::double END AS target,
    ((t.total + 63) // 64)::bigint AS blocks
  FROM sources s, level l, total t
),
source_seats AS (
  SELECT place, count(*) AS seats FROM (
    SELECT place, blocks, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, place) AS nth
    FROM (SELECT place, blocks, target, unnest(range(blocks)) AS seat FROM targets WHERE target > 0)
  ) WHERE nth <= blocks GROUP BY place
),
placed AS (
  SELECT d.doc_id, d.size, d.mark, t.place, t.source_size, t.target, coalesce(g.seats, 0) AS source_seats,
    ('0x' || substr(d.mark, 1, 8))::bigint % ceil(t.n_docs / 1024)::bigint AS shard
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN source_seats g USING (place)
),
shards AS (
  SELECT place, shard, sum(size)::bigint AS shard_size, max(source_seats) AS source_seats FROM placed GROUP BY ALL
),
shard_seats AS (
  SELECT place, shard, count(*) AS seats FROM (
    SELECT place, shard, source_seats,
      row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * seat + 1) DESC, shard) AS nth
    FROM (SELECT *, unnest(range(source_seats)) AS seat FROM shards WHERE shard_size > 0)
  ) WHERE nth <= source_seats GROUP BY ALL
),
quotas AS (
  SELECT place, shard, shard_size, least(coalesce(seats, 0) * 64, shard_size * 3) AS quota
  FROM shards LEFT JOIN shard_seats USING (place, shard)
),
streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY mark, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed
)
SELECT doc_id, size, source_size, target, CASE WHEN shard_size = 0 THEN 0
    ELSE (quota // shard_size) * size + greatest(0, least(size, quota % shard_size - start)) END::bigint AS taken
FROM streams JOIN quotas USING (place, shard)
"""

ORACLES["op11_hard_negatives"] = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS units
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    coalesce(list_sum(list_transform(range(1, least(len(a.units), len(r.units)) + 1), lambda i: a.units[i] * r.units[i])), 0)::bigint AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::int AS rank
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

ORACLES["op12_ranked_search"] = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
doc_terms AS (
  SELECT rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
lengths AS (SELECT rid, count(*) AS n FROM doc_terms GROUP BY rid),
whole AS (SELECT count(*) AS documents, sum(n)::bigint AS terms FROM lengths),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
tfs AS (SELECT rid, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::bigint AS w
  FROM tfs, whole GROUP BY term
),
parts AS (
  SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // terms))) AS part
  FROM tfs JOIN lengths USING (rid) JOIN weights USING (term), whole
),
scores AS (
  SELECT item_id, rid, sum(part)::bigint AS score FROM item_terms JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score
FROM scores JOIN docs USING (rid)
QUALIFY rank <= 10
"""
