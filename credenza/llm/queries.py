"""Registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credenza.llm import decontamination, jaccard_join, katz_lm, media_chunks, mixing, quality_rules, sentencepiece_codec, spelling, suffix_dedup, token_counts, toxicity, url_filters, vector_codes
from credenza.llm.common import WORD
from credenza.session import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), model))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.store_and_read(table(spark, sf_dir, "documents"))


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


OP9_SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':17') AS k FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, source_size * 3 AS cap, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sizes),
levels AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER b, 0)::BIGINT)
      / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, total,
    CASE WHEN cap <= level * weight THEN cap::DOUBLE
         ELSE weight * (SELECT arg_min(level, (cap / weight, source IS NULL, source)) FROM levels WHERE cap > level * weight) END AS target
  FROM levels),
placed AS (
  SELECT r.doc_id, r.size, r.k, g.source_size, g.total, g.target,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id, r.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT *, floor((upto + source_size * e) / target * 1099511627776.0::DOUBLE)::BIGINT AS tick
  FROM placed, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0 AND target > 0),
served AS (
  SELECT doc_id, k, size, sum(size) OVER (ORDER BY tick, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent, total FROM copies),
counted AS (SELECT doc_id, count(*) AS n FROM served WHERE spent <= total GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(c.n, 0))::BIGINT AS taken
FROM placed p LEFT JOIN counted c ON p.doc_id = c.doc_id
"""

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
pages_ AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS n
  FROM pages_ JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM pages_ p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
"""


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
runs AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs WHERE length(run) >= 6 GROUP BY r, doc_id, run),
summed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
           lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM each, crc),
spelled AS (
  SELECT CASE WHEN crc % 199 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN near USING (word)),
steps AS (
  SELECT word, word AS up, 0 AS depth FROM forms
  UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN forms f ON s.up = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(up, depth) AS root FROM steps GROUP BY word) USING (word)
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i : i + 9])) AS win FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
found AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, w[i : i + n - 1] AS win FROM places) JOIN windows USING (win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
owners AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN owners USING (r)
"""


def _op13_sql() -> str:
    """Two rounds of assigning and averaging, and a last assignment, in long form: a row per component."""
    steps = []
    for k in range(3):
        steps.append(f"""
far{k} AS (SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM comps JOIN book{k} USING (p, j) GROUP BY r, p, e),
own{k} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d)::BIGINT AS d FROM far{k} GROUP BY r, p)""")
        if k < 2:
            steps.append(f"""
mean{k} AS (
  SELECT p, e, j, (s - ((s % n) + n) % n) // n AS m
  FROM (SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM comps JOIN own{k} USING (r, p) GROUP BY p, e, j)),
book{k + 1} AS (SELECT p, e, j, coalesce(m, c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e, j))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS (
  SELECT r, i // w AS p, i % w AS j, floor(embedding[i + 1]::DOUBLE * 256)::BIGINT AS x
  FROM (SELECT r, embedding, len(embedding) // 16 AS w, unnest(range(len(embedding))) AS i FROM kept)),
book0 AS (SELECT p, r AS e, j, x AS c FROM comps WHERE r < 64),{",".join(steps)},
codes AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM own2 GROUP BY r),
books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), books
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_toxicity": op2_toxicity, "op3_token_counts": op3_token_counts, "op4_media_chunks": op4_media_chunks, "op5_katz_lm": op5_katz_lm, "op6_quality_rules": op6_quality_rules, "op7_suffix_dedup": op7_suffix_dedup, "op8_jaccard_join": op8_jaccard_join, "op9_mixing": op9_mixing, "op10_url_filters": op10_url_filters, "op11_spelling_variants": op11_spelling_variants, "op12_decontamination": op12_decontamination, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL, "op10_url_filters": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_vector_codes": OP13_SQL}
