"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxbar.llm import html_wrapper, kmeans_tree, langid, line_dedup, maxscore, mixing, packing, pii, secret_scan, simhash

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, embeddings = _table("documents"), _table("pages"), _table("embeddings")


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_main_text(pages(spark, sf_dir))


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest_neighbours(embeddings(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"), F.array_join("orders", ",").alias("orders"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(documents(spark, sf_dir))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "n_runs", "depth", "text")


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.exact_top_k(embeddings(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place, md5(coalesce(text, '')) AS digest
  FROM documents),
digits AS (SELECT CASE WHEN count(*) <= 256 THEN 1 WHEN count(*) <= 65536 THEN 2 WHEN count(*) <= 16777216 THEN 3 WHEN count(*) <= 4294967296 THEN 4 ELSE 5 END AS d FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM sized GROUP BY source),
fill(round, state, remaining) AS (
  SELECT 0, (SELECT list({'i': i, 's': source_size, 'w': weight, 'capped': false} ORDER BY i) FROM src), (SELECT CAST(sum(source_size) AS BIGINT) FROM src)
  UNION ALL
  SELECT round + 1,
         list_transform(state, lambda x: {'i': x.i, 's': x.s, 'w': x.w, 'capped': x.capped OR remaining * x.w > 3 * x.s * wsum}),
         CAST(remaining - list_sum(list_transform(state, lambda x: CASE WHEN NOT x.capped AND remaining * x.w > 3 * x.s * wsum THEN 3 * x.s ELSE 0 END)) AS BIGINT)
  FROM (SELECT round, state, remaining, CAST(list_sum(list_transform(state, lambda x: CASE WHEN x.capped THEN 0 ELSE x.w END)) AS BIGINT) AS wsum FROM fill)
  WHERE len(list_filter(state, lambda x: NOT x.capped AND remaining * x.w > 3 * x.s * wsum)) > 0),
last_round AS (SELECT max(round) AS r FROM fill),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN f.x.capped THEN CAST(3 * s.source_size AS DOUBLE) ELSE CAST(f.remaining * f.x.w AS DOUBLE) / f.wsum END AS target
  FROM src s JOIN (SELECT unnest(state) AS x, remaining, CAST(list_sum(list_transform(state, lambda x: CASE WHEN x.capped THEN 0 ELSE x.w END)) AS BIGINT) AS wsum
                   FROM fill WHERE round = (SELECT r FROM last_round)) f ON f.x.i = s.i),
drawn AS (
  SELECT d.*, substr(d.place, 1, (SELECT d FROM digits)) AS block, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS total,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE total // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE total % source_size END AS rest,
         dense_rank() OVER (PARTITION BY source ORDER BY block) - 1 AS nth FROM drawn),
dealt AS (
  SELECT source, max(nth) + 1 AS n_blocks, CAST((max(nth) + 1) * (any_value(passes) + CASE WHEN any_value(rest) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM parts GROUP BY source),
node(a, b, i, n, x, take) AS (
  SELECT 0, 16, 1, list(n ORDER BY i), []::BIGINT[], CAST(sum(n) AS BIGINT) * 8 // 16 FROM dealt
  UNION ALL
  SELECT a, b, i, n, x, CASE WHEN i = 1 THEN CAST(list_sum(n) AS BIGINT) * ((a + b) // 2 - a) // greatest(1, b - a) ELSE take END
  FROM (
    SELECT CASE WHEN done AND side = 1 THEN (a + b) // 2 ELSE a END AS a, CASE WHEN done AND side = 0 THEN (a + b) // 2 ELSE b END AS b, CASE WHEN done THEN 1 ELSE i + 1 END AS i,
           CASE WHEN NOT done THEN n WHEN side = 0 THEN x ELSE list_transform(n, lambda v, k: v - x[k]) END AS n,
           CASE WHEN done THEN []::BIGINT[] ELSE list_append(x, draw) END AS x, CASE WHEN done THEN 0 ELSE take - draw END AS take
    FROM (
      SELECT *, CASE WHEN NOT done THEN least(high, low + list_sum(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN list_sum(p[1:k]) <= u * list_sum(p) THEN 1 ELSE 0 END))) END AS draw
      FROM (
        SELECT *, list_transform(logs, lambda v: exp(v - list_max(logs))) AS p
        FROM (
          SELECT *, CASE WHEN NOT done THEN list_transform(range(low, high + 1), lambda k: -lgamma(k + 1) - lgamma(own - k + 1) - lgamma(take - k + 1) - lgamma(others - take + k + 1)) END AS logs
          FROM (
            SELECT *, greatest(0, take - others) AS low, least(own, take) AS high
            FROM (
              SELECT *, i > len(n) AS done, n[i] AS own, CAST(coalesce(list_sum(n[i + 1:]), 0) AS BIGINT) AS others,
                     CAST('0x' || substr(md5('0:' || a || ':' || b || ':' || (i - 1)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
              FROM node WHERE b - a > 1)))))
    CROSS JOIN (VALUES (0), (1)) v(side) WHERE done OR side = 0)),
quotas AS (SELECT a AS shard, unnest(n) AS q, generate_subscripts(n, 1) AS i FROM node WHERE b - a = 1 AND i = 1),
until AS (SELECT d.source, d.n_blocks, list(q.upto ORDER BY q.shard) AS until
          FROM (SELECT i, shard, sum(q) OVER (PARTITION BY i ORDER BY shard) AS upto FROM quotas) q JOIN dealt d ON d.i = q.i GROUP BY 1, 2),
taken AS (
  SELECT p.*, u.until, u.n_blocks, CAST(greatest(0, least(p.size, rest - before)) AS BIGINT) AS part
  FROM parts p JOIN until u ON p.source IS NOT DISTINCT FROM u.source),
copies AS (SELECT *, CASE WHEN size > 0 THEN range(0, CAST(passes AS BIGINT) + CASE WHEN part > 0 THEN 1 ELSE 0 END) ELSE []::BIGINT[] END AS c FROM taken)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken,
       array_to_string(list_transform(c, lambda k: len(list_filter(until, lambda v: v <= n_blocks * k + nth))), ',') AS shards,
       array_to_string(list_transform(c, lambda k: substr(md5('0:order:' || k || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 12)), ',') AS orders
FROM copies
"""

OP8_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
solid AS (
  SELECT doc_id, text, line, pos, row_number() OVER w AS nth, lead(line) OVER w AS following,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
one AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, text, nth) > 1 AS later FROM solid),
two AS (
  SELECT doc_id, text, nth, row_number() OVER (PARTITION BY line, following ORDER BY doc_id NULLS LAST, text, nth) > 1 AS later
  FROM solid WHERE following IS NOT NULL),
gone AS (
  SELECT doc_id, text, nth FROM one WHERE later AND words >= 10
  UNION SELECT doc_id, text, nth FROM two WHERE later
  UNION SELECT doc_id, text, nth + 1 FROM two WHERE later),
inner_blank AS (
  SELECT a.doc_id, a.text, a.pos AS lo, b.pos AS hi
  FROM two t JOIN solid a ON a.doc_id IS NOT DISTINCT FROM t.doc_id AND a.text = t.text AND a.nth = t.nth
  JOIN solid b ON b.doc_id IS NOT DISTINCT FROM t.doc_id AND b.text = t.text AND b.nth = t.nth + 1 WHERE t.later AND b.pos > a.pos + 1),
removed AS (
  SELECT s.doc_id, s.text, s.pos FROM solid s JOIN gone g ON s.doc_id IS NOT DISTINCT FROM g.doc_id AND s.text = g.text AND s.nth = g.nth
  UNION SELECT r.doc_id, r.text, r.pos FROM raw r JOIN inner_blank i ON r.doc_id IS NOT DISTINCT FROM i.doc_id AND r.text = i.text AND r.pos > i.lo AND r.pos < i.hi),
marks AS (
  SELECT doc_id, text, nth, max(len) AS len
  FROM (SELECT doc_id, text, nth, 1 AS len FROM one WHERE later AND words >= 10 UNION ALL SELECT doc_id, text, nth, 2 FROM two WHERE later) GROUP BY 1, 2, 3),
runs AS (
  SELECT doc_id, text, count(*) FILTER (nth >= coalesce(reach, 0)) AS n_runs
  FROM (SELECT *, max(nth + len) OVER (PARTITION BY doc_id, text ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM marks) GROUP BY 1, 2),
seqs AS (SELECT doc_id, text, list(line ORDER BY nth) AS ls, list(words ORDER BY nth) AS ws FROM solid GROUP BY 1, 2),
windows AS (
  SELECT doc_id, text, h, unnest(generate_series(1, len(ls) - h + 1)) AS nth, unnest(list_transform(generate_series(1, len(ls) - h + 1), lambda i: md5(CAST(ls[i : i + h - 1] AS VARCHAR)))) AS c, ws
  FROM seqs, (SELECT CAST(2 ** k AS BIGINT) AS h FROM range(24) t(k)) WHERE len(ls) >= h),
depths AS (
  SELECT doc_id, text, max(h) AS depth
  FROM (SELECT *, row_number() OVER (PARTITION BY h, c ORDER BY doc_id NULLS LAST, text, nth) > 1 AS later FROM windows) WHERE later AND (h > 1 OR ws[nth] >= 10) GROUP BY 1, 2),
clean AS (
  SELECT r.doc_id, r.text AS old, count(*) AS n_lines, count(*) FILTER (x.pos IS NOT NULL) AS n_removed,
         coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (x.pos IS NULL), '') AS text
  FROM raw r LEFT JOIN removed x ON x.doc_id IS NOT DISTINCT FROM r.doc_id AND x.text = r.text AND x.pos = r.pos GROUP BY 1, 2)
SELECT d.doc_id, CAST(c.n_lines AS BIGINT) AS n_lines, CAST(c.n_removed AS BIGINT) AS n_removed, CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(p.depth, 0) AS BIGINT) AS depth, c.text
FROM documents d JOIN clean c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.old = coalesce(d.text, '')
LEFT JOIN runs r ON r.doc_id IS NOT DISTINCT FROM d.doc_id AND r.text = c.old LEFT JOIN depths p ON p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.text = c.old
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_wrapper, op2_kmeans_tree, op3_pii, op4_secrets, op5_harmonic_packing, op6_source_mixing, op7_language_id, op8_line_runs, op9_simhash_bktree, op10_maxscore)}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": OP6_SQL, "op8_line_runs": OP8_SQL, "op10_maxscore": OP10_SQL}

