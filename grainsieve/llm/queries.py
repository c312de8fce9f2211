"""The operators of this folder as registered queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, clusters, extract, mixing, ngram_join, packing, pii, secrets, suffix_dedup, toxicity, vector_codes,
               vector_dedup, vectors)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op7_pack_sequences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query("op5_pii_anchors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


@query("op8_html_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


TOP_K_SQL = """
WITH valid AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY qr ORDER BY score DESC, vec_id, r)
QUALIFY row_number() OVER w <= 5
"""


@query("op3_exact_top_k", TOP_K_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


NEAR_VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND list_sum([abs(x::DOUBLE) FOR x IN embedding]) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS low FROM embeddings UNION SELECT links.y, reach.low FROM reach JOIN links USING (x)
), component AS (SELECT x AS vec_id, min(low) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
"""


@query("op10_vector_near_duplicates", NEAR_VECTORS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS low FROM documents UNION SELECT links.y, reach.low FROM reach JOIN links USING (x)
), component AS (SELECT x AS doc_id, min(low) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(k, 0) AS n_links, component_id
FROM component LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM links GROUP BY x) USING (doc_id)
"""


@query("op1_ngram_jaccard_join", JACCARD_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), ngram_join.Rule(4, 85))


REPEATS_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), windows AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s + 1, s + 50), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM words WHERE len(w) >= 50)
), seen AS (
  SELECT doc_id, s, first_value(doc_id) OVER o AS source_id, row_number() OVER o AS nth
  FROM windows WINDOW o AS (PARTITION BY h ORDER BY doc_id, s)
), marked AS (
  SELECT doc_id, s, source_id,
    CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 1 ELSE 0 END AS begins
  FROM seen WHERE nth > 1
), islands AS (
  SELECT doc_id, s, source_id, sum(begins) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked
), spans AS (
  SELECT doc_id, island, min(s) AS start_word, max(s) + 50 - min(s) AS n_words FROM islands GROUP BY doc_id, island
)
SELECT DISTINCT doc_id, CAST(start_word AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words, source_id
FROM spans JOIN islands USING (doc_id, island)
"""


@query("op6_repeated_passages", REPEATS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents"), suffix_dedup.Passage(50))
    return found.select("doc_id", "start_word", "n_words", F.explode("source_ids").alias("source_id"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIXING_SQL = r"""
WITH words AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h FROM documents
), sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM words GROUP BY source),
weighed AS (
  SELECT source, n, 3 * n AS most, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources
), levels AS (
  SELECT *, CAST((SELECT sum(n) FROM sources) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / w, source)
), level AS (SELECT level FROM levels WHERE level * w <= most ORDER BY most / w, source LIMIT 1),
targets AS (SELECT source, n, least(CAST(most AS DOUBLE), (SELECT level FROM level) * w) AS target FROM weighed),
wanted AS (
  SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS times,
    greatest(target - CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END * n, 0) AS rest FROM targets
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM words
)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(size * (times
  + CASE WHEN before + size <= rest OR (before <= rest AND 2 * (rest - before) >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed JOIN wanted ON placed.source IS NOT DISTINCT FROM wanted.source
"""


@query("op11_source_mixing", MIXING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def _lloyd_sql(books: str, rounds: int, entries: int) -> str:
    """Rounds over `cells` (r, p, x) from the codebook `books` (p, e, c): a{i} is the assignment by b{i}."""
    out = [f"b0 AS MATERIALIZED ({books})"]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * {entries} + e) AS m
  FROM cells JOIN b{i} USING (p) GROUP BY r, p)""")
        if i < rounds:
            out.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(any_value(n.c), any_value(b{i}.c)) AS c FROM b{i} LEFT JOIN (
    SELECT p, e, list(c ORDER BY j) AS c FROM (
      SELECT p, m % {entries} AS e, j, floor(sum(x[j]) / count(*)) AS c
      FROM a{i} JOIN cells USING (r, p) CROSS JOIN (SELECT unnest(range(1, 65)) AS j) WHERE j <= len(x) GROUP BY ALL)
    GROUP BY p, e) n USING (p, e) GROUP BY p, e)""")
    return ",\n".join(out)


CODES_SQL = f"""
WITH valid AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), cells AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM valid CROSS JOIN (SELECT unnest(range(4)) AS p)
), {_lloyd_sql("SELECT p, r - 1 AS e, x AS c FROM cells WHERE r <= 256", 4, 256)},
coded AS (
  SELECT vec_id, label, string_agg(lower(right('0' || hex(m % 256), 2)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error
  FROM a4 JOIN valid USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN c], ','), ',' ORDER BY p, e)) FROM b4) AS codebooks_sha256
FROM coded
"""


@query("op12_vector_codes", CODES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


CLUSTERS_SQL = f"""
WITH cells AS MATERIALIZED (
  SELECT vec_id, 0 AS p, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x,
    row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) AS r FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), {_lloyd_sql("SELECT p, r - 1 AS e, x AS c FROM cells WHERE r <= 40", 5, 40)}
SELECT vec_id, CAST(m % 40 AS INTEGER) AS cluster, m // 40 AS distance, CAST(sum(m // 40) OVER (PARTITION BY m % 40) AS BIGINT) AS cluster_inertia,
  CAST(sum(m // 40) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c], ',')) AS centroid_sha256
FROM a5 JOIN cells USING (r) JOIN b5 ON b5.e = m % 40
"""


@query("op13_centroid_clusters", CLUSTERS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.digests(table(spark, sf_dir, "embeddings"))
