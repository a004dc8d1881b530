"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import secrets
from weftgraph.llm.bpe import round_trip
from weftgraph.llm.licenses import scan as scan_licenses
from weftgraph.llm.mixing import mixture
from weftgraph.llm.neardup import near_duplicates
from weftgraph.llm.neighbours import nearest
from weftgraph.llm.retrieval import search
from weftgraph.llm.sharding import shard
from weftgraph.llm.shared import table
from weftgraph.llm.toxicity import toxicity
from weftgraph.llm.urls import filter_urls

#: Shards of op6, and the rules of op10: host, path, verdict.
SHARDS = 8
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def vocabulary() -> str:
    """The place of the tokenizer's file, the same on the driver and all executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), SHARDS)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bm25_top_k": op2_bm25_top_k,
    "op3_source_mixing": op3_source_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_jump_sharding": op6_jump_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_vantage_point_neighbours": op8_vantage_point_neighbours,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
}

#: One word in DuckDB: lower-casing of A-Z only, runs of anything but the space and U+0009 to U+000D.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _jump_sql(shards: int) -> str:
    """Jump hashing of the column key, a step a table; CRC-32 byte by byte with a table made from its polynomial."""
    step = "SELECT * REPLACE (if(j < {n}, (k * 2862933555777941757 + 1) % 18446744073709551616, k) AS k, if(j < {n}, j, b) AS b, if(j < {n}, floor((j + 1) * (2147483648.0::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT, j) AS j) FROM {last}"
    out = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: if(c % 2 = 1, xor(c >> 1, 3988292384), c >> 1))) AS t),
docs AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INTEGER])), 4294967295) AS text_crc32,
    ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::HUGEINT * 4294967296 + ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[9:16])::HUGEINT AS key
  FROM documents, crc)"""
    for name, n in (("s", shards), ("g", shards + 1)):
        out += f", {name}0 AS (SELECT DISTINCT doc_id, key AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM docs)"
        for i in range(n):
            out += f", {name}{i + 1} AS ({step.format(n=n, last=f'{name}{i}')})"
    return (
        out
        + f"""
SELECT doc_id, size, text_crc32, 'key' AS law, s.b::INTEGER AS shard,
  row_number() OVER (PARTITION BY s.b ORDER BY ('0x' || md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, text_crc32))[1:15])::BIGINT % (((SELECT count(*) FROM documents) + 49999) // 50000), doc_id, size, text_crc32) - 1 AS slot,
  g.b::INTEGER AS grown_shard
FROM docs JOIN s{shards} s USING (doc_id) JOIN g{shards + 1} g USING (doc_id)"""
    )


ORACLE_SQL: dict[str, str] = {
    "op6_jump_sharding": _jump_sql(SHARDS),
    "op2_bm25_top_k": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, sum(len(w)) / count(*)::DOUBLE AS average FROM docs),
tf AS (SELECT r, doc_id, len(w) AS length, t, count(*) AS tf FROM docs, unnest(w) AS x(t) GROUP BY ALL),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
scores AS (
  SELECT q.doc_id AS query_id, d.r, d.doc_id,
    sum(round(1000000 * ln(1 + (n - df + 0.5) / (df + 0.5)) * (d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.length / average)))))::BIGINT AS units
  FROM tf q JOIN tf d ON q.t = d.t AND q.doc_id % 100 = 0 JOIN df ON df.t = q.t, stats GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id))::INTEGER AS rank, doc_id, units / 1000000.0::DOUBLE AS score
FROM scores WHERE units > 0 QUALIFY rank <= 10
""",
    "op3_source_mixing": rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, len({_WORDS}) AS tokens, md5(coalesce(text, '')) AS digest FROM documents),
sources AS (SELECT key, sum(tokens)::BIGINT AS mass, count(*) AS n FROM docs GROUP BY key),
total AS (SELECT sum(mass)::BIGINT AS t, count(*) FILTER (mass > 0) AS n FROM sources),
logs AS (SELECT key, ln(mass / t::DOUBLE) AS lp FROM sources, total WHERE mass > 0),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d
  UNION ALL
  SELECT i + 1, if(h >= 0.95 * ln(n), x, a), if(h >= 0.95 * ln(n), b, x), if(r <= 4.0, c, y), if(r <= 4.0, y, d)
  FROM (
    SELECT i, a, b, c, d, x, y, n,
      (SELECT ln(sum(exp(x * lp))) - x * sum(exp(x * lp) * lp) / sum(exp(x * lp)) FROM logs) AS h,
      (SELECT max(exp((y - 1) * lp)) / sum(exp(y * lp)) FROM logs) AS r
    FROM (SELECT *, (a + b) / 2 AS x, (c + d) / 2 AS y FROM bisect WHERE i < 32), total)),
power AS (SELECT if(n < 2, 1.0, round(greatest(a, d), 9)) AS e FROM bisect, total WHERE i = 32),
raised AS (SELECT key, exp(e * lp) AS p FROM logs, power),
plan AS (
  SELECT s.key, s.mass, s.n, coalesce(p / (SELECT sum(p) FROM raised), 0.0) AS w,
    floor(round(t::DOUBLE * coalesce(p / (SELECT sum(p) FROM raised), 0.0), 3))::BIGINT AS quota, ((s.n + 511) // 512)::BIGINT AS blocks
  FROM sources s LEFT JOIN raised USING (key), total),
placed AS (
  SELECT doc_id, source, key, tokens, digest, w, mass, quota, ('0x' || md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || digest)[1:15])::BIGINT AS o, blocks
  FROM docs JOIN plan USING (key)),
turned AS (
  SELECT *, o % blocks AS block, ('0x' || md5('0:' || key || ':' || (o % blocks))[1:15])::BIGINT AS turn FROM placed),
summed AS (
  SELECT *, (sum(tokens) OVER (PARTITION BY key ORDER BY turn, block, o, doc_id, digest ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS place FROM turned)
SELECT doc_id, source, tokens::BIGINT AS tokens, round(w, 9) AS weight,
  if(w > 0, quota // mass + if(place + tokens <= quota - (quota // mass) * mass, 1, 0), 0)::BIGINT AS copies, block, place
FROM summed
""",
    "op7_minhash_near_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
""",
    "op8_vantage_point_neighbours": """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM vectors q JOIN vectors v ON q.vec_id % 100 = 0 AND v.r <> q.r AND len(q.e) = len(v.e))
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
""",
    "op10_url_filter": r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY p.r ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) = 1
""",
}
