"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.additive_search import nearest
from buildlens.llm.exact_dedup import exact_groups
from buildlens.llm.language_id import languages
from buildlens.llm.minhash_dedup import near_duplicates
from buildlens.llm.mixing import mixed
from buildlens.llm.packing import pack_documents
from buildlens.llm.secret_scan import _NAMES, MIN_BITS, MOST_OWNERS, MOST_REPOSITORIES, scan_secrets
from buildlens.llm.substring_dedup import drop_repeated_substrings
from buildlens.llm.toxicity import toxicity
from buildlens.llm.url_filters import judge_urls

#: The contract's rules of op2: host, path prefix, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_substrings(_table(spark, sf_dir, "documents"), window=50, texts=False).drop("kept_text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 6).alias("first_position"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)


def op8_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=20, top=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"), spans=False)


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_url_filters, op3_substring_dedup, op4_secret_scan, op5_source_mixing, op6_exact_dedup, op7_packing, op8_additive_search, op9_toxicity, op10_language_id)}

ORACLE_SQL = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)
), ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, b FROM reach JOIN ways ON node = a
), least AS (
  SELECT root, min(node) AS component_id FROM reach GROUP BY root
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON root = d.doc_id
""",
    "op3_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM w WHERE len(w) >= 50
), hits AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE doc_id > least
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w
), marked AS (
  SELECT words.doc_id, words.pos, word, count(hits.pos) OVER (PARTITION BY words.doc_id ORDER BY words.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN hits ON words.doc_id = hits.doc_id AND words.pos = hits.pos
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op2_url_filters": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
""",
    "op5_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS k FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, k + 1 AS weight, [-0.5, 0.0, 0.5][k + 1]::DOUBLE AS tilt, source_size * 3 AS lim FROM per
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(lim) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed
), targets AS (
  SELECT source, source_size, tilt, least(lim::DOUBLE, (max(level) OVER ()) * weight) AS target FROM levels
), rows AS (
  SELECT doc_id, size, source_size, target, tilt, floor(target + 0.5)::BIGINT AS wanted,
    coalesce((sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), took AS (
  SELECT *, CASE WHEN source_size > 0 THEN (wanted // source_size) * size + greatest(0, least(size, wanted - (wanted // source_size) * source_size - start)) ELSE 0 END AS taken FROM rows
), placed AS (
  SELECT *, (start + least(taken, size) / 2::DOUBLE) / wanted AS u FROM took
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(2 * u / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)), 6) END AS first_position FROM placed
""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""",
}

_KINDS = [
    rf"({_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "AKIA[A-Z0-9]+",
    "[0-9a-f]{32,}",
    "[A-Za-z0-9+/_=-]{20,}",
]
_MATCHES = " UNION ALL ".join(f"SELECT rid, {i} AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {2 if i == 0 else 0}) AS vs, regexp_split_to_array(t, '{p}') AS ps FROM d" for i, p in enumerate(_KINDS))
ORACLE_SQL["op4_secret_scan"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS owner, coalesce(CAST(doc_id AS VARCHAR), chr(1)) AS repository, coalesce(text, '') AS t FROM documents
), f AS (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({_MATCHES}) WHERE len(ms) > 0
), s AS (
  SELECT rid, kind, vs[i] AS v, length(ms[i]) AS n, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM f
), base AS MATERIALIZED (
  SELECT rid, kind, v, a, a + n AS b FROM s WHERE (kind = 0 AND length(v) >= 8) OR (kind = 1 AND n >= 16) OR kind = 2
), further AS (
  SELECT rid, kind, v, a, a + n AS b FROM s WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND list_aggregate(string_split(v, ''), 'entropy') >= {MIN_BITS}
), every AS (
  SELECT * FROM base UNION ALL SELECT * FROM further m WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = m.rid AND x.a < m.b AND m.a < x.b)
), owned AS (
  SELECT v, count(DISTINCT owner) <= {MOST_OWNERS} AND count(DISTINCT owner || chr(2) || repository) <= {MOST_REPOSITORIES} AS live FROM every JOIN d USING (rid) GROUP BY v
), judged AS (
  SELECT rid, kind, a, live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS x FROM every JOIN owned USING (v)
), g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(x, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
    string_agg(x, ',' ORDER BY a, kind) FILTER (kind < 3 OR live) AS spans, count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_example FROM judged GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""
