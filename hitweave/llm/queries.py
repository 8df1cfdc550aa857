"""The registered queries of this subpackage, one per operator, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm import ann, bpe, licenses, packing, quality, secrets, sharding, simhash, topk, urls
from hitweave.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = bpe.encode(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), decode_too=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.resample(docs, model).select("doc_id", "log_weight", "gumbel_key")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"))
    kind = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return out.select(
        "doc_id",
        kind(0).alias("n_assign"),
        kind(1).alias("n_access"),
        kind(2).alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_topk, op2_bpe, op3_simhash, op4_quality, op5_secrets, op6_packing, op7_licenses, op8_urls, op9_sharding, op10_ann)
    return {f.__name__: f for f in found}


OP1_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT h.page_id, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS n
      FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)),
p AS (SELECT page_id, host, path, regexp_matches(lower(host || path), '{bad}') AS bad FROM h)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, CASE WHEN p.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""

_PLACES = """SELECT doc_id, {kind} AS kind, w AS whole, v AS value, list_sum(g[1:i]) + coalesce(list_sum(l[1:i - 1]), 0) AS start FROM (
  SELECT doc_id, unnest(whole) AS w, unnest(val) AS v, unnest(range(1, len(whole) + 1)) AS i,
         list_transform(gaps, lambda x: length(x)) AS g, list_transform(whole, lambda x: length(x)) AS l
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {group}) AS val,
               string_split_regex(text, '{p}') AS gaps FROM t))"""


def _places(kind: int, pattern: str, group: int) -> str:
    return _PLACES.format(kind=kind, p=pattern.replace("'", "''"), group=group)


OP5_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({_places(0, secrets.ASSIGN, 2)}) WHERE length(value) >= 6
  UNION ALL {_places(1, secrets.ACCESS, 0)} UNION ALL {_places(2, secrets.HEX, 0)}),
wide AS (SELECT w.* FROM ({_places(3, secrets.WIDE, 0)}) w
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) > {secrets.MIN_DISTINCT}
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.start + length(w.whole) AND w.start < b.start + length(b.whole))),
every AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
who AS (SELECT doc_id, coalesce('x' || source, '') AS owner, coalesce('x' || source, '') || chr(31) || coalesce('x' || lang, '') AS repo FROM documents),
total AS (SELECT count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM who),
spread AS (SELECT value, count(DISTINCT owner) <= greatest(1, {secrets.OWNERS_SHARE} * (SELECT owners FROM total))
                  AND count(DISTINCT repo) <= greatest(2, {secrets.REPOS_SHARE} * (SELECT repos FROM total)) AS live
           FROM every JOIN who USING (doc_id) GROUP BY value),
judged AS (SELECT e.*, start + length(whole) AS stop, live,
                  (['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || start || ':' || (start + length(whole)) AS one
           FROM every e JOIN spread USING (value)),
found AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
                 string_agg(one, ',' ORDER BY start, kind) FILTER (kind < 3) AS b,
                 string_agg(one, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS s,
                 count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM judged GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(s, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    blocking = "|".join(f"(?:{r.pattern})" for r in urls.default_rules() if r.name is None)
    return {"op1_topk": OP1_SQL, "op5_secrets": OP5_SQL, "op8_urls": OP8_SQL.replace("{bad}", blocking.replace("'", "''"))}
