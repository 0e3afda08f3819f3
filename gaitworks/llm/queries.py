"""Registered queries of the operators over the driver tables, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.llm import alignment, cuckoo, licences, mixing, neardup, packing, pii, quality, runs, secrets, substrings, token_files, topk
from gaitworks.llm.common import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def episodes(docs: DataFrame) -> DataFrame:
    """documents as episodes: the text is the instruction, the source the dataset."""
    return docs.select(F.col("doc_id").alias("episode_index"), F.col("text").alias("instruction"), F.col("source").alias("source_dataset"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark.read.parquet(f"{d}/documents.parquet"))


def good_labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("episode_index"), F.col("quality").alias("good"))


@query("op1_threshold_topk", """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.e, b.e)::BIGINT AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""")
def op1_threshold_topk(spark: SparkSession, d: str) -> DataFrame:
    frames = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("index"), F.col("embedding").alias("states"))
    found = topk.top_k(frames, frames.where(F.pmod("index", F.lit(100)) == 0), 10)
    return found.select(F.col("query_index").alias("query_id"), "rank", F.col("index").alias("vec_id"), "score")


@query("op2_bootstrapped_pii")
def op2_bootstrapped_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(documents(spark, d)).select(
        F.col("episode_index").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op3_curve_packing")
def op3_curve_packing(spark: SparkSession, d: str) -> DataFrame:
    return packed(documents(spark, d))


def packed(rows: DataFrame) -> DataFrame:
    return packing.pack_along_curve(rows, vocabulary()).select(
        F.col("episode_index").alias("doc_id"), "start", "length", F.crc32("input_ids").alias("ids_crc32"),
        F.col("episode_tokens").alias("doc_tokens"), F.col("sequence_index").alias("sequence_id"), "offset")


@query("op4_minhash_inverted_join", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.d = doc_id
""")
def op4_minhash_inverted_join(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, d)).select(
        F.col("episode_index").alias("doc_id"), "n_shingles", F.col("component_index").alias("component_id"), "kept")


@query("op5_rare_token_licences")
def op5_rare_token_licences(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan_licences(documents(spark, d)).withColumnRenamed("episode_index", "doc_id")


@query("op6_cuckoo_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""")
def op6_cuckoo_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return cuckoo.exact_duplicates(documents(spark, d)).withColumnsRenamed({"episode_index": "doc_id", "keep_index": "keep_id"})


@query("op7_paragraph_banding")
def op7_paragraph_banding(spark: SparkSession, d: str) -> DataFrame:
    return substrings.repeated_passages(documents(spark, d)).withColumnsRenamed({"episode_index": "doc_id", "component_index": "component_id"})


@query("op8_bitplane_token_files")
def op8_bitplane_token_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(documents(spark, d), path, vocabulary())
    return token_files.read_token_files(spark, path).select(
        F.col("episode_index").alias("doc_id"), "start", "n_tokens", F.crc32("input_ids").alias("ids_crc32"))


@query("op9_subword_quality")
def op9_subword_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d)
    return quality.score_quality(rows, quality.fit(rows, good_labels(spark, d))).select(
        F.col("episode_index").alias("doc_id"), "held_out", "score", "predicted")


@query("op10_block_mixing")
def op10_block_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, d)).select(F.col("episode_index").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op11_owned_secrets", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS lab, concat_ws('/', source, lang) AS repo FROM documents),
p AS (FROM (VALUES (0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]{12,}'), (2, '[0-9a-f]{32,}'), (3, '[A-Za-z0-9+/_=-]{16,}')) v(kind, pat)),
s AS (SELECT r, lab, repo, kind, pat, regexp_extract_all(t, pat) AS m, string_split_regex(t, pat) AS g FROM d, p WHERE regexp_matches(t, pat)),
u AS (SELECT r, lab, repo, kind, pat, unnest(m) AS match, unnest(g[:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM s),
e AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
f AS (SELECT r, lab, repo, kind, (e - length(match))::BIGINT AS s, e::BIGINT AS e, CASE WHEN kind = 0 THEN regexp_extract(match, pat, 1) ELSE match END AS v FROM e),
h AS (SELECT * FROM f WHERE kind > 0 OR length(v) >= 8),
n AS (SELECT *, max(CASE WHEN kind < 3 THEN e END) OVER (PARTITION BY r ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach,
  min(CASE WHEN kind < 3 THEN s END) OVER (PARTITION BY r ORDER BY s RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM h),
c AS (SELECT * FROM n WHERE kind < 3 OR (coalesce(reach <= s, true) AND coalesce(nxt >= e, true) AND regexp_matches(v, '[0-9]'))),
k AS (SELECT v, count(DISTINCT lab) AS owners, bool_or(kind < 3) AS named FROM c GROUP BY 1),
b AS (SELECT v, owners, named, owners <= 1 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND NOT regexp_matches(v, '(?i)example|sample|dummy|placeholder|changeme|your|xxxx|test|fake|123456|abcdef')
  AND round(-list_sum([((length(v) - length(replace(v, x, ''))) / length(v)::DOUBLE) * log2((length(v) - length(replace(v, x, ''))) / length(v)::DOUBLE) for x in list_distinct(string_split(v, ''))]), 6) >= 3 AS live FROM k),
o AS (SELECT r, kind, s, e, concat(['assign', 'access', 'hex', 'value'][kind + 1], ':', s, ':', e) AS span, owners, live FROM c JOIN b USING (v) WHERE kind < 3 OR live OR (owners <= 1 AND named)),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg(span, ',' ORDER BY s, kind) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= 3) AS n_copied FROM o GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (r)
""")
def op11_owned_secrets(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = docs.select(F.col("doc_id").alias("episode_index"), F.col("text").alias("instruction"), F.concat_ws("/", "source", "lang").alias("source_dataset"), F.col("source").alias("lab"))
    return secrets.find_secrets(held).select(
        F.col("episode_index").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_copied")


@query("op12_lockstep_alignment")
def op12_lockstep_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align_tokens(documents(spark, d), vocabulary(), vocabulary("piece_bpe_32k.model")).withColumnRenamed("episode_index", "doc_id")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.periodic_runs(looped(documents(spark, d))).drop("n_words").withColumnRenamed("episode_index", "doc_id")


def looped(rows: DataFrame) -> DataFrame:
    """Every tenth instruction, by the hash of its number, goes round in a loop from one of its words on."""
    h = F.crc32(F.col("episode_index").cast("string").cast("binary"))
    t = rows.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("instruction", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))))
    n = F.size("w").cast("long")
    t = t.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, left = F.col("a").cast("int"), F.col("p").cast("int"), (n - F.col("a")).cast("int")
    loop = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), a), loop), " ")).otherwise(F.col("instruction"))
    return t.select("episode_index", text.alias("instruction"))


@query("pipeline")
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, d)
