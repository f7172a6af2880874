"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import additive_quantisation, alignment, bit_sliced, bk_trees, html_extraction, importance, license_scan, lm_score, mixing, near_dedup, packing, toxicity, warc
from loomgraph.llm.common import new_path, read

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    drawn = mixing.draws(read(spark, sf_dir, "documents"))
    taken = F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)").alias("taken")
    return drawn.select("doc_id", "size", "source_size", "target", taken, F.expr("array_sort(transform(draws, d -> d.shard))").alias("shards"))


def tokenizer() -> str:
    """The vocabulary file that op3 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    pieces = packing.pieces(read(spark, sf_dir, "documents"), tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, ["doc_id", "piece"])


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the archives written for all pages."""
    path = new_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op5_warc"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_dedup.groups(read(spark, sf_dir, "documents"))


ORACLE_SQL["op9_minhash_near_dedup"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN least ON least.a = d.doc_id
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "clauses")


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return bit_sliced.top_k(read(spark, sf_dir, "embeddings"))


ORACLE_SQL["op6_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, x -> x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    return additive_quantisation.neighbours(read(spark, sf_dir, "embeddings"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of every document."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document, by counts over all of them."""
    scores = lm_score.score(read(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL["op7_lm_scoring"] = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
u AS (SELECT w, count(*) AS n FROM w GROUP BY 1), b AS (SELECT v, w, count(*) AS n FROM w WHERE v IS NOT NULL GROUP BY 1, 2), z AS (SELECT count(*) AS n FROM w),
s AS (SELECT w.doc_id, CASE WHEN w.v IS NULL THEN ln(u.n) - ln(z.n) WHEN b.n >= 2 THEN ln(b.n) - ln(c.n) ELSE ln(0.4 * u.n) - ln(z.n) END AS s
  FROM w JOIN u ON u.w = w.w LEFT JOIN b ON b.v = w.v AND b.w = w.w LEFT JOIN u c ON c.w = w.v CROSS JOIN z),
d AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM s GROUP BY 1)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(s, 6) AS log_score, round(s / n, 6) AS mean_log_score FROM t LEFT JOIN d ON d.doc_id = t.doc_id
"""


def piece_model() -> str:
    """The sentencepiece model that op11 aligns with op3's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of both tokenizers' tokens over every document."""
    return alignment.align(read(spark, sf_dir, "documents"), tokenizer(), piece_model())


@query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return bk_trees.groups(read(spark, sf_dir, "documents"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place in the draw of every document, towards the benchmark texts."""
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL["op13_importance_resampling"] = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (SELECT i, c FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
run(w, h, i, c) AS (
  SELECT w, h, 0, 4294967295 FROM h
  UNION ALL SELECT w, h, run.i + 1, xor(crc.c, run.c >> 8)
  FROM run JOIN crc ON crc.i = xor(run.c & 255, CAST('0x' || substr(h, 2 * run.i + 1, 2) AS BIGINT)) WHERE 2 * run.i < length(h)
), bucket AS (SELECT w, xor(c, 4294967295) % 10000 AS k FROM run WHERE 2 * i = length(h)),
s AS (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM dw JOIN bucket USING (w) GROUP BY 1), t AS (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM bw JOIN bucket USING (w) GROUP BY 1),
z AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s, coalesce((SELECT sum(n) FROM t), 0) AS t),
gain AS (
  SELECT range AS k, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(z.s + 10000 AS DOUBLE) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(z.t + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM range(10000) LEFT JOIN s ON s.k = range LEFT JOIN t ON t.k = range CROSS JOIN z
), own AS (SELECT r, CAST(sum(n * g) AS BIGINT) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY 1),
scored AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN own USING (r)
), placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""
