"""Registered queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm import graph_search, html_extract, licenses, merkle, mixture, near_dup, packing, pii, quality, secrets, topk, warc, whitening
from snapfold.llm.common import table


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality.train(docs, labels)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_search.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors.where("vec_id % 50 = 0"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write_bundles(table(spark, sf_dir, "pages"), folder)
    return warc.read_bundles(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, F.lit(False))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered, F.translate("text", ascii_uppercase, ascii_lowercase))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_source_mixture, op3_quality, op4_personal_data, op5_licenses, op6_nearest, op7_near_duplicates, op8_top_products, op9_packing, op10_secrets, op11_warc, op12_whitening, op13_merkle)
}

ORACLE_SQL: dict[str, str] = {
    "op7_near_duplicates": r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id
""",
    # base32 of a digest: of each 20 bits (5 hex digits) four letters.
    "op11_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
d AS (SELECT *, sha1(payload) AS h FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
""",
    # crc32 by its table, which the SQL makes from the polynomial; trees level by level; folds along the levels.
    "op13_merkle": r"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
docs AS (SELECT doc_id, lang, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0 AS forged, text,
  concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM documents, crc),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN forged THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM docs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM hashed),
low AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 8, n),
subroots AS (SELECT tree, tree - 1 AS i, h, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 1000 AS level, i, n, h FROM subroots
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 8, n),
runs AS (SELECT tree, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM low WHERE n > 1 GROUP BY ALL UNION ALL SELECT 0, level, i // 8, list(h ORDER BY i) FROM high WHERE n > 1 GROUP BY ALL),
walk AS (SELECT doc_id, tree, leaf, tree AS at, 0 AS level, i, n, coalesce(other, leaf) AS h, '' AS beside FROM leaves
  UNION ALL SELECT w.doc_id, w.tree, w.leaf, CASE WHEN w.n > 1 THEN w.at ELSE 0 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 1000 END, CASE WHEN w.n > 1 THEN w.i // 8 ELSE s.i END, CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE s.n END,
      CASE WHEN w.n > 1 THEN sha256(array_to_string(r.hs[:w.i % 8] || [w.h] || r.hs[w.i % 8 + 2:], '')) ELSE w.h END, CASE WHEN w.n > 1 THEN w.beside || array_to_string(r.hs[:w.i % 8] || r.hs[w.i % 8 + 2:], '') ELSE w.beside END
    FROM walk w LEFT JOIN runs r ON w.n > 1 AND r.tree = w.at AND r.level = w.level AND r.run = w.i // 8 LEFT JOIN subroots s ON w.n = 1 AND s.tree = w.tree WHERE w.n > 1 OR w.at > 0)
SELECT w.doc_id, w.leaf, s.h AS subroot, t.h AS root, sha256(w.beside) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM walk w JOIN subroots s USING (tree), (SELECT h FROM high WHERE n = 1) t WHERE w.at = 0 AND w.n = 1
""",
    "op8_top_products": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
