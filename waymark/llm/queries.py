"""The registered queries of this subpackage, over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, hard_negatives, language_id, line_dedup, media, mixing, near_dedup, packing, substring_dedup, token_counts, warc, whitening
from .common import read_table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('20:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
e AS (SELECT *, ('0x' || substr(h, 1, 3))::BIGINT AS b1, ('0x' || substr(h, 4, 3))::BIGINT AS b2 FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k,
             sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 3 * source_size AS before,
             sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
             sum(source_size) OVER () AS total FROM r),
l AS (SELECT (total - before)::BIGINT AS free, w_left::BIGINT AS w_free, k FROM o WHERE weight * (total - before) <= 3 * source_size * w_left ORDER BY k LIMIT 1),
t AS (SELECT o.source AS src, source_size, CASE WHEN o.k < l.k THEN 3.0::DOUBLE * source_size ELSE weight::DOUBLE * l.free::DOUBLE / l.w_free::DOUBLE END AS target FROM o, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM g),
a AS (SELECT source, b1, sum(size) AS words FROM e GROUP BY source, b1),
b AS (SELECT source, b1, words, sum(words) OVER (PARTITION BY source ORDER BY b1) AS upto FROM a),
c AS (SELECT src, b1 AS cut1, upto - words AS before FROM b JOIN q ON source IS NOT DISTINCT FROM src WHERE upto > rest AND upto - words <= rest),
f AS (SELECT src, before, b2, sum(size) AS words FROM e JOIN c ON source IS NOT DISTINCT FROM src AND b1 = cut1 GROUP BY src, before, b2),
h AS (SELECT src, b2, words, before + sum(words) OVER (PARTITION BY src ORDER BY b2) AS upto FROM f),
i AS (SELECT h.src, b2 + CASE WHEN rest * 2 > upto * 2 - words THEN 1 ELSE 0 END AS cut2 FROM h JOIN q ON h.src IS NOT DISTINCT FROM q.src WHERE upto > rest AND upto - words <= rest),
p AS (SELECT q.src, source_size, target, whole, cut1, cut2 FROM q LEFT JOIN c ON q.src IS NOT DISTINCT FROM c.src LEFT JOIN i ON q.src IS NOT DISTINCT FROM i.src)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN b1 < cut1 OR (b1 = cut1 AND b2 < cut2) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e JOIN p ON source IS NOT DISTINCT FROM src
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.classes(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.passages(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start", "end", F.col("first_id").alias("first_doc_id"), "first_start", "first_end", "similarity")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    out = warc.read_records(warc.archive(pages))
    number = lambda c: F.col(c).cast(pages.schema["page_id"].dataType)
    return out.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


def op7_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


OP7_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(ls) - 2)) AS i, ls FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM p),
v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS occ FROM w WHERE regexp_matches(a || b || c, '\S')),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM v, (VALUES (0), (1), (2)) t(k) WHERE occ > 1),
x AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, ls FROM l WHERE text IS NOT NULL),
y AS (SELECT x.doc_id, x.i, x.ls[x.i] AS line, g.i IS NOT NULL AS gone FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i),
z AS (SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM y GROUP BY doc_id)
SELECT d.doc_id, z.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id
"""


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.measured(media.stored(read_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.assignments(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs)).withColumnRenamed("id", "doc_id")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, len(p) AS m, array_to_string(p, ' ') AS key FROM (
  SELECT item_id, ws[k:k + least(10, len(ws)) - 1] AS p FROM (SELECT *, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS k FROM b WHERE len(ws) > 0))),
l AS (SELECT DISTINCT m FROM i),
w AS (SELECT r, k, m, array_to_string(ws[k:k + m - 1], ' ') AS key FROM (SELECT *, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM d, l WHERE len(ws) >= m)),
o AS (SELECT r, k, m, item_id FROM w JOIN i USING (m, key)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS p FROM (SELECT DISTINCT r, k, m FROM o)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").where(hard_negatives.takes_part("label", "embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantised("embedding").alias("q"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, "vec_id")


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id, s.r)::INT AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_warc": op6_warc,
    "op7_dedup_lines": op7_dedup_lines,
    "op8_media_columns": op8_media_columns,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_decontamination": op11_decontamination,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
SQL = {"op1_mix_sources": OP1_SQL, "op6_warc": OP6_SQL, "op7_dedup_lines": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_decontamination": OP11_SQL, "op12_hard_negatives": OP12_SQL}
