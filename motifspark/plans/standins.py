"""Stand-ins for the domain's tables, derived from the driver's tables by integer arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import coefficient_hash, unit
from ..tables import read

# --- labelled folder rows: 20 sources of documents as templates
ROWS = "rows_ AS (SELECT source AS template, concat(source, '/', doc_id) AS image_path, doc_id, text FROM documents)"


def labelled_rows(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("source").alias("template"), F.concat("source", F.lit("/"), "doc_id").alias("image_path"), "doc_id", "text")


# --- predictions of four methods over embeddings, with truth
PREDS = """preds AS (
  SELECT vec_id AS sample_id, concat('m', m) AS method, CAST(vec_id % 3 AS INTEGER) AS seed,
    CASE WHEN vec_id % 7 = 0 THEN 'Non-Meme' WHEN vec_id % 5 = 0 THEN 'Template-Free' ELSE concat('t', label) END AS truth,
    CASE WHEN (vec_id + m) % 11 = 0 THEN 'Template-Free' WHEN (vec_id + m) % 17 = 0 THEN 'Non-Meme'
         WHEN (vec_id + m) % 23 = 0 THEN '__OUTLIER__'
         WHEN (vec_id * 7 + m * 13) % 10 < 6 + m % 3 THEN CASE WHEN vec_id % 7 = 0 THEN 'Non-Meme' WHEN vec_id % 5 = 0 THEN 'Template-Free' ELSE concat('t', label) END
         ELSE concat('t', (label + 1) % 10) END AS pred,
    CAST((vec_id * 37 + m * 11) % 101 AS DOUBLE) / 100 AS confidence
  FROM embeddings, (SELECT CAST(range AS INTEGER) AS m FROM range(4)) mm)"""


def predictions(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("m", F.explode(F.array(*map(F.lit, range(4)))))
    truth = "CASE WHEN vec_id % 7 = 0 THEN 'Non-Meme' WHEN vec_id % 5 = 0 THEN 'Template-Free' ELSE concat('t', label) END"
    pred = f"CASE WHEN (vec_id + m) % 11 = 0 THEN 'Template-Free' WHEN (vec_id + m) % 17 = 0 THEN 'Non-Meme' WHEN (vec_id + m) % 23 = 0 THEN '__OUTLIER__' WHEN (vec_id * 7 + m * 13) % 10 < 6 + m % 3 THEN {truth} ELSE concat('t', (label + 1) % 10) END"
    return e.selectExpr("vec_id AS sample_id", "concat('m', m) AS method", "CAST(vec_id % 3 AS INT) AS seed", f"{truth} AS truth", f"{pred} AS pred", "CAST((vec_id * 37 + m * 11) % 101 AS DOUBLE) / 100 AS confidence")


# --- 64-bit hashes of 64 coefficients, and planted near copies
HASHES = """raw_ AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings),
med_ AS (SELECT vec_id, label, c, list_sort(c[2:64])[32] AS m FROM raw_),
bits_ AS (SELECT vec_id, label, i, CASE WHEN c[i + 1] > m THEN 1 ELSE 0 END AS b FROM med_, (SELECT CAST(range AS INTEGER) AS i FROM range(64)) r),
own_ AS (SELECT vec_id AS id, label, CAST(sum(CASE WHEN b = 1 THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << i END ELSE 0 END) AS BIGINT) AS h FROM bits_ GROUP BY 1, 2),
hashes AS (
  SELECT id, label, h, CASE WHEN id % 5 = 0 THEN 'imgflip_test' ELSE 'imgflip_train' END AS source FROM own_
  UNION ALL
  SELECT id + 100000, label, xor(h, CAST((id % 256) AS BIGINT) << CAST(id % 50 AS INTEGER)), 'social_media' FROM own_ WHERE id % 4 = 0)"""


def hashes(spark, d) -> DataFrame:
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", coefficient_hash(F.col("embedding").cast("array<double>")).alias("h"))
    base = own.withColumn("source", F.when(F.col("id") % 5 == 0, "imgflip_test").otherwise("imgflip_train"))
    near = own.filter("id % 4 = 0").selectExpr("id + 100000 AS id", "label", "h ^ shiftleft(id % 256, CAST(id % 50 AS INT)) AS h", "'social_media' AS source")
    return base.unionByName(near)


# --- vectors with planted classes
PLANTED = """pl_ AS (SELECT vec_id, label, list_transform(embedding, lambda x: 0.3 * CAST(x AS DOUBLE)) AS e FROM embeddings),
pv_ AS (SELECT vec_id, label, list_transform(range(64), lambda i: e[i + 1] + CASE WHEN i % 10 = label THEN 1.0 ELSE 0.0 END) AS v FROM pl_),
planted AS (SELECT vec_id AS id, label, concat('t', label) AS template,
  list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v,
  CASE WHEN vec_id % 5 = 0 THEN 'imgflip_test' WHEN vec_id % 3 = 0 THEN 'social_media' ELSE 'imgflip_train' END AS source FROM pv_)"""


def planted(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * 0.3 + F.when(i % 10 == F.col("label"), 1.0).otherwise(0.0))
    source = F.when(F.col("vec_id") % 5 == 0, "imgflip_test").when(F.col("vec_id") % 3 == 0, "social_media").otherwise("imgflip_train")
    return e.select(F.col("vec_id").alias("id"), "label", F.concat(F.lit("t"), "label").alias("template"), unit(v).alias("v"), source.alias("source"))


# --- votes of five raters over documents
VOTES = """votes AS (
  SELECT doc_id AS image_id, concat('r', r) AS annotator, r AS ord,
    CASE WHEN doc_id % 10 = 0 AND r < 3 THEN 'NON_MEME' WHEN (doc_id * 31 + r * 17) % 7 <= 2 THEN 'TEMPLATE'
         WHEN (doc_id * 31 + r * 17) % 7 <= 4 THEN 'TEMPLATELESS' WHEN (doc_id * 31 + r * 17) % 7 = 5 THEN 'NON_MEME' ELSE 'UNSURE' END AS kind,
    concat(CASE WHEN r % 2 = 0 THEN 'Src ' ELSE 'src-' END, (doc_id + r // 3) % 20) AS name
  FROM documents, (SELECT CAST(range AS INTEGER) AS r FROM range(5)) rr)"""


def votes(spark, d) -> DataFrame:
    v = read(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(5)))).alias("r"))
    q = "(doc_id * 31 + r * 17) % 7"
    return v.selectExpr("doc_id AS image_id", "concat('r', r) AS annotator", "r AS ord", f"CASE WHEN doc_id % 10 = 0 AND r < 3 THEN 'NON_MEME' WHEN {q} <= 2 THEN 'TEMPLATE' WHEN {q} <= 4 THEN 'TEMPLATELESS' WHEN {q} = 5 THEN 'NON_MEME' ELSE 'UNSURE' END AS kind", "concat(CASE WHEN r % 2 = 0 THEN 'Src ' ELSE 'src-' END, (doc_id + r div 3) % 20) AS name")
