"""Registered queries for annotation tables and whole runs; ``catalog`` imports this module to have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import bootstrap, densejoin, hashjoin, rows, runs
from ..schema import TEMPLATED
from ..sources import annotations as A
from ..tables import read
from . import standins as S
from .catalog import _DBSCAN, _FREE, _NAMES, _NON, COARSE, KEY, boot_sql, metrics_sql, query


def _kind(c: str) -> str:
    key = KEY.format(c, "_")
    return f"CASE WHEN {key} IN {_NON} THEN 'NON_MEME' WHEN {key} IN {_FREE} OR {key} IN ('', 'none', 'null', 'nan') THEN 'TEMPLATELESS' ELSE 'TEMPLATE' END"


# ---------------------------------------------------------------- annotation tables
_CONSENSUS = "CASE WHEN image_id % 9 = 4 THEN ' ' WHEN image_id % 11 = 3 THEN ' not a meme ' WHEN image_id % 11 = 5 THEN 'Templateless' ELSE concat(' ', name) END"


@query(f"""WITH {S.VOTES}, f AS (SELECT image_id, arg_min({_CONSENSUS}, 4 - ord) AS c FROM votes GROUP BY 1), voc AS (SELECT {KEY.format('name', '_')} AS key, min(name) AS name FROM (SELECT concat('SRC ', doc_id % 15) AS name FROM documents) GROUP BY 1),
k AS (SELECT *, {KEY.format('c', '_')} AS key FROM f WHERE trim(c) <> '')
SELECT CAST(image_id AS VARCHAR) AS sample_id, CASE WHEN k.key IN {_NON} THEN 'Non-Meme' WHEN k.key IN {_FREE} THEN 'Template-Free' ELSE coalesce(voc.name, trim(c)) END AS label FROM k LEFT JOIN voc ON voc.key = k.key""")
def truth_label_table(spark, d):
    merged = S.votes(spark, d).selectExpr("image_id", f"{_CONSENSUS} AS consensus_label", "4 - ord AS place")
    vocabulary = read(spark, d, "documents").select(F.concat(F.lit("SRC "), F.col("doc_id") % 15).alias("name"))
    return A.truth_labels(merged, "place", vocabulary)


@query(f"""WITH {S.PREDS} SELECT CAST(sample_id AS VARCHAR) AS image_id, concat('p/', sample_id) AS image_path, CASE method WHEN 'm0' THEN 'Alpha' WHEN 'm1' THEN 'beta' ELSE 'c' END AS model, pred AS prediction,
CASE WHEN method = 'm1' OR (method = 'm0' AND sample_id % 6 = 0) THEN NULL ELSE confidence END AS confidence FROM preds WHERE method <> 'm3'""")
def wide_predictions(spark, d):
    p = S.predictions(spark, d)
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    sure = F.max(F.when(F.col("method") == "m0", F.when(F.col("sample_id") % 6 == 0, "N/A").otherwise(F.col("confidence").cast("string"))))
    wide = p.groupBy(F.col("sample_id").cast("string").alias("image_id")).agg(F.concat(F.lit(" p/"), F.max("sample_id")).alias("image_path"), of("m0", "pred").alias("Alpha_pred"), sure.alias("alpha_score"), of("m1", "pred").alias("beta_Label"), of("m2", "pred").alias("c_prediction"), of("m2", "confidence").cast("string").alias("C_CONF"), F.max("sample_id").alias("place"))
    return A.predictions(wide, "place").drop("examples")


@query(f"""WITH {S.PREDS} SELECT CAST(sample_id AS VARCHAR) AS image_id, concat('p/', sample_id) AS image_path, method AS model, CASE WHEN sample_id % 10 = 0 THEN 'again' ELSE pred END AS prediction,
CASE WHEN sample_id % 10 = 0 THEN NULL ELSE confidence END AS confidence, CASE WHEN sample_id % 10 = 0 THEN 'c' ELSE 'a|b' END AS examples FROM preds WHERE method IN ('m0', 'm2')""")
def long_predictions(spark, d):
    p = S.predictions(spark, d)
    first = p.selectExpr("CAST(sample_id AS STRING) AS image_id", "concat('p/', sample_id) AS image_path", "method AS model", "pred AS prediction", "CAST(confidence AS STRING) AS confidence", "' a | |b' AS template_examples", "'z' AS template_ref", "0 AS place")
    again = p.filter("sample_id % 10 = 0").selectExpr("CAST(sample_id AS STRING) AS image_id", "'late' AS image_path", "method AS model", "'again' AS prediction", "'nan' AS confidence", "'' AS template_examples", "'c' AS template_ref", "1 AS place")
    return A.predictions(first.unionByName(again), "place", ["m0", "m2"]).withColumn("examples", F.array_join("examples", "|"))


_RUN = "CASE WHEN pred = 'Non-Meme' THEN 'not a meme' ELSE pred END AS pred_label, CASE WHEN sample_id % 2 = 0 THEN confidence END AS meme_probability, CASE WHEN sample_id % 5 > 0 THEN confidence END AS confidence, CASE WHEN sample_id % 3 = 0 THEN 0.5 END AS stage2_confidence"


@query(f"""WITH {S.PREDS}, r AS (SELECT sample_id, method, {_RUN} FROM preds)
SELECT CAST(sample_id AS VARCHAR) AS image_id, concat('p/', sample_id) AS image_path, method AS model, pred_label AS prediction, round(CASE WHEN pred_label = 'not a meme' AND meme_probability IS NOT NULL THEN 1 - meme_probability ELSE coalesce(confidence, CAST(stage2_confidence AS DOUBLE)) END, 6) AS confidence FROM r""")
def collected_predictions(spark, d):
    p = S.predictions(spark, d).selectExpr("sample_id", "concat('p/', sample_id) AS image_path", "method AS model", *_RUN.split(", "))
    return A.run_predictions(p)


@query(f"""WITH {S.VOTES}, b AS (SELECT name, image_id * 10 + ord AS ord, 0 AS side FROM votes WHERE image_id % 4 = 0 UNION ALL SELECT concat(' SRC_', doc_id % 30, ' '), doc_id, 1 FROM documents), k AS (SELECT *, {KEY.format('name', '_')} AS key FROM b)
SELECT key, trim(name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY side, ord, name) AS r FROM k WHERE key <> '') WHERE r = 1""")
def display_vocabulary(spark, d):
    labels = S.votes(spark, d).filter("image_id % 4 = 0").selectExpr("name", "image_id * 10 + ord AS ord")
    return A.display_names(labels, read(spark, d, "documents").selectExpr("concat(' SRC_', doc_id % 30, ' ') AS name", "doc_id AS ord"))


_OWN = "CASE doc_id % 8 WHEN 2 THEN 'TEMPLATE' WHEN 6 THEN 'TEMPLATELESS' WHEN 7 THEN 'TEMPLATE' END AS truth_kind, CASE doc_id % 8 WHEN 2 THEN concat('SRC_', doc_id % 20) WHEN 7 THEN ' ' END AS truth_label"


@query(f"""WITH {S.PREDS}, {S.VOTES}, voc AS (SELECT {KEY.format('name', '_')} AS key, min(name) AS name FROM votes GROUP BY 1), j AS (SELECT doc_id, {_OWN} FROM documents),
ch AS (SELECT doc_id, m FROM documents, (SELECT * FROM (VALUES ('m0', 0), ('m1', 0), ('m2', 1)) t(m, k)) WHERE doc_id % 4 = k),
win AS (SELECT doc_id, arg_min(m, md5(concat('40|', doc_id, '|', m))) AS winner FROM ch GROUP BY 1),
x AS (SELECT j.doc_id AS doc_id, winner, pred, coalesce(truth_kind, 'UNSURE') AS own, truth_label, trim(coalesce(truth_label, '')) AS own_name, voc.name AS name FROM j LEFT JOIN win USING (doc_id) LEFT JOIN preds p ON p.sample_id = j.doc_id AND p.method = winner LEFT JOIN voc ON voc.key = {KEY.format('truth_label', '_')}),
y AS (SELECT *, CASE WHEN winner IS NULL THEN own WHEN pred IS NULL THEN 'TEMPLATELESS' ELSE {_kind('pred')} END AS kind FROM x)
SELECT doc_id AS image_id, 'r0' AS annotator, CASE WHEN kind = 'UNSURE' THEN '' WHEN kind <> 'TEMPLATE' THEN kind WHEN winner IS NOT NULL THEN pred WHEN own_name <> '' THEN coalesce(name, own_name) END AS label, kind,
  CASE WHEN winner IS NOT NULL THEN 'judged' WHEN own = 'UNSURE' THEN 'unsure' WHEN own = 'TEMPLATE' AND own_name = '' THEN 'error' ELSE 'none_correct' END AS decision, CASE WHEN winner IS NOT NULL THEN concat('model:', winner) ELSE 'annotator' END AS source FROM y""")
def judgement_labels(spark, d):
    from ..operators import raters

    docs = read(spark, d, "documents")
    chosen = "CASE doc_id % 4 WHEN 0 THEN array('m1', 'm0') WHEN 1 THEN array('m2') ELSE array() END AS chosen"
    judged = docs.selectExpr("doc_id AS image_id", "'r0' AS annotator", chosen, *_OWN.split(", CASE")[:1], "CASE" + _OWN.split(", CASE")[1])
    places = raters.display_order(docs.selectExpr("doc_id AS image_id"), ["m0", "m1", "m2"], 40)
    said = S.predictions(spark, d).selectExpr("sample_id AS image_id", "method AS model", "pred AS prediction")
    names = S.votes(spark, d).groupBy(L.normal_key(F.col("name")).alias("key")).agg(F.min("name").alias("name"))
    return A.judgements(judged, places, said, names)


@query("SELECT page_id % 50 AS id, arg_min(url, page_id) AS url FROM pages WHERE page_id % 7 <> 0 AND url IS NOT NULL GROUP BY 1")
def submission_urls(spark, d):
    return A.submissions(read(spark, d, "pages").selectExpr("page_id % 50 AS id", "IF(page_id % 7 = 0, NULL, url) AS url", "page_id", "html"), "id", "url", "page_id")


@query(f"WITH {S.ROWS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN image_path ELSE concat('/data/img/', image_path) END AS image_path FROM rows_")
def rebased_paths(spark, d):
    r = S.labelled_rows(spark, d).select("doc_id", "image_path")
    return A.rebased(r, r.filter("doc_id % 3 = 0").select(F.col("image_path").alias("path")), "/data/img/")


# ---------------------------------------------------------------- unions and alignment (B11, B13, B14), replicates of one class (I4)
@query(f"WITH {S.PLANTED} SELECT id, template, CASE WHEN source = 'imgflip_test' THEN 'imgflip_train' ELSE source END AS source FROM planted")
def discovery_rows(spark, d):
    p = S.planted(spark, d).select("id", "template", "source")
    part = lambda s: p.filter(F.col("source") == s)
    return rows.discovery(part("imgflip_train"), extra=part("imgflip_test"), corpus=part("social_media"))


@query("SELECT concat(lang, '/', doc_id % 100) AS key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL GROUP BY 1 HAVING key LIKE 'en/%'")
def aligned_rows(spark, d):
    r = read(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.concat("lang", F.lit("/"), F.col("doc_id") % 100).alias("key"), "doc_id", "source")
    return rows.aligned(r, r.select("key").filter("key LIKE 'en/%'"), "key", "doc_id")


@query(f"""WITH {S.PREDS}, {boot_sql(20, 40)}, b AS (SELECT rep, method, {COARSE.format('truth')} = 'Templated-Meme' AS t, {COARSE.format('pred')} = 'Templated-Meme' AS p, w FROM src),
s AS (SELECT rep, method, CAST(coalesce(sum(w) FILTER (t AND p), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(w) FILTER (NOT t AND p), 0) AS DOUBLE) AS fp, CAST(coalesce(sum(w) FILTER (t AND NOT p), 0) AS DOUBLE) AS fn FROM b GROUP BY 1, 2)
SELECT rep, method, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s""")
def binary_replicates(spark, d):
    """Replicates that SQL replays draw by draw."""
    p = S.predictions(spark, d).select("sample_id", "method", L.coarse(F.col("truth")).alias("truth"), L.coarse(F.col("pred")).alias("pred"))
    return bootstrap.replicate_binary(p, bootstrap.weights(p, "sample_id", 20, 40), ["method"], "sample_id", TEMPLATED)


# ---------------------------------------------------------------- whole runs
def split_sql(source: str, key: str, fraction: float) -> str:
    """CTEs that end in ``dealt``: rows (key, template) of ``source`` with part."""
    f = f"CAST({fraction} AS DOUBLE)"
    return f"""sz AS (SELECT template, count(*) AS n FROM {source} GROUP BY 1), sh AS (SELECT template, CAST(floor(n * {f}) AS BIGINT) AS base, round(n * {f} - floor(n * {f}), 9) AS rest FROM sz),
qt AS (SELECT template, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, template) <= (SELECT CAST(floor(round(sum(n) * {f}, 6)) AS BIGINT) FROM sz) - (SELECT sum(base) FROM sh) THEN 1 ELSE 0 END AS quota FROM sh),
rk AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY md5(concat('40|', {key})), {key}) AS k FROM {source}),
dealt AS (SELECT rk.* EXCLUDE (k), CASE WHEN k <= quota THEN 'train' ELSE 'test' END AS part FROM rk JOIN qt USING (template))"""


@query(f"""WITH {S.ROWS}, kept AS (SELECT * FROM rows_ WHERE template <> 'src1' AND template IN (SELECT template FROM rows_ GROUP BY 1 HAVING count(*) >= 7)), {split_sql('kept', 'doc_id', 0.8)} SELECT doc_id, image_path, template, part FROM dealt""")
def canonical_split(spark, d):
    return runs.canonical_split(S.labelled_rows(spark, d), "doc_id", ("src1",)).select("doc_id", "image_path", "template", "part")


_FOUND = _DBSCAN.replace("\nhashes AS (", "\nevery_ AS (", 1).replace(", e AS (", ", hashes AS (SELECT * FROM every_ WHERE source <> 'imgflip_test'), e AS (", 1)


@query(f"""WITH RECURSIVE {_FOUND}, {_NAMES}, b AS (SELECT cluster_id, id, h FROM clustered JOIN hashes USING (id) WHERE cluster_id >= 0), share AS (SELECT cluster_id, i, avg(CAST((h >> i) & 1 AS DOUBLE)) AS a FROM b, (SELECT CAST(range AS INTEGER) AS i FROM range(64)) r GROUP BY 1, 2),
mj AS (SELECT cluster_id, CAST(sum(CASE WHEN a >= 0.5 THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << i END ELSE 0 END) AS BIGINT) AS major FROM share GROUP BY 1),
md AS (SELECT cluster_id, h FROM (SELECT cluster_id, h, row_number() OVER (PARTITION BY cluster_id ORDER BY bit_count(xor(h, major)), id) AS k FROM b JOIN mj USING (cluster_id)) WHERE k = 1),
near AS (SELECT q.id AS id, md.cluster_id AS cluster_id, CAST(bit_count(xor(q.h, md.h)) AS INTEGER) AS dist, names.template AS template FROM every_ q JOIN md ON q.source = 'imgflip_test' LEFT JOIN names USING (cluster_id)),
op AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster_id) AS k FROM near), cl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster_id) AS k FROM near WHERE template IS NOT NULL)
SELECT op.id AS id, cl.cluster_id AS closed_id, cl.template AS pred_template, op.cluster_id AS open_id, op.dist AS dist, coalesce(op.template, 'Template-Free') AS pred_label FROM op JOIN cl ON op.id = cl.id AND op.k = 1 AND cl.k = 1""")
def hash_cluster_run(spark, d):
    h = S.hashes(spark, d).select("id", "h", "source", F.concat(F.lit("t"), "label").alias("template"), F.concat(F.lit("p/"), "id").alias("image_path"))
    return runs.hash_clusters(h.filter("source <> 'imgflip_test'"), h.filter("source = 'imgflip_test'"), 20, 4)["predictions"]


_RADII = [6, 8, 10, 12, 14, 16, 20, 24, 32]


def vote_run_sql(points: str, own: str, dist: str, radii: list, order: str, refs: int = 1 << 62) -> str:
    """CTEs that end in ``final``. points: CTEs ending in ``pts`` (id, template, source, and the column ``own``); dist: of q and r; the first ``refs`` rows of a template vote."""
    grid = ", ".join(f"({i}, {r})" for i, r in enumerate(radii))
    weigh = "CASE WHEN weights = 'uniform' THEN 1.0 WHEN z = 1 THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(1 AS DOUBLE) / dist END"
    return f"""{points}, tr AS (SELECT id, template, {own} FROM pts WHERE source = 'imgflip_train'), te AS (SELECT id, template, {own} FROM pts WHERE source = 'imgflip_test'), {split_sql('tr', 'id', 0.9)},
grid AS (SELECT 2 * i + j AS grid, CAST(r AS DOUBLE) AS radius, w AS weights FROM (SELECT * FROM (VALUES {grid}) t(i, r)), (SELECT * FROM (VALUES (0, 'uniform'), (1, 'distance')) u(j, w))),
ev AS (SELECT q.id AS id, r.template AS label, {dist} AS dist FROM dealt q JOIN (SELECT * FROM dealt WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY template ORDER BY id) <= {refs}) r ON q.part = 'test' AND {dist} <= {max(radii)}),
m AS (SELECT grid.grid AS grid, weights, id, label, dist, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grid.grid, id) AS z FROM ev JOIN grid ON dist <= radius),
sw AS (SELECT grid, id, label, round(sum({weigh}), 9) AS w FROM m GROUP BY 1, 2, 3), wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid, id ORDER BY w DESC, label) AS k FROM sw) WHERE k = 1),
swept AS (SELECT grid.grid AS grid, radius, weights, q.id AS id, q.template AS truth, coalesce(wn.label, '__OUTLIER__') AS pred, 1 AS w FROM grid CROSS JOIN (SELECT * FROM dealt WHERE part = 'test') q LEFT JOIN wn ON wn.grid = grid.grid AND wn.id = q.id),
{metrics_sql('swept', 'grid, radius, weights')}, cov AS (SELECT grid, count(*) FILTER (pred <> '__OUTLIER__') / count(*) AS coverage FROM swept GROUP BY 1),
best AS (SELECT radius, weights FROM scored JOIN cov USING (grid) {order} LIMIT 1),
ef AS (SELECT q.id AS id, r.template AS label, {dist} AS dist, weights, max(CASE WHEN {dist} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q.id) AS z FROM te q CROSS JOIN best JOIN (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY template ORDER BY id) <= {refs}) r ON {dist} <= radius),
sf AS (SELECT id, label, round(sum({weigh}), 9) AS w FROM ef GROUP BY 1, 2), wf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS k FROM sf) WHERE k = 1),
final AS (SELECT te.id AS id, te.template AS template, coalesce(wf.label, '__OUTLIER__') AS pred FROM te LEFT JOIN wf ON wf.id = te.id)"""


_HASH_POINTS = f"{S.HASHES}, pts AS (SELECT id, h, source, concat('t', label) AS template FROM hashes)"


@query(f"WITH {vote_run_sql(_HASH_POINTS, 'h', 'bit_count(xor(q.h, r.h))', _RADII, 'ORDER BY f1 DESC, grid')} SELECT id, template, pred FROM final")
def radius_vote_run(spark, d):
    """The grid of nine radii and two weightings, chosen on a tenth of the training rows."""
    h = S.hashes(spark, d).select("id", "h", "source", F.concat(F.lit("t"), "label").alias("template"))
    return runs.radius_votes(h.filter("source = 'imgflip_train'"), h.filter("source = 'imgflip_test'"), hashjoin.radius_join, _RADII)["predictions"]


_COSINES = [0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3]
_POINTS = f"{S.PLANTED}, pts AS (SELECT id, template, source, v FROM planted)"


@query(f"WITH {vote_run_sql(_POINTS, 'v', '(1 - list_dot_product(q.v, r.v))', _COSINES, 'WHERE coverage >= 1 ORDER BY radius, f1 DESC, grid')} SELECT id, template, pred FROM final")
def embedding_vote_run(spark, d):
    """Cosine radius votes; of the radii that reject nothing, the smallest."""
    p = S.planted(spark, d).select("id", "template", "source", "v")
    return runs.radius_votes(p.filter("source = 'imgflip_train'"), p.filter("source = 'imgflip_test'"), densejoin.cosine_radius_join, _COSINES, selection="zero_rejection", by="v")["predictions"]


@query()
def vector_cluster_run(spark, d):
    """k-means clusters of fused vectors, refined, named, and test rows assigned; k is the number of templates."""
    p = S.planted(spark, d).withColumn("image_path", F.concat(F.lit("p/"), "id"))
    found = p.filter("source <> 'imgflip_test'")
    start = runs.clusterer("kmeans", found.select("id", "v"), k=p.select("template").distinct().count())
    return runs.vector_clusters(found, p.filter("source = 'imgflip_test'").select("id", "v"), start)["predictions"]


@query()
def density_vector_run(spark, d):
    """Density clusters of fused vectors, named, and test rows assigned to the nearest centroid."""
    p = S.planted(spark, d).withColumn("image_path", F.concat(F.lit("p/"), "id"))
    found = p.filter("source <> 'imgflip_test'")
    start = runs.clusterer("hdbscan", found.select("id", "v"), min_samples=5)
    return runs.vector_clusters(found, p.filter("source = 'imgflip_test'").select("id", "v"), start, steps=0)["predictions"]


@query()
def sparse_matching_run(spark, d):
    """Sparse-representation matching as one call; test rows are all in, and the first 30 training rows of each template."""
    p = S.planted(spark, d).select("id", "template", "source", "v")
    found = runs.sparse_matching(p.filter("source = 'imgflip_train'"), p.filter("source = 'imgflip_test'"))
    return found["predictions"].withColumn("residual", F.round("residual", 6))
