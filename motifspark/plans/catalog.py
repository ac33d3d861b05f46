"""Registered queries over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import urls as U
from ..functions import vectors as V
from ..operators import bootstrap, cluster, densejoin, features, gate, hashjoin, metrics, models, raters, replies, rows, sparse, vote
from ..schema import OUTLIER, TEMPLATE_FREE, TEMPLATED
from ..streaming import rates
from ..tables import read
from . import standins as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def metrics_sql(source: str, keys: str, digits: int = 6) -> str:
    """CTEs that end in ``scored``: the scores of rows (keys, truth, pred, w) of ``source``."""
    return f"""ct AS (SELECT {keys}, truth, pred, CAST(sum(w) AS BIGINT) AS n FROM {source} GROUP BY ALL),
sides AS (SELECT {keys}, truth AS class, n AS t, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS d FROM ct UNION ALL SELECT {keys}, pred, 0, n, 0 FROM ct),
cl AS (SELECT {keys}, class, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(d) AS DOUBLE) AS d FROM sides GROUP BY ALL),
agg AS (SELECT {keys}, sum(t) AS n, sum(d) AS c, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp,
  sum(CASE WHEN p > 0 THEN t * d / p ELSE 0 END) AS wp, sum(CASE WHEN t + p > 0 THEN t * 2 * d / (t + p) ELSE 0 END) AS wf FROM cl GROUP BY ALL),
scored AS (SELECT {keys}, CAST(n AS BIGINT) AS n, round(c / n, {digits}) AS accuracy, round(wp / n, {digits}) AS precision, round(c / n, {digits}) AS recall, round(wf / n, {digits}) AS f1,
  round(CASE WHEN sqrt((n * n - pp) * (n * n - tt)) > 0 THEN (n * c - tp) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0 END, {digits}) AS mcc,
  round(CASE WHEN tp / (n * n) < 1 THEN (c / n - tp / (n * n)) / (1 - tp / (n * n)) ELSE 0 END, {digits}) AS cohen_kappa, tp / (n * n) >= 1 AS degenerate FROM agg)"""


COARSE = "CASE WHEN {0} IN ('Non-Meme', 'Template-Free') THEN {0} ELSE 'Templated-Meme' END"
VIEWS = f"""cc AS (SELECT *, {COARSE.format('truth')} AS ct_, {COARSE.format('pred')} AS cp_ FROM preds),
views AS (
  SELECT method, 'fine' AS view, truth, pred, 1 AS w FROM cc
  UNION ALL SELECT method, 'coarse', ct_, cp_, 1 FROM cc
  UNION ALL SELECT method, 'binary', CASE WHEN ct_ = 'Templated-Meme' THEN 'templated' ELSE 'rest' END, CASE WHEN cp_ = 'Templated-Meme' THEN 'templated' ELSE 'rest' END, 1 FROM cc
  UNION ALL SELECT method, 'fine_pred_templated', truth, pred, 1 FROM cc WHERE cp_ = 'Templated-Meme'
  UNION ALL SELECT method, 'fine_true_templated', truth, pred, 1 FROM cc WHERE ct_ = 'Templated-Meme')"""


# ---------------------------------------------------------------- metrics
@query(f"WITH {S.PREDS}, {VIEWS}, {metrics_sql('views', 'method, view')} SELECT * FROM scored")
def open_set_scores(spark, d):
    """Every view of every method in one job."""
    return metrics.scores(metrics.open_set_views(S.predictions(spark, d).select("method", "truth", "pred")), ["method", "view"])


@query(f"WITH {S.PREDS} SELECT method, truth, pred, count(*) AS n FROM preds GROUP BY ALL")
def contingency_counts(spark, d):
    return metrics.contingency(S.predictions(spark, d), ["method"])


@query(f"""WITH {S.PREDS} SELECT method, count(*) FILTER (pred <> '__OUTLIER__') AS covered_count, count(*) FILTER (pred = '__OUTLIER__') AS rejected_count,
  round(count(*) FILTER (pred <> '__OUTLIER__') / count(*), 6) AS coverage, round(count(*) FILTER (pred <> '__OUTLIER__' AND pred = truth) / count(*) FILTER (pred <> '__OUTLIER__'), 6) AS covered_accuracy
FROM preds GROUP BY method""")
def rejection_coverage(spark, d):
    return metrics.coverage(S.predictions(spark, d), ["method"], OUTLIER)


@query(f"""WITH {S.PREDS}, b AS (SELECT method, {COARSE.format('truth')} = 'Templated-Meme' AS t, {COARSE.format('pred')} = 'Templated-Meme' AS p FROM preds),
s AS (SELECT method, count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (t = p) AS r FROM b GROUP BY 1)
SELECT method, n, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(r / n, 6) AS accuracy FROM s""")
def binary_templated(spark, d):
    p = S.predictions(spark, d).select("method", L.coarse(F.col("truth")).alias("truth"), L.coarse(F.col("pred")).alias("pred"))
    return metrics.binary_scores(p, ["method"], TEMPLATED)


@query(f"""WITH {S.PREDS}, lab AS (SELECT DISTINCT sample_id FROM preds WHERE sample_id % 9 <> 0), p2 AS (SELECT * FROM preds WHERE (sample_id + CAST(substr(method, 2) AS INTEGER)) % 13 <> 0)
SELECT method, count(*) FILTER (l.sample_id IS NULL) AS unlabelled_predictions, count(l.sample_id) AS matched, (SELECT count(*) FROM lab) - count(l.sample_id) AS unpredicted_labels
FROM p2 LEFT JOIN lab l USING (sample_id) GROUP BY method""")
def join_coverage(spark, d):
    p = S.predictions(spark, d)
    lab = p.select("sample_id").distinct().filter("sample_id % 9 <> 0")
    return metrics.join_labels(p.filter("(sample_id + CAST(substr(method, 2) AS INT)) % 13 <> 0"), lab, ["method"])[1]


@query(f"""WITH {S.PREDS}, src AS (SELECT method, seed, truth, pred, 1 AS w FROM preds), {metrics_sql('src', 'method, seed')},
long AS (SELECT method, seed, 'f1' AS metric, f1 AS value FROM scored UNION ALL SELECT method, seed, 'mcc', mcc FROM scored UNION ALL SELECT method, seed, 'cohen_kappa', cohen_kappa FROM scored)
SELECT method, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(DISTINCT seed) AS n_seeds FROM long GROUP BY 1, 2""")
def seed_aggregate(spark, d):
    return metrics.seed_summary(metrics.scores(S.predictions(spark, d), ["method", "seed"]), ["method"], ["f1", "mcc", "cohen_kappa"])


@query(f"WITH {S.PREDS}, c AS (SELECT method, {COARSE.format('pred')} AS pred_class, pred FROM preds) SELECT method, pred_class, count(*) AS n, count(DISTINCT pred) AS n_labels FROM c GROUP BY 1, 2")
def prediction_summary(spark, d):
    p = S.predictions(spark, d).withColumn("pred_class", L.coarse(F.col("pred")))
    return p.groupBy("method", "pred_class").agg(F.count("*").alias("n"), F.count_distinct("pred").alias("n_labels"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean_s, round(sum(value), 3) AS total_s, round(sum(value) / 60, 3) AS total_min, round(count(value) * 3600 / sum(value), 3) AS per_hour FROM events GROUP BY 1")
def timing_summary(spark, d):
    return metrics.timing(read(spark, d, "events"), ["event_type"], "value")


@query(f"""WITH {S.PREDS}, va AS (SELECT * FROM (SELECT seed, method, truth, pred, 1 AS w, 'all' AS variant FROM preds UNION ALL SELECT seed, method, truth, pred, 1, 'without_rejected' FROM preds WHERE pred <> '__OUTLIER__'
  UNION ALL SELECT seed, method, truth, pred, 1, 'in_vocabulary' FROM preds WHERE pred LIKE 't%')), {metrics_sql('va', 'seed, method, variant')} SELECT * FROM scored""")
def rescoring_variants(spark, d):
    v = F.array(F.lit("all"), F.when(F.col("pred") != OUTLIER, "without_rejected"), F.when(F.col("pred").startswith("t"), "in_vocabulary"))
    p = S.predictions(spark, d).withColumn("variant", F.explode(F.filter(v, lambda x: x.isNotNull())))
    return metrics.scores(p, ["seed", "method", "variant"])


# ---------------------------------------------------------------- labels
KEY = "regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '[^a-z0-9]+', '{1}', 'g'), '^{1}+|{1}+$', '', 'g')"


@query(f"SELECT p_partkey, {KEY.format('p_name', '_')} AS key, {KEY.format('p_name', '-')} AS slug, {KEY.format('p_name', ' ')} AS lenient FROM part")
def label_keys(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", L.normal_key(n).alias("key"), L.slug(n).alias("slug"), L.lenient_key(n).alias("lenient"))


_FREE, _NON = (str(tuple(keys)) for keys in (L.TEMPLATE_FREE_KEYS, L.NON_MEME_KEYS))
_SPELT = """lab AS (SELECT sample_id, CASE sample_id % 6 WHEN 0 THEN ' Not a MEME' WHEN 1 THEN 'template-free' WHEN 2 THEN concat(chr(9), upper(pred), chr(13)) WHEN 3 THEN concat(' ', pred, ' ') WHEN 4 THEN 'none' ELSE NULL END AS label FROM preds WHERE method = 'm0')"""


@query(f"""WITH {S.PREDS}, {_SPELT}, voc AS (SELECT {KEY.format('pred', '_')} AS key, min(pred) AS name FROM preds GROUP BY 1), k AS (SELECT *, {KEY.format('label', '_')} AS key FROM lab)
SELECT sample_id, CASE WHEN k.key IN {_NON} THEN 'Non-Meme' WHEN k.key IN {_FREE} THEN 'Template-Free' ELSE coalesce(voc.name, trim(coalesce(label, ''), concat(' ', chr(9), chr(10), chr(13)))) END AS canonical,
  CASE WHEN k.key IN {_NON} THEN 'NON_MEME' WHEN k.key IN {_FREE} OR k.key IN ('', 'none', 'null', 'nan') THEN 'TEMPLATELESS' ELSE 'TEMPLATE' END AS kind
FROM k LEFT JOIN voc ON voc.key = k.key""")
def canonical_labels(spark, d):
    p = S.predictions(spark, d)
    spelt = F.expr("CASE sample_id % 6 WHEN 0 THEN ' Not a MEME' WHEN 1 THEN 'template-free' WHEN 2 THEN concat(chr(9), upper(pred), chr(13)) WHEN 3 THEN concat(' ', pred, ' ') WHEN 4 THEN 'none' ELSE NULL END")
    lab = p.filter("method = 'm0'").select("sample_id", spelt.alias("label"))
    return L.canonical_label(lab, "label", p.select(F.col("pred").alias("name"))).select("sample_id", "canonical", L.label_kind(F.col("label")).alias("kind"))


@query(f"WITH {S.PREDS} SELECT sample_id, method, CASE WHEN pred = '__OUTLIER__' THEN 'Template-Free' ELSE pred END AS mapped, {COARSE.format('pred')} AS coarse FROM preds")
def reject_mapping(spark, d):
    return S.predictions(spark, d).select("sample_id", "method", L.map_rejects(F.col("pred")).alias("mapped"), L.coarse(F.col("pred")).alias("coarse"))


@query(f"""WITH n AS (SELECT DISTINCT concat(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_brand END) AS name FROM part)
SELECT {KEY.format('name', ' ')} AS key, min(name) AS name FROM n GROUP BY 1 HAVING count(DISTINCT name) = 1""")
def lenient_names(spark, d):
    n = read(spark, d, "part").select(F.expr("CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_brand END").alias("name"))
    return L.lenient_lookup(n, "name")


@query("""SELECT event_id, TRY_CAST(CASE WHEN lower(trim(t, concat(' ', chr(9), chr(10), chr(13)))) IN ('na', 'n/a', 'none', 'nan', 'null', '') THEN NULL ELSE trim(t, concat(' ', chr(9), chr(10), chr(13))) END AS DOUBLE) AS number
FROM (SELECT event_id, CASE event_id % 6 WHEN 5 THEN concat('N/A', chr(9)) WHEN 0 THEN ' N/A ' WHEN 1 THEN concat(chr(9), event_id, chr(13)) WHEN 2 THEN '' WHEN 3 THEN 'x1' ELSE concat(event_id, '.5') END AS t FROM events)""")
def lenient_numbers(spark, d):
    t = F.expr("CASE event_id % 6 WHEN 5 THEN concat('N/A', chr(9)) WHEN 0 THEN ' N/A ' WHEN 1 THEN concat(chr(9), event_id, chr(13)) WHEN 2 THEN '' WHEN 3 THEN 'x1' ELSE concat(event_id, '.5') END")
    return read(spark, d, "events").select("event_id", L.to_float(t).alias("number"))


@query("SELECT source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT source FROM documents)")
def label_indexing(spark, d):
    return L.label_index(S.labelled_rows(spark, d)).withColumn("label_idx", F.col("label_idx").cast("int"))


# ---------------------------------------------------------------- rows
@query(f"WITH {S.ROWS} SELECT image_path, template FROM rows_ WHERE template NOT IN ('src1', 'src2') AND template IN (SELECT template FROM rows_ GROUP BY 1 HAVING count(*) >= 7)")
def filtered_classes(spark, d):
    return rows.drop_small_classes(rows.exclude_templates(S.labelled_rows(spark, d), ["src1", "src2"]), 7).select("image_path", "template")


@query(f"WITH {S.ROWS}, c AS (SELECT template, count(*) AS n FROM rows_ GROUP BY 1) SELECT count(*) AS templates_before, CAST(sum(n) AS BIGINT) AS rows_before, count(*) FILTER (n >= 45) AS templates_after, CAST(coalesce(sum(n) FILTER (n >= 45), 0) AS BIGINT) AS rows_after FROM c")
def small_class_summary(spark, d):
    return rows.class_summary(S.labelled_rows(spark, d), 45)


@query(f"WITH {S.ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY image_path) AS k, dense_rank() OVER (ORDER BY template) AS t FROM rows_) SELECT template, image_path FROM r WHERE k <= 5 AND t <= 8")
def template_manifest(spark, d):
    return rows.first_per_template(rows.first_templates(S.labelled_rows(spark, d), 8), 5, "image_path").select("template", "image_path")


@query(f"WITH {S.ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY image_path) AS k, count(DISTINCT template) OVER () AS t FROM rows_) SELECT template, image_path FROM r WHERE k <= greatest(1, 70 // t) ORDER BY template, image_path LIMIT 70".replace("count(DISTINCT template) OVER ()", "(SELECT count(DISTINCT template) FROM rows_)"))
def budgeted_cap(spark, d):
    return rows.budgeted(S.labelled_rows(spark, d), 70, "image_path").select("template", "image_path")


@query(f"WITH {S.ROWS} SELECT doc_id, image_path FROM rows_ WHERE doc_id % 50 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM rows_ WHERE doc_id % 50 = 0)")
def content_exclusion(spark, d):
    r = S.labelled_rows(spark, d)
    return rows.exclude_content(r.filter("doc_id % 50 <> 0"), r.filter("doc_id % 50 = 0"), "text").select("doc_id", "image_path")


@query(f"WITH {S.ROWS} SELECT doc_id, template FROM rows_ ORDER BY md5(concat('40|', doc_id)), doc_id LIMIT 120")
def seeded_sample(spark, d):
    return rows.sample(S.labelled_rows(spark, d), 120, 40, "doc_id").select("doc_id", "template")


@query(f"""WITH {S.ROWS}, z AS (SELECT template, count(*) AS n FROM rows_ GROUP BY 1), s AS (SELECT template, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS base, round(n * CAST(0.8 AS DOUBLE) - floor(n * CAST(0.8 AS DOUBLE)), 9) AS rest FROM z),
q AS (SELECT template, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, template) <= (SELECT CAST(floor(round(sum(n) * CAST(0.8 AS DOUBLE), 6)) AS BIGINT) FROM z) - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT doc_id, template, row_number() OVER (PARTITION BY template ORDER BY md5(concat('40|', doc_id)), doc_id) AS k FROM rows_)
SELECT doc_id, template, CASE WHEN k <= quota THEN 'train' ELSE 'test' END AS part FROM r JOIN q USING (template)""")
def stratified_split(spark, d):
    return rows.stratified_split(S.labelled_rows(spark, d), 0.8, 40, "doc_id").select("doc_id", "template", "part")


@query(f"WITH {S.PREDS}, p AS (SELECT * FROM preds WHERE (sample_id + CAST(substr(method, 2) AS INTEGER)) % 13 <> 0) SELECT sample_id FROM p GROUP BY 1 HAVING count(DISTINCT method) = 4")
def ids_of_all_methods(spark, d):
    return rows.common_ids(S.predictions(spark, d).filter("(sample_id + CAST(substr(method, 2) AS INT)) % 13 <> 0"), "sample_id", "method")


@query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def pending_pages(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    return rows.pending(p, p.filter("page_id % 3 = 0"), "page_id")


@query("""SELECT page_id, replace(url, '/', '#') AS all_replaced, CASE WHEN instr(url, '/') = 0 THEN url ELSE concat(substr(url, 1, instr(url, '/') - 1), '#', substr(url, instr(url, '/') + 1)) END AS first_replaced FROM pages""")
def prefix_rewrites(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", rows.replace_prefix_all(u, "/", "#").alias("all_replaced"), rows.replace_prefix_first(u, "/", "#").alias("first_replaced"))


_SPECIAL = """CASE page_id % 14 WHEN 0 THEN 'https://www.youtube.com/x' WHEN 1 THEN concat('https://imgur.com/a/', page_id) WHEN 2 THEN concat('https://imgur.com/G', page_id) WHEN 3 THEN 'https://imgur.com/u/v'
  WHEN 4 THEN concat('https://i.redd.it/', page_id) WHEN 5 THEN 'https://ex.com/p.PNG' WHEN 6 THEN '' WHEN 7 THEN NULL
  WHEN 8 THEN 'https://www.youtube.com/watch?v=a|b' WHEN 9 THEN 'https://imgur.com/a/x y' WHEN 10 THEN 'https://twitter.com/a/b?q={x}' WHEN 11 THEN concat('https://imgur.com/G[', page_id, ']')
  WHEN 12 THEN concat(' ', url, chr(10)) ELSE url END"""


@query(f"""WITH u AS (SELECT page_id, {_SPECIAL} AS u, url FROM pages)
SELECT page_id, CASE WHEN page_id % 14 IN (0, 1, 3, 6, 7, 8, 9, 10) THEN NULL WHEN page_id % 14 = 2 THEN concat('https://i.imgur.com/G', page_id, '.jpg') WHEN page_id % 14 = 11 THEN concat('https://i.imgur.com/G[', page_id, '].jpg')
  WHEN page_id % 14 = 12 THEN url ELSE u END AS direct FROM u""")
def direct_urls(spark, d):
    return read(spark, d, "pages").select("page_id", U.direct_url(F.expr(_SPECIAL)).alias("direct"))


_FETCH = "CASE WHEN event_id % 19 = 0 THEN 'skipped' WHEN event_id % 17 = 0 THEN 'error' WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 1000 < 12 OR event_id % 13 = 0 THEN 'deleted' ELSE 'ok' END"


@query(f"SELECT {_FETCH} AS outcome, count(*) AS n FROM events GROUP BY 1")
def fetch_outcomes(spark, d):
    e = read(spark, d, "events")
    x = lambda s: F.expr(s)
    out = U.fetch_outcome(x("IF(event_id % 19 = 0, NULL, 'u')"), x("IF(event_id % 11 = 0, 404, 200)"), x("IF(event_id % 7 = 0, 'text/html', 'image/png')"), x("'https://i.redd.it/x.png'"), x("500 + event_id % 1000"), x("event_id % 13 <> 0"), x("IF(event_id % 17 = 0, 'timeout', NULL)"))
    return e.select(out.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- hashes and vectors (D2, D6-D8, E, F)
@query(f"WITH {S.HASHES} SELECT id, label, h, source FROM hashes")
def coefficient_hashes(spark, d):
    return S.hashes(spark, d).select("id", "label", "h", "source")


@query(f"WITH {S.HASHES} SELECT a.id AS id, b.id AS other, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS dist FROM hashes a JOIN hashes b ON bit_count(xor(a.h, b.h)) <= 8")
def hamming_radius_join(spark, d):
    h = S.hashes(spark, d)
    return hashjoin.radius_join(h, h, 8)


@query(f"WITH {S.HASHES}, e AS (SELECT a.id AS id, b.id AS other, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS dist FROM hashes a JOIN hashes b ON bit_count(xor(a.h, b.h)) <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM e) SELECT id, other, dist FROM r WHERE k <= 4")
def capped_neighbours(spark, d):
    """A radius beyond the bands: tiles."""
    h = S.hashes(spark, d)
    return hashjoin.capped(hashjoin.radius_join(h, h, 20), 4)


@query(f"""WITH {S.HASHES}, reps AS (SELECT CAST(label AS BIGINT) AS cluster_id, min(id) AS rid FROM hashes WHERE source = 'imgflip_train' GROUP BY 1), rr AS (SELECT cluster_id, h FROM reps JOIN hashes ON id = rid),
x AS (SELECT q.id AS id, r.cluster_id AS cluster_id, CAST(bit_count(xor(q.h, r.h)) AS INTEGER) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.h, r.h)), r.cluster_id) AS k FROM hashes q, rr r)
SELECT id, cluster_id, dist FROM x WHERE k = 1""")
def nearest_representative(spark, d):
    h = S.hashes(spark, d)
    reps = h.filter("source = 'imgflip_train'").groupBy(F.col("label").cast("long").alias("cluster_id")).agg(F.min_by("h", "id").alias("h"))
    return hashjoin.nearest_hash(h, reps)


_DBSCAN = f"""{S.HASHES}, e AS (SELECT a.id AS id, b.id AS other FROM hashes a JOIN hashes b ON a.id <> b.id AND bit_count(xor(a.h, b.h)) <= 20),
deg AS (SELECT h.id AS id, count(e.other) + 1 AS n FROM hashes h LEFT JOIN e ON e.id = h.id GROUP BY 1), core AS (SELECT id FROM deg WHERE n >= 4),
ce AS (SELECT e.id AS id, e.other AS other FROM e WHERE e.id IN (SELECT id FROM core) AND e.other IN (SELECT id FROM core)),
reach AS (SELECT id AS node, id AS root FROM core UNION SELECT ce.other, r.root FROM reach r JOIN ce ON ce.id = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1), num AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster_id FROM (SELECT DISTINCT component FROM comp)),
cored AS (SELECT node AS id, cluster_id FROM comp JOIN num USING (component)),
border AS (SELECT e.id AS id, min(c.cluster_id) AS cluster_id FROM e JOIN cored c ON c.id = e.other WHERE e.id NOT IN (SELECT id FROM core) GROUP BY 1),
clustered AS (SELECT h.id AS id, CAST(coalesce(c.cluster_id, b.cluster_id, -1) AS BIGINT) AS cluster_id, c.id IS NOT NULL AS core FROM hashes h LEFT JOIN cored c ON c.id = h.id LEFT JOIN border b ON b.id = h.id)"""


def _clustered(spark, d):
    h = S.hashes(spark, d)
    return h, cluster.hash_dbscan(h, 20, 4)


@query(f"WITH RECURSIVE {_DBSCAN} SELECT id, cluster_id, core FROM clustered")
def dbscan_clusters(spark, d):
    return _clustered(spark, d)[1]


_NAMES = """lv AS (SELECT cluster_id, concat('t', label) AS template, count(*) AS n FROM clustered JOIN hashes USING (id) WHERE source = 'imgflip_train' AND cluster_id >= 0 GROUP BY 1, 2),
names AS (SELECT cluster_id, template FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, template) AS k FROM lv) WHERE k = 1)"""


@query(f"WITH RECURSIVE {_DBSCAN}, {_NAMES} SELECT cluster_id, template FROM names")
def cluster_names(spark, d):
    h, c = _clustered(spark, d)
    return cluster.name_clusters(c.join(h.withColumn("template", F.concat(F.lit("t"), "label")), "id"))


@query(f"WITH RECURSIVE {_DBSCAN}, {_NAMES} SELECT count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS clusters_discovered, (SELECT count(*) FROM names) AS clusters_named, count(*) FILTER (cluster_id < 0) AS noise_points FROM clustered")
def cluster_counters(spark, d):
    h, c = _clustered(spark, d)
    m = c.join(h.withColumn("template", F.concat(F.lit("t"), "label")), "id")
    return cluster.run_counters(m, cluster.name_clusters(m))


_CENTRES = """pos AS (SELECT CAST(label AS BIGINT) AS cluster_id, unnest(v) AS x, unnest(range(64)) AS i FROM planted WHERE source = 'imgflip_train'),
mean AS (SELECT cluster_id, i, avg(x) AS x FROM pos GROUP BY 1, 2), nrm AS (SELECT cluster_id, sqrt(sum(x * x)) AS n FROM mean GROUP BY 1)"""


@query(f"WITH {S.PLANTED}, {_CENTRES} SELECT cluster_id, CAST(i AS INTEGER) AS i, round(x / n, 6) AS x FROM mean JOIN nrm USING (cluster_id)")
def centroid_vectors(spark, d):
    p = S.planted(spark, d).filter("source = 'imgflip_train'").select("v", F.col("label").cast("long").alias("cluster_id"))
    return cluster.centroids(p).select("cluster_id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {S.PLANTED}, {_CENTRES}, q AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS i FROM planted), s AS (SELECT q.id AS id, mean.cluster_id AS cluster_id, sum(q.x * mean.x / n) AS score FROM q JOIN mean USING (i) JOIN nrm USING (cluster_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster_id) AS k FROM s) SELECT id, cluster_id, round(score, 6) AS score FROM r WHERE k = 1""")
def nearest_centroids(spark, d):
    p = S.planted(spark, d)
    c = cluster.centroids(p.filter("source = 'imgflip_train'").select("v", F.col("label").cast("long").alias("cluster_id")))
    return densejoin.nearest_centroid(p, c).withColumn("score", F.round("score", 6))


@query(f"WITH {S.PLANTED} SELECT a.id AS id, b.id AS other, round(1 - list_dot_product(a.v, b.v), 6) AS dist FROM planted a JOIN planted b ON a.source = 'imgflip_test' AND b.source = 'imgflip_train' AND 1 - list_dot_product(a.v, b.v) <= 0.03")
def cosine_radius(spark, d):
    p = S.planted(spark, d)
    return densejoin.cosine_radius_join(p.filter("source = 'imgflip_test'"), p.filter("source = 'imgflip_train'"), 0.03).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {S.HASHES}, b AS (SELECT CAST(label AS BIGINT) AS cluster_id, id, h FROM hashes), sh AS (SELECT cluster_id, i, avg(CAST((h >> i) & 1 AS DOUBLE)) AS a FROM b, (SELECT CAST(range AS INTEGER) AS i FROM range(64)) r GROUP BY 1, 2),
mj AS (SELECT cluster_id, CAST(sum(CASE WHEN a >= 0.5 THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << i END ELSE 0 END) AS BIGINT) AS major FROM sh GROUP BY 1),
r AS (SELECT cluster_id, id, h, row_number() OVER (PARTITION BY cluster_id ORDER BY bit_count(xor(h, major)), id) AS k FROM b JOIN mj USING (cluster_id)) SELECT cluster_id, id, h FROM r WHERE k = 1""")
def cluster_medoids(spark, d):
    return cluster.medoids(S.hashes(spark, d).select("id", "h", F.col("label").cast("long").alias("cluster_id")))


@query(f"WITH RECURSIVE {_DBSCAN}, {_NAMES} SELECT id, cluster_id, coalesce(template, 'UNKNOWN_CLUSTER') AS pred_template FROM clustered LEFT JOIN names USING (cluster_id)")
def closed_predictions(spark, d):
    h, c = _clustered(spark, d)
    names = cluster.name_clusters(c.join(h.withColumn("template", F.concat(F.lit("t"), "label")), "id"))
    return cluster.closed_predictions(c.select("id", "cluster_id"), names).select("id", "cluster_id", "pred_template")


@query(f"WITH RECURSIVE {_DBSCAN}, {_NAMES} SELECT id, cluster_id, coalesce(template, '__OUTLIER__') AS pred_label FROM clustered LEFT JOIN names USING (cluster_id)")
def open_predictions(spark, d):
    h, c = _clustered(spark, d)
    names = cluster.name_clusters(c.join(h.withColumn("template", F.concat(F.lit("t"), "label")), "id"))
    return cluster.open_predictions(c.select("id", "cluster_id"), names, "__OUTLIER__").select("id", "cluster_id", "pred_label")


_TYPICAL = f"""{S.PLANTED}, {_CENTRES}, own AS (SELECT id, source, CASE WHEN id % 7 = 0 THEN -1 ELSE CAST(label AS BIGINT) END AS cluster_id, v FROM planted),
q AS (SELECT id, source, cluster_id, unnest(v) AS x, unnest(range(64)) AS i FROM own),
typical AS (SELECT q.id AS id, q.source AS source, q.cluster_id AS cluster_id, coalesce(sum(q.x * mean.x / n), CAST('-inf' AS DOUBLE)) AS score FROM q LEFT JOIN mean USING (cluster_id, i) LEFT JOIN nrm USING (cluster_id) GROUP BY 1, 2, 3)"""


def _typical(spark, d):
    p = S.planted(spark, d)
    centres = cluster.centroids(p.filter("source = 'imgflip_train'").select("v", F.col("label").cast("long").alias("cluster_id")))
    own = p.withColumn("cluster_id", F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).cast("long"))
    return cluster.typicality(own, centres)


@query(f"WITH {_TYPICAL} SELECT id, cluster_id, round(score, 6) AS score FROM typical")
def typicality(spark, d):
    return _typical(spark, d).select("id", "cluster_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_TYPICAL}, ranked AS (SELECT cluster_id, concat('p/', id) AS image_path, source, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, concat('p/', id)) AS k FROM typical WHERE cluster_id >= 0)
SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN concat('t', cluster_id) ELSE '' END AS template, count(*) AS n_members, count(*) FILTER (source = 'imgflip_train') AS n_labeled_members, string_agg(image_path, '|' ORDER BY k) FILTER (k <= 6) AS example_paths FROM ranked GROUP BY 1""")
def cluster_examples(spark, d):
    members = _typical(spark, d).withColumn("image_path", F.concat(F.lit("p/"), "id"))
    names = members.filter("cluster_id >= 0 and cluster_id % 2 = 0").select("cluster_id", F.concat(F.lit("t"), "cluster_id").alias("template")).distinct()
    return cluster.cluster_examples(members.drop("template"), names)


@query(f"""WITH {S.PLANTED}, {_CENTRES}, q AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS i FROM planted), s AS (SELECT q.id AS id, mean.cluster_id AS cluster_id, sum(q.x * mean.x / n) AS score FROM q JOIN mean USING (i) JOIN nrm USING (cluster_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster_id) AS k FROM s) SELECT id, cluster_id FROM r WHERE k = 1""")
def refined_clusters(spark, d):
    p = S.planted(spark, d)
    first = F.when(F.col("source") == "imgflip_train", F.col("label")).otherwise(F.lit(-1)).cast("long")
    return cluster.refine(p.select("id", "v", first.alias("cluster_id")))[0].select("id", "cluster_id")


@query(f"WITH {S.PLANTED}, both_ AS (SELECT id, unnest(list_concat(list_transform(v, lambda x: sqrt(0.3) * x), list_transform(list_reverse(v), lambda x: sqrt(0.7) * x))) AS x, CAST(unnest(range(128)) AS INTEGER) AS i FROM planted) SELECT id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM both_")
def fused_vectors(spark, d):
    p = S.planted(spark, d).select("id", V.fuse(F.col("v"), F.reverse("v"), 0.3).alias("v"))
    return p.select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {S.HASHES} SELECT id, CAST(i AS INTEGER) AS i, CASE WHEN (h >> i) & 1 = 1 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END AS x FROM hashes, (SELECT CAST(range AS INTEGER) AS i FROM range(64)) r")
def hash_signs(spark, d):
    return S.hashes(spark, d).select("id", F.posexplode(V.bit_signs(F.col("h"))).alias("i", "x"))


@query("""WITH a AS (SELECT source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT source FROM documents)),
b AS (SELECT source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src3'))
SELECT coalesce(a.label, b.label) AS label, coalesce(a.idx, -1) AS idx_a, coalesce(b.idx, -1) AS idx_b FROM a FULL JOIN b ON a.label = b.label WHERE a.idx IS DISTINCT FROM b.idx""")
def label_map_changes(spark, d):
    own = S.labelled_rows(spark, d)
    one, other = (L.label_index(x).withColumn("label_idx", F.col("label_idx").cast("int")) for x in (own, own.filter("template <> 'src3'")))
    return rows.label_map_differences(one, other).select("label", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("idx_a", "idx_b")))


# ---------------------------------------------------------------- votes and gates (G)
_EDGES = f"{S.HASHES}, ed AS (SELECT q.id AS id, concat('t', q.label) AS truth, concat('t', r.label) AS label, bit_count(xor(q.h, r.h)) AS dist FROM hashes q JOIN hashes r ON q.source <> 'imgflip_train' AND r.source = 'imgflip_train' AND bit_count(xor(q.h, r.h)) <= 22)"


def _edges(spark, d):
    h = S.hashes(spark, d).withColumn("label", F.concat(F.lit("t"), "label"))
    q, r = h.filter("source <> 'imgflip_train'"), h.filter("source = 'imgflip_train'")
    e = hashjoin.radius_join(q, r, 22).join(r.select(F.col("id").alias("other"), "label"), "other")
    return q.select("id", F.col("label").alias("truth")), e.select("id", "label", "dist")


_GRID = f"""{_EDGES}, grid AS (SELECT 2 * i + j AS grid, CAST(r AS DOUBLE) AS radius, w AS weights FROM (SELECT * FROM (VALUES (0, 8), (1, 16), (2, 22)) t(i, r)), (SELECT * FROM (VALUES (0, 'uniform'), (1, 'distance')) u(j, w))),
m AS (SELECT g.grid AS grid, g.weights AS weights, ed.id AS id, ed.label AS label, ed.dist AS dist, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g.grid, ed.id) AS z FROM ed JOIN grid g ON ed.dist <= g.radius),
s AS (SELECT grid, id, label, round(sum(CASE WHEN weights = 'uniform' THEN 1.0 WHEN z = 1 THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(1 AS DOUBLE) / dist END), 9) AS w FROM m GROUP BY 1, 2, 3),
won AS (SELECT grid, id, label FROM (SELECT *, row_number() OVER (PARTITION BY grid, id ORDER BY w DESC, label) AS k FROM s) WHERE k = 1),
swept AS (SELECT g.grid AS grid, g.radius AS radius, g.weights AS weights, q.id AS id, concat('t', q.label) AS truth, coalesce(won.label, '__OUTLIER__') AS pred, 1 AS w FROM grid g CROSS JOIN (SELECT * FROM hashes WHERE source <> 'imgflip_train') q LEFT JOIN won ON won.grid = g.grid AND won.id = q.id)"""


@query(f"WITH {_GRID} SELECT CAST(grid AS INTEGER) AS grid, radius, weights, id, truth, pred FROM swept")
def radius_vote_grid(spark, d):
    q, e = _edges(spark, d)
    return vote.sweep(q, e, [8, 16, 22])


@query(f"WITH {_GRID}, {metrics_sql('swept', 'grid, radius, weights')} SELECT CAST(grid AS INTEGER) AS grid, radius, weights, f1 FROM scored ORDER BY f1 DESC, grid LIMIT 1")
def grid_selection(spark, d):
    q, e = _edges(spark, d)
    return vote.best_f1(metrics.scores(vote.sweep(q, e, [8, 16, 22]), ["grid", "radius", "weights"])).select("grid", "radius", "weights", "f1")


_DESC = """kp AS (SELECT vec_id AS image, CAST(k AS INTEGER) AS kp, [h, xor(h, CAST(k AS BIGINT)), h, xor(h, CAST(vec_id % 8 AS BIGINT))] AS d, src FROM (SELECT id % 100000 AS vec_id, id AS hid, h, source AS src FROM hashes), (SELECT range AS k FROM range(3)) kk)"""


@query(f"""WITH {S.HASHES}, {_DESC}, p AS (SELECT DISTINCT q.image AS query, r.image AS ref, q.kp AS kp FROM kp q JOIN kp r ON q.src = 'social_media' AND r.src <> 'social_media'
  AND CAST(bit_count(xor(q.d[1], r.d[1])) AS INTEGER) + CAST(bit_count(xor(q.d[2], r.d[2])) AS INTEGER) + CAST(bit_count(xor(q.d[3], r.d[3])) AS INTEGER) + CAST(bit_count(xor(q.d[4], r.d[4])) AS INTEGER) <= 27)
SELECT query, ref, count(*) AS n, CASE WHEN count(*) >= 2 THEN 1 - least(count(*) / CAST(3 AS DOUBLE), 1.0) ELSE 1.0 END AS dist FROM p GROUP BY 1, 2""")
def shared_keypoints(spark, d):
    h = S.hashes(spark, d)
    kp = h.select((F.col("id") % 100000).alias("image"), "source", "h", F.explode(F.array(*map(F.lit, range(3)))).alias("kp"))
    kp = kp.withColumn("d", F.expr("array(h, h ^ CAST(kp AS BIGINT), h, h ^ (image % 8))"))
    n = vote.shared_keypoints(kp.filter("source = 'social_media'"), kp.filter("source <> 'social_media'"), 27)
    return n.withColumn("dist", vote.graded_distance(F.col("n"), F.lit(3.0), 2))


@query(f"""WITH {S.PREDS}, s AS (SELECT confidence AS threshold, count(*) FILTER ({COARSE.format('truth')} = 'Templated-Meme') AS p, count(*) FILTER ({COARSE.format('truth')} <> 'Templated-Meme') AS n FROM preds GROUP BY 1),
c AS (SELECT threshold, CAST(sum(p) OVER (ORDER BY threshold DESC) AS DOUBLE) / (SELECT sum(p) FROM s) AS tpr, CAST(sum(n) OVER (ORDER BY threshold DESC) AS DOUBLE) / (SELECT sum(n) FROM s) AS fpr FROM s),
r AS (SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(sqrt(tpr * (1 - fpr)), 6) AS gmean FROM c) SELECT *, row_number() OVER (ORDER BY gmean DESC, threshold DESC) = 1 AS selected FROM r""")
def roc_sweep(spark, d):
    p = S.predictions(spark, d).select(F.col("confidence").alias("score"), (L.coarse(F.col("truth")) == TEMPLATED).alias("positive"))
    return gate.roc(p)


@query(f"WITH {S.PREDS} SELECT sample_id, method, CASE WHEN coalesce(CASE WHEN sample_id % 6 = 0 THEN NULL ELSE confidence END, 1.0) < 0.4 THEN '__REJECTED_BY_STAGE1__' ELSE pred END AS pred FROM preds")
def two_stage_gate(spark, d):
    p = S.predictions(spark, d).select("sample_id", "method", F.expr("IF(sample_id % 6 = 0, NULL, confidence)").alias("p_meme"), F.col("pred").alias("stage2_label"))
    return gate.two_stage(p, 0.4).select("sample_id", "method", "pred")


@query(f"WITH {S.PREDS} SELECT round(quantile_cont(confidence, 0.1), 6) AS threshold, round(min(confidence), 6) AS min, round(quantile_cont(confidence, 0.05), 6) AS p05, round(quantile_cont(confidence, 0.5), 6) AS median, round(max(confidence), 6) AS max FROM preds WHERE truth <> 'Non-Meme'")
def confidence_calibration(spark, d):
    return gate.calibrate(S.predictions(spark, d), 10)


@query(f"WITH {S.PREDS}, a AS (SELECT method, confidence < 0.3 AND pred <> 'Non-Meme' AS demoted, CASE WHEN confidence < 0.3 AND pred <> 'Non-Meme' THEN 'Template-Free' ELSE pred END AS pred FROM preds) SELECT method, pred, count(*) FILTER (demoted) AS demoted, count(*) AS n FROM a GROUP BY 1, 2")
def confidence_gate(spark, d):
    return gate.apply_confidence(S.predictions(spark, d), 0.3).groupBy("method", "pred").agg(F.count_if("demoted").alias("demoted"), F.count("*").alias("n"))


# ---------------------------------------------------------------- bootstrap (I)
def boot_sql(replicates: int, seed: int) -> str:
    return f"""ids AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS pos FROM (SELECT DISTINCT sample_id FROM preds)), cnt AS (SELECT count(*) AS c FROM ids),
draws AS (SELECT r.range AS rep, CAST(concat('0x', substr(md5(concat('{seed}|', r.range, '|', k.range)), 1, 7)) AS BIGINT) % (SELECT c FROM cnt) AS pos FROM range({replicates}) r, range((SELECT c FROM cnt)) k),
wt AS (SELECT rep, sample_id, count(*) AS w FROM draws JOIN ids USING (pos) GROUP BY 1, 2), src AS (SELECT rep, method, truth, pred, w FROM preds JOIN wt USING (sample_id)), {metrics_sql('src', 'rep, method', 9)}"""


def _replicates(spark, d, n=20, seed=40):
    """Few replicates, for the queries that SQL replays draw by draw; the whole job is in those ending in _10000."""
    p = S.predictions(spark, d)
    return bootstrap.replicate_scores(p, bootstrap.weights(p, "sample_id", n, seed), ["method"], "sample_id")


@query(f"""WITH {S.PREDS}, {boot_sql(20, 40)}, long AS (SELECT method, 'f1' AS metric, f1 AS value FROM scored UNION ALL SELECT method, 'mcc', mcc FROM scored UNION ALL SELECT method, 'cohen_kappa', cohen_kappa FROM scored)
SELECT method, metric, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.025), 4) AS lo, round(quantile_cont(value, 0.975), 4) AS hi FROM long GROUP BY 1, 2""")
def bootstrap_intervals(spark, d):
    return bootstrap.intervals(_replicates(spark, d), ["method"], ["f1", "mcc", "cohen_kappa"])


@query(f"""WITH {S.PREDS}, {boot_sql(20, 40)}, df AS (SELECT a.method AS method, a.f1 - b.f1 AS f1, a.mcc - b.mcc AS mcc FROM scored a JOIN scored b ON a.rep = b.rep AND b.method = 'm0' AND a.method <> 'm0'),
long AS (SELECT method, 'f1' AS metric, f1 AS value FROM df UNION ALL SELECT method, 'mcc', mcc FROM df) SELECT method, metric, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.025), 4) AS lo, round(quantile_cont(value, 0.975), 4) AS hi FROM long GROUP BY 1, 2""")
def bootstrap_differences(spark, d):
    return bootstrap.paired_differences(_replicates(spark, d), "method", "m0", ["f1", "mcc"])


@query(f"""WITH {S.PREDS}, {boot_sql(20, 40)}, sv AS (SELECT CASE WHEN method < 'm2' THEN 'a' ELSE 'b' END AS grp, method AS seed, avg(f1) AS m, var_samp(f1) AS v FROM scored GROUP BY 1, 2),
o AS (SELECT grp, avg(m) AS mean, var_samp(m) AS vb, avg(v) AS vw, count(*) AS s FROM sv GROUP BY 1) SELECT grp, round(mean, 4) AS mean, round(mean - 4.302653 * sqrt(vb / s + vw / (s * 20)), 4) AS lo, round(mean + 4.302653 * sqrt(vb / s + vw / (s * 20)), 4) AS hi FROM o""")
def two_stage_bootstrap(spark, d):
    v = _replicates(spark, d).withColumn("grp", F.when(F.col("method") < "m2", "a").otherwise("b")).withColumnRenamed("method", "seed")
    return bootstrap.two_stage_interval(v, ["grp"], "f1", 20)


#: Replicates of the survey's P14.
REPLICATES = 10_000


def _all_replicates(spark, d, seed=40):
    return bootstrap.pooled_scores(S.predictions(spark, d), "method", "sample_id", REPLICATES, seed)


@query()
def bootstrap_intervals_10000(spark, d):
    return bootstrap.intervals(_all_replicates(spark, d), ["method"], ["f1", "mcc", "cohen_kappa"])


@query()
def bootstrap_differences_10000(spark, d):
    return bootstrap.paired_differences(_all_replicates(spark, d), "method", "m0", ["f1", "mcc"])


@query()
def two_stage_bootstrap_10000(spark, d):
    v = _all_replicates(spark, d).withColumn("grp", F.when(F.col("method") < "m2", "a").otherwise("b")).withColumnRenamed("method", "seed")
    return bootstrap.two_stage_interval(v, ["grp"], "f1", REPLICATES)


# ---------------------------------------------------------------- raters (J)
_TALLY = """fv AS (SELECT *, CASE WHEN kind = 'UNSURE' THEN 'TEMPLATELESS' ELSE kind END AS k2 FROM votes), by_ AS (SELECT image_id, k2, count(*) AS n FROM fv GROUP BY 1, 2),
top_ AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, k2) AS k, lead(n) OVER (PARTITION BY image_id ORDER BY n DESC, k2) AS second, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS n_votes FROM by_),
nm AS (SELECT image_id, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS key, count(*) AS n, min(ord) AS o, arg_min(name, ord) AS name FROM votes WHERE kind = 'TEMPLATE' GROUP BY 1, 2),
nw AS (SELECT image_id, name FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, o) AS k FROM nm) WHERE k = 1)"""


@query(f"""WITH {S.VOTES}, {_TALLY} SELECT t.image_id AS sample_id, CASE WHEN k2 = 'TEMPLATE' AND nw.name IS NOT NULL THEN nw.name WHEN k2 = 'NON_MEME' THEN 'Non-Meme' WHEN k2 = 'TEMPLATELESS' THEN 'Template-Free' ELSE 'Templated-Meme' END AS label, k2 AS kind, n_votes, n AS n_agree
FROM top_ t LEFT JOIN nw ON nw.image_id = t.image_id WHERE k = 1 AND n IS DISTINCT FROM second
UNION ALL SELECT t.image_id, 'Non-Meme', 'NON_MEME', t.n_votes, (SELECT count(*) FROM fv WHERE fv.image_id = t.image_id AND k2 = 'NON_MEME') FROM top_ t WHERE k = 1 AND n = second AND t.image_id % 3 = 0""")
def ground_truth(spark, d):
    v = S.votes(spark, d)
    breaks = v.select("image_id").distinct().filter("image_id % 3 = 0").withColumn("kind", F.lit("NON_MEME")).withColumn("label", F.lit(""))
    return raters.ground_truth(v, breaks)


_CODED = """cd AS (SELECT image_id, annotator, 'three_class' AS coding, CASE WHEN kind = 'UNSURE' THEN 'TEMPLATELESS' ELSE kind END AS code FROM votes
UNION ALL SELECT image_id, annotator, 'templated_vs_rest', CASE WHEN kind = 'TEMPLATE' THEN 'templated' ELSE 'rest' END FROM votes UNION ALL SELECT image_id, annotator, 'meme_vs_rest', CASE WHEN kind = 'NON_MEME' THEN 'non_meme' ELSE 'meme' END FROM votes
UNION ALL SELECT image_id, annotator, 'four_class', kind FROM votes)"""


@query(f"""WITH {S.VOTES}, {_CODED}, c AS (SELECT coding, image_id, code, count(*) AS c FROM cd GROUP BY 1, 2, 3), i AS (SELECT coding, image_id, sum(c * c) AS s, count(*) AS kinds FROM c GROUP BY 1, 2),
a AS (SELECT coding, count(*) AS n_items, avg(CAST(s - 5 AS DOUBLE) / 20) AS pa, avg(CASE WHEN kinds = 1 THEN 1.0 ELSE 0.0 END) AS u FROM i GROUP BY 1), t AS (SELECT coding, code, CAST(sum(c) AS DOUBLE) AS c FROM c GROUP BY 1, 2),
e AS (SELECT t.coding AS coding, sum((c / (n_items * 5)) * (c / (n_items * 5))) AS pe FROM t JOIN a ON a.coding = t.coding GROUP BY 1)
SELECT a.coding AS coding, n_items, round((pa - pe) / (1 - pe), 6) AS kappa, round(pa, 6) AS pairwise, round(CAST(u AS DOUBLE), 6) AS unanimous FROM a JOIN e ON a.coding = e.coding""")
def rater_agreement(spark, d):
    return raters.agreement(raters.codings(S.votes(spark, d), keep_unsure=True), 5)


@query(f"""WITH {S.VOTES}, c AS (SELECT a.annotator AS rater_a, b.annotator AS rater_b, a.kind AS ka, b.kind AS kb, count(*) AS n FROM votes a JOIN votes b ON a.image_id = b.image_id AND a.annotator < b.annotator GROUP BY 1, 2, 3, 4),
s AS (SELECT rater_a, rater_b, CAST(sum(n) AS DOUBLE) AS n, CAST(coalesce(sum(n) FILTER (ka = kb), 0) AS DOUBLE) AS c FROM c GROUP BY 1, 2), x AS (SELECT rater_a, rater_b, ka AS k, sum(n) AS na FROM c GROUP BY 1, 2, 3), y AS (SELECT rater_a, rater_b, kb AS k, sum(n) AS nb FROM c GROUP BY 1, 2, 3),
p AS (SELECT x.rater_a AS rater_a, x.rater_b AS rater_b, CAST(sum(na * nb) AS DOUBLE) AS tp FROM x JOIN y ON x.rater_a = y.rater_a AND x.rater_b = y.rater_b AND x.k = y.k GROUP BY 1, 2)
SELECT s.rater_a AS rater_a, s.rater_b AS rater_b, CAST(n AS BIGINT) AS n, round(c / n, 6) AS agreement, round((c / n - coalesce(tp, 0) / (n * n)) / (1 - coalesce(tp, 0) / (n * n)), 6) AS kappa FROM s LEFT JOIN p ON p.rater_a = s.rater_a AND p.rater_b = s.rater_b""")
def rater_pairs(spark, d):
    return raters.rater_pairs(S.votes(spark, d))


@query(f"""WITH {S.VOTES}, b AS (SELECT image_id, kind, count(*) AS n FROM votes GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, kind) AS k, lead(n) OVER (PARTITION BY image_id ORDER BY n DESC, kind) AS s, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS a FROM b)
SELECT image_id, CASE WHEN n = s THEN '' ELSE kind END AS consensus_label, a AS n_annotators, n AS n_agree FROM t WHERE k = 1""")
def annotation_consensus(spark, d):
    v = S.votes(spark, d).withColumnRenamed("kind", "label")
    older = v.withColumn("ord", F.lit(-1)).withColumn("label", F.lit("UNSURE"))
    return raters.consensus(v.unionByName(older))


@query("SELECT p.name AS annotator, doc_id AS idx FROM documents, (SELECT * FROM (VALUES (0, 'ana'), (1, 'bo'), (2, 'cy')) t(i, name)) p WHERE doc_id < 50 OR (doc_id - 50) % 3 = p.i")
def work_assignment(spark, d):
    return raters.assign(read(spark, d, "documents").select(F.col("doc_id").alias("idx")), ["ana", "bo", "cy"], 50)


@query("SELECT doc_id AS image_id, m.name AS model, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat('40|', doc_id, '|', m.name)), m.name) AS INTEGER) AS place FROM documents, (SELECT * FROM (VALUES ('a'), ('b'), ('c')) t(name)) m")
def display_orders(spark, d):
    return raters.display_order(read(spark, d, "documents").select(F.col("doc_id").alias("image_id")), ["a", "b", "c"], 40)


@query("SELECT user_id AS annotator, arg_max(event_type, event_id) AS run_id, max(event_id) AS ts FROM events WHERE event_type <> 'click' GROUP BY 1")
def last_sessions(spark, d):
    return raters.last_session(read(spark, d, "events").select(F.col("user_id").alias("annotator"), F.col("event_type").alias("run_id"), F.col("event_id").alias("ts")), "click")


@query(f"WITH {S.PREDS}, p AS (SELECT * FROM preds WHERE (sample_id + CAST(substr(method, 2) AS INTEGER)) % 13 <> 0) SELECT sample_id, method AS model FROM preds WHERE (sample_id + CAST(substr(method, 2) AS INTEGER)) % 13 = 0")
def prediction_gaps(spark, d):
    p = S.predictions(spark, d).withColumnRenamed("method", "model")
    return raters.coverage_gaps(p.select("sample_id").distinct(), p.filter("(sample_id + CAST(substr(model, 2) AS INT)) % 13 <> 0"))


# ---------------------------------------------------------------- replies and search
_REPLY = """CASE event_id % 7 WHEN 0 THEN concat('```json\n{"template_id": ', event_id % 90, '}\n```') WHEN 1 THEN concat('noise {"template_id": "[', event_id % 90, ']"} tail') WHEN 2 THEN concat('{"template": "T', event_id % 60, '"}')
  WHEN 3 THEN concat('{"template": "t-', event_id % 60, '"}') WHEN 4 THEN 'nope' WHEN 5 THEN '{"template_id": true}' ELSE concat('{"template_id": [', event_id % 90, ']}') END"""


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 6) AND event_id % 90 < 60 THEN concat('T', event_id % 90) WHEN event_id % 7 = 2 THEN concat('T', event_id % 60) ELSE '__INVALID_TEMPLATE__' END AS template_pred,
CASE WHEN event_id % 7 IN (0, 1, 6) AND event_id % 90 < 60 THEN 'index' WHEN event_id % 7 = 2 THEN 'name_exact' ELSE 'invalid' END AS match_mode FROM events""")
def resolved_replies(spark, d):
    e = read(spark, d, "events").select("event_id", F.expr(_REPLY.replace("\n{", "\\n{").replace("}\n`", "}\\n`")).alias("raw_response_text"))
    return replies.resolve(e, _label_space(spark, d)).select("event_id", "template_pred", "match_mode")


def _label_space(spark, d):
    """60 labels, from part keys."""
    return read(spark, d, "part").select((F.col("p_partkey") % 60).cast("int").alias("label_idx")).distinct().withColumn("label", F.concat(F.lit("T"), "label_idx"))


@query("""WITH q AS (SELECT DISTINCT p_brand AS query FROM part), v AS (SELECT DISTINCT concat(p_brand, ' ', p_type) AS label FROM part),
qw AS (SELECT query, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: w <> '')) AS qw, concat(' ', trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')), ' ') AS qf FROM q),
lw AS (SELECT label, list_distinct(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda w: w <> '')) AS lw, concat(' ', trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' ') AS lf FROM v),
g AS (SELECT query, qw, label, lw, list_distinct(list_transform(range(1, length(qf) - 1), lambda i: substr(qf, i, 3))) AS qg, list_distinct(list_transform(range(1, length(lf) - 1), lambda i: substr(lf, i, 3))) AS lg FROM qw, lw),
x AS (SELECT query, label, len(qw) AS n, len(list_intersect(qw, lw)) AS e, (SELECT count(*) FROM (SELECT unnest(qw) AS w) a WHERE EXISTS (SELECT 1 FROM (SELECT unnest(lw) AS y) b WHERE starts_with(b.y, a.w))) AS p, len(list_intersect(qg, lg)) AS i, len(list_distinct(list_concat(qg, lg))) AS u, len(lw) AS m FROM g),
s AS (SELECT query, label, round(CAST(3 AS DOUBLE) * e / n + CAST(1.5 AS DOUBLE) * p / n + CAST(2 AS DOUBLE) * i / u - CAST(0.02 AS DOUBLE) * m, 4) AS score FROM x)
SELECT query, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def template_search(spark, d):
    p = read(spark, d, "part")
    q, v = p.select(F.col("p_brand").alias("query")).distinct(), p.select(F.concat("p_brand", F.lit(" "), "p_type").alias("label")).distinct()
    return replies.search(q, v, 5)


# ---------------------------------------------------------------- features and models (D1, D5, D9, E9, G7), a stream
@query("""WITH px AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS p FROM embeddings),
basis AS (SELECT k.range AS k, i.range AS i, CASE WHEN k.range = 0 THEN sqrt(CAST(1 AS DOUBLE) / 8) ELSE sqrt(CAST(2 AS DOUBLE) / 8) * cos(pi() * (2 * i.range + 1) * k.range / 16) END AS w FROM range(8) k, range(8) i),
low AS (SELECT vec_id, a.k * 8 + b.k AS c, sum(x * a.w * b.w) AS y FROM px JOIN basis a ON a.i = p // 8 JOIN basis b ON b.i = p % 8 GROUP BY 1, 2),
med AS (SELECT vec_id, median(y) AS m FROM low WHERE c > 0 GROUP BY 1)
SELECT vec_id AS id, CAST(sum(CASE WHEN y > m THEN CASE WHEN c = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(c AS INTEGER) END ELSE 0 END) AS BIGINT) AS h FROM low JOIN med USING (vec_id) GROUP BY 1""")
def dct_hashes(spark, d):
    """Each vector as a gray grid of 8 x 8."""
    return features.dct_hash(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 8)


@query(f"""WITH {S.PLANTED}, pos AS (SELECT id, source, unnest(v) AS x, unnest(range(64)) AS i FROM planted), mo AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM pos WHERE source = 'imgflip_train' GROUP BY 1)
SELECT id, CAST(i AS INTEGER) AS i, round((x - m) / s, 6) AS x FROM pos JOIN mo USING (i)""")
def standardised_positions(spark, d):
    p = S.planted(spark, d)
    scaled = models.standardise(p, models.position_moments(p.filter("source = 'imgflip_train'")))
    return scaled.select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {S.PLANTED}, t AS (SELECT template, count(*) AS n FROM planted WHERE source = 'imgflip_train' GROUP BY 1) SELECT id, template, round(CAST((SELECT sum(n) FROM t) AS DOUBLE) / ((SELECT count(*) FROM t) * n), 6) AS weight FROM planted JOIN t USING (template) WHERE source = 'imgflip_train'")
def balanced_weights(spark, d):
    p = S.planted(spark, d).filter("source = 'imgflip_train'").select("id", "template")
    return models.balanced_weights(p, "template").select("id", "template", F.round("weight", 6).alias("weight"))


@query()
def principal_components(spark, d):
    p = S.planted(spark, d).select("id", "source", "v")
    return models.pca(p, p.filter("source = 'imgflip_train'"), 8).select("id", "v")


@query()
def logistic_predictions(spark, d):
    p = S.planted(spark, d).drop("label").withColumnRenamed("template", "label")
    return models.logistic(p.filter("source = 'imgflip_train'"), p.filter("source <> 'imgflip_train'")).select("id", "label", "pred", "confidence")


@query()
def sparse_matches(spark, d):
    """Dictionary: the first 30 training vectors of each template."""
    p = S.planted(spark, d)
    refs = rows.first_per_template(p.filter("source = 'imgflip_train'"), 30, "id").select("id", F.col("template").alias("label"), "v")
    return sparse.sparse_match(p.filter("source = 'imgflip_test'"), refs, alpha=0.001)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS kind, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def streamed_rates(spark, d):
    out = rates.drain(spark, f"{d}/events[.]parquet", "ts", "event_type", "value")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).withColumn("total", F.round("total", 3))


from . import composed, methods  # noqa: E402, F401  register their queries
