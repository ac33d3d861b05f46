"""Queries on tables as they grow: folders of part files, ids past the 100,000 that copies are shifted by, joins that Spark takes for small."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Folder of tables by step: half of the vectors' ids lie past 100,000, ``step`` apart, in several part files."""

    def make(first: int) -> str:
        d = str(tmp_path_factory.mktemp("grown"))
        e = spark.read.parquet(f"{SF}/embeddings.parquet")
        e.withColumn("vec_id", F.expr(f"IF(vec_id < 250, vec_id, 100000 + 4 * (vec_id - 250) + {first})")).repartition(3).write.parquet(f"{d}/embeddings.parquet")
        return d

    made: dict[int, str] = {}
    return lambda first: made.setdefault(first, None) or made.update({first: make(first)}) or made[first]


def agrees(spark, name, d):
    import duckdb

    import __spark_entry__

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    want = c.execute(f"SELECT * FROM ({__spark_entry__.oracle_sql()[name]}) ORDER BY ALL")
    columns = [x[0] for x in want.description]
    got = __spark_entry__.queries()[name](spark, d).select(*columns).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)


def test_keypoints_are_not_broadcast(spark):
    """Estimates leave out that a descriptor becomes 16 x 17 rows, so the probes looked small."""
    from motifspark.operators.vote import shared_keypoints

    rows = spark.range(5000).selectExpr("CAST(id AS INT) AS image", "0 AS kp", "array(id, id, id, id) AS d")
    assert "Broadcast" not in shared_keypoints(rows, rows)._jdf.queryExecution().executedPlan().toString()


def test_keypoint_run_sends_no_rows_to_the_driver(spark, monkeypatch):
    """Descriptors, matches and labels were broadcast while they were small as written."""
    import __spark_entry__
    from motifspark.operators import runs

    plans, settle = {}, runs.settle
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(runs, "settle", lambda df, name: plans.setdefault(name, text(df)) and settle(df, name))
    plans["predictions"] = text(__spark_entry__.queries()["keypoint_run"](spark, SF))
    assert {"keypoints-points", "keypoints-matches"} < set(plans)
    assert not [n for n in ("keypoints-points", "keypoints-matches", "predictions") if "Broadcast" in plans[n]]


def test_keypoint_run_past_the_shift(spark, grown):
    assert agrees(spark, "keypoint_run", grown(1))  # ids 5 and 100005 are one image, as in the SQL


def test_keypoint_run_with_ids_of_copies(spark, grown, tmp_path):
    """Vector 100220 has the id of 220's near copy, so it holds that copy's descriptors, which vector 1 shares, and is in once."""
    import duckdb

    import __spark_entry__

    h = sum(1 << i for i in range(1, 12))
    g = h ^ 220 << 20 ^ 7 << 40  # three bits from the copy, eight from the vector: 12 and 32 bits of a descriptor
    bits = lambda x: F.array(*[F.lit(float(x >> i & 1)).cast("float") for i in range(64)])
    e = spark.read.parquet(f"{grown(0)}/embeddings.parquet")
    e.withColumn("embedding", F.when(F.col("vec_id") == 220, bits(h)).when(F.col("vec_id") == 1, bits(g)).otherwise(F.col("embedding"))).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: (r.template, r.pred) for r in __spark_entry__.queries()["keypoint_run"](spark, str(tmp_path)).collect()}
    labels = {r.vec_id: f"t{r.label}" for r in e.collect()}
    assert got[100220] == (labels[100220], labels[1])
    assert set(got) == {i for i in labels if i % 5 == 0}
    c = duckdb.connect(config={"threads": 1})  # any_value takes the vector's own row where rows come in order
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {i: (t, p) for i, t, p in c.execute(f"SELECT id, template, pred FROM ({__spark_entry__.oracle_sql()['keypoint_run']})").fetchall()}


@pytest.mark.parametrize("name", ["streamed_assignment", "nearest_representative"])
def test_part_files_and_ids_past_the_shift(spark, grown, name):
    assert agrees(spark, name, grown(0))  # copies of 0, 4, ... have the ids 100000, 100004, ... of other vectors


def test_streamed_assignment_takes_every_row(spark, grown, tmp_path):
    """Ids from 100,000 on were left out; so were ids before a day under zero, and null ones. Two rows of one id: the nearest counts."""
    import __spark_entry__

    e = spark.read.parquet(f"{grown(0)}/embeddings.parquet")
    label = {r.vec_id: r.label for r in e.collect()}
    twin = next(i for i in range(20, 250) if label[i] != label[15])
    other = {1: "NULL", 2: "5000000000000000", 3: "-100001", twin: "15"}
    e.withColumn("vec_id", F.expr("CASE vec_id " + " ".join(f"WHEN {i} THEN CAST({x} AS BIGINT)" for i, x in other.items()) + " ELSE vec_id END")).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.id for r in __spark_entry__.queries()["streamed_assignment"](spark, str(tmp_path)).collect()]
    assert len(got) == 499 and set(got) == (set(label) - set(other)) | {None, 5 * 10**15, -100001, 15}
    assert agrees(spark, "streamed_assignment", str(tmp_path))


def test_streamed_counts_of_part_files(spark, tmp_path):
    import __spark_entry__

    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    name = next(n for n, q in __spark_entry__.queries().items() if n.startswith("streamed") and n != "streamed_assignment")
    one, parts = (sorted(map(tuple, __spark_entry__.queries()[name](spark, d).collect())) for d in (SF, str(tmp_path)))
    assert one == parts and one


@pytest.mark.parametrize("radius", [0, 3, 8, 11])
def test_bands_of_any_number_find_every_pair(spark, monkeypatch, radius):
    """The plan follows the counts, so each number of bands is tried with counts that choose it."""
    import random

    from motifspark.operators import hashjoin

    r = random.Random(radius)
    base = [r.getrandbits(63) for _ in range(12)]
    near = lambda: r.choice(base) ^ sum(1 << b for b in r.sample(range(63), r.choice([0, 1, radius, radius + 1])))
    a, b = ({near() for _ in range(60)} for _ in range(2))
    want = {(h, g, (h ^ g).bit_count()) for h in a for g in b if (h ^ g).bit_count() <= radius}
    x, y = (spark.createDataFrame([(h,) for h in s], "h long") for s in (a, b))
    plan, tried = hashjoin.band_plan, set()
    for n in (10, 10**4, 10**6):
        monkeypatch.setattr(hashjoin, "band_plan", lambda radius, left, right: plan(radius, n, n))
        tried.add(len(plan(radius, n, n)))
        joined = hashjoin.banded(x, y, radius)
        assert {tuple(p) for p in joined.collect()} == want
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert len(tried) > 1 or radius == 0


def test_hash_compares_with_a_variable(spark):
    """The sort for the median stood inside the comparison of each of the 64 bits and ran once for each."""
    from motifspark.functions.vectors import coefficient_hash

    plan = spark.range(1).select(coefficient_hash(F.array(*[F.rand(i) for i in range(64)])).alias("h"))._jdf.queryExecution().analyzed().toString()
    compared = plan[plan.index(" > ") + 3 :]
    assert compared.startswith("lambda")


@pytest.mark.parametrize("labels", [3, 400])
def test_votes_shuffle_labels_not_edges(spark, labels):
    """Edges of a wide radius come as counts by label and distance; the votes of the grid are those of plain edges."""
    import random

    from motifspark.operators import hashjoin, vote

    r = random.Random(labels)
    q, refs = ([(i, f"t{r.randrange(labels)}", r.choice([None, r.getrandbits(12), r.getrandbits(12)])) for i in range(n)] for n in (30, 400))
    a, b = (vote.pointed(spark.createDataFrame(t, "id long, template string, h long"), "h") for t in (q, refs))
    near = vote.distinct_edges(a, b, hashjoin.radius_join, 7, "h")
    pairs = [(i, t, (h ^ g).bit_count()) for i, _, h in q for _, t, g in refs if h is not None and g is not None and (h ^ g).bit_count() <= 7]
    assert near.agg(F.sum("copies")).first()[0] == sum(1 for i, _, _ in pairs if i == min(k for k, _, h in q if h == q[i][2]))
    if labels == 3:
        assert near.count() <= 30 * 3 * 8
    plain = spark.createDataFrame(pairs, "id long, label string, dist int")
    asked = a.select("id", F.col("template").alias("truth"), "point")
    got = {(x.grid, x.id): x.pred for x in vote.sweep(asked, near, [7, 2, 5]).collect()}
    for k, (radius, weights) in enumerate((x, w) for x in (7, 2, 5) for w in ("uniform", "distance")):
        want = {x.id: x.label for x in vote.votes(plain.filter(F.col("dist") <= radius), ["id"], weights).collect()}
        assert {i: got[k, i] for i, _, _ in q} == {i: want.get(i, "__OUTLIER__") for i, _, _ in q}


def test_kmeans_sends_no_pairs_of_centres(spark):
    from motifspark.operators.cluster import kmeans

    rows = spark.range(60).selectExpr("id", "array(CAST(id % 3 AS DOUBLE), CAST(id AS DOUBLE) / 1000) AS v")
    out, model = kmeans(rows, 3)
    assert model.getSolver() == "block"
    assert {len({r.id % 3 for r in out.collect() if r.cluster_id == c}) for c in range(3)} == {1}


@pytest.mark.parametrize("name", ["hamming_radius_join", "capped_neighbours", "prediction_counters"])
def test_radius_joins_of_labelled_hashes(spark, grown, name):
    """A label beside the hash, without copies, was taken for the tallied form and ended the query; ids past the shift are two rows of one id."""
    assert agrees(spark, name, grown(0))


def test_band_groups_grow_with_the_rows():
    """A million hashes were 700 probes each; now they are under 100, and under a hundredth of all pairs is compared."""
    from itertools import combinations

    from motifspark.operators.hashjoin import band_plan

    n = 10**6
    plan = band_plan(8, n, n)
    chosen = list(combinations(plan, len(plan) - 8))
    assert len(chosen) < 100
    assert sum(n * n * 0.5 ** sum(w for _, w in c) for c in chosen) < 0.01 * n * n


def test_counted_edges_multiply_copies(spark):
    from motifspark.operators import cluster, hashjoin

    rows = spark.createDataFrame([(i, 0) for i in range(400)] + [(i, 1) for i in range(350, 600)] + [(7, 7), (8, None)], "id long, h long")
    local = [(r.id, r.h) for r in rows.collect() if r.h is not None]
    want = sum(1 for a, x in local for b, y in local if a != b and (x ^ y).bit_count() <= 2)
    said = spark.createDataFrame([("t1",)], "pred_template string")
    near = hashjoin.near_hashes(rows, rows, 2)
    assert near.count() == 7  # three hashes, not 650 rows
    assert cluster.prediction_counters(said, hashjoin.edge_count(rows, 2)).first()["neighbour_edges"] == want


@pytest.mark.parametrize("name", ["dbscan_clusters", "cluster_names", "cluster_counters"])
def test_density_clusters_past_the_shift(spark, grown, name):
    """Two rows of one id, a vector and another's copy, were two points of one name and came out four times."""
    assert agrees(spark, name, grown(0))


def test_embedding_votes_are_those_of_the_sql(spark, grown, monkeypatch):
    from motifspark.operators import densejoin

    monkeypatch.setattr(densejoin, "LEAST_BLOCK", 64)
    assert agrees(spark, "embedding_vote_run", grown(0))
