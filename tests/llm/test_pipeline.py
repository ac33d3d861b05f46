"""The pipeline's stages, each against a plain version on its own input, and on an empty table."""

import os
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from motifspark.llm import quality, toxicity  # noqa: E402
from motifspark.llm.queries import tokenizer  # noqa: E402

DATA = "/root/testdata/sf0.01"
CLASHING = {"Score": "0.25", "SEVERITY": "7", "Rejected": "'own'", "N_Bytes": "3", "n_spans": "'x'", "predicted": "9"}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small table with labels, odd rows and clashing columns."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 260 and length(text) < 5000")
    some = " ".join(f"w{i}" for i in range(80))
    odd = [(None, None), (9001, ""), (9001, ""), (None, some), (9002, some + " end"), (9003, some.upper()), (9004, "one two"), (9005, "  \n"), (None, "lone text"), (9004, "one two three")]
    more = spark.createDataFrame([(i, t, None, "odd", len(t or "")) for i, t in odd], docs.schema)
    docs = docs.unionByName(more).withColumns({c: F.expr(v) for c, v in CLASHING.items()})
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def rows(df, cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def buffers(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_stages(spark, sf_dir, monkeypatch):
    models = {}
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "fit", lambda *a, f=module.fit, m=module.__name__: models.setdefault(m, f(*a)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = docs.columns
    ran = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/after-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        ran[name] = docs, spark.read.parquet(path)
        docs = ran[name][1]
        if name != "packing":
            assert docs.columns == cols and (name == "suffix_dedup" or docs.select(cols).dtypes == ran[name][0].dtypes)
            assert all(docs.filter(f"{c} is distinct from {v}").isEmpty() for c, v in CLASHING.items())

    def kept(name, good):
        own, out = (Counter(rows(d, cols)) for d in ran[name])
        assert out == Counter({r: n for r, n in own.items() if good(r[cols.index("text")])})

    tox = models[toxicity.__name__]
    weight = dict(zip(tox.features.tolist(), tox.weights.tolist()))

    def clean(text):
        seen = Counter(toxicity.tokens(*buffers(text))[1].tolist())
        eta = sum(float(np.log1p(n)) * weight.get(f, 0.0) for f, n in sorted(seen.items()))
        return 1 / (1 + np.exp(-(eta - tox.thresholds[0]))) < 0.5

    votes = models[quality.__name__]
    vectors = votes.vectors.astype(np.float64)

    def good(text):
        x = (quality.features(*buffers(text))[0] * votes.weight) @ votes.basis
        cosine = vectors @ (x / max(float(np.linalg.norm(x)), 1e-9))
        near = cosine >= np.sort(cosine)[-votes.neighbours] - 1e-7
        w = np.maximum(cosine[near], 0) ** 20 + 1e-9
        return (w * votes.labels[near]).sum() / w.sum() >= 0.3

    kept("toxicity", clean)
    kept("quality", good)
    assert ran["toxicity"][1].count() < ran["toxicity"][0].count() and ran["quality"][1].count() < ran["quality"][0].count()

    before, after = (rows(d, ["doc_id", "text"]) for d in ran["near_dedup"])
    wordless = [r for r in before if not (r[1] or "").strip()]
    assert Counter(r for r in after if not (r[1] or "").strip()) == Counter(wordless)
    worded = [r for r in before if (r[1] or "").strip()]
    found = brute.near_groups([(i, t) for i, (_, t) in enumerate(worded)], 5)
    groups = {}
    for i, (_, component) in found.items():
        groups.setdefault(component, []).append(worded[i])
    left = [r for r in after if (r[1] or "").strip()]
    assert len(left) == len(groups) and len(groups) < len(worded)
    place = {r: c for c, own in groups.items() for r in own}
    assert {place[r] for r in left} == set(groups)
    for r in left:
        ids = [i for i, _ in groups[place[r]] if i is not None]
        assert r[0] == (min(ids) if ids else None)

    before, after = (rows(d, ["doc_id", "text"]) for d in ran["suffix_dedup"])
    assert sorted(((i, t) for i, t in after), key=str) == sorted(((i, t) for (i, _), t in zip(before, brute.cut_texts([t for _, t in before]))), key=str)
    assert ran["suffix_dedup"][1].filter("n_chars <> length(text)").isEmpty()

    pieces = ran["packing"][1].toPandas()
    texts = ran["suffix_dedup"][1].select("doc_id", "text").toPandas()
    once = texts[~texts.doc_id.duplicated(keep=False) & texts.doc_id.notna()]
    of_once = pieces[pieces.doc_id.isin(once.doc_id)]
    brute.check_ids(of_once, dict(zip(once.doc_id, once.text)), tokenizer("byte_bpe_50k.json"))
    assert pieces.drop_duplicates(["doc_id", "start", "sequence_id", "offset"]).shape == pieces.shape
    assert (pieces.groupby("sequence_id").length.sum() == pieces.assign(e=pieces.offset + pieces.length).groupby("sequence_id").e.max()).all()
    assert pieces[pieces.start == 0].shape[0] == len(texts)


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
