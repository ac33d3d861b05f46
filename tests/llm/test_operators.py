"""The training-data operators against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from motifspark.llm import chat, minhash, packing, pieces, pivots, quality, sharding, suffix_dedup, toxicity, vptree  # noqa: E402
from motifspark.llm.common import RangeHash  # noqa: E402
from motifspark.llm.components import components  # noqa: E402
from motifspark.llm.queries import tokenizer  # noqa: E402

DOCS = "doc_id long, text string, n_bytes long, score double"


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, base = some(60), some(150)
    out = [None, "", " \t\n ", "one", "ONE", "a b c", "A  b\tc", base, base, base.upper(), passage]
    for _ in range(12):  # near copies
        w = base.split()
        w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [some(20) + passage + some(20) for _ in range(6)]
    out += ["ab" * 400, "x" * 700, some(4000), "日本語 " * 90, "<|endoftext|> </s> ▁▁ a  b ", "\x00\x1f é\u2028 z"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [*((i, x) for i, x in enumerate(t)), (3, "one"), (3, "one"), (900, t[7])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, x, 1, 0.5) for i, x in rows], DOCS).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(spark, docs, none, rows):
    got = sharding.shard(docs, limit=4000).toPandas()
    assert len(got) == len(rows)
    size = {}
    for r in got.itertuples():
        h = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16)
        assert h >> (32 - r.shard_depth) == r.shard_prefix
        size.setdefault((r.shard_depth, r.shard_prefix), []).append(len((r.text or "").encode()))
    for (depth, prefix), own in size.items():
        assert sum(own) <= 4000 or len(own) == 1
        assert all(not (d < depth and prefix >> (depth - d) == p) for d, p in size)
    hot = spark.range(400).select(F.lit(7).alias("doc_id"), F.concat(F.lit("x" * 90), F.col("id")).alias("text"))
    parts = sharding.shard(hot, limit=9000).groupBy("shard_part").agg(F.sum(F.octet_length("text")).alias("b")).toPandas()
    assert len(parts) > 3 and parts.b.max() <= 9000
    assert sharding.shard(none).count() == 0


def test_sharding_hot_keys(spark, monkeypatch):
    """Copies of one row and large rows under one key, and null keys: no part but a single row is over the limit, and bytes are the part's."""
    monkeypatch.setattr(sharding, "RUN_BITS", 3, raising=False)
    copies = [(7, "c" * 90)] * 300
    large = [(8, x * 5400) for x in "abc"] + [(8, "d" * 20000), (8, "e" * 4500), (8, "f" * 10), (8, None)]
    null = [(None, "n" * (i % 50)) for i in range(1000)] + [(None, "")] * 20
    data = [*copies, *large, *null, (1, "one")]
    got = sharding.shard(spark.createDataFrame(data, "doc_id long, text string").repartition(5), limit=9000, name="hot").toPandas()
    same = lambda x: sorted(x, key=str)
    assert same((None if r.doc_id != r.doc_id else int(r.doc_id), r.text) for r in got.itertuples()) == same(data)
    for _, own in got.groupby(["shard_depth", "shard_prefix", "shard_part"]):
        size = sum(len((t or "").encode()) for t in own.text)
        assert (size <= 9000 or len(own) == 1) and set(own.shard_bytes) == {size} and set(own.shard_docs) == {len(own)}
    for k, least in ((7, 4), (8, 5)):
        parts = set(got[got.doc_id == k].shard_part)
        assert parts == set(range(len(parts))) and least <= len(parts) <= 2 * least


def test_chat(spark):
    says = r"\### Assistant: </turn> ok"
    data = [(-7, 0, "user", says, 1), (-7, 1, "assistant", says, 1), (1, 0, "system", None, 1), (1, 1, "user", "###</turn>\n:\n\\h", 1), (1, 2, "assistant", "a", 1), (1, 3, "user", "b", 1), (1, 4, "assistant", "", 1), (2, 0, "user", "q", 1), (2, 0, "user", "q", 1), (None, 0, "assistant", "é", 1)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, n_turns int")
    examples = chat.expand(turns)
    assert sorted((r.conv_id or 0, r.example_no, r.n_turns) for r in examples.collect()) == [(-7, 0, 2), (0, 0, 1), (1, 0, 3), (1, 1, 5), (2, 0, 2)]
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    for conv in (-7, 1, 2, None):
        own = [(r, t or "") for c, _, r, t, _ in data if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for s in ["\\", "\\h", "####", ":\n", "</turn>\n", "<", "\\\\c", "a:\n###"]:
        assert chat.unescape(chat.escape(s)) == s and chat.parse("".join(chat.render(s, s))) == [(s, s)]
    assert chat.digest(chat.expand(turns.limit(0))).count() == 0


def test_suffix_dedup_of_a_hot_passage(spark):
    """One passage in unlike surroundings: more contexts for its grams than one task takes."""
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = some(70)
    own = [some(rnd.randint(0, 60)) + passage + some(rnd.randint(0, 60)) for _ in range(300)]
    got = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(6), window=30, gram=12, heavy=40).toPandas()
    want = {i: x for i, x in enumerate(brute.suffix_dedup(own, 30))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == want


def test_a_repeated_id_is_one_labelled_text(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in (1, 2, 3, 4) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (4, 0)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, "quality", 3).collect()
    assert len(rows) == len({(r.doc_id, r.label) for r in rows}) == 3
    assert set(rows) == set(quality.training_rows(docs.repartition(7), labels, "quality", 3).collect())


@pytest.mark.parametrize("window, gram, heavy", [(200, 40, 5000), (30, 12, 5000), (30, 12, 1)])
def test_suffix_dedup(docs, rows, window, gram, heavy):
    got = suffix_dedup.dedup(docs, window=window, gram=gram, heavy=heavy).toPandas()
    want = sorted(zip((i for i, _ in rows), brute.suffix_dedup([t for _, t in rows], window)))
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got.itertuples()) == want
    assert sum(r.n_removed for r in got.itertuples()) > 0


def test_suffix_empty(none):
    assert suffix_dedup.dedup(none).count() == 0


def test_merge_runs():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))).encode() for _ in range(300)]
    runs = [sorted((w, b"", 1, 2, 3, 4) for w in words[i::7]) for i in range(7)]
    got = list(suffix_dedup.merge_runs([suffix_dedup.decode_run(suffix_dedup.encode_run(r)) for r in runs]))
    assert [r[1] for _, r in got] == sorted(words)
    for (_, a), (shared, b) in zip(got, got[1:]):
        assert shared == len(os.path.commonprefix([a[1], b[1]]))


def test_packing(spark, none):
    t = dict(enumerate(texts()))
    docs = spark.createDataFrame([(i, x, 1, 0.5) for i, x in t.items()], DOCS)
    brute.check_packing(packing.pack(docs, tokenizer("byte_bpe_50k.json"), window=128).toPandas(), t, tokenizer("byte_bpe_50k.json"), 128)
    again = packing.pack(docs.unionByName(docs), tokenizer("byte_bpe_50k.json"), window=128)
    spots = again.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert spots.filter("n <> m or n > 128").count() == 0
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_text_ids():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert packing.byte_ranks(library) is not None
    rnd = random.Random(3)
    letters = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]] + list(" \n\t'") * 60 + list("sdmtlvre") * 40
    many = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200))) for _ in range(800)]
    many += [a + c + b for c in letters[: 0x250 + 24] for a in ("", "a", "1", " ", "\n", "'") for b in ("", "b", " ", "2")]
    many += ["\U0001f600 \u4e2d\u6587 \u0661\u0662", "a <|endoftext|> b", "x" + " " * 3000 + "y", "\n" * 2000, "ab" * 20000]
    for text, ids in zip(many, packing.text_ids(path)(many)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_pack_counts():
    histogram = {i: 1 + i * 7 % 50 for i in range(1, 128)}
    plan = packing.pack_counts(histogram, 128)
    seen = {}
    for lengths, n in plan:
        assert sum(lengths) <= 128
        for x in lengths:
            seen[x] = seen.get(x, 0) + n
    assert seen == histogram


def vectors(spark):
    g = np.random.default_rng(3)
    v = [*g.normal(size=(300, 8)).round(2).tolist(), [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, None, []]
    v += [v[0], v[0], v[1]]
    return v, spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, score int")


def test_vantage_points(spark):
    v, table = vectors(spark)
    ok = {i: np.array(x) for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and np.any(x)}
    found = {}
    for r in vptree.nearest(table, F.col("vec_id") % 20 == 0, k=5, factor=1.0, shard_rows=100, block_rows=8).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ok if i % 20 == 0}
    for q, own in found.items():
        want = sorted((float(np.sqrt(((ok[q] - x) ** 2).sum())), i) for i, x in ok.items() if i != q)[:5]
        own.sort()
        assert [i for _, i, _ in own] == [i for _, i in want] and np.allclose([s for *_, s in own], [s for s, _ in want], atol=1e-12)
    rough = vptree.nearest(table, F.col("vec_id") % 20 == 0, k=5, factor=0.5, shard_rows=100).select("query_id", "vec_id").collect()
    assert len({tuple(r) for r in rough} & {(q, i) for q, own in found.items() for _, i, _ in own}) >= 0.9 * 5 * len(found)
    assert vptree.nearest(table.limit(0), F.lit(True)).count() == 0


def test_pivots(spark):
    v, table = vectors(spark)
    ok = {i: np.floor(64 * np.array(x)).astype(int) for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all()}
    found = {}
    for r in pivots.top_inner_products(table, F.col("vec_id") % 20 == 0, k=6, shard_rows=100, block_rows=8).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ok if i % 20 == 0}
    for q, own in found.items():
        want = sorted((-int(ok[q] @ x), i) for i, x in ok.items() if i != q)[:6]
        assert [(i, s) for _, i, s in sorted(own)] == [(i, -s) for s, i in want]
    assert pivots.top_inner_products(table.limit(0), F.lit(True)).count() == 0


def test_repeated_ids(spark):
    """Copies of a row are one query and a candidate each; query rows with one id and other vectors have k rows each."""
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.0, 2.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    near = vptree.nearest(table, F.col("vec_id") == 0, k=2).collect()
    assert sorted((r["rank"], r.vec_id) for r in near) == [(1, 1), (1, 2), (2, 1), (2, 1)]
    top = pivots.top_inner_products(table, F.col("vec_id") == 0, k=2).collect()
    assert sorted((r["rank"], r.vec_id) for r in top) == [(1, 1), (1, 2), (2, 1), (2, 1)]


def test_pieces(docs, none, rows):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.digest(docs, path).collect()}
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert sum(r.n_corrected for r in got.values()) == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert all(back[i] == (t or "") for i, t in rows if not (t or "").startswith(" ") and "▁" not in (t or ""))
    assert pieces.encode(none, path).count() == 0 and pieces.digest(none, path).count() == 0
    long = "abracadabra" * 9
    v = pieces.Vocabulary(path)
    assert v.heap("▁" + long) == sp.encode(long) and v.rows(["▁abra", "▁▁▁x"]) == [sp.encode("abra"), sp.encode("  x")]


def test_near_groups(docs, none, rows):
    for words in (4, 5):
        want = brute.near_groups(rows, words)
        got = minhash.groups(docs, words=words, name=f"t{words}").toPandas()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.itertuples()) == sorted((rows[i][0], n, c) for i, (n, c) in want.items())
        assert (got.kept == (got.doc_id == got.component_id)).all()
    assert minhash.groups(none).count() == 0
    with pytest.raises(ValueError):
        minhash.groups(none, percent=70)
    kept = {r.doc_id for r in minhash.keep_one(docs).collect()}
    assert 7 in kept and not kept & {8, 900}  # upper-casing 9 changes more than A-Z


def test_keep_one_rows(spark):
    """Null ids, and one id with several texts: a row of each group stays, whatever its id."""
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(30)) for p in "abcd")
    near = c.replace("c29", "other")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, near), (None, d), (7, d), (None, a), (8, "x"), (8, "x"), (9, ""), (9, None), (None, " \t"), (None, None)]
    got = [(r.doc_id, r.text) for r in minhash.keep_one(spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], DOCS).repartition(3), name="rows").collect()]
    worded = sorted((r for r in got if (r[1] or "").strip()), key=str)
    of_c = [r for r in worded if r in ((None, c), (None, near))]
    assert len(of_c) == 1 and sorted([r for r in worded if r not in of_c], key=str) == sorted([(3, a), (5, b), (7, d), (8, "x")], key=str)
    assert sorted((r for r in got if not (r[1] or "").strip()), key=str) == sorted(rows[-4:], key=str)


def test_range_hash():
    """Equal bytes, equal hashes; the Thue-Morse words, which collide modulo any power of two, differ."""
    a, b = b"a", b"b"
    for _ in range(12):
        a, b = a + b, b + a
    data = np.frombuffer(a + b + a, np.uint8)
    hashed, n = RangeHash(data), len(a)
    x, y, z = hashed(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert x == z and x != y
    grams = hashed.grams(1024)
    seen = {}
    for i, h in enumerate(grams.tolist()):
        assert seen.setdefault(h, data[i : i + 1024].tobytes()) == data[i : i + 1024].tobytes()
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("words", [4, 5])
def test_shingles_of_short_slices(words):
    """Slices that hold fewer words in all than a shingle has."""
    for own in (["a"], ["hello world"], ["a", "b"], ["", "x y"], ["a b c"], ["a b", "C"], ["a b c d"], ["", ""]):
        raw = [t.encode() for t in own]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        doc, value = minhash.shingles(np.frombuffer(b"".join(raw), np.uint8), off, words)
        assert doc.tolist() == [i for i, t in enumerate(own) if t] and len(set(value.tolist())) == len(doc)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(60, 61), (61, 60), (62, 62), (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(edges).filter("node <> 62").collect()} == {**{i: 0 for i in range(51)}, 60: 60, 61: 60}


def test_quality_and_toxicity(spark, none):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    docs, labels = read("documents").withColumn("score", F.lit(1)), read("labels")
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95 and scored.score.between(0, 1).all()
    at = lambda sf, t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    # labels that the fit has not seen; 51 toxic texts in four languages are too few to learn more than the largest language
    for sf, recall in (("sf0.01", 0.6), ("sf0.1", 0.9)):
        model = toxicity.fit(at(sf, "documents"), at(sf, "labels").filter(~held))
        rejected = toxicity.score(at(sf, "documents"), model).join(at(sf, "labels").filter(held), "doc_id").toPandas()
        toxic = rejected.toxic == 1
        assert rejected.rejected[toxic].mean() > recall and rejected.rejected[~toxic].mean() < 0.01 and rejected.severity.between(0, 3).all()
        assert (np.diff(model.thresholds) > 0).all() and rejected.severity[toxic].mean() > 5 * rejected.severity[~toxic].mean()
    both = labels.unionByName(labels.withColumn("toxic", F.lit(1)).limit(3)).unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert len(toxicity.fit(docs.unionByName(docs), both).features)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (3, "  ")], "doc_id long, text string")
    voters = quality.fit(docs, labels)
    assert [r.score for r in quality.score(odd, voters).filter("doc_id < 3").collect()] == pytest.approx([float(voters.labels.mean())] * 2)
    named = docs.withColumnsRenamed({"lang": "predicted", "source": "rejected"}).withColumn("severity", F.lit("s"))
    assert quality.score(named, voters).count() == toxicity.score(named, toxicity.fit(docs, labels.limit(0))).count() == docs.count()
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).filter("rejected").count() == 0
    assert quality.score(none, quality.fit(none, labels)).count() == 0 and toxicity.score(none, toxicity.fit(none, labels)).count() == 0
