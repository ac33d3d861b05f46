"""Lexical search, spelling variants and decontamination against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from motifspark.llm import decontaminate, lexical, spelling, terms
from motifspark.llm.common import stage

DOCS = "doc_id long, text string, score double, word string, n long"
ITEMS = "item_id string, text string, doc_id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    lexicon = ["the", "of", "É", "42", *("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(150))]
    some = lambda n: " ".join(rnd.choices(lexicon, [400 / (k + 1) for k in range(len(lexicon))], k=n))
    out = [(i, some(rnd.randint(1, 120)).upper() if i % 9 == 0 else some(rnd.randint(1, 120)) + ",.") for i in range(400)]
    out += [(500, None), (501, ""), (502, "!?"), (None, some(40)), (7, out[7][1]), (7, out[8][1]), (503, out[7][1]), (503, out[7][1]), (504, some(20000))]
    return out


@pytest.fixture(scope="module")
def asks(rows):
    rnd = random.Random(3)
    own = [t for _, t in rows if t and len(t) < 2000]
    out = [(f"i{k}", " ".join(rnd.choice(own).split()[k % 5 :][:40])) for k in range(25)]
    return [*out, ("none", None), ("none", ""), ("short", "the of"), ("odd", "zzz Zzz"), (None, "The of " * 6), ("i1", "of the 42 É of")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, "x", 2) for i, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def items(spark, asks):
    return spark.createDataFrame([(i, t, 3) for i, t in asks], ITEMS)


def ranked(rows, asks, k):
    """(item position, rank, id, score) by scoring every document."""
    counts = [(i, Counter(WORD.findall(small(t)))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for _, text in asks:
        got = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in WORD.findall(small(text)))
            if s > 0:
                got.append((-s, i is None, i or 0))
        out.append([(r + 1, None if u else i, -s) for r, (s, u, i) in enumerate(sorted(got)[:k])])
    return out


@pytest.mark.parametrize("group", [1 << 20, 300])
def test_search(spark, docs, items, rows, asks, monkeypatch, group):
    monkeypatch.setattr(lexical, "asked_groups", lambda *a: terms.asked_groups(*a, group))
    got = Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(docs, items, k=7).collect())
    want = Counter((asks[q][0], *x) for q, xs in enumerate(ranked(rows, asks, 7)) for x in xs)
    assert got == want


def test_search_of_nothing(spark, docs, items):
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none, items).count() == lexical.search(docs, asked).count() == 0
    assert lexical.search(none, items).columns == lexical.search(docs, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_passed_over_only_by_their_bound():
    rng = np.random.default_rng(2)
    n, size = 3000, 60
    topic = rng.integers(0, 6, n)
    terms_ = [np.unique(np.concatenate([rng.integers(10 * t, 10 * t + 10, 6), rng.integers(0, size, 2)])) for t in topic]
    ends = np.append(0, np.cumsum([len(t) for t in terms_]))
    flat = np.concatenate(terms_)
    weights = rng.integers(1, 10**6, len(flat))
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), ends, flat, weights, size)
    queries = [(np.array([10 * t, 10 * t + 3, 10 * t + 7, (10 * t + 25) % size]), np.array([1, 2, 1, 1])) for t in range(6)]
    best = [lexical.Best(5) for _ in queries]
    evaluated = lexical.search_shard(shard, queries, best, size)
    full = np.zeros((n, size), np.int64)
    full[np.repeat(np.arange(n), np.diff(ends)), flat] = weights
    matched = 0
    for (t, c), own in zip(queries, best):
        s = full[:, t] @ c
        matched += int((s > 0).sum())
        order = np.lexsort((np.arange(n), -s))[:5]
        assert own.ids.tolist() == order.tolist() and own.scores.tolist() == s[order].tolist()
    assert evaluated < matched * 2 / 3
    docs, of, starts = shard.blocks(3)
    assert sorted(docs) == sorted(shard.list_of(3)[0]) and np.diff(starts).max() <= lexical.BLOCK
    for b in range(len(starts) - 1):
        assert (full[docs[starts[b] : starts[b + 1]], 7].max() == shard.maxima(3, 7)[b]) and (of[docs[starts[b] : starts[b + 1]]] == b).all()


def spelt(rows, least=7, times=2, factor=10):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", small(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    n = {w: c for w, c in n.items() if c >= times}
    cuts = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            cuts[w[:k], w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), ws in cuts.items():
        for w in ws | ({a + b} & n.keys()):
            for v in ws | ({a + b} & n.keys()):
                if v != w:
                    near[w].add(v)
    # two words that both lose a letter to become a third are only near if they lose it at one place
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def letters():
    rnd = random.Random(8)
    stems = ["".join(rnd.choice("abéÿ") for _ in range(rnd.randint(7, 11))) for _ in range(60)] + ["commonbeginning" + x for x in "abcdefghijklmnopqrstuvwxyz"] + ["z" * 900, "z" * 901]
    out = []
    for k in range(300):
        words = rnd.choices(stems, [1000 // (j + 1) ** 2 + 1 for j in range(len(stems))], k=60)
        for j in range(len(words)):
            if rnd.random() < 0.15:
                w, p = words[j], rnd.randrange(len(words[j]))
                words[j] = rnd.choice([w[:p] + w[p + 1 :], w[:p] + "a" + w[p:], w[:p] + "b" + w[p + 1 :], w.upper(), w + "é"])
        out.append((k, "1 ".join(words)))
    return [*out, (900, None), (901, ""), (None, " ".join(stems)), (3, out[3][1]), (902, " ".join(stems * 40)), (903, "short × ÷ words")]


@pytest.mark.parametrize("block", [spelling.BLOCK, 5])
def test_spelling(spark, letters, monkeypatch, block):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (7, block))
    docs = spark.createDataFrame([(i, t, 1.0, "x", 2) for i, t in letters], DOCS).repartition(4)
    got = spelling.variants(docs).collect()
    assert len(got) == len({r.word for r in got})
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == spelt(letters)
    assert any(r.root not in (r.word, r.form) for r in got)


def test_near_pairs_once_each(spark, letters):
    words = stage(spark.createDataFrame([(w, v[2]) for w, v in spelt(letters).items()], "word string, n long"), "words")
    got = [(r.word, r.near) for r in spelling.near_pairs(words, block=16).collect()]
    assert len(got) == len(set(got)) == sum(v[3] for v in spelt(letters).values())


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, 1.0, "x", 1), (2, "a b", 1.0, "x", 1)], DOCS)).count() == 0


def hits(rows, asks, window=10):
    wins = defaultdict(set)
    for i, t in asks:
        ws = WORD.findall(small(t))
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            wins[tuple(ws[k : k + window])].add(i or "")
    out = []
    for i, t in rows:
        ws = WORD.findall(small(t))
        hit, found = set(), set()
        for n in {len(w) for w in wins}:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[w]
        out.append((i, len(ws), len(hit), tuple(sorted(found)), len(found), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("group", [1 << 20, 300])
def test_decontamination(spark, docs, items, rows, asks, monkeypatch, group):
    monkeypatch.setattr(decontaminate, "asked_groups", lambda *a: terms.asked_groups(*a, group))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 20_000)
    got = decontaminate.decontaminate(docs, items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.n_items, r.contaminated) for r in got) == hits(rows, asks)


def test_decontamination_of_nothing(spark, docs, items, rows):
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.decontaminate(none, items).count() == 0
    got = decontaminate.decontaminate(docs, asked).collect()
    assert len(got) == len(rows) and not any(r.n_hit or r.contaminated or r["items"] for r in got)


def test_proximity(spark, rows, asks):
    some = [(i, t) for i, t in rows if i is not None and i < 60 and t]
    asked = [("a", "the of 42"), ("b", "of the of É"), ("c", "the the"), ("d", "É")]
    docs = spark.createDataFrame([(i, t, 1.0, "x", 2) for i, t in some], DOCS)
    got = decontaminate.matches(docs, spark.createDataFrame([(*a, 1) for a in asked], ITEMS), window=10, within=12).collect()
    want = set()
    for i, t in set(some):
        ws = WORD.findall(small(t))
        for name, text in asked:
            win = WORD.findall(small(text))
            need = Counter(win)
            covers = {(s, e) for s in range(len(ws)) for e in range(s + 1, min(len(ws), s + 12) + 1) if not need - Counter(ws[s:e])}
            want |= {(i, name, "near", s, e) for s, e in covers if not any(s <= a and b <= e and (a, b) != (s, e) for a, b in covers)}
            want |= {(i, name, "phrase", s, s + len(win)) for s in range(len(ws)) if ws[s : s + len(win)] == win}
    assert Counter(map(tuple, got)) == Counter(want)
    with pytest.raises(ValueError):
        decontaminate.matches(docs, docs, window=10, within=3)
