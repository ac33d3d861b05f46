"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

A signature has CHUNKS x SYMBOLS b-bit MinHash symbols, and the signature distance of two texts is the number
of symbols that differ. By pigeonhole, of two signatures at distance d some chunk has at most
floor(d / CHUNKS) errors. One error is allowed in a chunk and every place it can be is enumerated (a chunk's
key leaves that symbol out), so all pairs at a distance up to 2 * CHUNKS - 1 meet, whatever symbols differ, and
almost all others over the wanted similarity do: a link at similarity 0.8 is missed with probability under 3e-6.
Every link is then confirmed on the full shingle sets.

Texts with equal sets are one class, so copies cost nothing. Inside an index bucket pairs are not all made:
every class is first compared with its best bucket leader, then with its other leaders across components, and
only then are pairs made between components that still share a bucket, so no link between two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, mix, rows_of, slices, stage, text_buffers
from .components import components

CHUNKS, SYMBOLS = 12, 6
WIDTH = CHUNKS * SYMBOLS
#: Pairs with fewer equal symbols are no candidates: five standard deviations under what similarity 0.8 expects.
LEAST_EQUAL = 40
#: The wide signature of classes whose buckets stay open: so many symbols of PLANES bits, as bit planes of longs.
WIDE, PLANES = 512, 4
#: Wide symbols that may differ: over five standard deviations more than similarity 0.8 expects.
MOST_APART = 144
#: Bits of a class's odd sketch: each is the parity of the shingles that hash to it.
ODD = 2048
#: Rounds of neighbours in open buckets, and parts that a bucket is dealt to for them.
TURNS, SALTS = 1, 32
_odd = mix(np.arange(1, WIDTH + WIDE + 1, dtype=np.uint64)) | np.uint64(1)
_add = mix(np.arange(1001, WIDTH + WIDE + 1001, dtype=np.uint64))


def shingles(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash), sorted and distinct, of runs of ``words`` words; A-Z lowered. A text with fewer words has one of all."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return none
    word = RangeHash(low)(s, e)
    doc = np.searchsorted(off, s, "right") - 1
    value = np.zeros(len(word), np.uint64)
    length = np.zeros(len(word), np.uint64)
    for k in range(min(words, len(word))):
        inside = np.zeros(len(word), bool)
        inside[: len(word) - k] = doc[k:] == doc[: len(word) - k]
        value[inside] = mix(value[inside] * np.uint64(0x9E3779B97F4A7C15) + word[np.flatnonzero(inside) + k] + np.uint64(k + 1))
        length += inside
    start = np.ones(len(doc), bool)
    start[1:] = doc[1:] != doc[:-1]
    keep = (length == words) | start
    doc, value = doc[keep], value[keep]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text that has shingles: (its number, set size, class hash, row of 16-bit symbols)."""
    if not len(doc):
        return doc, doc, np.zeros(0, np.int64), np.zeros((0, WIDTH), np.uint16)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, len(doc)))
    whole = mix(np.add.reduceat(mix(value), first) ^ mix(size.astype(np.uint64)))
    out = np.empty((len(first), WIDTH), np.uint16)
    for k in range(WIDTH):
        least = np.minimum.reduceat((value * _odd[k] + _add[k]) >> np.uint64(16), first)
        out[:, k] = mix(least) & np.uint64(0xFFFF)
    return doc[first], size, whole.view(np.int64), out


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of a signature's index entries: for every chunk and every symbol left out of it, a hash of the others."""
    n = len(symbols)
    out = np.empty((n, WIDTH), np.uint64)
    chunks = symbols.reshape(n, CHUNKS, SYMBOLS).astype(np.uint64)
    parts = mix(chunks * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, SYMBOLS + 1, dtype=np.uint64)[None, None])
    whole = parts.sum(2, dtype=np.uint64)
    for c in range(CHUNKS):
        for k in range(SYMBOLS):
            out[:, c * SYMBOLS + k] = mix(whole[:, c] - parts[:, c, k] + np.uint64((c * SYMBOLS + k + 1) * 0x1000003))
    return out.view(np.int64)


def _signed(words: int):
    def run(batches):
        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            for i, j in slices(off):
                doc, size, whole, symbols = signatures(*shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], words))
                n = np.zeros(j - i, np.int64)
                n[doc] = size
                at = np.full(j - i, -1)
                at[doc] = np.arange(len(doc))
                cls = pa.array([int(whole[k]) if k >= 0 else None for k in at], pa.int64())
                sig = pa.array([symbols[k].tobytes() if k >= 0 else None for k in at], pa.binary())
                kept = [c for c in ("doc_id", "row") if c in b.schema.names]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in kept), pa.array(n), cls, sig], [*kept, "n_shingles", "cls", "sig"])

    return run


def _keyed(batches):
    for b in rows_of(batches):
        cls, n = b.column("cls").to_numpy(), b.column("n").to_numpy()
        sig = np.frombuffer(b"".join(x.as_py() for x in b.column("sig")), np.uint16).reshape(-1, WIDTH)
        for i in range(0, len(cls), 2000):
            keys = index_keys(sig[i : i + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(cls[i : i + 2000], WIDTH)), pa.array(np.repeat(n[i : i + 2000], WIDTH))], ["key", "cls", "n"])


def odd_sketches(doc: np.ndarray, value: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each text of ``found``: its odd sketch as longs. Bits that differ between two sketches come from shingles of only one
    of the sets, so they are never more than the sets' symmetric difference."""
    out = np.empty((len(found), ODD // 64), np.int64)
    bit = (mix(value ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(ODD)).astype(np.int64)
    edges = np.append(np.searchsorted(doc, found), len(doc))
    for i in range(0, len(found), 1000):
        j = min(i + 1000, len(found))
        at = np.repeat(np.arange(j - i), np.diff(edges[i : j + 1])) * ODD + bit[edges[i] : edges[j]]
        odd = (np.bincount(at, minlength=(j - i) * ODD) & 1).astype(np.uint8).reshape(j - i, ODD)
        out[i:j] = np.packbits(odd, axis=1).view(np.int64)
    return out


def _planed(words: int):
    """Odd sketches and wide signatures of texts, the latter plane by plane."""

    def run(batches):
        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            for i, j in slices(off):
                doc, value = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                found, _, whole, _ = signatures(doc, value)
                first = np.searchsorted(doc, found)
                low = np.empty((len(found), WIDE), np.uint8)
                for k in range(WIDE if len(found) else 0):
                    low[:, k] = mix(np.minimum.reduceat((value * _odd[WIDTH + k] + _add[WIDTH + k]) >> np.uint64(16), first)) & np.uint64(255)
                planes = [np.packbits((low >> np.uint8(p)) & np.uint8(1), axis=1).view(np.int64).reshape(len(found), -1) for p in range(PLANES)]
                columns = [pa.array(plane[:, h].copy()) for plane in [*planes, odd_sketches(doc, value, found)] for h in range(plane.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(whole), *columns], ["cls", *WIDE_NAMES])

    return run


WIDE_NAMES = [f"bits{p}_{h}" for p in range(PLANES) for h in range(WIDE // 64)] + [f"odd_{h}" for h in range(ODD // 64)]


def symbols_apart(x: str, y: str):
    """Column: how many symbols of two rows' bit planes differ; the planes' names end in x and y."""
    apart = F.lit(0)
    for h in range(WIDE // 64):
        differ = [F.col(f"bits{p}_{h}{x}").bitwiseXOR(F.col(f"bits{p}_{h}{y}")) for p in range(PLANES)]
        every = differ[0]
        for d in differ[1:]:
            every = every.bitwiseOR(d)
        apart = apart + F.bit_count(every)
    return apart


def sketch_bits_apart(x: str, y: str):
    """Column: how many bits of two rows' odd sketches differ."""
    apart = F.lit(0)
    for h in range(ODD // 64):
        apart = apart + F.bit_count(F.col(f"odd_{h}{x}").bitwiseXOR(F.col(f"odd_{h}{y}")))
    return apart


def _equal(batches):
    for b in rows_of(batches):
        x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint16).reshape(-1, WIDTH) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).sum(1).astype(np.int32))], ["a", "b", "equal"])


def _sets(words: int):
    def run(batches):
        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            for i, j in slices(off):
                doc, value = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                found, _, whole, _ = signatures(doc, value)
                bounds = np.searchsorted(doc, np.append(found, j - i)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(whole), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))], ["cls", "shingles"])

    return run


def may_link(percent: int):
    """Condition on two rows side by side (_x, _y): sizes, odd sketches and wide signatures allow a link.

    100 * common >= percent * all means that at most (100 - percent) / (100 + percent) of the sizes' sum is in one set only.
    """
    sizes = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    sketches = sketch_bits_apart("_x", "_y") * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)
    return sizes & sketches & (symbols_apart("_x", "_y") <= MOST_APART)


def pairs_of(met: DataFrame) -> DataFrame:
    return met.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct()


class Links:
    """Confirmed links between classes; ``rows`` (doc_id, text) are those the classes come from."""

    def __init__(self, rows: DataFrame, signed: DataFrame, classes: DataFrame, words: int, percent: int, name: str):
        self.rows, self.signed, self.classes, self.words, self.percent, self.name = rows, signed, classes, words, percent, name
        self.times = 0

    def near(self, pairs: DataFrame) -> DataFrame:
        """(a, b, equal) of distinct pairs (a, b) whose signatures have enough equal symbols."""
        sig = self.classes.select("cls", "sig")
        met = pairs.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b")), "b")
        return met.select("a", "b", "sig_a", "sig_b").mapInArrow(_equal, "a long, b long, equal int").filter(F.col("equal") >= LEAST_EQUAL)

    def texts(self, need: DataFrame) -> DataFrame:
        """(text) of the rows that the classes asked for (cls) come from; of rows with a repeated id, all."""
        asking = need.join(self.classes.select("cls", "doc_id"), "cls").select(F.col("doc_id").alias("id")).distinct()
        return self.rows.join(asking, self.rows["doc_id"].eqNullSafe(asking["id"])).select("text")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough; sets are made again from the texts of the classes asked for."""
        self.times += 1
        asked = stage(pairs.select("a", "b").distinct(), f"{self.name}-asked{self.times}")
        need = asked.select(F.col("a").alias("cls")).unionByName(asked.select(F.col("b").alias("cls"))).distinct()
        sets = self.texts(need).mapInArrow(_sets(self.words), "cls long, shingles array<long>").join(need, "cls", "left_semi").dropDuplicates(["cls"])
        sets = stage(sets, f"{self.name}-sets{self.times}")
        both = asked.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        links = both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
        return stage(links.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * self.percent).select("a", "b"), f"{self.name}-links{self.times}")


def groups(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 5, percent: int = 80, name: str = "near") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    A row's set: its distinct runs of ``words`` words; with fewer words, all of them as one; without words or
    text, empty and linked with nothing. Rows with 100 * common >= percent * all shingles are linked, and
    component_id is the least id that a row is linked with over any number of links, its own included; kept
    says that it is the row's own. Rows with equal sets are linked. Rows are told apart by their texts, so
    repeated rows and repeated ids are rows like any other. A null id never is a component's id unless all are
    null. No rows in: no rows out. Other columns are not used.
    """
    signed, named = _linked(docs, text, id, words, percent, name)
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    by_class = stage(named.join(least, "part").select("cls", "component_id"), f"{name}-named")
    out = signed.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select(F.col("doc_id").alias(id), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False)))


def _linked(docs: DataFrame, text: str, id: str, words: int, percent: int, name: str, pick: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with their set's class, classes (cls, doc_id, part) with the component they are in); pick: with each class's
    first row (none, doc_id, row) too, null ids last. The index and the bounds on signatures are sized for 80 percent and more."""
    if percent < 80:
        raise ValueError("links under 80 percent would be missed")
    row = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row")] if pick else []
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), *row, F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stage(rows.mapInArrow(_signed(words), f"doc_id long, {'row long, ' if pick else ''}n_shingles long, cls long, sig binary"), f"{name}-signed")
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("pick")] if pick else []
    classes = stage(signed.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), *first), f"{name}-classes")
    index = classes.select("cls", "n", "sig").mapInArrow(_keyed, "key long, cls long, n long")
    # a table of its own, so that the join below it can split a bucket that very many classes share
    leads = stage(index.groupBy("key").agg(F.count("*").alias("c"), F.min("cls").alias("lead")).filter("c > 1").select("key", "lead"), f"{name}-leads")
    buckets = stage(index.join(leads, "key"), f"{name}-buckets")
    links = Links(rows, signed, classes, words, percent, name)

    # each class with the leaders of its buckets; first the one that leads most of them, then all that a link could still join
    led = stage(buckets.filter("cls <> lead").groupBy(F.col("lead").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("times")), f"{name}-led")
    best = led.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
    edges = links.confirm(links.near(best))
    found = components(edges, f"{name}-c1")

    def across(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component yet."""
        x, y = found.select(F.col("node").alias("a"), F.col("component").alias("p")), found.select(F.col("node").alias("b"), F.col("component").alias("q"))
        return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")

    edges = edges.unionByName(links.confirm(links.near(across(led))))
    found = components(edges, f"{name}-c2")

    # what still shares a bucket across components, by size, sketch, wide signature and set: first neighbours in a hash order of
    # each bucket (salted, so a hot bucket is many), which joins what is densely linked; then all pairs that are left
    bits = [F.col(c) for c in WIDE_NAMES]

    def open_rows(member: DataFrame, step: str) -> DataFrame:
        """Rows (key, cls, n, component) of the buckets that hold several components."""
        now = member.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        now = stage(now, f"{name}-{step}-members")
        keys = stage(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), f"{name}-{step}-open")
        return stage(now.join(keys, "key", "left_semi"), f"{name}-{step}-rest")

    rest = open_rows(buckets.select("key", "cls", "n"), "3")
    need = stage(rest.select("cls").distinct(), f"{name}-open-classes")
    wide = links.texts(need).mapInArrow(_planed(words), "cls long, " + ", ".join(f"{c} long" for c in WIDE_NAMES)).join(need, "cls", "left_semi").dropDuplicates(["cls"])
    wide = stage(wide, f"{name}-wide")
    for turn in range(TURNS):
        hashed = F.xxhash64("cls", F.lit(turn))
        order = Window.partitionBy("key", F.pmod(F.xxhash64("cls", "key"), F.lit(SALTS))).orderBy(hashed)
        this = F.struct("cls", "n", "component", *bits)
        beside = rest.join(wide, "cls").withColumn("y", F.lag(this).over(order)).withColumn("x", this).filter("y is not null")
        beside = beside.select(*(F.col(f"{v}.{c}").alias(f"{c}_{v}") for v in "xy" for c in ("cls", "n", "component", *WIDE_NAMES)))
        edges = edges.unionByName(links.confirm(pairs_of(beside.filter(F.col("component_x") != F.col("component_y")).filter(may_link(percent)))))
        found = components(edges, f"{name}-c3-{turn}")
        rest = open_rows(rest.drop("component"), f"4-{turn}")
    rest = rest.join(wide, "cls")
    one, other = (rest.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "component", *WIDE_NAMES))) for s in "xy")
    pairs = pairs_of(one.join(other, "key").filter((F.col("component_x") < F.col("component_y")) & may_link(percent)))
    edges = edges.unionByName(links.confirm(pairs))
    found = components(edges, f"{name}-c5").withColumnsRenamed({"node": "cls", "component": "part"})

    return signed, classes.join(found, "cls", "left").select("cls", "doc_id", F.coalesce("part", "cls").alias("part"), *(["pick"] if pick else []))


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 5, percent: int = 80, name: str = "near") -> DataFrame:
    """One row of each group of ``docs``, that with the least id (null ids last, ties by a hash of the text); all columns stay.

    A row is told by its id and text together, so an id that is null or repeated with another text costs no row, and
    copies of the kept row (same id and text) stay once. Rows without words or text are linked with nothing: all stay.
    """
    _, named = _linked(docs, text, id, words, percent, name, pick=True)
    kept = named.groupBy("part").agg(F.min("pick").alias("p")).select(F.col("p.none").alias("__none"), F.coalesce("p.doc_id", F.lit(0)).alias("__id"), F.col("p.row").alias("__row"))
    own = docs[id].cast("long")
    keyed = docs.withColumn("__none", own.isNull()).withColumn("__id", F.coalesce(own, F.lit(0))).withColumn("__row", F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    worded = F.coalesce(docs[text], F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    key = ["__none", "__id", "__row"]
    one = keyed.filter(worded).join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)
    return one.unionByName(docs.filter(~worded))
