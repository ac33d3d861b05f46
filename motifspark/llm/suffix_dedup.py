"""Removal of long repeated byte strings by a sparse suffix array, built as a distributed merge sort.

A 200-byte window is repeated when it starts at two places. Sorting every suffix would move hundreds of
times the input, so suffixes are taken at anchors only: in each window the position whose 40-byte gram has
the least hash. Equal windows have equal anchors, so every repeat meets at an anchor, and neighbouring
windows that share an anchor travel as one suffix ("context"). Steps:

1. anchors of every text (numpy on Arrow buffers); grams that occur once are dropped by hash, the
   distinguishing-prefix step of string sorting: such suffixes need not be exchanged;
2. contexts that are equal as wholes are counted with partial aggregation (a hot passage is one row); the places of
   each gram's most frequent context, if that occurs again, are repeated as they stand and go on to step 5;
3. one suffix for each distinct context whose gram has several contexts is exchanged: every task sorts its
   suffixes and sends front-coded runs, and each range merges its runs with a loser tree that keeps
   common-prefix lengths and never compares known prefixes again;
4. in the merged order, suffixes sharing a gram lie together; the windows that their common prefixes allow
   are compared in full, so gram hash collisions don't matter;
5. repeated windows go back to their texts as byte ranges, by joins on the context (one row for each, with all
   its ranges) and on the row.

A gram with very many distinct contexts is no group of suffixes: its windows become rows with a 128-bit digest of their 200
bytes, which partial aggregation counts; those that occur again meet their digest in a join that a hot digest can
split, so one common line never gathers in one task.

A gram's most frequent context, if it occurs again, skips the join on contexts; its places still meet the others of their row.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, mix, row_key, rows_of, slices, stage, text_buffers

WINDOW, GRAM = 200, 40
#: Distinct contexts of one gram that a range takes together; grams with more are split by window.
HEAVY = 5000
#: Suffixes in a range, about.
RANGE = 40_000
_HEAD = struct.Struct("<qqHHHHH")


def anchors_of(data: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Contexts of the texts in a buffer: (text number, start, windows, anchor offset, gram hash, context hash)."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    hashed = RangeHash(data)
    grams = hashed.grams(gram)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    w, span = window - gram + 1, 1
    while span * 2 <= w:
        low[: len(low) - span] = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    least = np.minimum(low[: n - window + 1], low[w - span : w - span + n - window + 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n - window + 2, np.int32)
    long = np.flatnonzero(np.diff(off) >= window)
    np.add.at(inside, off[long], 1)
    np.add.at(inside, off[long + 1] - window + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | fresh[1:]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last)
    count, at = end - start + 1, anchor[start]
    shape = (count * 65536 + (at - start)).astype(np.uint64)
    context = mix(hashed(start, end + window) ^ mix(shape))
    return np.searchsorted(off, start, "right") - 1, start, count, at - start, grams[at], context


def _anchored(window: int, gram: int):
    def run(batches):
        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            rid = b.column("rid").to_numpy()
            for i, j in slices(off):
                part = off[i : j + 1] - off[i]
                text, start, count, at, g, t = anchors_of(data[off[i] : off[j]], part, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(t.view(np.int64)), pa.array(rid[i:j][text]), pa.array((start - part[text]).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(at.astype(np.int32))],
                    ["g", "t", "rid", "pos", "n", "at"],
                )

    return run


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known and not looked at."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return m - (differ.bit_length() + 7) // 8


def encode_run(records: list[tuple]) -> bytes:
    """A sorted run, front-coded: of each suffix only what differs from the one before it."""
    out, before = [], b""
    for suffix, left, g, t, at, n in records:
        shared = common_prefix(before, suffix, 0)
        out += (_HEAD.pack(g, t, at, n, shared, len(suffix) - shared, len(left)), suffix[shared:], left)
        before = suffix
    return b"".join(out)


def decode_run(blob: bytes):
    """(prefix shared with the suffix before, suffix, left context, g, t, at, n), in order."""
    i, before = 0, b""
    while i < len(blob):
        g, t, at, n, shared, rest, left = _HEAD.unpack_from(blob, i)
        i += _HEAD.size
        before = before[:shared] + blob[i : i + rest]
        i += rest
        yield shared, before, blob[i : i + left], g, t, at, n
        i += left


def merge_runs(runs: list):
    """Records of sorted runs in order, with the prefix each shares with the record before.

    A loser tree: every inner node keeps the run that lost there and the prefix that its head shares with
    the winner it lost to. Both heads at a node know their prefix with the last record put out: the longer
    prefix wins unseen, and only equal prefixes are compared, from their end on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    heads = [next(r, None) for r in runs]
    shares = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share is then with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = shares[a], shares[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, u = x[1], y[1]
        h = common_prefix(s, u, p)
        first = a if h == len(s) or (h < len(u) and s[h] < u[h]) else b
        second = b if first == a else a
        shares[second] = h
        return first, second

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1)
    while heads[win] is not None:
        yield shares[win], heads[win]
        heads[win] = next(runs[win], None)
        shares[win] = heads[win][0] if heads[win] else 0
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


def _runs(window: int, ranges: int):
    """Front-coded sorted runs of a task's suffixes, one for each range that it meets."""

    def flush(held):
        rows = [(p, encode_run(sorted(records))) for p, records in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["p", "run"])

    def run(batches):
        held: dict[int, list] = {}
        size, before = 0, None
        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            raw = data.tobytes()
            for k, (rid, contexts) in enumerate(zip(b.column("rid").to_pylist(), b.column("contexts").to_pylist())):
                if rid == before:  # a repeated row sends nothing that the first did not; its contexts count as repeated anyway
                    continue
                base, before = int(off[k]), rid
                for c in contexts:
                    s, n, at = base + c["pos"], c["n"], c["at"]
                    held.setdefault(c["g"] % ranges, []).append((raw[s + at : s + n - 1 + window], raw[s : s + at], c["g"], c["t"], at, n))
                    size += n + window
                if size > 24 << 20:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _digests(window: int):
    """(g, t, at, d): every window of the contexts, by its place in the context, with the digest of its bytes."""

    kinds = {"g": pa.int64(), "t": pa.int64(), "at": pa.int32(), "d": pa.binary()}

    def run(batches):
        held: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), kinds.values())], list(kinds))

        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            raw = data.tobytes()
            for k, contexts in enumerate(b.column("contexts").to_pylist()):
                for c in contexts:
                    s = int(off[k]) + c["pos"]
                    held += ((c["g"], c["t"], j, hashlib.blake2b(raw[s + j : s + j + window], digest_size=16).digest()) for j in range(c["n"]))
                if len(held) > 50_000:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def repeated_windows(records: list[tuple], window: int):
    """(g, t, first, last) of the windows that several of the contexts share.

    records: (prefix shared with the next or previous, suffix, left, g, t, at, n) with one gram. Only windows
    that the shared prefix can hold are compared, offset by offset, in full.
    """
    found: dict[int, list[int]] = {}
    by_left: dict[int, list[int]] = {}
    for k, (shared, suffix, left, _, _, at, n) in enumerate(records):
        for back in range(max(at - n + 1, window - shared), at + 1):
            by_left.setdefault(back, []).append(k)
    for back, members in by_left.items():
        if len(members) > 1:
            same: dict[bytes, list[int]] = {}
            for k in members:
                _, suffix, left, *_ = records[k]
                same.setdefault(left[len(left) - back :] + suffix[: window - back], []).append(k)
            for ks in same.values():
                if len(ks) > 1:
                    for k in ks:
                        found.setdefault(k, []).append(records[k][5] - back)
    for k, js in found.items():
        js.sort()
        first = last = js[0]
        for j in js[1:]:
            if j > last + 1:
                yield records[k][3], records[k][4], first, last
                first = j
            last = j
        yield records[k][3], records[k][4], first, last


def _merged(window: int, gram: int):
    schema = ["g", "t", "first", "last"]

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        group: list[list] = []

        def close():
            if len(group) > 1:
                out.extend(repeated_windows([tuple(x) for x in group], window))

        for shared, (_, suffix, left, g, t, at, n) in merge_runs([decode_run(r.as_py()) for r in table.column("run")]):
            if shared < gram:
                close()
                group = []
            if group:
                group[-1][0] = max(group[-1][0], shared)
            group.append([shared if group else 0, suffix, left, g, t, at, n])
        close()
        cols = list(zip(*out)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=schema)

    return run


def repeated_ranges(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, name: str = "suffix") -> DataFrame:
    """(rid, ranges) of ``texts`` (rid, text): byte ranges [start, end) of every window that occurs elsewhere too."""
    found = stage(texts.mapInArrow(_anchored(window, gram), "g long, t long, rid long, pos long, n int, at int"), f"{name}-anchors")
    # a table of its own, so that the join below it can split a gram that very many texts share
    grams = found.groupBy("g", "t").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("c"), F.max(F.struct("c", "t")).alias("most"), F.count("*").alias("m"))
    often = stage(grams.filter("c > 1").select("g", (F.col("m") > 1).alias("mixed"), F.when(F.col("most.c") > 1, F.col("most.t")).alias("lead")), f"{name}-often")
    whole = F.coalesce(F.col("t") == F.col("lead"), F.lit(False)).alias("whole")
    meet = stage(found.join(often, "g").select(*found.columns, "mixed", whole), f"{name}-meet")
    # the places of a gram's most frequent context are repeated as wholes; of the others the joins below tell
    mixed = meet.filter("mixed")
    contexts = stage(mixed.groupBy("g", "t").agg(F.count("*").alias("c"), F.min(F.struct("rid", "pos", "n", "at")).alias("one")), f"{name}-contexts")
    several = stage(contexts.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"), f"{name}-several")
    sent = stage(contexts.join(several, "g").select("g", "t", "one.*", (F.col("m") > heavy).alias("heavy")), f"{name}-sent")
    total, hot = sent.agg(F.count_if(~F.col("heavy")), F.count_if("heavy")).first()
    ranges = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE)

    def placed(part: DataFrame) -> DataFrame:
        each = part.groupBy("rid").agg(F.collect_list(F.struct("g", "t", "pos", "n", "at")).alias("contexts"))
        return texts.join(each, "rid").select("rid", "text", "contexts")

    runs = placed(sent.filter("not heavy")).mapInArrow(_runs(window, ranges), "p int, run binary")
    windows = runs.groupBy("p").applyInArrow(_merged(window, gram), "g long, t long, first int, last int")
    if hot:
        digests = stage(placed(sent.filter("heavy")).mapInArrow(_digests(window), "g long, t long, at int, d binary"), f"{name}-digests")
        again = stage(digests.groupBy("d").agg(F.count("*").alias("c")).filter("c > 1").select("d"), f"{name}-again")
        windows = windows.unionByName(digests.join(again, "d").select("g", "t", F.col("at").alias("first"), F.col("at").alias("last")))
    whole = contexts.filter("c > 1").select("g", "t", F.lit(0).alias("first"), (F.col("one.n") - 1).cast("int").alias("last"), F.lit(True).alias("whole"))
    # one row for each context, so that every place of a context meets one; what occurs again as a whole needs no parts
    span = F.struct("first", "last")
    parts = whole.unionByName(windows.withColumn("whole", F.lit(False))).groupBy("g", "t")
    both = parts.agg(F.collect_list(F.when(F.col("whole"), span)).alias("all"), F.collect_list(F.when(~F.col("whole"), span)).alias("some"))
    marked = stage(both.select("g", "t", F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("some")).alias("shared")), f"{name}-windows")
    at = F.transform("shared", lambda x: F.struct((F.col("pos") + x["first"]).alias("start"), (F.col("pos") + x["last"] + window).alias("end")))
    back = mixed.filter("not whole").join(marked, ["g", "t"]).select("rid", at.alias("ranges"))
    whole = meet.filter("whole").select("rid", F.array(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("n") - 1 + window).alias("end"))).alias("ranges"))
    return back.unionByName(whole).groupBy("rid").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def union_ranges(ranges, length: int) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover."""
    out: list[list[int]] = []
    for r in sorted((r["start"], min(r["end"], length)) for r in ranges or ()):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [tuple(r) for r in out]


def _cut(keep_text: bool):
    def run(batches):
        for b in rows_of(batches):
            data, off = text_buffers(b.column("__body"))
            raw = data.tobytes()
            ranges = b.column("__ranges")
            removed, spans, digests, texts = [], [], [], []
            for k in range(b.num_rows):
                own = raw[int(off[k]) : int(off[k + 1])]
                runs = union_ranges(ranges[k].as_py(), len(own)) if ranges[k].is_valid else []
                kept, at = [], 0
                for s, e in runs:
                    kept.append(own[at:s])
                    at = e
                kept.append(own[at:])
                joined = b"".join(kept)
                removed.append(len(own) - len(joined))
                spans.append(len(runs))
                digests.append(hashlib.sha256(joined).hexdigest())
                if keep_text:  # a character that a run cuts through goes as a whole
                    texts.append("".join(x.decode("utf-8", "ignore") for x in kept))
            new = [pa.array((off[1:] - off[:-1]).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            cols = {c: b.column(c) for c in b.schema.names if c not in ("__body", "__ranges")}
            if keep_text:
                cols["__text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), *new], [*cols, *names])

    return run


def dedup(docs: DataFrame, text: str = "text", keep_text: bool = True, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, name: str = "suffix") -> DataFrame:
    """``docs`` without the bytes that a repeated ``window``-byte string covers, in every place where it occurs.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes that are left); columns
    with those names are replaced. Column ``text`` becomes what is left (a character that a run cuts through goes
    whole), or goes if not keep_text. Null texts count as empty, and texts under ``window`` bytes lose nothing.
    Repeated rows are repeats of each other: both lose their text. Matches never cross texts. No rows in: no rows
    out. Rows meet their ranges by a 64-bit hash of the whole row.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    plain = docs.drop(*new)
    others = [c for c in plain.columns if c != text]
    rows = plain.withColumn("__body", F.coalesce(F.col(text), F.lit(""))).withColumn("__rid", row_key("__body", *[c for c in others if c in ("doc_id", "page_id", "conv_id")]))
    ranges = repeated_ranges(rows.select(F.col("__rid").alias("rid"), F.col("__body").alias("text")), window, gram, heavy, name)
    met = rows.join(ranges.select(F.col("rid").alias("__rid"), F.col("ranges").alias("__ranges")), "__rid", "left")
    kinds = dict(plain.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in others), *(["`__text` string"] if keep_text else []), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"]
    out = met.select(*others, "__body", "__ranges").mapInArrow(_cut(keep_text), ", ".join(schema))
    return out.withColumnRenamed("__text", text).select(*plain.columns, *new) if keep_text else out
