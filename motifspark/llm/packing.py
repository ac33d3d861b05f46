"""Packing of token ids into windows of fixed length.

A text's ids are cut into full windows and one rest shorter than a window. The histogram of rest lengths
(at most ``window`` - 1 numbers, whatever the size of the corpus) goes to the driver, where shallow length
combinations that fill a window (or a power of two, which needs no padding) are enumerated, their repeat
counts solved against the histogram by non-negative least squares and rounded down, and what is left is
packed best-fit decreasing, on counts. The plan says for each length which ranks go to which sequences;
ranks are counted in salted windows, so a length that a third of all texts share is no hot key.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, slices, stage, text_buffers

#: The byte-level pre-tokenizer's pattern (a fixed value of that published format).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts that go to the tokenizers library: characters whose class may differ between regex libraries' Unicode versions, very long gaps.
_ODD = re.compile("[^\x00-\u024f\u2010-\u2027]|\\s{1000}")
_encoders: dict = {}


def byte_ranks(tokenizer) -> dict[bytes, int] | None:
    """Ids by token bytes if merging by least id gives just what ``tokenizer`` gives; else None.

    That is so when the merges' results stand in the order of their ids, after the single bytes, and every token's own
    bytes encode to that token alone: a pair of symbols is then merged in a text only where its merge is listed.
    """
    made = json.loads(tokenizer.to_str())
    model, before = made["model"], made["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not made["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or model.get("dropout") or model.get("ignore_merges") or any(not t["special"] for t in made["added_tokens"]):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocabulary = model["vocab"]
    order = [vocabulary["".join(pair)] for pair in model["merges"]]
    if any(t not in vocabulary for t in byte) or any(x >= y for x, y in pairwise([max(vocabulary[t] for t in byte), *order])) or len(order) + 256 != len(vocabulary):
        return None
    from tokenizers import Tokenizer

    alone = Tokenizer(tokenizer.model).encode_batch_fast(list(vocabulary), add_special_tokens=False)
    if any(e.ids != [i] for e, i in zip(alone, vocabulary.values())):
        return None
    return {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items()}


def text_ids(path: str):
    """A function: texts to lists of id bytes (little-endian unsigned 32 bits), as the tokenizers library gives them.

    Where the vocabulary allows it (``byte_ranks``), plain texts are encoded by tiktoken, which gives the same ids
    in a quarter of the time; all others, and texts that spell an added token, by the tokenizers library.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        t = Tokenizer.from_file(path)
        ranks = byte_ranks(t)
        fast = ranks and tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        _encoders[path] = t, fast, [a.content for a in t.get_added_tokens_decoder().values()]
    slow, fast, added = _encoders[path]

    def encode(text: str) -> bytes:
        odd = fast is None or _ODD.search(text) or any(a in text for a in added)
        ids = slow.encode(text, add_special_tokens=False).ids if odd else fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    return lambda texts: map(encode, texts)


def _measured(path: str, window: int, end_id: int, keys: list[str]):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = text_ids(path)
        for b in rows_of(batches):
            _, off = text_buffers(b.column("text"))
            column = b.column("text")
            counts, sums = [], []
            for i, j in slices(off, 1 << 22):
                for ids in encode(column.slice(i, j - i).to_pylist()):
                    ids += end
                    counts.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[k : k + 4 * window]) for k in range(0, len(ids), 4 * window)])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], [*keys, "doc_tokens", "crcs"])

    return run


def combinations(lengths: np.ndarray, window: int, most: int = 4000) -> list[tuple[int, ...]]:
    """Shallow combinations (one to three lengths) that fill ``window`` or a smaller power of two exactly."""
    have = set(map(int, lengths))
    out: list[tuple[int, ...]] = []
    total = window
    while total >= 1:
        if total in have and total < window:
            out.append((total,))
        out += [(a, total - a) for a in sorted(have) if a <= total - a and total - a in have]
        total //= 2
    spread = sorted(have)[:: max(1, len(have) // 64)]
    triples = [(a, b, window - a - b) for a in spread for b in sorted(have) if a <= b <= window - a - b and window - a - b in have]
    step = max(1, len(triples) // max(1, most - len(out)) + 1) if len(triples) > most - len(out) else 1
    return out + triples[::step]


def nonnegative_least_squares(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, A's columns counting the lengths of each combination; by coordinate descent."""
    x = [0.0] * len(columns)
    rest = target.astype(float).tolist()
    entries = [sorted({(n, c.count(n)) for n in c}) for c in columns]
    norms = [sum(m * m for _, m in e) for e in entries]
    for _ in range(sweeps):
        moved = 0.0
        for j, e in enumerate(entries):
            step = max(-x[j], sum(m * rest[n] for n, m in e) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in e:
                    rest[n] -= m * step
        if moved < 0.25:
            break
    return np.array(x)


def pack_counts(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences): every item of the histogram in exactly one sequence."""
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    columns = combinations(np.flatnonzero(left), window)
    plan: list[tuple[tuple[int, ...], int]] = []
    x = np.floor(nonnegative_least_squares(columns, left) + 1e-6).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        c = columns[j]
        n = min(int(x[j]), *(int(left[m]) // c.count(m) for m in c))
        if n > 0:
            plan.append((c, n))
            for m in c:
                left[m] -= n
    # the rest, best fit decreasing: open sequences by what is free in them
    open_by_free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(window, 0, -1):
        todo = int(left[n])
        while todo:
            free = next((f for f in range(n, window + 1) if open_by_free.get(f)), None)
            if free is None:
                per = window // n
                whole, todo = divmod(todo, per)
                for items, count in ((per, whole), (todo, 1 if todo else 0)):
                    if count:
                        open_by_free.setdefault(window - items * n, []).append(((n,) * items, count))
                break
            items, count = open_by_free[free].pop()
            used = min(count, todo)
            if count > used:
                open_by_free[free].append((items, count - used))
            open_by_free.setdefault(free - n, []).append(((*items, n), used))
            todo -= used
    return plan + [x for group in open_by_free.values() for x in group]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, np.ndarray], int]:
    """By length: rows (first rank, first sequence, offset), sorted by rank; and the number of sequences."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for lengths, count in plan:
        at = 0
        for n in lengths:
            by.setdefault(n, []).append((seen.get(n, 0), sequence, at))
            seen[n] = seen.get(n, 0) + count
            at += n
        sequence += count
    return {n: np.array(v, np.int64) for n, v in by.items()}, sequence


def _placed(table: dict[int, np.ndarray]):
    def run(batches):
        for b in rows_of(batches):
            rest, rank = b.column("rest").to_numpy(), b.column("rank").to_numpy()
            seq, at = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            for n in np.unique(rest):
                if n:
                    rows, mine = table[int(n)], rest == n
                    k = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                    seq[mine], at[mine] = rows[k, 1] + rank[mine] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(at)], [*b.schema.names, "tail_sequence", "tail_offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0, name: str = "packing") -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of ``docs``.

    A row's ids are its text's (null or empty: none) and then ``end_id``. Each piece is a full window, a
    sequence of its own, or the row's rest, beside other rests; offsets in a sequence are gapless from 0.
    sequence_id counts from 0: shared sequences, then full windows. Rows with equal keys are rows like any
    other. No rows in: no rows out. Other columns are not used, whatever their names.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    found = stage(rows.mapInArrow(_measured(tokenizer_path, window, end_id, ["key"]), f"key {kind}, doc_tokens long, crcs array<long>"), f"{name}-tokens")
    found = found.withColumn("rest", F.col("doc_tokens") % window).withColumn("full", F.floor(F.col("doc_tokens") / window).cast("long"))
    histogram = found.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("f")).orderBy("rest").collect()
    total = sum(r["n"] for r in histogram)
    table, shared = slots(pack_counts({r["rest"]: r["n"] for r in histogram if r["rest"]}, window))
    firsts, at = [], shared
    for r in histogram:
        firsts.append((r["rest"], at))
        at += r["f"]
    first_full = found.sparkSession.createDataFrame(firsts or [(0, 0)], "rest long, first_full long")
    salts = max(64, total // 200_000)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("key", "crcs"), F.lit(salts)))
    order = Window.partitionBy("rest", "salt").orderBy("key", "doc_tokens", "crcs")
    inner = salted.withColumn("r", F.row_number().over(order) - 1).withColumn("f", F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("m")).select("rest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("f0"))
    bases = bases.join(F.broadcast(first_full), "rest")  # one row for each rest length, fewer than the window
    ranked = inner.join(bases, ["rest", "salt"]).select("key", "doc_tokens", "crcs", "rest", "full", (F.col("r") + F.col("n0")).cast("long").alias("rank"), (F.col("f") + F.col("f0") + F.col("first_full")).alias("full_sequence"))
    placed = ranked.mapInArrow(_placed(table), f"key {kind}, doc_tokens long, crcs array<long>, rest long, full long, rank long, full_sequence long, tail_sequence long, tail_offset long")
    pieces = placed.select("*", F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = F.col("k") < F.col("full")
    return pieces.select(
        F.col("key").alias(key),
        (F.col("k") * window).cast("long").alias("start"),
        F.when(whole, F.lit(window)).otherwise(F.col("rest")).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(whole, F.col("full_sequence") + F.col("k")).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("tail_offset")).cast("long").alias("offset"),
    )
