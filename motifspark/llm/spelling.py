"""Spelling variants: words of a corpus that differ by one letter, found with a bit-sliced position index.

The index of some words is a bitset for each (position, letter): the words with that letter there. A word is
looked up by recurrences over its letters that work on 64 words at a time: Z holds the words that agree so far,
S those with one letter replaced, I those with one letter more, whose letters are therefore looked up one position
further on. After the last letter, S meets the words of equal length and I those of one letter more; a lookup from
the shorter word finds a missing letter too, so each pair is met once.

Not every word is looked up in every block: of two words that differ by one letter, the first half or the rest of the
shorter is intact in both. For each length l of the shorter word, both halves are keys, and words with one key
meet in a block. Keys share blocks by hash; a key with more words than a block is cut into blocks which are met pair by pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stage

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of a block, letters of a block, lookups made together; words counted in a task before they are sent on.
BLOCK, LETTERS, TOGETHER, COUNTED = 2048, 1 << 20, 256, 200_000


def slip(id: str, run: str) -> str:
    """The run, less one letter where a checksum of id and run says so."""
    h = zlib.crc32(f"{id}:{run}".encode())
    if h % 31:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _words(least: int, slips: bool):
    runs = re.compile(_RUN.pattern[:-1] + "{%d,}" % least)  # shorter runs stay short

    def run(batches):
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in rows_of(batches):
            for id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                for w, n in Counter(runs.findall(text.encode().translate(_SMALL).decode())).items():
                    w = slip(id, w) if slips else w
                    if len(w) >= least:
                        seen[w] += n
                if len(seen) > COUNTED:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()

    return run


def counted_words(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, slips: bool = True) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased, of ``least`` letters and ``times`` occurrences at least."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_words(least, slips), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


class BitSlices:
    """Bitsets over some words by position and letter, kept for the positions being read."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, letters: int):
        self.codes, self.letters, self.words = codes, letters, (len(lengths) + 63) // 64
        self._held: dict[int, np.ndarray] = {}
        self.lengths = {int(n): self._bits((lengths == n)[None])[0] for n in np.unique(lengths)}

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(flags), self.words * 64), bool)
        padded[:, : flags.shape[1]] = flags
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """[letter] -> words with it at the position; row 0 is for letters that no word has there."""
        if position not in self._held:
            own = self.codes[:, position] if position < self.codes.shape[1] else np.zeros(len(self.codes), self.codes.dtype)
            out = self._bits(own[None] == np.arange(self.letters)[:, None])
            out[0] = 0
            if len(self._held) > 1024:
                self._held.clear()
            self._held[position] = out
        return self._held[position]

    def near(self, asked: np.ndarray, length: int):
        """(query, word) pairs: words with one letter replaced or one more than the query's ``length`` letters."""
        none = np.zeros(self.words, np.uint64)
        zero = np.full((len(asked), self.words), ~np.uint64(0))
        replaced, more = np.zeros_like(zero), np.zeros_like(zero)
        for i in range(length):
            here, next = self.at(i)[asked[:, i]], self.at(i + 1)[asked[:, i]]
            more = (more | zero) & next
            replaced = (replaced & here) | (zero & ~here)
            zero &= here
        found = (replaced & self.lengths.get(length, none)) | ((more | zero) & self.lengths.get(length + 1, none))
        flags = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(flags)


def _coded(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    codes = np.zeros((len(words), int(lengths.max(initial=0))), np.uint16)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.searchsorted(alphabet, flat) + 1
    return codes, lengths


def _paired(table: pa.Table) -> pa.Table:
    """Near pairs, both ways, of a block's words: index rows against lookups with the same key."""
    index, asked = (table.filter(table.column(c)) for c in ("indexed", "asked"))
    out = [[], [], []]
    if index.num_rows and asked.num_rows:
        length, side = asked.column("l")[0].as_py(), asked.column("side")
        alphabet = np.unique(np.frombuffer("".join(table.column("word").to_pylist()).encode("utf-32-le"), np.uint32))
        words, queries = index.column("word").to_pylist(), asked.column("word").to_pylist()
        codes, lengths = _coded(words, alphabet)
        q_codes, _ = _coded(queries, alphabet)
        keys, q_keys = index.column("key").to_numpy(), asked.column("key").to_numpy()
        n, q_n, half = index.column("n").to_numpy(), asked.column("n").to_numpy(), length // 2
        q_side, w_side = side.to_numpy(), index.column("side").to_numpy()
        slices = BitSlices(codes, lengths, len(alphabet) + 1)
        for i in range(0, len(queries), TOGETHER):
            q, w = slices.near(q_codes[i : i + TOGETHER], length)
            q = q + i
            good = (keys[w] == q_keys[q]) & (w_side[w] == q_side[q])
            q, w = q[good], w[good]
            # a pair that agrees in its first half is taken there
            good = (q_side[q] == 0) | (codes[w, :half] != q_codes[q, :half]).any(1)
            q, w = q[good], w[good]
            out[0] += [queries[k] for k in q]
            out[1] += [words[k] for k in w]
            out[2].append(n[w])
            longer = lengths[w] > length
            q, w = q[longer], w[longer]
            out[0] += [words[k] for k in w]
            out[1] += [queries[k] for k in q]
            out[2].append(q_n[q])
    counts = np.concatenate(out[2]) if out[2] else np.zeros(0, np.int64)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(counts.astype(np.int64))], ["word", "near", "near_n"])


def near_pairs(words: DataFrame, least: int = 7, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n), both ways, of all pairs of distinct ``words`` (word, n; ``least`` >= 2 letters) one letter apart."""
    size = F.length("word")
    each = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("l")).filter(F.col("l") >= least)
    half = F.floor(F.col("l") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", F.col("size") - F.col("l") + half + 1, F.col("l") - half).alias("part")))
    each = each.withColumn("s", F.explode(sides)).select("word", "n", "l", "s.side", (F.col("size") == F.col("l")).alias("asked"), F.xxhash64("l", "s.side", "s.part").alias("key"))
    room = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(LETTERS / F.col("l"))))
    keys = stage(each.groupBy("l", "key").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / room)), "spelling-keys")
    rooms = keys.filter("blocks = 1").groupBy("l").agg(F.ceil(F.sum("c") / F.first(room)).alias("rooms"))
    narrow = each.join(keys.filter("blocks > 1").select("l", "key"), ["l", "key"], "left_anti").join(rooms, "l")
    narrow = narrow.select("l", F.expr("pmod(key, rooms)").alias("place"), F.lit(0).alias("i"), F.lit(0).alias("j"), "word", "n", "side", "key", F.lit(True).alias("indexed"), "asked")
    wide = each.join(keys.filter("blocks > 1").select("l", "key", "blocks"), ["l", "key"]).withColumn("own", F.expr("pmod(xxhash64(word), blocks)").cast("int"))
    other = F.explode(F.expr("sequence(0, cast(blocks - 1 as int))"))
    shared = ["l", F.col("key").alias("place")], ["word", "n", "side", "key"]
    index = wide.withColumn("j", other).select(*shared[0], F.col("own").alias("i"), "j", *shared[1], F.lit(True).alias("indexed"), F.lit(False).alias("asked"))
    asked = wide.filter("asked").withColumn("i", other).select(*shared[0], "i", F.col("own").alias("j"), *shared[1], F.lit(False).alias("indexed"), F.lit(True).alias("asked"))
    # a wide key, unlike a place, is no small number; the two kinds of groups are told apart by a sign of their own
    blocks = narrow.withColumn("kind", F.lit(0)).unionByName(index.unionByName(asked).withColumn("kind", F.lit(1)))
    return blocks.groupBy("kind", "l", "place", "i", "j").applyInArrow(_paired, "word string, near string, near_n long")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, factor: int = 10, slips: bool = True) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``.

    Words are runs of Latin letters with at least ``least`` letters and ``times`` occurrences; n counts them. n_near: other words
    one inserted, deleted or replaced letter away. form: the near word of largest n (ties: the smallest), if that is at least
    ``factor`` times the word's n; form_n its n. root: the last word when forms are followed. ``slips`` leaves out letters by a
    checksum, as op12 asks. Null and empty texts have no words, a null id counts as empty text; very long texts are
    read whole; repeated rows count each. Other columns are not used, whatever their names. No words: no rows.
    """
    words = stage(counted_words(docs, id, text, least, times, slips), "spelling-words")
    near = near_pairs(words, least)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    strong = F.coalesce(-F.col("best.m") >= F.lit(factor) * F.col("n"), F.lit(False))
    formed = words.join(best, "word", "left").select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, -F.col("best.m")).alias("form_n"))
    formed = stage(formed, "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 1
    while times * factor**steps <= most:  # every step multiplies n, so there are no more than this
        steps += 1
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stage(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        reach *= 2
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
