"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs wait in an agenda ordered by the score of the piece they would make, ties to the left;
the best is merged until no pair makes a piece. No piece of such a vocabulary joins characters across the
start of a word (a space mark after another character), which the model is checked for, so every word has
an agenda of its own: short words go through theirs together, as numpy rows, long ones through a heap.
Each distinct word of an Arrow batch is encoded once, and checked against the sentencepiece library there;
should they ever differ, the library's ids are taken and the word is counted in every row that has it.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, slices, text_buffers

MARK = "▁"
#: Words in each of a worker's two caches, about; characters of a word that still goes through the rows.
CACHE, ROW = 150_000, 40
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_FAR = np.iinfo(np.int32).max
_models: dict = {}


class Vocabulary:
    """Pieces, scores and mergeable pairs of a model that the sentencepiece library has loaded."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece of this model joins words")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.fallback = sp.is_byte(self.bytes[0])
        symbols = dict(self.pieces)
        for p in self.pieces:
            for c in p:
                symbols.setdefault(c, len(symbols) + size)
        self.symbols = symbols
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # an equal score is an equal rank, so that ties go to the left
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.pieces.values()}, reverse=True))}
        pairs = {}
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (ranks[sp.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.numbers = list(range(size))
        self.decimals = [b"%d" % i for i in range(size)]

    def found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of symbol pairs; a pair that makes no piece has the last rank."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], _FAR), self.made[at]

    def ids(self, symbol: int, char: str) -> list[int]:
        """Ids of a symbol that is left: its piece, or a lone character's bytes."""
        if 0 <= symbol < len(self.numbers):
            return [symbol]
        return [self.bytes[b] for b in char.encode()] if self.fallback else [self.unknown]

    def heap(self, word: str) -> list[int]:
        """Ids of one word, by an agenda in a heap; entries whose symbols have changed are passed over."""
        n = len(word)
        sym = [self.symbols.get(c, -1) for c in word]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := self.pairs.get(sym[i] << 32 | sym[j])):
                heapq.heappush(agenda, (p[0], i, j, sym[i], sym[j], p[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b, made = heapq.heappop(agenda)
            if sym[i] != a or sym[j] != b or right[i] != j:
                continue
            sym[i], sym[j] = made, -2
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for i in range(n) if sym[i] != -2 for x in self.ids(sym[i], word[i])]

    def rows(self, words: list[str]) -> list[list[int]]:
        """Ids of short words, whose agendas advance together, one merge in each word at a time.

        Symbols of a word are linked from place to place; ``rank`` at a place is that of the pair which begins there.
        """
        n, width = len(words), max(map(len, words)) + 1
        size = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width)[None] < size[:, None]
        sym = np.full((n, width), -1, np.int64)
        sym[inside] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        rank, made = np.full((n, width), _FAR, np.int32), np.zeros((n, width), np.int64)
        rank[:, :-1], made[:, :-1] = self.found(sym[:, :-1], sym[:, 1:])
        right = np.tile(np.arange(1, width + 1), (n, 1)).reshape(-1)
        left = np.tile(np.arange(-1, width - 1), (n, 1)).reshape(-1)
        flat, ranks, makes = sym.reshape(-1), rank.reshape(-1), made.reshape(-1)
        live = np.arange(n)
        while len(live):
            k = rank[live].argmin(1)
            more = ranks[live * width + k] != _FAR
            live, k = live[more], k[more]
            row = live * width
            i = row + k
            j = row + right[i]
            far = right[j]
            flat[i], flat[j], ranks[j] = makes[i], -2, _FAR
            right[i], left[row + far] = far, k
            ranks[i], makes[i] = self.found(flat[i], flat[row + far])
            ok = left[i] >= 0
            i, b = i[ok], (row + left[i])[ok]
            ranks[b], makes[b] = self.found(flat[b], flat[i])
        kept = inside & (sym != -2)
        at = np.concatenate([[0], np.cumsum(kept.sum(1))]).tolist()
        ids, number = list(map(self.numbers.__getitem__, np.clip(sym[kept], 0, len(self.numbers) - 1).tolist())), len(self.numbers)
        out = [ids[x:y] for x, y in pairwise(at)]
        for r in np.flatnonzero((kept & ((sym < 0) | (sym >= number))).any(1)).tolist():
            word = words[r]
            out[r] = [x for i in np.flatnonzero(kept[r]).tolist() for x in self.ids(int(sym[r, i]), word[i])]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words (each begins with the space mark)."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if 0 < len(words[i]) <= ROW]
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            for k, ids in zip(part, self.rows([words[k] for k in part])):
                out[k] = ids
        for k in order:
            if out[k] is None:
                out[k] = self.heap(words[k])
        return out


class Words:
    """Encoded words of a worker, in two halves: words that are asked for again move to the new half, and the old half goes
    when the new one is full, so common words stay while rare ones pass."""

    def __init__(self) -> None:
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.corrected: set[str] = set()

    def lacking(self, words: set[str]) -> list[str]:
        """Words that are in neither half; those in the old one move."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        rest = words - self.new.keys()
        again = rest & self.old.keys()
        self.new.update((w, self.old.pop(w)) for w in again)
        return list(rest - again)


def model(path: str) -> tuple[Vocabulary, Words]:
    if path not in _models:
        _models[path] = (Vocabulary(path), Words())
    return _models[path]


def words_of(text: str) -> list[str]:
    """The text's words; each stands for a space mark and itself. (An added space comes first, as in the library.)"""
    if not text:
        return []
    if text[0] not in f" {MARK}" and text[-1] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [c[1:].replace(" ", MARK) for c in _CHUNK.findall(" " + text)]


def learned(vocabulary: Vocabulary, cache: Words, split: list[list[str]]) -> dict[str, tuple]:
    """(ids, decimal ids) of all words of some texts; those that the library encodes otherwise are remembered."""
    words = cache.lacking({w for ws in split for w in ws})
    gc.disable()  # many small lists without cycles: looking for some took a third of the time
    try:
        checked = vocabulary.library.encode(words, num_threads=1) if words else []
        for w, own, theirs in zip(words, vocabulary.encode_words([MARK + w for w in words]), checked):
            if own != theirs and w:
                own = theirs
                cache.corrected.add(w)
            cache.new[w] = tuple(own), b" ".join([vocabulary.decimals[i] for i in own])
    finally:
        gc.enable()
    return cache.new


def _coded(path: str, keys: list[str]):
    def run(batches):
        vocabulary, cache = model(path)
        end, corrected = vocabulary.decimals[vocabulary.end], cache.corrected
        for b in rows_of(batches):
            _, off = text_buffers(b.column("text"))
            column = b.column("text")
            counts, shas, decoded, differ = [], [], [], []
            for i, j in slices(off, 1 << 22):
                split = [words_of(t) for t in column.slice(i, j - i).to_pylist()]
                known = learned(vocabulary, cache, split)
                for ws in split:
                    got = [known[w] for w in ws]
                    ids = list(chain.from_iterable([g[0] for g in got]))
                    ids.append(vocabulary.end)
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(b" ".join([*[g[1] for g in got], end])).hexdigest())
                    decoded.append(hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest())
                    differ.append(sum(w in corrected for w in ws) if corrected else 0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded), pa.array(differ, pa.int64())],
                [*keys, "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"],
            )

    return run


def encode_ids(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each text, an end id last."""
    vocabulary, cache = model(path)
    split = [words_of(t) for t in texts]
    known = learned(vocabulary, cache, split)
    return [[i for w in ws for i in known[w][0]] + [vocabulary.end] for ws in split]


def _listed(path: str, keys: list[str]):
    def run(batches):
        for b in rows_of(batches):
            _, off = text_buffers(b.column("text"))
            for i, j in slices(off, 1 << 22):
                ids = encode_ids(path, b.column("text").slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in keys), pa.array(ids, pa.list_(pa.int32()))], [*keys, "ids"])

    return run


def _restored(path: str, keys: list[str]):
    def run(batches):
        library = model(path)[0].library
        for b in rows_of(batches):
            texts = [library.decode(x) if x else "" for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(texts, pa.string())], [*keys, "text"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: the library's ids and an end id. Null or empty text: the end id alone. No rows in: no rows out."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(_listed(path, ["key"]), f"key {dict(rows.dtypes)['key']}, ids array<int>").withColumnRenamed("key", key)


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids (null or empty: an empty text)."""
    rows = coded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_restored(path, ["key"]), f"key {dict(rows.dtypes)['key']}, text string").withColumnRenamed("key", key)


def digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_corrected): digests of ``encode`` and of its decoded text, without moving ids.

    n_corrected: words of the row whose agenda gave other ids than the library's, which were then taken (0 is right). Repeated
    rows get equal digests.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(_coded(path, ["key"]), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long")
    return out.withColumnRenamed("key", key)
