"""Words of texts as numbers of a small vocabulary, for searches that a set of items asks of all documents.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; only A-Z is lower-cased.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every byte that is no part of a word becomes a blank, A-Z become small.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of item texts whose vocabulary is held at a time, in the driver and in every task.
ITEM_BYTES = 8 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


class Asked:
    """A group of items: their ids, their words as numbers, and the vocabulary of these words."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        words = [words_of((t or "").encode()) for _, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.terms = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in words]


def asked_groups(items: DataFrame, id: str, text: str, most: int = ITEM_BYTES):
    """Items in groups of about ``most`` bytes, read one after the other; an item over that is a group of its own."""
    held, size = [], 0
    for r in items.select(F.col(id).alias("id"), F.col(text).alias("text")).toLocalIterator():
        n = len(r.text or "") * 4
        if held and size + n > most:
            yield Asked(held)
            held, size = [], 0
        held.append((r.id, r.text))
        size += n
    if held:
        yield Asked(held)


def numbered(raw: bytes, vocabulary: dict) -> np.ndarray:
    """The number of each word of a text, -1 for words outside the vocabulary."""
    words = words_of(raw)
    get = vocabulary.get
    return np.fromiter((get(w, -1) for w in words), np.int32, len(words))
