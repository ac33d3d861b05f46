"""Plain single-process versions of the operators, to hold results against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def suffix_dedup(texts, window=200):
    """(n_bytes, n_removed, n_spans, sha) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def cut_texts(texts, window=200):
    """Texts without repeated bytes; a character that a cut goes through goes as a whole."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append("".join(r[m.start() : m.end()].decode("utf-8", "ignore") for m in re.finditer(b"\0+", bytes(gone))))
    return out


def shingle_set(text, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def near_groups(rows, words, percent=80):
    """{position: (n_shingles, component id)} of rows (id, text)."""
    sets = [shingle_set(t, words) for _, t in rows]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in index[x] if j < i)
        for j, c in met.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return {i: (len(sets[i]), least[root(i)]) for i in range(len(rows))}


def check_ids(pieces, texts, path):
    """Asserts that pieces (a data frame) hold every id of texts {id: text} once."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {k: t.encode(v or "", add_special_tokens=False).ids + [0] for k, v in texts.items()}
    for k, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[k]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[k])
    assert set(pieces.doc_id) == set(ids)


def check_packing(pieces, texts, path, window=1024):
    """``check_ids``, and that sequences are gapless and fit; the padding share."""
    check_ids(pieces, texts, path)
    padded = 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        at = 0
        for p in own.itertuples():
            assert p.offset == at
            at += p.length
        assert at <= window
        padded += at if at & (at - 1) == 0 else window
    return 1 - pieces.length.sum() / padded
