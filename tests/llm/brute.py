"""Plain versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib

import numpy as np


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substrings(rows, window=100):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            else:
                seen.add(b[i : i + window])
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def word_windows(rows, window=50):
    """doc_id: (n_words, n_removed, kept_sha256)."""
    first, docs = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in docs:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = b"\1" * window
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def fingerprint(text, shingle=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids, fps, radius=3):
    """id: least id of its component."""
    ids, fps = np.array(ids), np.array(fps, np.uint64)
    order = np.argsort(ids)
    ids, fps = ids[order], fps[order]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {int(ids[i]): int(ids[find(i)]) for i in range(len(ids))}


def similar_firsts(rows, shingle=5, least=0.8):
    """Least ids of the components of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, of all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if (not x and not y) or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d for d in ids if find(d) == d}
