"""Suffix-array dedup: byte strings of a set length that occur earlier in the corpus are cut out.

Method: deep-shallow sorting. Suffixes that can have an equal partner are those around an anchor (a content-selected
k-gram, see grams) that occurs more than once; they are dealt out by anchor. In a bucket the suffixes to the right of the
anchor, and the reversed prefixes to its left, are put in order by multikey quicksort, one character at a time, down to a
shallow depth; groups that still agree are ordered by blind tries. The common prefixes of neighbours in the two arrays
give, at every depth, the classes of equal strings; a window with l bytes left of the anchor is the pair of its classes at
depth l and depth W - k - l, and all but the earliest window of a pair are duplicates. Copies of a block as it stands form one
class with it: they do not go to the sort, but are compared with the bytes of the earliest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import cut, discard, parts, read_table, utf8
from claimforge.llm.repeats import KEY, SPLIT, blocks_of, buckets, holding, listed, shared_occurrences, solved, wanted_bytes, with_spans

SHALLOW = 12


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length by a blind trie: nodes keep a depth and branching bytes only."""
    root: list | int = 0
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):  # blind descent: only the branching bytes are looked at
            node = node[1].get(s[node[0]], node[2])
        x = int.from_bytes(s) ^ int.from_bytes(strings[node])
        depth = len(s) - (x.bit_length() + 7) // 8
        other, parent, node = strings[node], None, root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = i
            continue
        new = [depth, {other[depth]: node, s[depth]: i}, i]
        if parent is None:
            root = new
        else:
            parent[1][s[parent[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return out


def multikey_quicksort(rows: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (a matrix) within sorted buckets by their first `depth` characters, and the heads of equal groups.

    Ternary partition at the middle string's character, of all groups at once: smaller, equal (one character deeper), greater.
    """
    n = len(rows)
    order, at_char = np.arange(n), np.zeros(n, np.int64)
    head = np.append(True, bucket[1:] != bucket[:-1])[:n]
    while True:
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, n))
        live = np.repeat(size > 1, size) & (at_char < depth)
        at = np.flatnonzero(live)
        if not len(at):
            return order, head
        group = (np.cumsum(head) - 1)[at]
        middle = (start + size // 2)[group]
        char, pivot = rows[order[at], at_char[at]], rows[order[middle], at_char[middle]]
        side = np.where(char < pivot, 0, np.where(char == pivot, 1, 2))
        key = 3 * group + side
        by = np.argsort(key, kind="stable")
        order[at], at_char[at] = order[at][by], at_char[at][by] + (side[by] == 1)
        key = key[by]
        head[at[1:]] |= key[1:] != key[:-1]


def deep_shallow(rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings of one length (a matrix) within buckets, and the common prefix of each with the one before."""
    n, width = rows.shape
    order, head = multikey_quicksort(rows, bucket, min(SHALLOW, width))
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, n))
    for a, m in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):  # long common prefixes: blind tries
        members = order[a : a + m]
        leaf: dict[bytes, list[int]] = {}
        for i in members:
            leaf.setdefault(rows[i].tobytes(), []).append(i)
        if len(leaf) > 1:
            strings = list(leaf)
            order[a : a + m] = [i for x in blind_trie_order(strings) for i in leaf[strings[x]]]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        x = rows[order]
        differ = x[1:] != x[:-1]
        b = bucket[order]
        lcp[1:] = np.where(b[1:] != b[:-1], -1, np.where(differ.any(1), differ.argmax(1), width))
    return order, lcp


def matrix(column: pa.Array, width: int, skip: int = 0, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a zero-padded matrix, and their lengths."""
    values = column.to_pylist()
    values = [v[skip:][:: -1 if backwards else 1] for v in values]
    size = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width), size


def _sorted_spans(window: int, k: int):
    reach = window - k

    def solve(table: pa.Table):
        key, doc, own, pos, lo, hi = (table.column(c).to_numpy() for c in ("key", "doc_id", "row", "pos", "lo", "hi"))
        n = len(key)
        bucket = np.append(0, np.cumsum(key[1:] != key[:-1]))
        right, n_right = matrix(table.column("after"), reach, skip=k)
        left, n_left = matrix(table.column("before"), reach, backwards=True)
        (ro, rl), (lo_, ll) = deep_shallow(right, bucket), deep_shallow(left, bucket)
        rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
        rank_r[ro], rank_l[lo_] = np.arange(n), np.arange(n)
        document = np.append(0, np.cumsum((doc[1:] != doc[:-1]) | (own[1:] != own[:-1])))  # a row of a bucket
        copy = np.zeros((n, reach + 3), bool)
        for back in range(int(lo.min()), int(hi.max()) + 1):
            at = np.flatnonzero((n_left >= back) & (n_right >= reach - back) & (lo <= back) & (back <= hi))
            if len(at) < 2:
                continue
            pair = np.cumsum(rl < reach - back)[rank_r[at]] * (n + 1) + np.cumsum(ll < back)[rank_l[at]]
            _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
            here = inverse * (n + 1) + document[at]
            _, first_here, inverse_here = np.unique(here, return_index=True, return_inverse=True)
            # rows are sorted by document and place: the first of a class is the earliest, of all and of its own document
            copy[at, back + 1] = (doc[at[first[inverse]]] < doc[at]) | (pos[at[first_here[inverse_here]]] < pos[at])
        step = np.diff(copy.astype(np.int8), axis=1)
        row, begin = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)  # runs of places left of the anchor
        a, b = pos[row] - (end - 1), pos[row] - begin + window
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(own[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=[*KEY, "a", "b"])

    def run(batches):
        for table in buckets(batches, "key", 8192):
            yield solve(table.sort_by([(c, "ascending") for c in ("key", "doc_id", "row", "pos")]).combine_chunks())

    return run


def duplicate_spans(docs: DataFrame, window: int = 100, k: int = 20, split: int = SPLIT) -> DataFrame:
    """(doc_id, row, spans) of bytes; the union of the spans that hold is all that an earlier string of `window` bytes covers."""
    reach = window - k
    occ = shared_occurrences(docs, "byte", window, k)
    copies = wanted_bytes(docs, occ.where("doc_id > o.doc_id"), reach, window)
    same = occ.where("doc_id = o.doc_id and pos > first").select(*KEY, (F.col("pos") - reach).alias("a"), (F.col("pos") + window).alias("b"), (F.col("first") - F.col("pos")).alias("shift"))
    blocks = cut(blocks_of(docs, occ.where("contested and doc_id = o.doc_id and pos = first"), "byte", window, k))
    by_sort = solved(blocks, "byte", window, k, _sorted_spans(window, k), "doc_id long, row long, a int, b int", split)
    spans = cut(copies.unionByName(listed(same)).unionByName(listed(by_sort)))
    discard(occ, blocks)
    return spans


def _cut_bytes(batches, text: bool = False):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in parts(batches, size=1 << 20):
        raw, off = utf8(batch.column("text"))
        view, column = memoryview(raw), batch.column("spans_")
        kept, spans = [], []
        for i in range(batch.num_rows):
            own = bytes(view[off[i] : off[i + 1]])
            x, y = holding(column, i, own, bytes)
            edges = [0, *(z for p in zip(x.tolist(), y.tolist(), strict=True) for z in p), len(own)]
            kept.append(b"".join(own[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
            spans.append([{"a": p, "b": q} for p, q in zip(x.tolist(), y.tolist(), strict=True)])
        del view
        left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if text else pa.array(kept, pa.binary())
        own = [pa.array((off[1:] - off[:-1]).astype(np.int64)), pa.array(spans, kind), left]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *own, *batch.columns[3:]], names=["doc_id", "n_bytes", "spans", "kept", *batch.schema.names[3:]])


def suffix_dedup(docs: DataFrame, window: int = 100, k: int = 20, split: int = SPLIT, more: tuple = (), text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (the remaining bytes).

    With text, kept is a string without the parts of characters that were cut. Uses the columns doc_id and text, and carries
    those named in more; others, whatever their names, play no part. A null text is empty. Rows with a null
    doc_id are kept whole and take no part in matching. Rows that share a doc_id never cost each other anything, and each has
    spans of its own; repeated rows come back as often. Texts shorter than the window lose nothing. split bounds the blocks
    of one task's bucket; results do not depend on it.
    """
    schema = f"doc_id long, n_bytes long, spans array<struct<a:int,b:int>>, kept {'string' if text else 'binary'}"
    return with_spans(docs, duplicate_spans(docs, window, k, split), lambda batches: _cut_bytes(batches, text), schema, more)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
