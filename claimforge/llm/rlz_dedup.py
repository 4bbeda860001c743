"""Substring dedup by Relative Lempel-Ziv parsing: word sequences that an earlier document has are cut out.

Documents are factored against indexed reference blocks, the words around content-selected anchors (see grams) that occur
more than once. A block that an earlier document has as it stands is one factor; neighbouring ones with the same source grow to
one long factor, and its words are compared with the source's. Where an anchor stands in different blocks, they come
together in a bucket, and each block is parsed greedily, earliest document first: at a place where a window of the index
begins, the longest common extension, word by word, is the factor; the next places tried are those of the windows across the
factor's end, so that nothing is missed at factor boundaries. Factors of at least `window` words are duplicate spans.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import cut, discard, parts, read_table, utf8
from claimforge.llm.repeats import KEY, SPLIT, blocks_of, buckets, holding, listed, shared_occurrences, solved, wanted_bytes, with_spans

LOCAL = "anchor long, doc_id long, row long, pos int, a int, b int"


class ReferenceIndex:
    """Windows of blocks already seen, for greedy factoring of further blocks. Hashes find places, words decide."""

    def __init__(self, window: int):
        self.window, self.at = window, {}

    def _starts(self, words: list[bytes], lo: int, hi: int):
        return range(max(0, lo), min(hi, len(words) - self.window) + 1)

    def factors(self, words: list[bytes], lo: int, hi: int) -> list[tuple[int, int]]:
        """Greedy factors [a, b) of at least `window` words that begin at places lo ... hi."""
        out, size, n, last = [], self.window, len(words), self._starts(words, lo, hi)
        i = last.start
        while i < last.stop:
            own = words[i : i + size]
            for source, j in self.at.get(hash(tuple(own)), ()):
                if source[j : j + size] == own:
                    break
            else:
                i += 1
                continue
            length = size
            while i + length < n and j + length < len(source) and words[i + length] == source[j + length]:
                length += 1
            out.append((i, i + length))
            i += length - size + 1
        return out

    def add(self, words: list[bytes], lo: int, hi: int) -> None:
        """Takes the windows that are not yet there."""
        size = self.window
        for i in self._starts(words, lo, hi):
            own = words[i : i + size]
            known = self.at.setdefault(hash(tuple(own)), [])
            if not any(source[j : j + size] == own for source, j in known):
                known.append((words, i))


def _parse(window: int):
    def run(batches):
        for table in buckets(batches, "key", 5000):
            table = table.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("pos", "ascending")]).combine_chunks()
            found: list[tuple[int, int, int]] = []  # row, factor in words from the anchor
            index, waiting, last = ReferenceIndex(window), [], None
            columns = [table.column(c) for c in ("key", "doc_id", "lo", "hi", "before", "after")]
            for i in range(table.num_rows):
                key, doc, lo, hi, before, after = (c[i].as_py() for c in columns)
                if (key, doc) != last:
                    if last is None or key != last[0]:
                        index, waiting = ReferenceIndex(window), []
                    for x in waiting:  # only earlier documents serve as reference
                        index.add(*x)
                    waiting, last = [], (key, doc)
                left = before.split()
                own = (left + after.split(), len(left) - hi, len(left) - lo)
                found += [(i, a - len(left), b - len(left)) for a, b in index.factors(*own)]
                waiting.append(own)
            if found:
                row, a, b = zip(*found, strict=True)
                one = table.select(["anchor", *KEY, "pos"]).take(pa.array(row)).append_column("a", pa.array(a, pa.int32())).append_column("b", pa.array(b, pa.int32()))
                yield from one.combine_chunks().to_batches()

    return run


def duplicate_factors(docs: DataFrame, window: int = 50, k: int = 20, split: int = SPLIT) -> DataFrame:
    """(doc_id, row, spans) of words; the union of the spans that hold is all that a window of an earlier document covers."""
    reach = window - k
    occ = shared_occurrences(docs, "word", window, k)
    copies = wanted_bytes(docs, occ.where("doc_id > o.doc_id"), reach, window)
    own = occ.where("contested and doc_id = o.doc_id")
    # a document may have its block more than once: it is parsed at its first place, the others follow
    blocks = cut(blocks_of(docs, own.where("pos = first"), "word", window, k))
    parsed = cut(solved(blocks, "word", window, k, _parse(window), LOCAL, split))
    moved = lambda df, shift: listed(df.select(*KEY, (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"), shift.alias("shift")))
    again = own.where("pos != first").select("anchor", *KEY, "pos", "first").join(parsed.withColumnRenamed("pos", "first"), ["anchor", *KEY, "first"])
    spans = cut(copies.unionByName(moved(parsed, F.lit(None))).unionByName(moved(again, F.col("first") - F.col("pos"))))
    discard(occ, blocks, parsed)
    return spans


def _cut_words(batches):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in parts(batches, size=1 << 20):
        raw, off = utf8(batch.column("text"))
        view, column = memoryview(raw), batch.column("spans_")
        total, spans, kept = [], [], []
        for i in range(batch.num_rows):
            words = bytes(view[off[i] : off[i + 1]]).split()
            total.append(len(words))
            x, y = holding(column, i, words, bytes.split)
            spans.append([{"a": p, "b": q} for p, q in zip(x.tolist(), y.tolist(), strict=True)])
            edges = [0, *(z for p in zip(x.tolist(), y.tolist(), strict=True) for z in p), len(words)]
            kept.append(b" ".join(w for j in range(0, len(edges), 2) for w in words[edges[j] : edges[j + 1]]))
        del view
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])


def rlz_dedup(docs: DataFrame, window: int = 50, k: int = 20, split: int = SPLIT) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (maximal removed runs of words) and kept (the rest, joined by one space).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Uses doc_id and text only; other columns, whatever
    their names, play no part. A null text has no words. Rows with a null doc_id are kept whole and take no part in matching.
    Rows that share a doc_id never cost each other anything, and each has spans of its own; repeated rows come back as often.
    Texts shorter than the window lose nothing. An empty table gives an empty result. split bounds the blocks of one task's
    bucket; results do not depend on it.
    """
    return with_spans(docs, duplicate_factors(docs, window, k, split), _cut_words, "doc_id long, n_words long, spans array<struct<a:int,b:int>>, kept string")


def op1_rlz_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = rlz_dedup(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
