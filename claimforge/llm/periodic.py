"""Maximal periodic runs of words, found with bit-parallel lags.

A text's distinct words get numbers, and bit j of all numbers is one big integer, a plane with one bit for each word. For a lag q a
plane is XORed with itself shifted by q places; the OR over planes has a zero where words q apart are equal. A run of length L
is a stretch of L - q such zeros, and shift-doubling AND leaves a bit only where a stretch that is long enough begins. Planes are added one by
one, and a lag is given up once no such stretch is left, which is mostly after one plane.

Lags below 8 are all tried. A run of a longer lag, with Q <= q < 2Q for a power of two Q, covers two marks in a row of those set every Q words,
and the words behind both return q words later; so two equal hashes in a row propose the lag, and the planes decide. Marks
within a run of a smaller period propose nothing, as two runs overlap by less than the sum of their periods. So work grows about as
n log n, not n * n, with the words of a text, and each text is handled where it is, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm import grams
from claimforge.llm.common import parts, read_table, release, ship, utf8

SMALL = 8  # lags below are tried without a proposal, and as many words are compared at a mark
RUN = "struct<start:int,length:int,period:int>"
TIMES = 4


def planes(ids: np.ndarray) -> list[int]:
    """Bit j of all numbers as one integer, bit i of which belongs to place i."""
    most = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits(((ids >> j) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for j in range(max(most, 1))]


def stretches(bits: list[int], n: int, q: int, least: int) -> int:
    """A bit for each place from which at least `least` words in a row equal those q places on."""
    whole = (1 << (n - q)) - 1
    equal = whole
    for plane in bits:
        equal &= ~(plane ^ (plane >> q))
        left, width = equal, 1
        while left and 2 * width <= least:
            left &= left >> width
            width *= 2
        if left and width < least:
            left &= left >> (least - width)
        if not left:
            return 0
    return left


def _lags(hashes: np.ndarray, n: int, size: int, core: np.ndarray) -> list[int]:
    """Lags q in [size, 2 size) that two marks in a row propose. hashes: of SMALL words from each place.

    core: at each place the greatest end less period of the runs there. A run of lag q that holds a mark's place m, and a known one of
    period p < q that ends at m + q + p or later, would overlap by q + p words, and then q were no smallest period.
    """
    marks = np.arange(0, len(hashes) - size, size)
    if len(marks) < 2:
        return []
    lag = np.arange(size, 2 * size)
    found: set[int] = set()
    for lo in range(0, len(marks) - 1, block := max(1, (1 << 18) // size)):  # bounds the memory
        m = marks[lo : lo + block + 1]
        there = m[:, None] + lag[None, :]
        equal = (there < len(hashes)) & (hashes[np.minimum(there, len(hashes) - 1)] == hashes[m][:, None])
        equal &= m[:, None] + lag[None, :] > core[m][:, None]
        found.update(lag[(equal[1:] & equal[:-1]).any(axis=0)].tolist())
    return sorted(q for q in found if TIMES * q <= n)


def _extend(bits, n, q, core, runs, shortest):
    """Adds the runs of smallest period q, given those of all smaller periods, to runs and core."""
    length = max(shortest, TIMES * q)
    if length > n or not (found := stretches(bits, n, q, length - q)):
        return
    flags = np.unpackbits(np.frombuffer(found.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.r_[0, flags, 0].astype(np.int8)))
    for s, e in zip(edge[::2].tolist(), (edge[1::2] - 1 + length).tolist(), strict=True):
        if core[s] < s + q:  # else it lies within a run of a smaller period
            runs.append((s, e - s, q))
            core[s:e] = np.maximum(core[s:e], e - q)


def runs_of(ids: np.ndarray, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with length >= max(shortest, 4 * smallest period), by start, then period."""
    n = len(ids)
    if n < shortest:
        return []
    bits, core, runs = planes(ids), np.zeros(n, np.int64), []
    for q in range(1, min(SMALL, n // TIMES + 1)):
        _extend(bits, n, q, core, runs, shortest)
    size = SMALL
    if n >= TIMES * size:
        hashes = grams.mix(grams.Ranges(grams.mix(ids.astype(np.uint64) + np.uint64(1))).grams(SMALL)) if n < grams.SLICE else _long_hashes(ids)
    while TIMES * size <= n:
        for q in _lags(hashes, n, size, core):
            _extend(bits, n, q, core, runs, shortest)
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _long_hashes(ids: np.ndarray) -> np.ndarray:
    """The hashes of a long text in slices, so that the table of powers stays small."""
    out = np.zeros(len(ids) - SMALL + 1, np.uint64)
    for a in range(0, len(out), grams.SLICE):
        b = min(a + grams.SLICE, len(out))
        out[a:b] = grams.mix(grams.Ranges(grams.mix(ids[a : b + SMALL - 1].astype(np.uint64) + np.uint64(1))).grams(SMALL))
    return out


def _collapse(shortest: int):
    def run(batches):
        for batch in parts(batches, size=1 << 20):
            raw, off = utf8(batch.column("text"))
            view = memoryview(raw)
            total, found, kept = [], [], []
            for i in range(batch.num_rows):
                words = bytes(view[off[i] : off[i + 1]]).split()
                number: dict[bytes, int] = {}
                runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64), shortest)
                if runs:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s, length, q in runs:
                        gone[s + q] += 1
                        gone[s + length] -= 1
                    words, n = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g], len(words)
                total.append(n if runs else len(words))
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                kept.append(b" ".join(words))
            del view
            kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            release()

    return run


def periodic_runs(docs: DataFrame, shortest: int = 6) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, runs and collapsed (the words left, joined by one space).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. runs lists, by start, then period, every stretch of words with smallest
    period q and length >= max(shortest, 4 q) that no neighbouring word extends; a word goes if a run holds it behind its first q
    words. Each row is judged by its own text: repeated rows and ids come back as often, null ids stay null, a null text has no words. Only
    doc_id and text are used, whatever other columns are called. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_collapse(shortest), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def repeated_tails(doc_id: Column, text: Column) -> Column:
    """The text of the query's contract: with h = crc32 of the decimal id, g = h / 10, if h % 10 = 0 the words from a = g % n on repeat
    the p = 1 + (n - a) / (3 + g % 8) words from a. Words are joined by one space then; other texts stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(text))[0]).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = periodic_runs(docs.select("doc_id", repeated_tails(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    length, period = -F.col("best.least").cast("long"), F.col("best.period").cast("long")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").cast("long").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
