"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade > j) = sigmoid(w . x - t_j) with thresholds t_0 < t_1 < ... and one weight vector for all grades. x says which hashed
features a text has: its words (letters and digits only, lower case) and the shapes of its tokens (runs of letters, digits and
signs). Weights are fitted on the driver on a bounded sample of rated documents; scores need nothing but the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimforge.llm import grams
from claimforge.llm.common import cut, keyed, read_table, release, ship, utf8

BITS = 22
SAMPLE = 20_000
#: features of the sample that come to the driver at most (128 MB), and of one text
FEATURES, LONGEST = 1 << 25, 1 << 17


def _tables() -> tuple[np.ndarray, np.ndarray]:
    core, shape = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    for c in range(256):
        ch = chr(c)
        if c >= 128 or ch.isascii() and ch.isalnum():
            core[c] = ord(ch.lower()) if c < 128 else c
            shape[c] = ord("0") if ch.isdigit() and c < 128 else ord("A") if c < 128 and ch.isupper() else ord("a")
    return core, shape


CORE, SHAPE = _tables()


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all texts, each feature once a row, sorted; whole texts, in numpy."""
    s, e, bounds = grams.words(raw, off)
    base = int(off[0])
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    text = raw[base : int(off[-1])]
    word = np.zeros(len(text) + 1, np.int32)
    np.add.at(word, s - base, 1)
    word = np.cumsum(word[:-1], dtype=np.int32) - 1
    solid = ~grams.SPACE[text]
    found = []
    for kind, keep, codes in ((1, solid & (CORE[text] > 0), CORE[text]), (2, None, SHAPE[text])):
        if keep is None:
            keep = solid.copy()
            keep[1:] &= (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(keep)
        w = word[at]
        first = np.searchsorted(w, np.arange(len(s) + 1))
        full = first[1:] > first[:-1]
        h = grams.word_hashes(codes[at], first[:-1][full], first[1:][full]) if full.any() else np.zeros(0, np.uint64)
        found.append((row[full], (grams.mix(h + np.uint64(kind)) >> np.uint64(64 - bits)).astype(np.int64)))
    both = np.unique(np.concatenate([(r << bits) | f for r, f in found]))
    # how often a text repeats its words, in half powers of two
    n, own = np.diff(bounds), np.bincount(np.unique((found[0][0] << bits) | found[0][1]) >> bits, minlength=len(off) - 1)
    some = np.flatnonzero(own)
    often = np.floor(2 * np.log2(n[some] / own[some])).astype(np.int64)
    spread = (grams.mix(np.maximum(often, 0).astype(np.uint64) + np.uint64(3000)) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.union1d(both, (some << bits) | spread)
    return both >> bits, both & ((1 << bits) - 1)


def _slices(raw: np.ndarray, off: np.ndarray, size: int = 1 << 20):
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, off[i : j + 1]
        i = j


def loss(w, first, gap, row, code, grades, ridge: float = 0.0) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the grades with half of ridge * |w|^2, and its gradients by w, first and gap.

    Text row[i] has feature code[i]; the thresholds are first, then each exp(gap) above the one before.
    """
    n, n_grades = len(grades), len(gap) + 1
    t = first[0] + np.append(0, np.cumsum(np.exp(gap)))
    eta = np.bincount(row, w[code], n)
    p = 1 / (1 + np.exp(-np.clip(eta[:, None] - t[None], -30, 30)))
    # likelihood of the observed grade: P(> g - 1) - P(> g)
    edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
    at = np.arange(n)
    hi, lo = edge[at, grades], edge[at, grades + 1]
    like = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
    d_eta = (d_lo - d_hi) / n
    d_t = np.zeros(n_grades)
    np.add.at(d_t, np.maximum(grades - 1, 0), np.where(grades > 0, d_hi, 0) / n)
    np.add.at(d_t, np.minimum(grades, n_grades - 1), np.where(grades < n_grades, -d_lo, 0) / n)
    grad = [np.bincount(code, d_eta[row], len(w)) + ridge * w, np.array([d_t.sum()]), np.exp(gap) * d_t[1:][::-1].cumsum()[::-1]]
    return float(-np.log(like).mean() + ridge / 2 * (w @ w)), grad


class OrdinalModel:
    """Weights and thresholds of a cumulative-link model with grades 0 .. n."""

    def __init__(self, index: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, bits: int = BITS):
        self.index, self.weights, self.thresholds, self.bits = index, weights, thresholds, bits
        self.dense = None

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, evidence: float = 18.0, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4, bits: int = BITS) -> OrdinalModel:
        """Adam on the whole sample.

        Features whose likelihood ratio against independence of the grade is below `evidence` are left out: with far more
        words than ratings the rest would fit chance.
        """
        n_grades = max(1, int(grades.max(initial=1)))
        n = len(rows)
        if not n or len(np.unique(grades)) < 2:  # nothing to tell apart: everything has the top grade or the only one
            at = 0.0 if not n else float(grades[0])
            return cls(np.zeros(0, np.int64), np.zeros(0), np.where(np.arange(n_grades) < (at if n else n_grades), -20.0, 20.0), bits)
        flat = np.concatenate(rows)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
        index = np.unique(flat)
        code = np.searchsorted(index, flat).astype(np.int32)
        del flat
        k = n_grades + 1
        cell = code.astype(np.int64)
        cell *= k
        cell += grades[row]
        seen = np.bincount(cell, minlength=len(index) * k).reshape(-1, k).astype(float)
        del cell
        total = np.bincount(grades, minlength=k).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda o, e: np.where(o > 0, o * np.log(o / e), 0.0).sum(1)
            size = seen.sum(1, keepdims=True)
            ratio = 2 * (part(seen, size * total / n) + part(total - seen, (n - size) * total / n))
        good = ratio >= evidence
        keep = good[code]
        row, code = row[keep], (np.cumsum(good) - 1)[code[keep]]
        index = index[good]
        w = np.zeros(len(index))
        above = (grades[:, None] > np.arange(n_grades)[None]).astype(float)
        share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
        t = -np.log(share / (1 - share))
        first, gap = t[:1].copy(), np.log(np.maximum(np.diff(t), 1e-3))  # gaps are exponentials, so the thresholds stay in order
        params = [w, first, gap]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            _, grad = loss(w, first, gap, row, code, grades, ridge)
            for i, (x, g) in enumerate(zip(params, grad, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
        return cls(index, w, first[0] + np.append(0, np.cumsum(np.exp(gap))), bits)

    def score(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the probabilities P(grade > j) of each text."""
        if self.dense is None:
            self.dense = np.zeros(1 << self.bits, np.float32)
            self.dense[self.index] = self.weights
        eta = np.zeros(len(off) - 1)
        for i, j, part in _slices(raw, off):
            row, f = features(raw, part, self.bits)
            eta[i:j] = np.bincount(row, self.dense[f], j - i)
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None], -30, 30)))
        return p.sum(1), p



def sample_features(rated: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, f): a row for each rated id of the sample that has a document, with the sorted features of its text, LONGEST at most.

    Of several ratings of an id the lowest counts, of several documents the one whose text has the least hash (null last). Of more than
    `sample` ratings those with the least hash of their id are used, and of their documents as many in this order as FEATURES allows, so reruns agree.
    """
    few = rated.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    few = few.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            for i, j, part in _slices(raw, off):
                row, f = features(raw, part)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("grade").slice(i, j - i), pa.array([f[a:b].astype(np.int32)[:LONGEST] for a, b in zip(ends, ends[1:], strict=False)], pa.list_(pa.int32()))], names=["doc_id", "grade", "f"])

    joined = keyed(docs, "doc_id", "text").join(F.broadcast(few), "doc_id")  # `sample` rows at most
    rank = F.struct(F.isnull("text"), F.xxhash64("text"))
    one = joined.groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min_by("text", rank).alias("text"))
    table = cut(one.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, f array<int>"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # `sample` small rows
    fit = table.select("doc_id", F.size("f").cast("long").alias("n")).withColumn("upto", upto).where(F.col("upto") <= FEATURES).select("doc_id")
    return table.join(fit, "doc_id", "left_semi")


def train(rated: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on documents with a grade; rated has doc_id and grade (0, 1, ...; null: not rated). See `sample_features` for what is used."""
    table = sample_features(rated, docs, sample).toArrow().sort_by("doc_id")
    f = table.column("f").combine_chunks()
    f = f.chunk(0) if isinstance(f, pa.ChunkedArray) else f
    at = np.append(0, np.cumsum(f.value_lengths().to_numpy(zero_copy_only=False)))
    flat, grades = f.flatten().to_numpy(), table.column("grade").to_numpy().astype(np.int64)
    del table, f
    return OrdinalModel.fit([flat[a:b] for a, b in zip(at, at[1:], strict=False)], grades)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from two labels: 0 toxic, 1 of low quality, 2 neither; null if a label is missing and the other doesn't decide."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def classify_rows(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """docs with its own columns and expected_grade, tail and keep, as `classify` has them; a row never leaves its partition."""
    ship(docs.sparkSession)
    small = (model.index, model.weights, model.thresholds, model.bits)
    shared = docs.sparkSession.sparkContext.broadcast(small)  # as many weights as features of the bounded sample
    own_names = [c for c in docs.columns if c not in ("expected_grade", "tail", "keep")]
    rows = docs.select(*own_names)
    schema = T.StructType([*rows.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches):
        own = OrdinalModel(*shared.value)
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            grade, p = own.score(raw, off)
            tail = p[:, -1]
            release()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grade), pa.array(tail), pa.array(tail >= threshold)], names=[*own_names, "expected_grade", "tail", "keep"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, expected_grade, tail (probability of the top grade) and keep (tail >= threshold).

    Uses doc_id and text only; other columns, whatever their names, play no part. Null and empty texts have no features and so
    the score of the thresholds alone. Ids may be null or repeated; rows come back as often.
    """
    return classify_rows(keyed(docs, "doc_id", "text"), model, threshold).select("doc_id", "expected_grade", "tail", "keep")


def op10_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, train(grades_of(read_table(spark, sf_dir, "labels")), docs))
