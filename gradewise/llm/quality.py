"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each whole text.  The number
of rows of every vote pattern (at most 3**len(LABELLERS), counted over all
rows) is all that expectation-maximisation needs to estimate each labeller's accuracy and
abstention in either class and the share of good rows, without a gold label.
The posterior of a row's pattern then is its training target for a linear scorer
over hashed features (byte-class pairs and word signatures), fitted on
``SAMPLE`` rows at most, taken in the order of a hash; all rows are scored.

Defined cases: null and empty texts have no features, get the scorer's
intercept like any text without words and are judged by it; repeated rows get
equal scores; an empty table gives an empty result; columns that clash with
the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.words import blocks, mix, text_buffer, words_of

SAMPLE = 8_000  # rows the scorer is fitted on
SIZE = 1024  # hashed features
SHRINK = 60  # features' worth of evidence that a text needs, so that a few words do not decide
ROUNDS = 200
KEEP_AT = 0.2  # a row is rejected only on clear evidence

# Byte classes: lower, upper, digit, other than ASCII, space, line end, and each sign its own.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 5, 6
_SIGNS = [b for b in range(33, 127) if not _CLASS[b]]
_CLASS[_SIGNS] = 8 + np.arange(len(_SIGNS))
_ORDINARY = np.zeros(256, bool)
_ORDINARY[[ord(c) for c in ".,;:'\"()-?"]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Shares of letters, signs and words of each text."""
    buf, offsets = text_buffer(column)
    words = words_of(column)
    n = np.maximum(words.counts, 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _CLASS[buf]
    upper, lower = _per_row(kind == 2, offsets), _per_row(kind == 1, offsets)
    sign = (kind >= 8) & ~_ORDINARY[buf]
    codes = words.codes() if len(words.start) else np.zeros(0, np.uint64)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[words.first[:-1][words.counts > 0]] = False
    row = words.row
    order = np.lexsort((codes, row))
    new = np.ones(len(order), bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (row[order][1:] != row[order][:-1])
    last = kind[words.end - 1] if len(codes) else np.zeros(0, np.int64)
    at = buf[words.end - 1] if len(codes) else np.zeros(0, np.uint8)
    odd_word = (words.end - words.start <= 2) & (last >= 8) & (kind[words.start] >= 8) if len(codes) else same
    return {
        "words": words.counts.astype(float),
        "upper": upper / np.maximum(upper + lower, 1),
        "signs": _per_row(sign, offsets) / size,
        "repeats": _per_row(same, words.first) / n,
        "distinct": np.bincount(row[order][new], minlength=len(n)) / n,
        "bare_signs": _per_row(odd_word, words.first) / n,
        "bangs": _per_row(buf == 33, offsets) / n,
        "stops": _per_row((at == 46) | (at == 44), words.first) / n,
        "length": _per_row(kind < 5, offsets) / n,
    }


# Each labeller: (name, bad where, good where) over the statistics.
LABELLERS = [
    ("capitals", lambda s: s["upper"] > 0.5, lambda s: s["upper"] < 0.2),
    ("signs", lambda s: s["signs"] > 0.08, lambda s: s["signs"] < 0.03),
    ("repeats", lambda s: s["repeats"] > 0.2, lambda s: s["repeats"] < 0.05),
    ("bare signs", lambda s: s["bare_signs"] > 0.15, lambda s: s["bare_signs"] < 0.05),
    ("bangs", lambda s: s["bangs"] > 0.3, lambda s: s["bangs"] < 0.05),
    ("variety", lambda s: (s["words"] >= 30) & (s["distinct"] < 0.15), lambda s: s["distinct"] > 0.3),
    ("stops", lambda s: (s["words"] >= 30) & (s["stops"] < 0.02), lambda s: (s["stops"] > 0.04) & (s["stops"] < 0.5)),
    ("word length", lambda s: (s["length"] > 14) | (s["length"] < 2), lambda s: (s["length"] > 3) & (s["length"] < 10)),
]


def patterns(column: pa.Array) -> np.ndarray:
    """The votes of all labellers as one number: base 3, 1 bad, 2 good, 0 none."""
    s = statistics(column)
    out = np.zeros(len(column), np.int64)
    for _, bad, good in LABELLERS:
        out = out * 3 + np.where(s["words"] == 0, 0, np.where(bad(s), 1, np.where(good(s), 2, 0)))
    return out


def votes(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3 ** k % 3 for k in range(len(LABELLERS) - 1, -1, -1)], axis=1)


@dataclass
class LabelModel:
    """share: of good rows; table[labeller, class, vote] probabilities."""

    share: float
    table: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        v = votes(pattern)
        score = np.log([1 - self.share, self.share])[None, :] + sum(
            np.log(self.table[k][:, v[:, k]]).T for k in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))


def fit_labels(pattern: np.ndarray, n: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and their row counts.  Kinds
    of bad text differ, each seen by few labellers, so at the start one bad
    vote outweighs the good ones; the classes thereby keep their meaning."""
    v, n = votes(pattern), n.astype(float)
    balance = (v == 2).sum(axis=1) - 8.0 * (v == 1).sum(axis=1)
    good = 1 / (1 + np.exp(-balance))
    model = None
    for _ in range(rounds):
        weight = np.stack([(1 - good) * n, good * n])  # class x pattern
        table = np.stack([[[weight[c][v[:, k] == x].sum() for x in range(3)] for c in range(2)] for k in range(v.shape[1])])
        table = (table + 0.5) / (table + 0.5).sum(axis=2, keepdims=True)
        share = float(np.clip((good * n).sum() / max(n.sum(), 1), 0.01, 0.99))
        model = LabelModel(share, table)
        new = model.posterior(pattern)
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return model


def features(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every byte pair and word of the texts."""
    buf, offsets = text_buffer(column)
    words = words_of(column)
    kind = _CLASS[buf].astype(np.uint64)
    byte_row = np.repeat(np.arange(len(column)), np.diff(offsets))
    pair = mix(kind[:-1] * np.uint64(64) + kind[1:]) if len(kind) > 1 else np.zeros(0, np.uint64)
    inside = byte_row[:-1] == byte_row[1:] if len(kind) > 1 else np.zeros(0, bool)
    rows, codes = [byte_row[:-1][inside] if len(kind) > 1 else byte_row[:0]], [pair[inside]]
    if len(words.start):
        word = words.codes()
        same = np.zeros(len(word), np.uint64)
        same[1:] = word[1:] == word[:-1]
        length = np.minimum(words.end - words.start, 16).astype(np.uint64)
        signature = ((kind[words.start] * np.uint64(64) + kind[words.end - 1]) * np.uint64(32) + length) * np.uint64(2) + same
        rows.append(words.row)
        codes.append(mix(signature + np.uint64(1 << 40)))
    return np.concatenate(rows), (np.concatenate(codes) % np.uint64(size)).astype(np.int64)


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability that each text is good."""
        row, feature = features(column, len(self.weights))
        n = np.bincount(row, minlength=len(column))
        out = np.bincount(row, weights=self.weights[feature], minlength=len(column)) / (n + SHRINK)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -500, 500)))


def pattern_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for part in blocks(batch):
                for p, n in zip(*np.unique(patterns(part.column("text")), return_counts=True)):
                    total[int(p)] = total.get(int(p), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["p", "n"])

    rows = docs.select("text").mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    return np.array([r["p"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> Scorer | None:
    """Label model over all rows, scorer over at most ``sample`` of them;
    None for an empty table."""
    pattern, n = pattern_counts(docs)
    if not len(pattern):
        return None
    labels = fit_labels(pattern, n)
    total = int(n.sum())
    # rows in hash order: a threshold on the hash that gives a little more than the sample
    h = F.xxhash64("text").bitwiseAND(F.lit((1 << 30) - 1))
    cut = min(1 << 30, int(1.2 * sample / total * (1 << 30)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                row, feature = features(part.column("text"), size)
                x = np.bincount(row * size + feature, minlength=part.num_rows * size).reshape(-1, size)
                x = (x / (x.sum(axis=1, keepdims=True) + SHRINK)).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), pa.array(patterns(part.column("text"))), pa.array([r.tobytes() for r in x], pa.binary())], ["h", "p", "x"])

    rows = (docs.select(h.alias("h"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("h") < cut)
            .dropDuplicates(["h"])  # copies of one text count once
            .orderBy("h").limit(sample).mapInArrow(run, "h long, p long, x binary").collect())
    if not rows:
        return Scorer(labels, np.zeros(size), float(np.log(labels.share / (1 - labels.share))))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    y = labels.posterior(np.array([r["p"] for r in rows], np.int64))
    weights, intercept = _logistic(x, y)
    return Scorer(labels, weights, intercept)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Soft-label logistic regression on scaled features by Adam steps."""
    scale = x.std(axis=0) + 1e-6
    z = np.concatenate([x / scale, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float64)
    w, step, m, v = np.zeros(z.shape[1]), 0.05, 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        g = z.T @ (p - y) / len(y) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - step * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w[:-1] / scale, float(w[-1])


def scored(docs: DataFrame, model: Scorer | None) -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_keep``."""
    names = [c for c in docs.columns if c not in ("quality_score", "quality_keep")]
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("quality_score", T.DoubleType()), T.StructField("quality_keep", T.BooleanType())])
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                s = shared.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s), pa.array(s >= KEEP_AT)], schema.names)

    return docs.select(names).mapInArrow(run, schema)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that the classifier, fitted on ``docs``, keeps."""
    return scored(docs, fit(docs)).where("quality_keep").select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, fit(docs)).drop("text")
