"""Toxic spans by a linear-chain conditional random field.

Labels mark whole texts, the field tags words, so word labels come first: from
a bounded sample of labelled texts, cues (words, word beginnings and endings)
are picked one after another, each the one that explains most toxic
texts not yet explained and hardly any clean text; the words with a cue in
toxic texts are the positive words.  The field has two states, hashed word and
affix features and transitions; its sequences are sentences, cut after
``LONGEST`` words.  It is fitted by gradient steps on the exact likelihood.

Every text is then read whole: forward-backward marginals give each word its
probability of being toxic, a text's score is a calibrated noisy-or over
them, and the words above ``SPAN_AT`` are its offending byte ranges.

Labels are used for the sample alone and only from documents whose
crc32(doc_id as text) mod 4 is not 2; a score depends on the text alone.

Defined cases: null and empty texts have the score of a text without toxic
words; rows without doc_id are scored (held out: null); labels that are null,
repeated or without a document are left out; without any labelled toxic and
clean text every score is 0; repeated rows get a row each.
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

SAMPLE = 1_500  # labelled texts of either class
SIZE = 1 << 18  # hashed weights
LONGEST = 256
STEPS = 30
CUES = 400
CUE_TEXTS = 4  # toxic texts that a cue must explain
SPAN_AT = 0.5
PREDICT_AT = 0.3
HELD_OUT = 2

# Words are runs of letters, digits and non-ASCII bytes.
_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = False
_BREAKS[128:] = False
_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True  # line end ! . ?
_PREFIXES, _SUFFIXES = (4, 5, 6), (5,)


@dataclass
class Tokens:
    """Words of a block: features (words x kinds), sequences and byte ranges."""

    codes: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first word of each sequence, and the end

    @property
    def features(self) -> np.ndarray:
        return (self.codes >> np.uint64(46)).astype(np.int32)


def tokens(column: pa.Array) -> Tokens:
    w = words_of(column, _BREAKS, lower=True)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros((0, 1 + len(_PREFIXES) + len(_SUFFIXES)), np.uint64), none, none, none, np.zeros(1, np.int64))
    kinds = [w.codes()]
    # a word no longer than an affix has no such feature: its own code stands in
    kinds += [w.codes(ends=np.minimum(w.start + k, w.end)) for k in _PREFIXES]
    kinds += [w.codes(starts=np.maximum(w.end - k, w.start)) for k in _SUFFIXES]
    codes = np.stack([mix(c + np.uint64(i)) for i, c in enumerate(kinds)], axis=1)
    row = w.row
    stops = np.cumsum(_STOPS[w.buf])[w.start]
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    if size.max() > LONGEST:
        extra = (size - 1) // LONGEST
        first = np.repeat(first, extra + 1) + LONGEST * (
            np.arange((extra + 1).sum()) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
    begin = text_buffer(column)[1][row]
    return Tokens(codes, row, w.start - begin, w.end - begin, np.append(first, n))


def joined_tokens(batch: pa.RecordBatch) -> Tokens:
    """The words of a batch, block after block, as one."""
    parts, row, word = [], 0, 0
    for part in blocks(batch):
        t = tokens(part.column("text"))
        parts.append((t.codes, t.row + row, t.start, t.end, t.first[:-1] + word))
        row, word = row + part.num_rows, word + len(t.row)
    codes, rows, start, end, first = (np.concatenate(x) for x in zip(*parts))
    return Tokens(codes, rows, start, end, np.append(first, word))


@dataclass
class Field:
    """The fitted field: word weights, begin and transition scores, calibration."""

    weights: np.ndarray
    bias: float
    begin: np.ndarray  # 2
    move: np.ndarray  # 2 x 2, from row to column
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, features: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Each word's probability of state 1, by forward-backward over all
        sequences at once, longest first; with ``pairs`` also the expected
        transitions, beginnings and the log-likelihood's normaliser."""
        n = len(features)
        emit = np.full(n, float(self.bias))
        for kind in features.T:
            emit += self.weights[kind]
        emit = np.exp(np.clip(emit, -30, 30))
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # sequences with a word at each step
        move, begin = np.exp(self.move), np.exp(self.begin)
        fwd = np.empty((n, 2))
        scale = np.empty(n)
        for t in range(longest):
            at = start[:alive[t]] + t
            if t:
                p = fwd[at - 1]
                a0, a1 = p[:, 0] * move[0, 0] + p[:, 1] * move[1, 0], p[:, 0] * move[0, 1] + p[:, 1] * move[1, 1]
            else:
                a0, a1 = begin[0], begin[1]
            a1 = a1 * emit[at]
            s = a0 + a1
            fwd[at, 0], fwd[at, 1], scale[at] = a0 / s, a1 / s, s
        back = np.ones((n, 2))
        expected = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            at = start[:alive[t]] + t
            e1 = emit[at] * back[at, 1]
            b0 = back[at, 0]
            s = scale[at]
            back[at - 1, 0] = (move[0, 0] * b0 + move[0, 1] * e1) / s
            back[at - 1, 1] = (move[1, 0] * b0 + move[1, 1] * e1) / s
            if pairs:
                p = fwd[at - 1]
                for i in (0, 1):
                    expected[i, 0] += (p[:, i] * move[i, 0] * b0 / s).sum()
                    expected[i, 1] += (p[:, i] * move[i, 1] * e1 / s).sum()
        prob = fwd[:, 1] * back[:, 1]
        prob = prob / (prob + fwd[:, 0] * back[:, 0])
        return (prob, expected, np.log(scale).sum()) if pairs else prob

    def text_scores(self, tok: Tokens, rows: int) -> tuple[np.ndarray, np.ndarray]:
        prob = self.marginals(tok.features, tok.first) if len(tok.row) else np.zeros(0)
        clean = np.bincount(tok.row, weights=np.log1p(-np.clip(prob, 0, 1 - 1e-12)), minlength=rows)
        return prob, self.calibrated(-clean)

    def calibrated(self, strength: np.ndarray) -> np.ndarray:
        """Score of texts whose noisy-or is 1 - exp(-strength)."""
        x = np.log(np.expm1(np.clip(strength, 1e-9, 30)))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -500, 500)))


def pick_cues(codes: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Feature codes that mark toxic texts: greedily the one in most toxic
    texts not yet explained, less its cost in clean texts, among those at least
    twenty times as frequent in toxic as in clean texts."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind in codes.T:  # one kind of feature at a time: a fifth of the memory
        _, once = np.unique(kind ^ mix(text.astype(np.uint64)), return_index=True)  # a code counts once a text
        where = text[once]
        names, index = np.unique(kind[once], return_inverse=True)
        bad = np.bincount(index, weights=toxic[where], minlength=len(names))
        good = np.bincount(index, weights=~toxic[where], minlength=len(names))
        rate = (bad / max(toxic.sum(), 1)) / ((good + 0.5) / max((~toxic).sum(), 1))
        use = ((rate >= 20) & (bad >= CUE_TEXTS))[index] & toxic[where]
        kept.append((names[index[use]], where[use], good[index[use]]))
    code, where, good = (np.concatenate(x) for x in zip(*kept))
    names, first, index = np.unique(code, return_index=True, return_inverse=True)
    cost = 5 * good[first]  # a clean text with the cue weighs as much as five toxic ones
    chosen = []
    while len(index) and len(chosen) < CUES:
        n = np.bincount(index, minlength=len(names)) - cost
        best = int(np.argmax(n))
        if n[best] < CUE_TEXTS:
            break
        chosen.append(names[best])
        explained = np.unique(where[index == best])
        rest = ~np.isin(where, explained)
        index, where = index[rest], where[rest]
    return np.array(sorted(chosen), np.uint64)


def fit_field(tok: Tokens, label: np.ndarray, toxic: np.ndarray) -> Field:
    """Maximum likelihood with a small ridge, by Adam steps."""
    features, first = tok.features, tok.first
    y = label.astype(float)
    starts = first[:-1]
    inner = np.ones(len(y), bool)
    inner[starts] = False
    after = np.flatnonzero(inner)
    seen = np.array([[((1 - y[after - 1]) * (1 - y[after])).sum(), ((1 - y[after - 1]) * y[after]).sum()],
                     [(y[after - 1] * (1 - y[after])).sum(), (y[after - 1] * y[after]).sum()]])
    begun = np.array([(1 - y[starts]).sum(), y[starts].sum()])
    field = Field(np.zeros(SIZE), -3.0, np.zeros(2), np.zeros((2, 2)))
    moments: dict[str, list] = {}
    for t in range(1, STEPS + 1):
        prob, expected, _ = field.marginals(features, first, pairs=True)
        gap = y - prob
        pull = sum(np.bincount(kind, weights=gap, minlength=SIZE) for kind in features.T)
        grad = {"weights": pull - 0.02 * field.weights, "bias": gap.sum(), "move": seen - expected,
                "begin": begun - np.array([(1 - prob[starts]).sum(), prob[starts].sum()])}
        for k, g in grad.items():
            m, v = moments.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moments[k] = (m, v)
            rate = 0.3 if k == "weights" else 0.15
            setattr(field, k, getattr(field, k) + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8))
    prob = field.marginals(features, first)
    strength = -np.bincount(tok.row, weights=np.log1p(-np.clip(prob, 0, 1 - 1e-12)), minlength=len(toxic))
    x = np.log(np.expm1(np.clip(strength, 1e-9, 30)))
    a, b = 0.5, 0.0
    for _ in range(50):  # logistic calibration by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((toxic - p) * x).sum() - (a - 0.5), (toxic - p).sum()])
        a, b = max(a + np.clip(step[0], -1, 1), 0.05), b + np.clip(step[1], -3, 3)
    field.slope, field.shift = float(a), float(b)
    field.weights = field.weights.astype(np.float32)
    return field


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from at most ``sample`` labelled texts of either class, in the
    order of a hash; None without both classes."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t2")).where("toxic = t2").drop("t2"))
    order = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample rows of an id and a label
    rows = (docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(chosen, "doc_id").collect())
    texts = {r["text"]: bool(r["toxic"]) for r in rows}  # copies of one text count once
    toxic = np.array(list(texts.values()), bool)
    if not toxic.any() or toxic.all():
        return None
    tok = joined_tokens(pa.record_batch({"text": pa.array(list(texts), pa.string())}))
    cues = pick_cues(tok.codes, tok.row, toxic)
    label = np.isin(tok.codes, cues).any(axis=1) & toxic[tok.row]
    return fit_field(tok, label, toxic)


def scored(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``: spans are the offending
    byte ranges of the text (UTF-8)."""
    schema = ("doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: int, end: int>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(field)  # SIZE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for part in blocks(batch):
                n = part.num_rows
                score, hit = np.zeros(n), np.zeros(0, np.int64)
                if field is not None:
                    tok = tokens(part.column("text"))
                    prob, score = field.text_scores(tok, n)
                    hit = np.flatnonzero(prob > SPAN_AT)
                    new = np.ones(len(hit), bool)  # neighbouring words are one span
                    new[1:] = (hit[1:] != hit[:-1] + 1) | (tok.row[hit[1:]] != tok.row[hit[:-1]])
                    a = hit[new]
                    z = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
                    counts = np.bincount(tok.row[a], minlength=n)
                    pairs = pa.StructArray.from_arrays([pa.array(tok.start[a].astype(np.int32)), pa.array(tok.end[z].astype(np.int32))], ["start", "end"])
                else:
                    counts = np.zeros(n, np.int64)
                    pairs = pa.array([], pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32)), spans],
                    ["doc_id", "held_out", "score", "predicted", "spans"])

    return rows.mapInArrow(run, T._parse_datatype_string(schema))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score, decision and offending spans for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
