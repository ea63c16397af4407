"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so similarity of whole sets says nothing;
what counts is how much of an item a document contains.  Items are partitioned
by their number of shingles.  An item of n shingles at threshold t may miss at
most n - ceil(t n) of them, so the k smallest hash values of its shingles with k one
more than that (the greatest k of its size partition) are a MinHash sketch of which a document with
enough of the item has at least one value: the search loses nothing.  A
document's own shingle hashes are looked up in the sorted sketch values, and
the item's exact share is then counted on the words themselves.

Items are handled in blocks of at most about ``BLOCK_BYTES`` of text; a block
is what is broadcast, and every block is held against all documents in a scan
without a shuffle, however many blocks the benchmark needs.

Defined cases: null or empty texts and items match nothing; an item with fewer
words than a shingle is one shingle of all its words; repeated rows and items
give a match each; rows without doc_id are searched like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.words import blocks, words_of

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 16 << 20


def _shingles(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]


class ItemIndex:
    """Sketches and exact shingles of a block of items."""

    def __init__(self, ids: list, texts: list[str], shingle: int, threshold: float) -> None:
        self.ids, self.sets, self.need, self.length = [], [], [], []
        codes: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in zip(ids, texts):
            words = text.encode().lower().split()
            if not words:
                continue
            n = min(shingle, len(words))
            column = pa.array([text])
            w = words_of(column, lower=True)
            hashes = np.unique(w.ngrams(w.codes(), n))
            size = len(hashes)
            top = (1 << size.bit_length()) - 1  # the largest size of this partition
            k = min(size, max(s - math.ceil(threshold * s - 1e-9) for s in range((top + 1) // 2, top + 1)) + 1)
            codes.setdefault(n, []).append(hashes[:k])
            owners.setdefault(n, []).append(np.full(k, len(self.ids)))
            self.ids.append(item)
            self.sets.append(set(_shingles(words, n)))
            self.need.append(math.ceil(threshold * len(self.sets[-1]) - 1e-9))
            self.length.append(n)
        self.sketch = {}
        for n, parts in codes.items():
            c, o = np.concatenate(parts), np.concatenate(owners[n])
            order = np.argsort(c, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(c >> np.uint64(48)).astype(np.int64)] = True
            self.sketch[n] = (c[order], o[order], seen)

    def candidates(self, part: pa.RecordBatch) -> dict[int, set[int]]:
        """Items that share a sketch value with a row, by row."""
        words = words_of(part.column("text"), lower=True)
        out: dict[int, set[int]] = {}
        if not len(words.start):
            return out
        codes = words.codes()
        for n, (values, owner, seen) in self.sketch.items():
            at = words.whole(n)
            grams = words.ngrams(codes, n)[at]
            near = seen[(grams >> np.uint64(48)).astype(np.int64)]
            at, grams = at[near], grams[near]
            lo, hi = np.searchsorted(values, grams, "left"), np.searchsorted(values, grams, "right")
            rows = np.searchsorted(words.first, at, "right") - 1
            for i in np.flatnonzero(hi > lo):
                out.setdefault(int(rows[i]), set()).update(owner[lo[i]:hi[i]].tolist())
        return out

    def matches(self, part: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, shingles held, first word, end word) of real matches."""
        texts = part.column("text")
        for row, items in sorted(self.candidates(part).items()):
            words = texts[row].as_buffer().to_pybytes().lower().split()
            places: dict[int, dict[bytes, int]] = {}
            for item in sorted(items):
                n = self.length[item]
                if n not in places:
                    places[n] = {s: i for i, s in enumerate(_shingles(words, n))}
                held = [places[n][s] for s in self.sets[item] if s in places[n]]
                if len(held) >= self.need[item]:
                    yield row, item, len(held), min(held), max(held) + n


def item_blocks(items: DataFrame, shingle: int, threshold: float, block_bytes: int) -> Iterator[ItemIndex]:
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = math.ceil(total / block_bytes)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        if rows:
            yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], shingle, threshold)


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_held, containment, first_word,
    end_word`` for every document and item with enough of the item inside
    (the word range from the first to the last shingle held, where a shingle
    occurs more than once its last place counts)."""
    schema = ("doc_id long, item_id long, n_shingles int, n_held int, containment double, first_word int, end_word int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for index in item_blocks(items, shingle, threshold, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = []
                for part in blocks(batch):
                    ids = part.column("doc_id")
                    found += [(ids[r].as_py(), index.ids[i], len(index.sets[i]), n, n / len(index.sets[i]), a, b)
                              for r, i, n, a, b in index.matches(part)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)],
                                                 ["doc_id", "item_id", "n_shingles", "n_held", "containment", "first_word", "end_word"])

        out = out.unionByName(rows.mapInArrow(search, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    for index in item_blocks(items, shingle, threshold, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in blocks(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[m[0] for m in shared.value.matches(part)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, T.StructType(list(docs.schema.fields)))
    return docs


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), b AS (
  SELECT item_id, ws, least(5, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x20\x09-\x0D]+') AS ws FROM benchmark) WHERE len(ws) > 0
), bs AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM b, unnest(range(1, len(ws) - n + 2)) AS u(i)
), bn AS (SELECT item_id, count(*) AS total FROM bs GROUP BY item_id
), ns AS (SELECT DISTINCT n FROM b
), ds AS (
  SELECT doc_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s, max(i) - 1 AS place
  FROM d, ns, unnest(CASE WHEN len(ws) >= n THEN range(1, len(ws) - n + 2) ELSE [] END) AS u(i) GROUP BY ALL
), hit AS (
  SELECT doc_id, bs.item_id, count(*) AS n_held, min(place) AS a, max(place + bs.n) AS z
  FROM ds JOIN bs ON ds.s = bs.s AND ds.n = bs.n GROUP BY doc_id, bs.item_id
)
SELECT doc_id, hit.item_id, CAST(total AS INTEGER) AS n_shingles, CAST(n_held AS INTEGER) AS n_held,
       n_held / CAST(total AS DOUBLE) AS containment, CAST(a AS INTEGER) AS first_word, CAST(z AS INTEGER) AS end_word
FROM hit JOIN bn ON hit.item_id = bn.item_id WHERE n_held >= ceil(0.8 * total - 1e-9)
"""
