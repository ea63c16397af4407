"""Substring deduplication by prefix-partitioned suffix trees.

A suffix is what follows a word of a document; only its first ``window``
words matter, so a suffix is a path of ``window`` words in a tree.  The forest
is cut by prefixes of variable length: counts of hashed 2-, 4-, 8- ... word
prefixes over the whole corpus give each suffix the shortest prefix whose
suffixes fit in memory, and prefixes are gathered into groups of equal size.
A group is one task: its suffixes are sorted, neighbours with equal codes hang
below the same internal node of depth ``window``, and such a node's
leaves in other documents than the smallest are repeats.  Codes are hashes of whole
windows, so there are no other nodes: spans are runs of words that repeats cover,
and a run may join passages of different documents.

A prefix that is too frequent even at full depth (one passage in a third of
all documents) is dealt to several tasks by document; each keeps one
representative per node, and the representatives meet in a second, small
round, so no task sees all its copies.

A suffix crosses the shuffle as an 80-bit code of its words (two independent
hashes), its document and its place; two different windows are taken for equal
with probability 2**-80 per pair within a group.

Defined cases: null or empty texts have no words; rows without doc_id neither
give nor lose words; rows that share a doc_id are one document (no window of
one is a repeat of the other); other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.tables import written
from gradewise.llm.words import blocks, words_of

WINDOW = 13
GROUP_SUFFIXES = 1_000_000  # suffixes of one tree (about 13 MB, 100 MB while it is built)
FLUSH_SUFFIXES = 1_500_000  # suffixes a map task holds before it writes its pieces

_PIECE = T.StructType([T.StructField("grp", T.IntegerType())] + [
    T.StructField(c, T.BinaryType()) for c in ("ids", "marks", "runs", "places", "codes", "extra")])
_FOUND = T.StructType([T.StructField("representative", T.BooleanType()), *_PIECE.fields])
_REPEATS = "doc_id long, mark long, places binary"


def prefix_lengths(window: int) -> list[int]:
    """Lengths a prefix may have: 2, 4, 8 ... and the whole window."""
    out, n = [], 2
    while n < window:
        out.append(n)
        n *= 2
    return [*out, window]


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of an integer array, equal ranks together, compressed."""
    flat = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())


def _expand(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()


def _suffixes(batch: pa.RecordBatch, window: int, lengths: list[int], bits: int, full: bool):
    """Per block: rows, places, codes and the prefix bucket at each length."""
    for part in blocks(batch):
        words = words_of(part.column("text"))
        at = words.whole(window)
        if not len(at):
            continue
        codes = words.codes()
        shift = np.uint64(64 - bits)
        grams = [words.ngrams(codes, n)[at] for n in lengths]
        buckets = [(g >> shift).astype(np.int32) for g in grams]
        if not full:
            yield buckets
            continue
        row = words.row[at]
        extra = (words.ngrams(codes, window, family=1)[at] >> np.uint64(48)).astype(np.uint16)
        # the group's bits of the code say nothing new within a group; the rest is kept whole
        yield part, row, (at - words.first[row]).astype(np.uint32), grams[-1], extra, buckets


def prefix_counts(docs: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """Number of suffixes in each hashed prefix, for each prefix length."""
    lengths = prefix_lengths(window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(lengths), 1 << bits), np.int64)
        for batch in batches:
            for buckets in _suffixes(batch, window, lengths, bits, full=False):
                for level, b in enumerate(buckets):
                    total[level] += np.bincount(b, minlength=1 << bits)
        level, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(bucket.astype(np.int32)),
                                          pa.array(total[level, bucket])], ["level", "bucket", "n"])

    rows = docs.mapInArrow(count, "level int, bucket int, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n"))
    out = [np.zeros(1 << bits, np.int64) for _ in lengths]
    for level, bucket, n in rows.collect():  # at most len(lengths) * 2**bits counters
        out[level][bucket] = n
    return out


class Plan:
    """Which group takes the suffixes of each prefix.

    ``group[level][bucket]`` is the group, or -1 where the prefix has too many
    suffixes and the next length decides; beyond the last length the suffixes
    go to ``spread`` extra groups by document."""

    def __init__(self, counts: list[np.ndarray], groups: int) -> None:
        total = int(counts[0].sum())
        share = max(1, math.ceil(total / groups))
        self.groups, self.group = groups, []
        for level, n in enumerate(counts):
            take = n <= max(share // 2, 1)
            where = np.full(len(n), -1, np.int32)
            if level == 0:  # largest first into the emptiest group
                heap = [(0, g) for g in range(groups)]
                for b in sorted(np.flatnonzero(take & (n > 0)), key=lambda b: -n[b]):
                    load, g = heapq.heappop(heap)
                    where[b] = g
                    heapq.heappush(heap, (load + int(n[b]), g))
            else:
                where[take] = (np.flatnonzero(take) * 0x9E3779B1 >> 7) % groups
            self.group.append(where)
        hot = int(counts[-1][self.group[-1] < 0].sum())
        self.spread = math.ceil(2 * hot / share)

    def of(self, buckets: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        out = self.group[0][buckets[0]]
        for where, b in zip(self.group[1:], buckets[1:]):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                return out
            out[open_] = where[b[open_]]
        open_ = np.flatnonzero(out < 0)
        if len(open_):
            out[open_] = self.groups + _scatter(ids[open_], max(self.spread, 1))
        return out


def _pieces(grp, ids, marks, place, code=None, extra=None) -> Iterator[list]:
    """One row per group of the suffixes held, documents run-length coded."""
    order = np.argsort(grp.astype(np.uint16) if grp.max(initial=0) < 65536 else grp, kind="stable")
    grp = grp[order]
    cuts = np.flatnonzero(np.diff(grp)) + 1
    for seg in np.split(order, cuts):
        d, m, p = ids[seg], marks[seg], place[seg].astype(np.int64)
        new = np.ones(len(seg), bool)
        new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (p[1:] < p[:-1])
        at = np.flatnonzero(new)
        step = np.diff(p, prepend=0)
        step[at] = p[at]
        yield [_squeeze(d[at]), _squeeze(m[at].astype(np.uint32)), _squeeze(np.diff(at, append=len(seg)).astype(np.uint32)),
               _squeeze(step.astype(np.uint32)), None if code is None else code[seg].tobytes(),
               None if extra is None else extra[seg].tobytes()]


def _unpiece(ids, marks, runs, places):
    n = _expand(runs, np.uint32).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    step = _expand(places, np.uint32).astype(np.int64)
    p = np.cumsum(step)
    p -= np.repeat(p[at] - step[at], n)
    return np.repeat(_expand(ids, np.int64), n), np.repeat(_expand(marks, np.uint32), n), p.astype(np.uint32)


def _leaves(table: pa.Table):
    """Document, mark and place of all suffixes in a group's pieces."""
    cols = [table.column(c).to_pylist() for c in ("ids", "marks", "runs", "places")]
    return (np.concatenate(x) for x in zip(*(_unpiece(*row) for row in zip(*cols))))


def deep_nodes(code: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of one tree in order, and where each node of full depth begins:
    neighbours in sorted order share such a node when their codes are equal."""
    order = np.argsort(code, kind="stable")
    c, x = code[order], extra[order]
    if np.any((c[1:] == c[:-1]) & (x[1:] != x[:-1])):
        order = np.lexsort((extra, code))
        c, x = code[order], extra[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
    return order, np.flatnonzero(new)


def _tree(spread_from: int, groups: int):
    """Build one group's subtree; give its repeats in pieces by document bucket
    and, for a prefix that was dealt to several groups, representatives of
    each node in pieces by code."""

    def build(table: pa.Table) -> pa.Table:
        ids, marks, place = _leaves(table)
        code = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("codes")])
        extra = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("extra")])
        order, at = deep_nodes(code, extra)
        smallest = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(at, append=len(order)))
        rows = []
        repeat = order[ids[order] > smallest]
        if len(repeat):
            by = repeat[np.lexsort((place[repeat], marks[repeat], ids[repeat]))]
            bucket = _scatter(ids[by], groups)
            rows += [[False, int(g), *p] for g, p in zip(np.unique(bucket), _pieces(bucket, ids[by], marks[by], place[by]))]
        if spread_from >= 0 and table.column("grp")[0].as_py() >= spread_from:
            keep = np.sort(order[ids[order] == smallest])  # the smallest document's leaves stand for the node
            bucket = _scatter(code[keep], groups)
            rows += [[True, int(g), *p] for g, p in zip(np.unique(bucket), _pieces(
                bucket, ids[keep], marks[keep], place[keep], code[keep], extra[keep]))]
        kinds = [pa.bool_(), pa.int32()] + [pa.binary()] * 6
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _FOUND.names)

    return build


def _scatter(x: np.ndarray, n: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def _by_document(table: pa.Table) -> pa.Table:
    """One row per document of a bucket with all its repeated places."""
    ids, marks, place = _leaves(table)
    order = np.lexsort((place, marks, ids))
    ids, marks, place = ids[order], marks[order], place[order]
    at = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]))
    return pa.table({"doc_id": ids[at], "mark": marks[at].astype(np.int64),
                     "places": pa.array([x.tobytes() for x in np.split(place, at[1:])], pa.binary())})


def repeated_places(docs: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES,
                    bits: int | None = None) -> DataFrame:
    """``doc_id, mark, places``: the words at which a window begins that also
    begins in a document with a smaller id (``mark`` is the text's CRC-32;
    ``places`` is an array of packed little-endian uint32)."""
    spark = docs.sparkSession
    rows = (docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                    F.crc32(F.col("text").cast("binary")).alias("mark")))
    if bits is None:  # counters in proportion to the input's splits, within bounds
        bits = min(20, max(14, (rows.rdd.getNumPartitions() * 64 - 1).bit_length()))
    counts = prefix_counts(rows.select("text"), window, bits)
    total = int(counts[0].sum())
    if not total:
        return spark.createDataFrame([], _REPEATS)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2 * partitions, math.ceil(total / group_suffixes))
    plan = spark.sparkContext.broadcast(Plan(counts, groups))  # 4 bytes a counter
    spread = plan.value.spread
    lengths = prefix_lengths(window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            grp, ids, marks, place, code, extra = (np.concatenate(x) for x in zip(*held))
            held.clear()
            pieces = [[int(g), *p] for g, p in zip(np.unique(grp), _pieces(grp, ids, marks, place, code, extra))]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*pieces), [pa.int32()] + [pa.binary()] * 6)], _PIECE.names)

        n = 0
        for batch in batches:
            for part, row, place, code, extra, buckets in _suffixes(batch, window, lengths, bits, full=True):
                ids = part.column("doc_id").to_numpy()[row]
                marks = part.column("mark").to_numpy()[row].astype(np.uint32)
                held.append((plan.value.of(buckets, ids), ids, marks, place, code, extra))
                n += len(row)
                if n >= FLUSH_SUFFIXES:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    pieces = rows.mapInArrow(cut, _PIECE)
    found = written(pieces.groupBy("grp").applyInArrow(_tree(groups if spread else -1, groups), _FOUND), "repeats")
    repeats = found.where(~F.col("representative"))
    if spread:
        again = found.where("representative").groupBy("grp").applyInArrow(_tree(-1, groups), _FOUND)
        repeats = repeats.unionByName(written(again, "repeats-spread"))
    return repeats.groupBy("grp").applyInArrow(_by_document, _REPEATS)


def _spans(places: np.ndarray, window: int) -> np.ndarray:
    """Maximal runs of covered words as [start, end) pairs."""
    places = np.unique(places)
    new = np.flatnonzero(np.diff(places.astype(np.int64), prepend=-window - 1) > window)
    last = np.append(new[1:], len(places)) - 1
    return np.stack([places[new], places[last] + window], axis=1).astype(np.int64)


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True,
                    group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """The columns of ``docs`` plus ``n_words, n_removed, kept_sha256, spans``
    (word ranges removed: runs of words that repeats cover) and, with ``with_text``, a new
    ``text`` (kept words joined by one space where words were removed, else
    the text as it was).  Columns of ``docs`` with these names are replaced."""
    added = ("n_words", "n_removed", "kept_sha256", "spans")
    mark = F.crc32(F.col("text").cast("binary"))
    places = (repeated_places(docs, window, group_suffixes)
              .select(F.col("doc_id").alias("__repeat_id"), F.col("mark").alias("__repeat_mark"), F.col("places").alias("__repeat_places")))
    carried = [c for c in docs.columns if c not in added]
    if not with_text:
        carried = [c for c in carried if c == "doc_id"]
    left = docs.select(*dict.fromkeys([*carried, "doc_id", "text"]))
    joined = (left.join(places, (left["doc_id"].cast("long") == F.col("__repeat_id")) & (mark == F.col("__repeat_mark")), "left")
              .drop("__repeat_id", "__repeat_mark"))
    schema = T.StructType([left.schema[c] for c in carried] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, removed, digest, spans = [], [], [], [], []
            for text, got in zip(batch.column("text"), batch.column("__repeat_places").to_pylist()):
                raw = (text.as_buffer().to_pybytes() if text.is_valid else b"")
                words = raw.split()
                n_words.append(len(words))
                cut = _spans(np.frombuffer(got, np.uint32), window) if got else []
                kept, at = [], 0
                for a, b in cut:
                    kept += words[at:a]
                    at = b
                kept = kept + words[at:] if at else words
                joined_text = b" ".join(kept)
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined_text).hexdigest())
                spans.append([{"start": int(a), "end": int(b)} for a, b in cut])
                if with_text:
                    texts.append((joined_text if len(cut) else raw).decode() if text.is_valid else None)
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], schema.names)

    return joined.mapInArrow(finish, schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: words, words removed, digest of the kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram
  FROM w, unnest(CASE WHEN len(ws) >= 13 THEN range(1, len(ws) - 11) ELSE [] END) AS u(i)
), m AS (SELECT gram, min(doc_id) AS d FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN m ON g.gram = m.gram AND m.d < g.doc_id, unnest(range(0, 13)) AS t(k)
), p AS (SELECT doc_id, ws, i FROM w, unnest(range(1, len(ws) + 1)) AS u(i)
), k AS (
  SELECT p.doc_id, count(*) FILTER (WHERE c.i IS NOT NULL) AS n_removed,
         string_agg(p.ws[p.i], ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept,
         count(*) FILTER (WHERE c.i IS NULL OR c.i IS NOT NULL) AS n,
         count(*) FILTER (WHERE c.i IS NOT NULL AND cb.i IS NULL) AS n_spans
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i LEFT JOIN c cb ON p.doc_id = cb.doc_id AND p.i - 1 = cb.i
  GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
