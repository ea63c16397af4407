"""Near-duplicate classes by SimHash with covering locality-sensitive hashing.

Each text's word shingles are hashed and summed into a 64-bit fingerprint; two
fingerprints are linked when at most ``radius`` bits differ, and a class is a
connected component of that graph.

Linked pairs are found by covering hashing: every bit position gets a vector
of ``radius + 1`` bits, and table v (of 2**(radius+1) - 1) keeps the positions
whose vector has odd parity with v.  The vectors of any ``radius`` positions leave a
non-zero v orthogonal to all of them, so a linked pair agrees on that table's
kept bits: no pair within the radius is missed.  Tables hold distinct
fingerprints (exact copies are one), a bucket is searched breadth-first and
gives a spanning forest of its links, never its pairs.  A bucket over
``BUCKET`` fingerprints is not held: it is divided by a second covering of the
bits that its table left out, again without losing a pair.  Components are
found by alternating large-star and small-star rounds on written tables.

Defined cases: null, empty and wordless texts have fingerprint zero and are
linked like any other; texts with fewer words than a shingle hash the whole
sequence; rows without doc_id get the class of their fingerprint and name no
class (null where no row of the class has an id); repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.llm.tables import written

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
BUCKET = 1 << 15  # fingerprints of one bucket that a task holds


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text (UTF-8)."""
    words = text.lower().split()  # bytes: A-Z only, space and 0x09-0x0D only
    if not words:
        return 0
    line = np.frombuffer(joined := b" ".join(words), np.uint8)
    gaps = np.flatnonzero(line == 0x20)
    n = max(len(words) - shingle + 1, 1)
    starts = np.concatenate([[0], gaps + 1])[:n].tolist()
    ends = np.concatenate([gaps, [len(joined)]])[-n:].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)])
    ones = np.zeros(BITS, np.int64)
    bits = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        ones += np.unpackbits(bits[at:at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp``: the fingerprint as a signed long; ``mark`` is
    Spark's xxhash64 of the text, to tell rows with one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle)
                           for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(fp.view(np.int64))],
                                             ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """For each table the mask of the bit positions it keeps."""
    width = radius + 1
    vector = {p: i % ((1 << width) - 1) + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, 1 << width)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bucket_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, breadth
    first: each visited one is compared with those not yet reached."""
    rest, edges = fps, []
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        frontier = [seed]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                edges += [(int(at), int(x)) for x in rest[near]]
                frontier += list(rest[near])
                rest = rest[~near]
    return edges


def _links(rows: DataFrame, keys: list[str], radius: int, limit: int | None) -> DataFrame:
    """Stream buckets in key order.  Gives ``a, b, table`` with a link's ends,
    or, for buckets over ``limit``, a fingerprint to be divided further."""
    names = [*keys, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now: tuple | None = None
        deep = False

        def close():
            if not deep and held:
                fps = np.concatenate(held).view(np.uint64)
                if len(fps) > 1:
                    for a, b in bucket_forest(fps, radius):
                        out.append((_signed(a), _signed(b), -1))
            held.clear()

        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_numpy() for c in names]
            cut = np.zeros(batch.num_rows, bool)
            cut[:1] = True
            for c in cols[:-1]:
                cut[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(cut)
            for lo, hi in zip(at, np.append(at[1:], batch.num_rows)):
                key = tuple(int(c[lo]) for c in cols[:-1])
                if key != now:
                    close()
                    now, deep = key, False
                held.append(cols[-1][lo:hi])
                if limit and (deep or sum(map(len, held)) > limit):
                    deep = True
                    out += [(int(x), None, key[0]) for part in held for x in part]
                    held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["a", "b", "tab"])
        out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["a", "b", "tab"])

    return (rows.repartition(*keys).sortWithinPartitions(*keys).select(*names)
            .mapInArrow(run, "a long, b long, tab long"))


def _tables(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key"))
                               for t, m in enumerate(masks)]))


def links(fps: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """``a, b``: links that connect the same distinct fingerprints ``fp`` as
    all links within ``radius`` do."""
    masks = covering_masks(radius, list(range(BITS)))
    rows = fps.select("fp", _tables(F.col("fp"), masks).alias("x")).select("x.t", "x.key", "fp")
    first = written(_links(rows, ["t", "key"], radius, limit), "simhash-links")
    found = first.where(F.col("b").isNotNull()).select("a", "b")
    if first.where(F.col("b").isNull()).limit(1).count():
        # the bits that table t left out, covered once more
        inner = F.array(*[F.array(*[F.lit(_signed(m)) for m in covering_masks(
            radius, [p for p in range(BITS) if not mask >> p & 1])]) for mask in masks])
        outer = F.array(*[F.lit(_signed(m)) for m in masks])
        deep = (first.where(F.col("b").isNull())
                .select("tab", F.col("a").alias("fp"), F.element_at(outer, (F.col("tab") + 1).cast("int")).alias("m"),
                        F.posexplode(F.element_at(inner, (F.col("tab") + 1).cast("int"))).alias("t2", "m2"))
                .select(F.col("tab").alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "t2",
                        F.col("fp").bitwiseAND(F.col("m2")).alias("key2"), "fp"))
        # what is left free is a quarter of the bits, so a bucket has a fixed greatest size
        found = found.unionByName(written(_links(deep, ["t", "key", "t2", "key2"], radius, None), "simhash-deep")
                                  .select("a", "b"))
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges; root is the smallest
    node of its component.  Large-star and small-star rounds until nothing
    changes; hubs are pre-aggregated, so no round gathers a node's edges."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e holds each edge once as (big, small)
        both = e.unionByName(e.select(F.col("small").alias("big"), F.col("big").alias("small"))) if large else e
        least = both.groupBy("big").agg(F.min("small").alias("m"))
        joined = both.join(least.withColumnRenamed("big", "u"), F.col("big") == F.col("u"))
        if large:  # neighbours larger than u go to the least of u and its neighbours
            out = joined.where(F.col("small") > F.col("big")).select(
                F.col("small").alias("big"), F.least("m", "big").alias("small"))
        else:  # u and its smaller neighbours go to the least of them
            out = joined.select(F.explode(F.array("small", "big")).alias("big"), F.col("m").alias("small"))
        return out.where(F.col("big") != F.col("small")).distinct()

    now = edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).where("big != small").distinct()
    now, seen = written(now, "components"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("h")).first()
        if seen == (state["n"], state["h"]):
            return now.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(
                now.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct())
        seen = (state["n"], state["h"])
        now = written(star(star(now, True), False), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``fp, doc_id, mark, root, component_id``, one row per row of ``docs``;
    root is the smallest fingerprint (signed) of the class."""
    rows = written(fingerprints(docs, shingle), "simhash")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(reps.select("fp"), radius))
    classes = (reps.join(roots, F.col("fp") == F.col("node"), "left")
               .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the row with the
    smallest doc_id (of rows that share it, the one with the smallest ``mark``;
    copies of one row count once; a row without doc_id only where its class
    has no other)."""
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("mark"))
    best = (near_duplicates(docs, shingle, radius).groupBy("root").agg(F.min(first).alias("k"))
            .select(F.col("k.doc_id").alias("__best_id"), F.col("k.mark").alias("__best_mark")))
    named = docs.withColumn("__own_id", F.col("doc_id").cast("long")).withColumn("__own_mark", F.xxhash64("text"))
    kept = named.join(best, F.col("__own_id").eqNullSafe(F.col("__best_id")) & (F.col("__own_mark") == F.col("__best_mark")), "left_semi")
    return kept.dropDuplicates(["__own_id", "__own_mark"]).select(*docs.columns)


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
