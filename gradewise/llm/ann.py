"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by Gaussian projections, cut into slots; a row is stored in
one bucket per table.  The projections of two vectors at distance d differ by a normal
variable of deviation d, so for a query the chance that a neighbour lies in a bucket at any
slot offsets is known, and buckets are visited in the order of that chance
until the tables together reach ``RECALL`` (offsets over 4.5 deviations, some 10^-5 of the chance, aside).
The candidates of a visited bucket are all compared exactly, and only a
query's best ``k`` leave a task.

The scale is the distance of the k-th neighbour that ``SCALE`` of ``FITTED`` rows have, found exactly among all
rows.  Tables, projections per table and slot width are then the ones of least estimated work: rows
compared (their share measured on ``SAMPLE`` rows at most, times the number of rows), buckets
visited and rows stored.  The more rows, the more projections pay.  Where neighbours are hardly nearer than
other rows (vectors without clusters in many dimensions), every hashing at this recall visits most rows; ``compared`` tells.

Buckets over an even share of the rows (``BUCKET`` at most) are divided by row, and a query visits
every part.  Of identical vectors the k + 1 smallest ids can ever be in a result, so
more are not indexed.  Queries whose k-th found neighbour is farther than the scale probe
again at that distance; those left with fewer than k neighbours, or with one farther than
``wider`` scales (where buckets to visit would be too many), are searched against all rows, in blocks.

Defined cases: vectors that are null, empty, zero, of another length than most rows',
or that hold null or non-finite components take no part, nor do null ids; rows that share
an id and vector are one, rows that share an id only are compared each; ties go to the smaller id; a table without queries
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewise.llm.tables import written
from gradewise.session import bounded_broadcast

K = 10
RECALL = 0.97
SCALE = 0.9  # share of rows whose k-th neighbour is within the scale
FITTED = 200  # rows whose k-th neighbour is searched exactly to fit the scale
SAMPLE = 10_000  # rows on which shares of visited rows are measured
TRIED = 8  # queries a choice is measured with
CHOICES = [(hashes, width) for hashes in (4, 6, 8, 10, 12) for width in (1.0, 2.0, 3.0)]  # width in scales
TABLES = (2, 3, 4, 6)
PROBES = 4_096  # buckets a table that a choice may need at the scale; visits themselves have no limit
PROBE_WORK, STORE_WORK = 10, 100  # work of a visit and of a stored row, in distances
BUCKET = 50_000
LEAST = 256  # rows below which a bucket is never divided
QUERY_BLOCK = 2_048
SEED = 7

_NORMAL = np.vectorize(math.erf)


class Hashes:
    """Projections, offsets and slot width of all tables."""

    def __init__(self, dimension: int, distance: float, tables: int, hashes: int, width: float, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.distance, self.tables, self.hashes = distance, tables, hashes
        self.width = width * distance
        self.wider = 1.0  # times the scale that probes reach
        self.lines = rng.standard_normal((tables * hashes, dimension))
        self.offsets = rng.uniform(0, self.width, tables * hashes)
        self.step = rng.integers(1 << 62, size=hashes, dtype=np.int64) | 1

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.lines.T + self.offsets) / self.width).reshape(-1, self.tables, self.hashes)

    def key(self, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (slots.astype(np.int64) * self.step).sum(axis=-1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self.key(np.floor(self.project(x)))

    def visits(self, place: np.ndarray, distance: float, success: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Bucket keys of a table in order of estimated success, until ``success``, and the
        chance reached with each, for a query at ``place``; None if there are over ``most``.

        The best combinations of all projections begin with best combinations of the first ones, so
        only as many as are wanted are carried from projection to projection."""
        slot = np.floor(place)
        reach = math.ceil(4.5 * distance / self.width) + 1
        moves = np.arange(-reach, reach + 1, dtype=np.int64)
        edge = np.arange(-reach, reach + 2)[None, :] + (slot - place)[:, None]
        chance = np.log(np.maximum(np.diff(0.5 * (1 + _NORMAL(edge * self.width / (distance * math.sqrt(2)))), axis=1), 1e-300))
        carried = 256
        while True:
            total, key, whole = np.zeros(1), np.zeros(1, np.int64), True
            for h in range(self.hashes):
                total = (total[:, None] + chance[h][None, :]).ravel()
                with np.errstate(over="ignore"):
                    key = (key[:, None] + (moves * self.step[h])[None, :]).ravel()
                if len(total) > carried:
                    best = np.argpartition(-total, carried - 1)[:carried]
                    total, key, whole = total[best], key[best], False
            order = np.argsort(-total, kind="stable")
            reached = np.cumsum(np.exp(total[order]))
            if whole or reached[-1] >= success:
                break
            if most and carried > most:
                return None
            carried *= 4
        n = int(np.searchsorted(reached, min(success, reached[-1]))) + 1
        if most and n > most:
            return None
        with np.errstate(over="ignore"):
            return key[order[:n]] + self.key(slot), reached[:n]

    def probes(self, x: np.ndarray, distance: float) -> Iterator[tuple[int, np.ndarray]]:
        """(table, bucket keys) that one query visits whose neighbours are ``distance`` away."""
        place = self.project(x[None, :])[0]
        for t in range(self.tables):
            yield t, self.visits(place[t], distance, success(self.tables))[0]


def success(tables: int) -> float:
    """Chance that each table must reach so that all miss a neighbour with 1 - RECALL."""
    return 1 - (1 - RECALL) ** (1 / tables)


def fitted(sample: np.ndarray, kth: np.ndarray, rows: int, queries: int) -> Hashes:
    """The hashing of least estimated work a query, given distances of some k-th neighbours."""
    dimension = sample.shape[1]
    distance = float(np.quantile(kth, SCALE)) or float(kth.max()) or 1.0
    best: tuple[float, int, int, float, float] | None = None
    asked = sample[:: max(1, len(sample) // TRIED)][:TRIED]
    for hashes, width in CHOICES:
        h = Hashes(dimension, distance, 1, hashes, width)
        own, places = h.buckets(sample)[:, 0], h.project(asked)[:, 0]
        found = [h.visits(p, distance, success(min(TABLES)), PROBES) for p in places]
        if any(f is None for f in found):
            continue
        wider = 1.0
        for w in (1.25, 1.5, 2.0):
            if any(h.visits(p, w * distance, success(min(TABLES)), 4 * PROBES) is None for p in places[:3]):
                break
            wider = w
        for tables in TABLES:
            cut = [keys[:int(np.searchsorted(reached, min(success(tables), reached[-1]))) + 1] for keys, reached in found]
            share = float(np.mean([np.isin(own, keys).mean() for keys in cut]))
            share = 1 - (1 - share) ** tables + float(np.mean(kth > wider * distance))
            work = share * rows + PROBE_WORK * tables * float(np.mean([len(c) for c in cut])) + STORE_WORK * tables * rows / max(queries, 1)
            if best is None or work < best[0]:
                best = (work, tables, hashes, width, wider)
    _, tables, hashes, width, wider = best or (0.0, min(TABLES), *CHOICES[0], 1.0)
    out = Hashes(dimension, distance, tables, hashes, width)
    out.wider = wider
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimension)


def nearest(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact k nearest among the rows given: ids and distances, best first."""
    use = ids != query
    ids, x = ids[use], x[use]
    if len(ids) > 4 * k:  # a quick estimate with a margin far above its error
        rough = (x * x).sum(axis=1) - 2 * (x @ q)
        cut = np.partition(rough, k - 1)[k - 1] + 1e-6 * (1 + np.abs(rough).max() + q @ q)
        ids, x = ids[rough <= cut], x[rough <= cut]
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def valid_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, embedding`` (doubles) of the rows that take part, and the
    dimension (0: none)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                      & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                      & F.exists("embedding", lambda v: v != 0))
    size = (rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first())
    if size is None:
        return rows, 0
    return rows.where(F.size("embedding") == size["d"]), size["d"]


def _packed(rows: DataFrame) -> DataFrame:
    """``vec_id, v``: vectors as little-endian doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                e = part.column("embedding")
                flat, n = e.flatten().to_numpy(), part.num_rows
                v = [r.tobytes() for r in flat.reshape(n, -1)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(v, pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def _sample(rows: DataFrame, dimension: int, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)


def fit(base: DataFrame, dimension: int, k: int, rows: int, queries: int) -> Hashes:
    """Scale and hashing for the packed rows ``base``."""
    sample = _sample(base, dimension, SAMPLE).collect()
    x = np.frombuffer(b"".join(r["v"] for r in sample), np.float64).reshape(-1, dimension)
    near = (_exact(base, _sample(base, dimension, FITTED), dimension, k, FOUND).where(F.col("score") > 0).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .groupBy("query_id").agg(F.sort_array(F.collect_list("score")).alias("s")).collect())
    kth = np.array([r["s"][min(k, len(r["s"])) - 1] for r in near] or [float(np.linalg.norm(x[0]))])
    return fitted(x, kth, rows, queries)


FOUND = "query_id long, vec_id long, score double, compared long"


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score, compared``: the nearest found of every row of
    ``queries`` (``vec_id, embedding``) among ``vectors``, and the distances computed for the query."""
    spark = vectors.sparkSession
    rows, dimension = valid_vectors(vectors)
    final = "query_id long, rank int, vec_id long, score double, compared long"
    if not dimension:
        return spark.createDataFrame([], final)
    distinct = (rows.dropDuplicates(["vec_id", "embedding"])
                .withColumn("copy", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
                .where(F.col("copy") <= k + 1).drop("copy"))
    base = written(_packed(distinct), "ann-rows")
    asked = written(_packed(valid_vectors(queries)[0].where(F.size("embedding") == dimension)
                            .dropDuplicates(["vec_id", "embedding"])), "ann-queries")
    total = base.count()
    hashes = fit(base, dimension, k, total, asked.count())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2 * partitions, math.ceil(total * hashes.tables / BUCKET))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                keys = hashes.buckets(_matrix(part.column("v"), dimension))
                for t in range(hashes.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]),
                                                      part.column("vec_id"), part.column("v")], ["t", "key", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
                t, key, query, v = [], [], [], []
                for i, q, raw, d in zip(part.column("vec_id").to_pylist(), _matrix(part.column("v"), dimension), part.column("v").to_pylist(),
                                        part.column("d").to_pylist()):
                    for table, keys in hashes.probes(q, d):
                        t += [table] * len(keys)
                        key += keys.tolist()
                        query += [i] * len(keys)
                        v += [raw] * len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(key, pa.int64()), pa.array(query, pa.int64()),
                                                  pa.array(v, pa.binary())], ["t", "key", "query_id", "v"])

    index = written(base.mapInArrow(store, "t int, key long, vec_id long, v binary"), "ann-index")
    # no part holds more than a group's even share, so a bucket of very many rows is spread over the groups
    most = min(BUCKET, max(LEAST, math.ceil(total * hashes.tables / groups)))
    sizes = index.groupBy("t", "key").agg(F.count("*").alias("n")).select("t", "key", F.ceil(F.col("n") / most).alias("parts"))
    large = sizes.where("parts > 1")
    if large.limit(1).count():
        large = bounded_broadcast(written(large, "ann-large"), total * hashes.tables // most)  # each holds over ``most`` rows
        index = (index.join(large, ["t", "key"], "left")
                 .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))).drop("parts"))
    else:
        large, index = None, index.withColumn("part", F.lit(0).cast("long"))
    group = F.pmod(F.xxhash64("t", "key", "part"), F.lit(groups))
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, float | None, int | None]] = []
        if left.num_rows and right.num_rows:
            t, key, part, ids = (right.column(c).to_numpy() for c in ("t", "key", "part", "vec_id"))
            x = _matrix(right.column("v"), dimension)
            order = np.lexsort((ids, part, key, t))
            t, key, part, ids, x = t[order], key[order], part[order], ids[order], x[order]
            number = row_numbers(ids, x)
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            where = {(int(t[a]), int(key[a]), int(part[a])): (a, z) for a, z in zip(new, np.append(new[1:], len(t)))}
            for query, raw, visits in zip(left.column("query_id").to_pylist(), left.column("v").to_pylist(), left.column("visits").to_pylist()):
                spans = [where[b] for v in visits if (b := (v["t"], v["key"], v["part"])) in where]
                if spans:
                    take = np.concatenate([np.arange(a, z) for a, z in spans])
                    take = take[np.unique(number[take], return_index=True)[1]]  # several tables may give a candidate
                    found, d = nearest(ids[take], x[take], query, np.frombuffer(raw, np.float64), k)
                    out.append((query, None, None, len(take)))
                    out += zip([query] * len(found), found.tolist(), d.tolist(), [None] * len(found))
        return pa.table([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                        names=["query_id", "vec_id", "score", "compared"])

    def visited(queries: DataFrame) -> DataFrame:
        asks = queries.mapInArrow(probe, "t int, key long, query_id long, v binary")
        if large is None:
            asks = asks.withColumn("part", F.lit(0).cast("long"))
        else:
            asks = (asks.join(large, ["t", "key"], "left")
                    .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))
        # a query's vector goes once to each group, with the buckets it visits there
        asks = (asks.withColumn("g", group).groupBy("g", "query_id", "v")
                .agg(F.collect_list(F.struct("t", "key", "part")).alias("visits")))
        return written(asks.groupBy("g").cogroup(index.withColumn("g", group).groupBy("g")).applyInArrow(search, FOUND), "ann-found")

    found = visited(asked.withColumn("d", F.lit(hashes.distance)))
    need = min(k, max(total - 1, 0))
    # where the k-th found is farther than the fitted distance, fewer buckets were visited than RECALL needs
    kth = found.where("vec_id is not null").select("query_id", "vec_id", "score").distinct().groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score")).alias("scores"))
    state = written(asked.join(kth, F.col("vec_id") == F.col("query_id"), "left")
                    .select("vec_id", "v", (F.coalesce("n", F.lit(0)) < need).alias("few"), F.get("scores", F.lit(max(need - 1, 0))).alias("d")), "ann-state")
    limit = hashes.wider * hashes.distance
    far = state.where(~F.col("few") & (F.col("d") > hashes.distance) & (F.col("d") <= limit)).select("vec_id", "v", "d")
    if far.limit(1).count():
        found = found.unionByName(visited(far))
    short = state.where(F.col("few") | (F.col("d") > limit)).select("vec_id", "v")
    found = written(found.unionByName(_exact(base, short, dimension, k, FOUND)), "ann-all")
    work = found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.where("vec_id is not null").select("query_id", "vec_id", "score").distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(work, "query_id").select("query_id", "rank", "vec_id", "score", "compared")


def row_numbers(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One number for each id and vector: rows that share both are one, rows that share an id only are not."""
    if not len(ids):
        return np.zeros(0, np.int64)
    row = np.column_stack([np.ascontiguousarray(ids, np.int64).view(np.float64), x])
    return np.unique(row.view(np.dtype((np.void, row.itemsize * row.shape[1]))).ravel(), return_inverse=True)[1].ravel()


def _exact(base: DataFrame, asked: DataFrame, dimension: int, k: int, schema: str) -> DataFrame:
    """Every row against the queries given, in blocks of ``QUERY_BLOCK``."""
    spark = base.sparkSession
    out = spark.createDataFrame([], schema)
    blocks = math.ceil(asked.count() / QUERY_BLOCK)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r["vec_id"], bytes(r["v"])) for r in block])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dimension)
                rows: list[tuple[int, int | None, float | None, int | None]] = []
                for query, raw in shared.value:
                    found, d = nearest(ids, x, query, np.frombuffer(raw, np.float64), k)
                    rows.append((query, None, None, len(ids)))
                    rows += zip([query] * len(found), found.tolist(), d.tolist(), [None] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                                                 ["query_id", "vec_id", "score", "compared"])

        out = out.unionByName(base.mapInArrow(scan, schema))
    return out


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth id of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
