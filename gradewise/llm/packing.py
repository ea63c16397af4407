"""Token ids packed into matrices by best-fit-decreasing.

Texts are encoded, ended by the end-of-text id, split without loss where they are longer
than a row, and placed longest first into the row with the least room that
still fits; a segment tree over the possible rooms finds that row in
logarithmic time.  A row of the result is one row of the id matrix with the
cumulative lengths of its segments and positions that begin at 0 in each.

Packing runs inside a task over ``BUFFER`` tokens at a time, so memory is
bounded, nothing is shuffled, and only a buffer's last rows are less full.

Binary columns are little-endian: ``ids`` uint32 and ``positions`` uint32, both
of the row's filled part (``n_tokens``); ``padded_ids`` pads to the full row.

Defined cases: a null text is no segment; an empty text is its end-of-text id
alone; rows without doc_id are packed with a null id; repeated rows are packed
as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 2048
BUFFER = 4_000_000
VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = ("row_id string, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
          "doc_ids array<long>, offsets array<int>")


class Rooms:
    """Rows by the room they have left: a segment tree of counts whose
    ``best`` finds the least room of at least a given size."""

    def __init__(self, row: int) -> None:
        self.size = 1 << row.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def best(self, need: int) -> int | None:
        """Take a row with the least room that is at least ``need``."""
        i = need + self.size
        if not self.count[i]:
            # up to the first right neighbour that has rows, then down its left side
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows as lists of item indexes; every length is at most ``row``."""
    rooms, rows, left = Rooms(row), [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = rooms.best(lengths[i])
        if at is None:
            at = len(rows)
            rows.append([])
            left.append(row)
        rows[at].append(i)
        left[at] -= lengths[i]
        if left[at]:
            rooms.put(left[at], at)
    return rows


@lru_cache(maxsize=2)
def encoding(name: str):
    """The byte-pair encoding of a rank file and its end-of-text id."""
    import base64

    import public_tokenizers
    import tiktoken

    path = name if name.startswith("/") else public_tokenizers.path(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def pack(docs: DataFrame, row: int = ROW, vocabulary: str = VOCABULARY, buffer: int = BUFFER) -> DataFrame:
    """One row per row of the id matrix (see the module's text): ``doc_ids`` and
    ``offsets`` give each segment's document and its place among that
    document's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, end = encoding(vocabulary)
        context = TaskContext.get()
        name, made = context.partitionId() if context else 0, 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows = best_fit_decreasing([len(t) for _, _, t in held], row)
            out: list[list] = [[] for _ in range(7)]
            for items in rows:
                segments = [held[i] for i in items]
                lengths = [len(t) for _, _, t in segments]
                ids = np.concatenate([t for _, _, t in segments])
                for column, value in zip(out, (
                        f"{name}-{made}", len(ids), ids.tobytes(), np.cumsum([0, *lengths]).tolist(),
                        np.concatenate([np.arange(m, dtype=np.uint32) for m in lengths]).tobytes(),
                        [d for d, _, _ in segments], [o for _, o, _ in segments])):
                    column.append(value)
                made += 1
            held.clear()
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                              ["row_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "offsets"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*coder.encode_ordinary(text.as_py()), end], np.uint32)
                for at in range(0, len(ids), row):
                    held.append((doc, at, ids[at:at + row]))
                n += len(ids)
                if n >= buffer:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)


def padded_ids(packed_ids: bytes, row: int = ROW, pad: int = 0) -> np.ndarray:
    """A full matrix row from the ``ids`` column."""
    out = np.full(row, pad, np.uint32)
    ids = np.frombuffer(packed_ids, np.uint32)
    out[:len(ids)] = ids
    return out


def op10_token_packing(spark, sf_dir: str) -> DataFrame:
    """``documents`` as packed rows of 2048 token ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
