"""Written tables shared by all jobs (the reference's clean-table cache).

A prepared table (stand-in + split) is written once as parquet under the
shared folder named by ``spark.checkpoint.dir`` and read back by every
query: lineage is cut, a lost executor re-reads files instead of replaying
the joins and window, and later scans prune columns and push filters.

The path carries a fingerprint of the inputs (path, length and modification
time of every file) and of the preparing code's source, taken on every call, so
a change of data or of the preparation code never reuses a stale table.
File status comes from the ``binaryFile`` source without its ``content``
column, so no file body is read.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.session import shared_path

# Tables of smaller inputs are written in files of so many rows: a file of one row group is
# read by one task, and a few such files leave most cores idle in every later query.
SMALL_INPUT, FILE_ROWS = 2 << 30, 100_000


def _status(spark: SparkSession, paths: list[str]) -> tuple:
    """Number, bytes and an order-free hash of the paths' files: one row,
    however many files there are."""
    try:
        files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    except AnalysisException:  # missing path
        return (0, 0, 0)
    return tuple(files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)),
                           F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def fingerprint(spark: SparkSession, paths: list[str], code: tuple = ()) -> str:
    """A digest of the files under ``paths`` and the source of ``code``."""
    h = hashlib.md5(repr((paths, _status(spark, paths))).encode())
    for f in code:
        h.update(inspect.getsource(f).encode())
    return h.hexdigest()[:16]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's write ended well: the marker table written after it
    has a committed file."""
    return _status(spark, [f"{path}.done"])[0] > 0


def materialized(spark: SparkSession, name: str, code: tuple, inputs: list[str],
                 build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per state of the inputs and of the modules or
    functions in ``code``, and scan the written table.  The state is looked at
    on every call; a write that did not end is done again."""
    path = shared_path(spark, f"{name}_{fingerprint(spark, inputs, code)}")
    if not complete(spark, path):
        rows = FILE_ROWS if _status(spark, inputs)[1] < SMALL_INPUT else 0  # 0: no bound
        build().write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.done")
    return spark.read.parquet(path)
