"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a match of the split pattern there is exactly one
valid last token (``forward.Forward``, here over bytes): the vocabulary's token
that ends there and stays apart from the prefix's last token before it.  The
table of those tokens' starts gives the encoding of every prefix, so

* an append keeps the table and goes on from its end (:meth:`Encoded.append`);
* an edit keeps the matches before it and, from the first unit border behind
  it where old and new text agree, those after it (:meth:`Encoded.edit`).

A *unit* is a run of white space and the run of other characters after it.  No
match of the pattern spans two units and none looks over a unit's border, so
units are encoded apart and a text is the sum of its units.  A block's new
matches are sorted, each beginning with the table of the prefix that it shares
with the one before.

Each Python worker remembers units and matches, up to ``MEMO`` of each; when
full, the table becomes the older one and a new one is begun.

Defined cases: null and empty texts have no ids and decode to no bytes;
strings of special tokens are ordinary text; repeated rows get a row each;
other columns are not looked at, whatever their names; a very long match is
only a longer table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.forward import Forward
from gradewise.llm.words import blocks

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO = 700_000
# The characters that Unicode calls white space.
WHITE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def units(text: str) -> list[str]:
    return _UNITS.findall(text)


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = {token.decode("latin-1"): i for token, i in self.ranks.items()}
        if any(chr(b) not in own for b in range(256)):
            raise ValueError("a vocabulary with all single bytes is needed")
        self.ids = own
        get = own.get
        self.forward = Forward(own, list(own), lambda a, b: get(a + b))
        self.split = regex.compile(pattern, regex.V0).findall
        size = max(own.values()) + 1
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        by_id = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
        self.bytes_of = by_id
        self.surface = _Gather(by_id)
        self.decimal = _Gather([b"%d " % i for i in range(size)])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    # ------------------------------------------------------------ one match

    def packed(self, match: str, starts: list[int]) -> bytes:
        """The ids of a match (bytes as characters) from its table."""
        ids = self.ids
        return array(self.code, [ids[t] for t in self.forward.tokens(match, starts)]).tobytes()

    # ------------------------------------------------------------ many texts

    def learn(self, new: set[str]) -> None:
        """Encode distinct units."""
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.older = {}, self.memo
        if len(self.matches) > MEMO:
            self.matches = {}
        parts: dict[str, list[str]] = {}
        known, split = self.older, self.split
        for unit in new:
            ids = known.get(unit)
            if ids is None:
                parts[unit] = [m if m.isascii() else m.encode().decode("latin-1") for m in split(unit)]
            else:
                self.memo[unit] = ids
        matches, vocabulary = self.matches, self.ids
        before, starts = "", [0]
        for match in sorted({m for ms in parts.values() for m in ms if m not in matches}):
            whole = vocabulary.get(match)
            if whole is not None:
                matches[match] = whole.to_bytes(self.dtype.itemsize, "little")
                continue
            same = len(commonprefix((before, match)))
            starts = starts[:same + 1] + [0] * (len(match) - same)
            self.forward.fill(match, starts, same)
            matches[match] = self.packed(match, starts)
            before = match
        for unit, ms in parts.items():
            self.memo[unit] = matches[ms[0]] if len(ms) == 1 else b"".join([matches[m] for m in ms])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin (one more than texts)."""
        split = [units(t) for t in texts]
        every = set().union(*split)
        new = {u for u in every if u not in self.memo}
        if new:
            self.learn(every if len(self.memo) + len(new) > MEMO else new)
        rows = [b"".join(map(self.memo.__getitem__, us)) for us in split]
        offsets = np.cumsum([0, *map(len, rows)]) // self.dtype.itemsize
        return np.frombuffer(b"".join(rows), self.dtype), offsets

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Gather:
    """Byte strings by number: the joined strings of an array of numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings])
        self.at = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The strings of ids[offsets[i]:offsets[i + 1]], joined, for each i."""
        size = self.size[ids]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        raw = self.flat[np.repeat(self.at[ids] - after + size, size) + np.arange(total)].tobytes()
        cut = np.concatenate([[0], after])[offsets].tolist()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]


class Encoded:
    """One text with the tables of its matches, open to appends and edits.

    ``reused`` and ``filled`` count the bytes whose table entries were kept and
    made by the last change."""

    def __init__(self, codec: Codec, text: str = "") -> None:
        self.codec = codec
        self.units: list[str] = []
        self.tables: list[list[tuple[str, list[int]]]] = []  # per unit: its matches and their tables
        self.reused = self.filled = 0
        self._replace(0, 0, units(text))

    @property
    def text(self) -> str:
        return "".join(self.units)

    @property
    def ids(self) -> list[int]:
        ids = self.codec.ids
        return [ids[t] for tables in self.tables for match, starts in tables for t in self.codec.forward.tokens(match, starts)]

    def _replace(self, first: int, last: int, new: list[str]) -> None:
        """Put ``new`` units in place of those from ``first`` to ``last``.
        Tables of matches go on from the longest prefix that an old match at
        the same place has."""
        old = [m for tables in self.tables[first:last] for m in tables]
        codec, made, k = self.codec, [], 0
        self.reused = self.filled = 0
        for unit in new:
            tables = []
            for match in codec.split(unit):
                match = match.encode().decode("latin-1")
                before, kept = old[k] if k < len(old) else ("", [0])
                k += 1
                same = len(commonprefix((before, match)))
                starts = kept[:same + 1] + [0] * (len(match) - same)
                codec.forward.fill(match, starts, same)
                self.reused += same
                self.filled += len(match) - same
                tables.append((match, starts))
            made.append(tables)
        self.units[first:last] = new
        self.tables[first:last] = made

    def append(self, more: str) -> None:
        """The text with ``more`` at its end: its last unit grows, all before stays."""
        if more:
            last = max(len(self.units) - 1, 0)
            self._replace(last, len(self.units), units("".join(self.units[last:]) + more))

    def edit(self, at: int, removed: int, put: str) -> None:
        """Characters ``at`` to ``at + removed`` give way to ``put``.  Units
        wholly before or behind the change, but for the one that meets it on
        either side, stay."""
        size = len(self.text)
        if not 0 <= at <= at + removed <= size:
            raise ValueError("outside the text")
        ends = np.cumsum([len(u) for u in self.units]).tolist()
        first = max(bisect_right(ends, at) - 1, 0)
        last = min(bisect_right(ends, at + removed) + 1, len(self.units))
        begin = ends[first - 1] if first else 0
        middle = "".join(self.units[first:last])
        a = at - begin
        self._replace(first, last, units(middle[:a] + put + middle[a + removed:]))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if name.startswith("/") else public_tokenizers.path(name)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary file."""
    import public_tokenizers

    return Codec(path, public_tokenizers.PATTERN)


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary))
        for batch in batches:
            for part in blocks(batch):
                ids, offsets = own.encode_batch(_texts(part))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, decoded`` (binary) of rows with ``ids``; null ids: no bytes,
    an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [own.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encoding and decoding of every row in one pass: ``doc_id, n_tokens``,
    the SHA-256 of the decimal ids joined by one space, and that of the
    decoded bytes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary))
        sha = hashlib.sha256
        for batch in batches:
            for part in blocks(batch):
                ids, offsets = own.encode_batch(_texts(part))
                listed = [sha(x[:-1]).hexdigest() for x in own.decimal.joined(ids, offsets)]
                decoded = [sha(x).hexdigest() for x in own.surface.joined(ids, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(listed), pa.array(decoded)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, for every row of ``documents``."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
