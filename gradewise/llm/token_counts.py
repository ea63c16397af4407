"""Exact token counts at every prefix, by prefix dynamic programming.

For vocabularies with word ends (white space is dropped, no token spans it) a
text's count is the sum over its white-space separated chunks, and a chunk's
count is its forward pass (``forward.Forward``), so one pass over a text stores
the count at the end of every chunk, and the forward pass of one chunk answers
for the prefixes that end inside it.  Truncation to a budget and "how many
tokens has this prefix" are then look-ups, without encoding again.

Each Python worker remembers chunk counts, up to ``MEMO`` of them, and begins
anew when full.

Defined cases: a null text is empty; an empty text has no tokens; special
strings inside a text are one token each, as the tokenizers library has it by
default; nothing is truncated or padded; repeated rows get a row each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.forward import END, Forward
from gradewise.llm.words import blocks, text_buffer

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
MEMO = 700_000


class PrefixCounter:
    """Token counts of prefixes for a vocabulary with word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or not suffix or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        mark = lambda s: s[:-len(suffix)] + END if s.endswith(suffix) else s
        ranks: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[mark(a), mark(b)] = i
        pieces = {mark(p) for p in model["vocab"]}
        self.forward = Forward(pieces, list(pieces), lambda a, b: ranks.get((a, b)))
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.chunks: dict[bytes, int] = {}
        self.words: dict[str, int] = {}

    def word_count(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            n = self.words[word] = self.forward.counts(word + END)[-1]
        return n

    def count(self, chunk: str) -> int:
        """Tokens of a text without white space among them."""
        total = 0
        if self.special and (found := self.special.findall(chunk)):
            total, parts = len(found), self.special.split(chunk)
        else:
            parts = [chunk]
        for part in parts:
            if part:
                total += sum(self.word_count(w) for w, _ in self.split(self.normalize(part)))
        return total

    def chunk_counts(self, text: bytes) -> list[int]:
        """Token count of each white-space separated chunk of a UTF-8 text."""
        chunks = text.split()
        out = list(map(self.chunks.get, chunks))
        if None in out:
            if len(self.chunks) >= MEMO:
                self.chunks.clear()
            for i, n in enumerate(out):
                if n is None:
                    c = chunks[i]
                    n = self.chunks.get(c)
                    out[i] = n if n is not None else self.chunks.setdefault(c, self.count(c.decode()))
        return out

    def prefix_counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset of every chunk's end and the tokens up to it."""
        counts = np.cumsum([0, *self.chunk_counts(text)])[1:]
        ends = np.fromiter((m.end() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)), np.int64, len(counts))
        return ends, counts

    def tokens_before(self, text: bytes, end: int, table: tuple[np.ndarray, np.ndarray]) -> int:
        """Tokens of ``text[:end]`` (a character border), from the table."""
        ends, counts = table
        k = int(np.searchsorted(ends, end, "right"))
        start = int(ends[k - 1]) if k else 0
        rest = text[start:end].split()
        return (int(counts[k - 1]) if k else 0) + (self.count(rest[0].decode()) if rest else 0)

    def within(self, text: bytes, budget: int, table: tuple[np.ndarray, np.ndarray]) -> int:
        """Bytes of the longest prefix at a chunk's end with ``budget`` tokens at most."""
        ends, counts = table
        k = int(np.searchsorted(counts, budget, "right"))
        return int(ends[k - 1]) if k else 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter a worker process and vocabulary file."""
    return PrefixCounter(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, with_prefixes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row and, with
    ``with_prefixes``, the stored table: ``ends`` (byte offset of each chunk's
    end) and ``counts`` (tokens up to it), both arrays of long.  ``tokenizer``
    is a file name for the tokenizer package or an absolute path."""
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    if with_prefixes:
        schema += ", ends array<long>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer if tokenizer.startswith("/") else vocabulary(tokenizer))
        for batch in batches:
            for part in blocks(batch):
                buf, offsets = text_buffer(part.column("text"))
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                size = np.diff(offsets)
                if with_prefixes:
                    tables = [own.prefix_counts(t) for t in texts]
                    total = np.array([c[-1] if len(c) else 0 for _, c in tables], np.int64)
                else:  # the last entry of each table
                    total = np.array([sum(own.chunk_counts(t)) for t in texts], np.int64)
                cols = [part.column("doc_id"), pa.array(size), pa.array(total), pa.array(total > limit)]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                if with_prefixes:
                    cols += [pa.array([e for e, _ in tables], pa.list_(pa.int64())), pa.array([c for _, c in tables], pa.list_(pa.int64()))]
                    names += ["ends", "counts"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether over the limit, for every row of ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
