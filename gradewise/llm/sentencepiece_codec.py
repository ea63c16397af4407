"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is normalised by the model and marked (spaces become U+2581).  No piece
spans a mark that follows another character, nor a character that occurs only
alone in the vocabulary, so marked words are encoded apart (and within them
parts between whose border characters no piece reaches).  A batch's distinct
new ones are sorted, which lays out their trie in depth-first order: each
begins with the forward states of the prefix it shares with the one before
it, and only what differs is computed.

Unigram models: a state is the best score and where its last piece begins
(Viterbi).  BPE models (the given one): scores are merge ranks, and the best
sum of them is not what the library's greedy merging gives, so the state is
the last token of the prefix's one valid encoding (``forward.Forward``); the
traversal and sharing are the same, and ids equal the library's.

Each Python worker remembers words, up to ``MEMO`` of them; when full the
table becomes the older one and a new one is begun.

Defined cases: null and empty texts have no ids and decode to the empty text;
characters outside the vocabulary become byte pieces; the strings of control
pieces are ordinary text; repeated rows get a row each; very long words are
only more trie levels.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import add
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.forward import Forward
from gradewise.llm.words import blocks

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MEMO = 450_000


class Codec:
    def __init__(self, path: str, unigram: bool | None = None) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(size)]
        own = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {text[i]: i for i in own}
        self.scores = {text[i]: sp.get_score(i) for i in own}
        by_byte = {int(text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        if len(by_byte) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.byte_ids = [by_byte[b] for b in range(256)]
        # a greedy model scores its pieces by rank: 0, -1, -2 ... in id order
        if unigram is None:
            usual = [self.scores[p] for p in self.ids if self.scores[p] > -1e8]
            unigram = any(s != int(s) for s in usual)
        self.unigram = unigram
        self.low = min(self.scores.values()) - 10  # an unknown character
        scores = self.scores
        self.forward = Forward(self.ids, list(self.ids), lambda a, b: None if (s := scores.get(a + b)) is None else -s)
        joint = sorted({c for p in self.ids if len(p) > 1 for c in p} - {MARK})
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans words")
        inner = "".join(map(re.escape, joint))
        self.words = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|[^{inner}{MARK}]").findall
        self.dtype, self.code = (np.uint16, "H") if size <= 1 << 16 else (np.int32, "i")  # of remembered and packed ids
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.memo: dict[str, bytes] = {}  # words
        self.older: dict[str, bytes] = {}  # what was there before the table was begun anew
        self.parts: dict[str, bytes] = {}
        self.surface = [b""] * size
        for p, i in self.ids.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.lengths = np.array([len(x) for x in self.surface])
        self.places = np.cumsum(self.lengths) - self.lengths

    def _step(self, word: str, i: int, best: list[float]) -> int:
        at, top = i - 1, -math.inf
        longest = min(self.forward.reach.get(word[i - 3:i], 2), i) if i > 2 else i
        low = self.low
        for n in range(1, longest + 1):
            score = self.scores.get(word[i - n:i], low if n == 1 else None)
            if score is not None and best[i - n] + score > top:
                at, top = i - n, best[i - n] + score
        best[i] = top
        return at

    def _ids(self, word: str, starts: list[int]) -> bytes:
        pieces, ids = self.forward.tokens(word, starts), self.ids
        try:
            return array(self.code, [ids[p] for p in pieces]).tobytes()
        except KeyError:  # a character outside the vocabulary
            return array(self.code, [i for p in pieces for i in ([ids[p]] if p in ids else [self.byte_ids[b] for b in p.encode()])]).tobytes()

    def _cut(self, word: str) -> list[str]:
        """Parts of a word between whose border characters no piece reaches."""
        inside = self.inside
        at = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in inside]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])] if at else [word]

    def learn(self, words: set[str]) -> None:
        """Encode distinct words: their distinct new parts in sorted order, a
        part beginning with the states of the prefix it shares with the last."""
        if len(self.memo) + len(words) > MEMO:
            self.memo, self.older = {}, self.memo
        if len(self.parts) > MEMO:
            self.parts = {}
        known, cut = self.older, {}
        for w in words:
            ids = known.get(w)
            if ids is None:
                cut[w] = self._cut(w)
            else:
                self.memo[w] = ids
        before, starts, best = "", [0], [0.0]
        for part in sorted({p for parts in cut.values() for p in parts if p not in self.parts}):
            same = len(commonprefix((before, part)))
            n = len(part) + 1
            starts = starts[:same + 1] + [0] * (n - same - 1)
            if self.unigram:
                best = best[:same + 1] + [0.0] * (n - same - 1)
                for i in range(same + 1, n):
                    starts[i] = self._step(part, i, best)
            else:
                self.forward.fill(part, starts, same)
            self.parts[part] = self._ids(part, starts)
            before = part
        for w, parts in cut.items():
            self.memo[w] = b"".join([self.parts[p] for p in parts])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian numbers (``self.dtype``)."""
        split = [self.words(self.library.normalize(t)) if t else [] for t in texts]
        every = set().union(*split)
        memo = self.memo
        new = {w for w in every if w not in memo}
        if len(self.memo) + len(new) > MEMO:  # the table is begun anew
            new = every
        if new:
            self.learn(new)
        return [b"".join(map(self.memo.__getitem__, words)) for words in split]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids (rows are ids[offsets[i]:offsets[i + 1]])."""
        size = self.lengths[ids]
        after = np.cumsum(size)
        flat = self.flat[np.repeat(self.places[ids] - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        if len(ids):  # the mark before a text's first word is no space of its own
            cut = np.concatenate([[0], after])[offsets]
        else:
            cut = np.zeros(len(offsets), np.int64)
        raw = flat.tobytes()
        return [raw[a + (raw[a:a + 1] == b" "):b] if a < b else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if ids and text.startswith(" ") else text


def model_path(name: str) -> str:
    import public_tokenizers

    return name if name.startswith("/") else public_tokenizers.path(name)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str = MODEL, column: str = "text") -> DataFrame:
    """The columns of ``docs`` plus ``piece_ids`` (array of int) and
    ``n_pieces`` and ``round_trip`` (whether decoding gives the text back);
    columns of ``docs`` with these names are replaced."""
    names = [c for c in docs.columns if c not in ("piece_ids", "n_pieces", "round_trip")]
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()),
        T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path(model))
        for batch in batches:
            for part in blocks(batch, column):
                texts = [t or "" for t in part.column(column).to_pylist()]
                packed = own.encode_batch(texts)
                kind = np.dtype(own.dtype)
                values = np.frombuffer(b"".join(packed), kind).astype(np.int32)
                offsets = np.cumsum([0, *(len(p) // kind.itemsize for p in packed)])
                same = [b == t.encode() for b, t in zip(own.decode_batch(values, offsets), texts)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                     pa.array(np.diff(offsets), pa.int32()), pa.array(same)], schema.names)

    return docs.select(names).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL, column: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """The columns of ``rows`` with ``to`` added: the text of the ids (null
    ids: the empty text; an id outside the vocabulary is an error)."""
    names = [c for c in rows.columns if c != to]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [own.decode(ids or []) for ids in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], schema.names)

    return rows.select(names).mapInArrow(run, schema)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Piece ids of every row of ``documents`` and whether they decode to it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
