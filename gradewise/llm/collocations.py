"""Phrase collocations by weighted acyclic automata.

1. Words and word pairs are counted by 64-bit codes, then longer phrases of
   which all pairs are frequent; codes that occur at least ``least`` times become
   bits of a filter (of bounded size; where two codes share a bit, or the filter
   is full, only more is counted below).
2. Each position's window, its next words as far as all phrases in it pass the
   filter (a phrase around a rare one is rare itself), is counted in a shard.
   A shard's sorted windows become count transducers (``transducer``), cut by
   prefix range: the range of the first two words.
3. Per range the shards' transducers are united and their weights summed, in
   two rounds so that no task reads all shards of a frequent range at once.  The
   total at a state is the number of occurrences of the words that lead to it.
   Totals of single words are spread over ranges and summed after.
4. The parts of a phrase cut after its first words are looked up by composing
   them with the transducer of their range.

Defined cases: a null text has no words; a null language is ``und``; repeated
rows count as often as they come; a language without candidates has no rows,
nor has an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewise.llm.tables import written
from gradewise.llm.transducer import NONE, Transducer, summed, union
from gradewise.llm.words import blocks, mix, words_of

# Bytes that end a piece, and those that end a word.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True

LEAST, LONGEST, ABSORBED, FIRST = 30, 4, 80, 2000
SHARD = 1_500_000  # windows held in a task
ROUND = 16  # groups of shards that are united before all are
SALTS = 8  # parts of the look-ups of one range
FILTER_BITS = 1 << 28  # the filter's greatest size: 32 MB
SEGMENT = 1 << 15  # bits of a row of the filter
RANGE_ENTRIES = 20_000  # frequent words and pairs of a prefix range, about
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Words of a block of rows: codes by language, and which words follow each
    other in one piece."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.words = words = words_of(part.column("text"), SEPARATORS, lower=True)
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        seeds = np.array([int.from_bytes(_digest(x), "little") for x in self.langs], np.uint64)
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.row]
        plain = words.codes() if len(words.start) else np.zeros(0, np.uint64)
        self.plain = plain
        self.codes = mix(plain + seeds[self.lang]) if len(plain) else plain
        ends = np.concatenate([[0], np.cumsum(BREAKS[words.buf])])
        row = words.row
        self.follows = np.zeros(len(plain), bool)  # the next word is in the same piece
        if len(plain) > 1:
            self.follows[:-1] = (row[1:] == row[:-1]) & (ends[words.start[1:]] == ends[words.end[:-1]])

    def phrases(self, longest: int, bits: np.ndarray | None = None, known: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size up to ``longest`` the codes of the phrases that begin at
        each word and whether there is one, of which all parts of up to
        ``known`` words pass ``bits``."""
        codes, there = self.codes, np.ones(len(self.codes), bool)
        for size in range(1, longest + 1):
            if size > 1:
                following = np.concatenate([codes[1:], codes[:1]])
                there = there & self.follows & np.concatenate([there[1:], there[:0], [False] * min(1, len(there))])
                codes = mix(codes * _PAIR + following)
            yield codes, there
            if size <= known:
                there = there & _passes(bits, codes)


def _digest(lang: str) -> bytes:
    return hashlib.blake2b(lang.encode(), digest_size=8).digest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                                        F.col("text").cast("string").alias("text"))


def code_counts(docs: DataFrame, sizes: range, least: int = LEAST, bits: np.ndarray | None = None) -> DataFrame:
    """``lang, size, code, n``: words of each language (size 0), and codes of
    phrases of the sizes with at least ``least`` occurrences, of those whose
    shorter parts pass ``bits``."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=2 << 20):
                b = Block(part)
                n = np.bincount(b.lang, minlength=len(b.langs))
                found = [(0, np.zeros(len(n), np.uint64), n)] if 1 in sizes else []
                for size, (codes, there) in enumerate(b.phrases(sizes.stop - 1, shared.value, sizes.start - 1), 1):
                    if size in sizes:
                        found.append((size, *np.unique(codes[there], return_counts=True)))
                langs = b.langs if 1 in sizes else []
                total = sum(len(c) for _, c, _ in found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*langs, *[None] * (total - len(langs))], pa.string()),
                     pa.array(np.repeat(np.array([x[0] for x in found], np.int8), [len(x[1]) for x in found])),
                     pa.array(np.concatenate([x[1] for x in found]).view(np.int64)),
                     pa.array(np.concatenate([x[2] for x in found]).astype(np.int64))], ["lang", "size", "code", "n"])

    counted = _texts(docs).mapInArrow(run, "lang string, size byte, code long, n long")
    return counted.groupBy("lang", "size", "code").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= least))


def code_filter(counts: DataFrame) -> tuple[np.ndarray, int]:
    """Bits set at the codes of ``counts`` and how many codes there are."""
    codes = counts.where("size > 0")
    entries = codes.count()
    size = min(FILTER_BITS, max(SEGMENT, 1 << (16 * entries).bit_length()))
    place = F.col("code").bitwiseAND(F.lit(size - 1))

    def segment(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, np.uint8)
        bits[table.column("at").to_numpy() % SEGMENT] = 1
        return pa.table({"segment": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    rows = (codes.select(place.alias("at")).distinct().withColumn("segment", F.floor(F.col("at") / SEGMENT))
            .groupBy("segment").applyInArrow(segment, "segment long, bits binary").collect())  # 4 KB each, 32 MB at most
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        at = r["segment"] * SEGMENT // 8
        out[at:at + SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return out, entries


def _passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _windows(b: Block, bits: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A block's distinct windows (its language's number and word numbers, ``NONE``
    behind the end), how often each occurs, and the words."""
    n = len(b.codes)
    length = np.zeros(n, np.int64)
    for codes, there in b.phrases(longest, bits, longest):
        length += there & _passes(bits, codes)
    at = np.flatnonzero(length)
    if not len(at):
        return np.zeros((0, longest + 1), np.int64), np.zeros(0, np.int64), []
    taken = np.zeros(n + longest, bool)
    for k in range(longest):
        taken[at[length[at] > k] + k] = True
    used = np.flatnonzero(taken[:n])
    number, words = _vocabulary(b, used)
    ids = np.zeros(n + longest, np.int64)
    ids[used] = number + 1
    columns = [b.lang[at], *(np.where(length[at] > k, ids[at + k], 0) for k in range(longest))]
    base = len(words) + 1
    if base ** longest * len(b.langs) < 1 << 63:
        key = columns[0]
        for c in columns[1:]:
            key = key * base + c
        keys, times = np.unique(key, return_counts=True)
        rows = np.empty((len(keys), longest + 1), np.int64)
        for k in range(longest, 0, -1):
            keys, rows[:, k] = np.divmod(keys, base)
        rows[:, 0] = keys
    else:
        rows, times = summed(np.stack(columns, axis=1), np.ones(len(at), np.int64))
    rows[:, 1:] -= 1  # 0 was no word: NONE
    return rows, times, words


def _vocabulary(b: Block, used: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each used word, equal for equal bytes, and the words."""
    w = b.words
    _, first, number = np.unique(b.plain[used], return_index=True, return_inverse=True)
    start, end = w.start[used], w.end[used]
    raw = w.buf.tobytes()
    words = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]
    # codes are hashes: compare the bytes of all words with those of the words that stand for them
    size, stand = end - start, first[number]
    same = bool((size == size[stand]).all())
    if same:
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = bool((w.buf[np.repeat(start, size) + within] == w.buf[np.repeat(start[stand], size) + within]).all())
    if not same:
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist())])
        words = list(known)
    return number, words


class Shard:
    """Windows of many blocks, in numbers of the shard's own languages and words."""

    def __init__(self, longest: int) -> None:
        self.langs: dict[str, int] = {}
        self.words: dict[bytes, int] = {}
        self.rows = [np.zeros((0, longest + 1), np.int32)]
        self.counts = [np.zeros(0, np.int64)]
        self.size = 0

    def add(self, langs: list[str], words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> None:
        known = self.words
        own = np.array([*(known.setdefault(w, len(known)) for w in words), NONE], np.int32)
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)
        self.rows.append(np.concatenate([lang[rows[:, :1]], own[rows[:, 1:]]], axis=1))
        self.counts.append(counts)
        self.size += len(rows)

    def compact(self) -> None:
        rows, counts = summed(np.concatenate(self.rows), np.concatenate(self.counts))
        self.rows, self.counts, self.size = [rows], [counts], len(rows)

    def transducers(self, ranges: int) -> Iterator[tuple[str, int, bytes]]:
        """(language, prefix range, automaton) of all windows."""
        self.compact()
        rows, counts = self.rows[0], self.counts[0]
        words = list(self.words)
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words) + 1, np.int64)
        rank[order] = np.arange(len(words))
        rank[-1] = NONE
        words = [words[i] for i in order]
        rows = np.concatenate([rows[:, :1].astype(np.int64), rank[rows[:, 1:]]], axis=1)
        # the range of the first two words: the same in all shards
        place = np.array([*(zlib.crc32(w) for w in words), 0], np.int64)
        second = place[rows[:, 2]] if rows.shape[1] > 2 else 0
        ranged = np.concatenate([rows[:, :1], ((place[rows[:, 1]] * 31 + second) % ranges)[:, None], rows[:, 1:]], axis=1)
        order = np.lexsort(ranged.T[::-1])
        ranged, counts = ranged[order], counts[order]
        edges = np.flatnonzero((ranged[1:, :2] != ranged[:-1, :2]).any(axis=1)) + 1
        names = list(self.langs)
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ranged)]):
            if a == b:
                continue
            part = ranged[a:b, 2:]
            used = np.unique(part)
            used = used[used != NONE]
            own = np.where(part == NONE, NONE, np.searchsorted(used, part))
            yield (names[ranged[a, 0]], int(ranged[a, 1]),
                   Transducer.from_rows([words[i] for i in used.tolist()], own, counts[a:b]).to_bytes())


def shard_transducers(docs: DataFrame, bits: np.ndarray, ranges: int, longest: int = LONGEST, shard: int = SHARD) -> DataFrame:
    """``lang, range, part, automaton``: count transducers of the windows of
    shards of ``docs``, cut by prefix range."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, made = TaskContext.get(), 0
        task = context.partitionId() if context else 0

        def out(held: Shard) -> Iterator[pa.RecordBatch]:
            rows = list(held.transducers(ranges))
            if rows:
                lang, place, data = zip(*rows)
                part = pa.array([(task * 31 + made) % ROUND] * len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(place, pa.int32()), part, pa.array(data, pa.binary())],
                                                 ["lang", "range", "part", "automaton"])

        held = Shard(longest)
        for batch in batches:
            for part in blocks(batch):
                b = Block(part)
                rows, counts, words = _windows(b, shared.value, longest)
                if len(rows):
                    held.add(b.langs, words, rows, counts)
                if held.size >= shard:
                    held.compact()
                    if held.size >= shard // 2:
                        yield from out(held)
                        held, made = Shard(longest), made + 1
        yield from out(held)

    return _texts(docs).mapInArrow(run, "lang string, range int, part int, automaton binary")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases up to ``longest`` words that
    occur at least ``least`` times, and ``lang, n`` (words of a language)."""
    counts = written(code_counts(docs, range(1, min(longest, 2) + 1), least), "collocation-codes")
    bits, entries = code_filter(counts)
    if longest > 2:
        longer = written(code_counts(docs, range(3, longest + 1), least, bits), "collocation-longer-codes")
        bits, entries = code_filter(counts.unionByName(longer))
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // RANGE_ENTRIES + 1)

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        merged = union([Transducer.from_bytes(x.as_py()) for x in table.column("automaton")])
        return pa.table({"lang": [key[0].as_py()], "range": pa.array([key[1].as_py()], pa.int32()), "automaton": [merged.to_bytes()]})

    def totals(key: tuple, table: pa.Table) -> pa.Table:
        merged = union([Transducer.from_bytes(x.as_py()) for x in table.column("automaton")])
        total = merged.totals()
        marked = [np.ones(len(t), bool) if not d else t >= least for d, t in enumerate(total)]
        found = [(b" ".join(w).decode(), d + 1, int(total[d][s])) for w, d, s in merged.phrases(marked)]
        phrase, size, f = zip(*found) if found else ((), (), ())
        return pa.table({"lang": pa.array([key[0].as_py()] * len(phrase), pa.string()), "phrase": pa.array(phrase, pa.string()),
                         "size": pa.array(size, pa.int32()), "f": pa.array(f, pa.int64())})

    shards = shard_transducers(docs, bits, ranges, longest, shard)
    first = shards.groupBy("lang", "range", "part").applyInArrow(unite, "lang string, range int, automaton binary")
    pieces = first.groupBy("lang", "range").applyInArrow(totals, "lang string, phrase string, size int, f long")
    phrases = pieces.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(phrases, "collocation-phrases"), counts.where("size = 0").select("lang", "n")


def part_counts(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """``lang, phrase, a, cut, l, r`` for every cut of the candidates, by
    composing their parts with the transducers of ``phrases``."""
    ranges = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.split("phrase", " ")
    first_two = lambda c: F.concat_ws(" ", F.slice(F.split(c, " "), 1, 2))
    place = lambda c: F.pmod(F.xxhash64("lang", first_two(c)), F.lit(ranges)).cast("int")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"),
                             F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    join = lambda a: F.concat_ws(" ", a)
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), join(F.slice("w", F.lit(1), F.col("cut"))).alias("part")),
        F.struct(F.lit(1).alias("side"), join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut"))).alias("part")),
    )).alias("_p")).select("lang", "phrase", "a", "cut", "_p.side", "_p.part")
    asked = asked.withColumn("range", place("part")).withColumn("salt", F.pmod(F.xxhash64("phrase", "cut"), F.lit(SALTS)).cast("int"))
    known = phrases.select("lang", "phrase", "f", place("phrase").alias("range"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = known.toDF(*known.columns)  # columns of its own, since both sides come from the same table

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["lang", "phrase", "a", "cut", "side", "f"]
        split = lambda c: [tuple(x.encode().split(b" ")) for x in c.to_pylist()]
        own = Transducer.build(sorted(zip(split(left.column("phrase")), left.column("f").to_pylist())))
        parts = split(right.column("part"))
        f = pa.array(own.compose(parts), pa.int64())
        return pa.table([*(right.column(c) for c in names[:-1]), f], names)

    keys = ["lang", "range", "salt"]
    found = known.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        look_up, "lang string, phrase string, a long, cut int, side int, f long")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    return found.groupBy("lang", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))


def not_absorbed(candidates: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Candidates but for those inside a longer one that occurs at least
    ``absorbed`` per cent as often."""
    words = F.split("phrase", " ")
    inner = candidates.where("size > 2").select("lang", "f", "size", words.alias("w"), F.explode(
        F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    inside = inner.select("lang", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("k"))).alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(most, ["lang", "phrase"], "left").where(
        F.col("_most").isNull() | (big("_most") * 100 < big("f") * absorbed)).drop("_most")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorbed: int = ABSORBED, first: int = FIRST,
                 shard: int = SHARD) -> DataFrame:
    """The first phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    phrases, sizes = phrase_counts(docs, least, longest, shard)
    candidates = phrases.where("size > 1")
    cuts = part_counts(phrases, not_absorbed(candidates, absorbed))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = (cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """Collocations of every language over all of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang,
         UNNEST(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, size, phrase, COUNT(*) AS f FROM (
    SELECT lang, k.size AS size, array_to_string(w[i.i:i.i + k.size - 1], ' ') AS phrase
    FROM w, (SELECT UNNEST([1, 2, 3, 4]) AS size) k, LATERAL (SELECT UNNEST(range(1, len(w) - k.size + 2)) AS i) i
    WHERE len(w) >= k.size)
  GROUP BY lang, size, phrase HAVING COUNT(*) >= 30),
c AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inside AS (
  SELECT lang, array_to_string(w[i.i:i.i + k.size - 1], ' ') AS phrase, MAX(f) AS most
  FROM c, (SELECT UNNEST([2, 3]) AS size) k, LATERAL (SELECT UNNEST(range(1, c.size - k.size + 2)) AS i) i
  WHERE k.size < c.size GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(c.f AS HUGEINT)),
cuts AS (
  SELECT kept.lang, kept.phrase, kept.f AS a, k.cut, x.f AS l, y.f AS r,
         (CAST(2000000 AS HUGEINT) * kept.f) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM kept, (SELECT UNNEST([1, 2, 3]) AS cut) k, f x, f y
  WHERE k.cut < kept.size AND x.lang = kept.lang AND y.lang = kept.lang
    AND x.phrase = array_to_string(kept.w[1:k.cut], ' ') AND y.phrase = array_to_string(kept.w[k.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
