"""Repair of conversation structure by bidirectional Dijkstra over an edit lattice.

A lattice node is (rows consumed, state of the role pattern ``(s?(ua)+)?``);
an edge keeps, reroles or deletes the next row or inserts an empty turn, and
costs what the constants below say.  A forward heap from the start and a
reverse heap from the end meet; the search goes on until no crossing of the
least cost can be missing, and the least concatenated audit of them wins.

Audits that lead from one node to another at one cost are never beginnings of
each other (the rest would be inserts, which cost), so the least audit of two
stretches is the join of least ones.  Hence a conversation of more than
``BLOCK`` rows is solved block by block, for each state at its borders, and
composed: memory holds one block's texts, one digest a distinct row, and the
audits.

Rows are damaged, judged and sorted by Spark (one shuffle by conversation); a
task streams through its sorted conversations.  A conversation's one hash over
its whole repaired text can only be taken in order, so one conversation is one
task's stream, however long; nothing of it is collected.

Defined cases: a null role or text is one space, so the row is blank or of an
unknown role; a role that is empty or begins otherwise than with s, u or a
cannot be kept, only reroled or deleted; null conversation ids are one
conversation with a null id; rows of one turn are ordered by role and text
(bytes) as they came; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 256  # rows of one lattice
# The role pattern: states are nothing, s, ...u, ...ua; what a role's initial does in each.
STATES = 4
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEGAL = frozenset(("su", "ua", "au"))
ROLES = {2: "user", 3: "assistant"}  # the role that leads into a state
SPACES = " \t\n\x0b\f\r"


def _edges(row: str, state: int, last: bool) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows consumed, state after) from a node.  A row is its
    role's initial and ``x`` (must go), ``t`` (truncated) or ``k``."""
    out = [("I", INSERT, 0, after) for initial, after in NEXT[state].items() if initial != "s"]
    if last:
        return out
    initial, fault = row
    out.append(("D", DELETE, 1, state))
    if fault != "x":
        more = TRUNCATED if fault == "t" else 0
        if initial in NEXT[state]:
            out.append(("K", KEEP + more, 1, NEXT[state][initial]))
        out += [("R", REROLE + more, 1, after) for role, after in NEXT[state].items() if role != "s"]
    return out


@lru_cache(maxsize=100_000)
def least(rows: tuple[str, ...], enter: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits that lead from state ``enter``
    over all rows into one of ``exits``, the ASCII-least audit of equals."""
    n = len(rows)
    if not n and enter in exits:
        return 0, ""
    onward = {(i, q): [(e, c, (i + step, to)) for e, c, step, to in _edges(rows[i] if i < n else "", q, i == n)]
              for i in range(n + 1) for q in range(STATES)}
    back: dict[tuple[int, int], list] = {node: [] for node in onward}
    for node, edges in onward.items():
        for e, c, to in edges:
            back[to].append((e, c, node))
    # Of equal costs the node with fewer rows behind it comes first: edges that cost nothing consume a row, so
    # when a node is settled all its audits of that cost are on the heap.
    forward, reverse = [(0, 0, "", (0, enter))], [(0, 0, "", (n, q)) for q in exits]
    heapq.heapify(reverse)
    came: dict[tuple[int, int], tuple[int, str]] = {}
    goes: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None
    while forward and reverse:
        if best is not None and forward[0][0] + reverse[0][0] > best[0]:
            break
        if forward[0][0] <= reverse[0][0]:
            cost, _, audit, node = heapq.heappop(forward)
            if node in came:
                continue
            came[node] = cost, audit
            for e, c, to in onward[node]:
                if to not in came:
                    heapq.heappush(forward, (cost + c, to[0], audit + e, to))
                if to in goes:
                    whole = cost + c + goes[to][0], audit + e + goes[to][1]
                    best = whole if best is None else min(best, whole)
        else:
            cost, _, audit, node = heapq.heappop(reverse)
            if node in goes:
                continue
            goes[node] = cost, audit
            for e, c, at in back[node]:
                if at not in goes:
                    heapq.heappush(reverse, (cost + c, n - at[0], e + audit, at))
                if at in came:
                    whole = came[at][0] + c + cost, came[at][1] + e + audit
                    best = whole if best is None else min(best, whole)
    return best


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of the rows that an audit leaves, from a state on,
    and the state after."""
    out, i = [], 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        if e == "K":
            role, text = rows[i]
            state = NEXT[state][role[0]]
        else:
            state = next(to for initial, to in NEXT[state].items() if initial != "s")
            role, text = ROLES[state], rows[i][1] if e == "R" else ""
        i += e != "I"
        out.append((e, role, text))
    return out, state


class Conversation:
    """One conversation's rows as they stream past."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.codes: list[str] = []  # the current block
        self.rows: list[tuple[str, str]] = []
        self.seen: set[bytes] = set()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        #: per state: least cost and audit of all blocks so far, the hash of what they leave and whether that is anything
        self.ways: dict[int, tuple[int, str, object, bool]] = {0: (0, "", hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, blank: bool, ended: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        mark = hashlib.blake2b(b"%d:" % len(role) + role.encode() + text.encode(), digest_size=16).digest()
        fault = "k"
        if blank:
            self.blank, fault = self.blank + 1, "x"
        elif mark in self.seen:
            self.duplicate, fault = self.duplicate + 1, "x"
        elif not ended:
            self.truncated, fault = self.truncated + 1, "t"
        self.seen.add(mark)
        self.codes.append((role[:1] if role[:1] in ("s", "u", "a") else "-") + fault)
        self.rows.append((role, text))
        if len(self.rows) == BLOCK:
            self._advance(range(STATES))

    def _advance(self, exits, together: bool = False) -> None:
        """Solve the block and go on from its end; ``together``: into any of the exits."""
        codes, ways = tuple(self.codes), {}
        for goal in ([tuple(exits)] if together else [(q,) for q in exits]):
            found = [(cost + step[0], audit + step[1], q, step[1]) for q, (cost, audit, _, _) in self.ways.items()
                     if (step := least(codes, q, goal)) is not None]
            if found:
                cost, audit, q, own = min(found)
                kept, state = edited(self.rows, own, q)
                _, _, sha, some = self.ways[q]
                sha = sha.copy()
                for _e, role, text in kept:
                    sha.update((("\n" if some else "") + role + ":" + text).encode())
                    some = True
                ways[state] = cost, audit, sha, some
        self.ways, self.codes, self.rows = ways, [], []

    def result(self) -> tuple:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
        self._advance(ENDS, together=True)
        (cost, audit, sha, _), = self.ways.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, first, second, gone``: the rows after the
    damage that their id and turn call for (see the contract's kinds);
    ``first`` and ``second`` order rows of one turn, ``gone`` marks dropped ones."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                space("role").alias("first"), space("text").alias("second"), kind.alias("_kind"))
    text = (F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("second", ".!?", ""))
            .otherwise(F.col("second")))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("first")).alias("role"),
                       text.alias("text"), "first", "second", (F.col("_kind") == 0).alias("gone"),
                       F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with their order, whether they are blank and whether they end a sentence."""
    have = rows.columns
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in have else F.lit(False)
    empty = lambda c: F.when(F.col("_gone"), "").otherwise(F.col(c))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"),
                      (space("first") if "first" in have else space("role")).alias("_first"),
                      (space("second") if "second" in have else space("text")).alias("_second"), gone.alias("_gone"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    return out.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"), empty("_first").alias("_first"),
                      F.when(F.col("_second") != F.col("text"), empty("_second")).alias("_second"),
                      "_gone", (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"))


def _ordered(judged: DataFrame) -> DataFrame:
    whole = F.coalesce("_second", "text")  # the text as it came, carried apart only where damage changed it
    return (judged.repartition("conv_id")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "_first", whole))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256`` of rows ``conv_id, turn, role,
    text`` (and, from :func:`damage`, ``first, second, gone``)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, id_type = None, [], None

        def out() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
                                                     "cost", "audit", "repaired_sha256"])

        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv_id, turn, role, text, gone, blank, ended in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "text", "_gone", "blank", "ended"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                        if len(done) >= 2000:
                            yield out()
                    now = Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text, blank, ended)
        if now is not None:
            done.append(now.result())
        if done:
            yield out()

    ordered = _ordered(_judged(rows)).select("conv_id", "turn", "role", "text", "_gone", "blank", "ended")
    return ordered.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, role, text``.
    ``audits`` (from :func:`repair` of the same rows) travel ahead of their
    conversation's rows in the same sorted stream, so a task holds one row
    and one audit at a time."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    judged = _judged(rows).where(~F.col("_gone")).withColumn("_audit", F.lit(None).cast("string"))
    heads = audits.select("conv_id", *[F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in judged.columns[1:-1]],
                          F.col("audit").alias("_audit"))
    both = judged.unionByName(heads)
    order = [F.col("conv_id").asc_nulls_first(), F.col("_audit").isNull(), F.col("turn").asc_nulls_first(), F.col("_first"),
             F.coalesce("_second", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text, head in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "_audit"))):
                own: list[tuple[str, str]] = []
                if head is not None:
                    audit, at, state, place, to = head, 0, 0, 0, 0
                else:
                    own, to = [(role, text)], at + 1
                while to < len(audit) and audit[to] == "I":  # inserts follow the row before them
                    to += 1
                kept, state = edited(own, audit[at:to], state)
                at = to
                for e, r, t in kept:
                    out.append((conv_id, place, e, r, t))
                    place += 1
            cols = list(zip(*out)) or [[]] * 5
            kinds = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "position", "edit", "role", "text"])

    ordered = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "_audit")
    return ordered.mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """``conversations`` after the contract's damage: faults, cheapest repair
    and the repaired text's hash of every conversation."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
