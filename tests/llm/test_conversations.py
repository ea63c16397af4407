"""Conversation repair against plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from gradewise.llm import conversations as cv

SF = "/root/testdata/sf0.001"


def plain(codes):
    """Least (cost, audit) by a whole table from the end, audits as strings."""
    n = len(codes)

    @lru_cache(None)
    def go(i, q, inserts):
        found = []
        if i == n and q in (0, 3):
            found.append((0, ""))
        steps = []
        turn = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[q]
        if inserts < 3:
            steps += [("I", 3, i, to, inserts + 1) for r, to in turn if r != "s"]
        if i < n:
            steps.append(("D", 4, i + 1, q, 0))
            role, fault = codes[i]
            if fault != "x":
                t = 3 * (fault == "t")
                steps += [("K", t, i + 1, to, 0) for r, to in turn if r == role]
                steps += [("R", 3 + t, i + 1, to, 0) for r, to in turn if r != "s"]
        for e, c, j, to, more in steps:
            rest = go(j, to, more)
            if rest is not None:
                found.append((c + rest[0], e + rest[1]))
        return min(found) if found else None

    return go(0, 0, 0)


def brute(rows):
    """The query's row of one conversation from its (turn, role, text) rows."""
    kept = []
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        key = (turn is not None, turn or 0, role.encode(), text.encode())
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(key, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    kept.sort(key=lambda r: r[0])
    turns = [t for _, t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, codes = set(), []
    for _, _, role, text in kept:
        body = re.sub(r"[\x20\x09-\x0d]", "", text)
        fault = "k"
        if not body:
            fault = "b"
        elif (role, text) in seen:
            fault = "d"
        elif body[-1] not in ".!?":
            fault = "t"
        seen.add((role, text))
        codes.append((role[:1], fault))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
    cost, audit = plain(tuple((r, "x" if f in "bd" else f) for r, f in codes))
    out, i = [], 0
    for e in audit:
        before = out[-1][0] if out else ""
        other = "assistant" if before[:1] == "u" else "user"
        if e == "I":
            out.append((other, ""))
            continue
        if e != "D":
            out.append((kept[i][2] if e == "K" else other, kept[i][3]))
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    count = lambda f: sum(c[1] == f for c in codes)
    return (gaps, count("b"), count("d"), count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r))
    return out


def held(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_lattice_equals_plain_search():
    r = random.Random(3)
    for _ in range(4000):
        codes = tuple(r.choice("suaau-") + r.choice("kkkxt") for _ in range(r.randrange(9)))
        assert cv.least(codes, 0, cv.ENDS) == plain(codes), codes


def test_blocks_compose(monkeypatch):
    r = random.Random(4)
    for block in (1, 2, 3):
        monkeypatch.setattr(cv, "BLOCK", block)
        for _ in range(300):
            rows = [(1, t, r.choice(["system", "user", "assistant", "x", ""]), r.choice(["a.", "b", "", "c!", "d?"]) + str(t) * r.randrange(2) + ".")
                    for t in range(r.randrange(1, 9))]
            rows = [x for x in rows if zlib.crc32(f"1:{x[1]}".encode()) % 20 > 4]
            one = cv.Conversation(1)
            for _, t, role, text in rows:
                body = text.strip(cv.SPACES)
                one.add(t, role, text, not body, body[-1:] in (".", "!", "?"))
            assert one.result()[1:] == brute(rows)


@pytest.mark.parametrize("block", [256, 2])
def test_query_on_the_table(spark, block, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", block)
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = held(cv.op13_conversation_repair(spark, SF))
    assert got == {c: brute(rs) for c, rs in grouped(rows).items()}


def test_odd_rows(spark):
    r = random.Random(5)
    texts = [None, "", "  \t", "Yes.", "Yes.", "no end", "q? ", "\x0b.", "é!\n", " ", "x" * 20_000 + "."]
    rows = [(r.choice([None, 1, 2, 3, 4, 5, 6, 7]), r.choice([None, None, -3, 0, 1, 1, 2, 3, 9]),
             r.choice([None, "", "user", "assistant", "system", "tool", "User"]), r.choice(texts), "extra") for _ in range(150)]
    rows += [(50, t, "user", "same.", "extra") for t in range(40)] + [(51, 0, "user", "a.", "e"), (51, 0, "user", "a.", "e")]
    dropped = next(t for t in range(100) if zlib.crc32(f"60:{t}".encode()) % 20 == 0)
    rows.append((60, dropped, "user", "gone.", "e"))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, audit string")
    got = held(cv.repair(cv.damage(df)))
    assert got == {c: brute([x[:4] for x in rs]) for c, rs in grouped(rows).items()}
    assert got[60] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cv.repair(cv.damage(df.limit(0))).count() == 0
    # the repaired rows give the hash
    damaged = cv.damage(df)
    out = {}
    for x in sorted(cv.repaired_rows(damaged, cv.repair(damaged)).collect(), key=lambda x: x.position):
        out.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    for c, row in got.items():
        assert hashlib.sha256("\n".join(out.get(c, [])).encode()).hexdigest() == row[-1]
