"""Collocations against plain counting; transducers against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gradewise.llm import collocations as co
from gradewise.llm.transducer import Transducer, union


def _bag(r, n):
    return Counter(tuple(r.choice([b"a", b"b", b"ab", b"\x01", b"c"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def test_transducers_hold_their_weights():
    r = random.Random(1)
    for _ in range(200):
        bags = [_bag(r, r.randrange(30)) for _ in range(r.randrange(1, 4))]
        made = [Transducer.from_bytes(Transducer.build(sorted(b.items())).to_bytes()) for b in bags]
        whole, total = union(made), sum(bags, Counter())
        every = [np.ones(len(t), bool) for t in whole.totals()]
        walked = {w: (d, s) for w, d, s in whole.phrases(every)}
        begins = Counter()
        for words, n in total.items():
            for k in range(1, len(words) + 1):
                begins[words[:k]] += n
        assert {w: whole.levels[d][2][s] for w, (d, s) in walked.items() if whole.levels[d][2][s]} == dict(total)
        assert {w: whole.totals()[d][s] for w, (d, s) in walked.items()} == dict(begins)
        asked = [*total, *_bag(r, 20), (b"new",), (b"a",) * 7]
        assert whole.compose(asked) == [total.get(w) for w in asked]


def test_beginnings_are_shared():
    words = [(a, b, b"end") for a in (b"1", b"2", b"3") for b in (b"x", b"y")]
    assert [len(x[0]) for x in Transducer.build((w, 1) for w in words).levels] == [3, 6, 6]
    with pytest.raises(ValueError):
        Transducer.build([((b"b",), 1), ((b"a",), 1)])


def plain(rows, least, first, absorbed=80, longest=4):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        within = {}
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i:i + k]] = max(within.get(p[i:i + k], 0), a)
        found = []
        for p, a in cand.items():
            if 100 * within.get(p, 0) >= absorbed * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def _corpus(r):
    words = ["a", "b", "The", "éa", "x\x01", "\x02", "zz", "中", "0"]
    rows = []
    for _ in range(60):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ", "\x85 "]) for _ in range(r.randrange(0, 120)))
        rows.append((r.choice([None, "en", "und", "de", "en"]), text))
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " \t "), ("en", "a b " * 8000), ("fr", "word" * 4000)]


@pytest.mark.parametrize("shard", [7, 250_000])
def test_collocations_equal_plain_counting(spark, shard):
    for seed in range(2):
        rows = _corpus(random.Random(seed))
        df = spark.createDataFrame([(t, g, 1, 2) for g, t in rows], "text string, lang string, phrase int, n int").repartition(3)
        got = sorted(map(tuple, co.collocations(df, least=4, first=25, shard=shard).collect()))
        assert got == plain(rows, 4, 25)


def test_a_full_filter_and_equal_codes_change_nothing(spark, monkeypatch):
    rows = _corpus(random.Random(9))
    df = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    want = plain(rows, 4, 25)
    monkeypatch.setattr(co, "code_filter", lambda counts: (co.np.full(4096, 255, co.np.uint8), 5))
    assert sorted(map(tuple, co.collocations(df, least=4, first=25).collect())) == want


def test_words_of_one_code_stay_apart():
    import pyarrow as pa

    b = co.Block(pa.RecordBatch.from_pydict({"text": ["aa bb cc aa"], "lang": ["en"]}))
    b.plain = b.plain * 0
    number, words = co._vocabulary(b, co.np.arange(4))
    assert [words[i] for i in number] == [b"aa", b"bb", b"cc", b"aa"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    out = co.collocations(df)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
