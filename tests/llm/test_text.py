"""Token counts, SentencePiece, packing, licences, quality and toxicity."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gradewise.llm import licenses, packing, quality, toxicity
from gradewise.llm import sentencepiece_codec as sp
from gradewise.llm import token_counts as tc

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   \n", "İstanbul ΣΑΣ ﬁ é ́x <|endoftext|>a<|startoftext|> it's I'LL 123 ½ 中文字  x　y\x85z 😀😀 ▁▁a ▁",
       "a" * 3000, "ab" * 2000 + "é", "  lead\t\n\x0b trail  ", "don't!!!??? x'ss 'S", "the the the " * 900]


def odd_docs(spark):
    rows = [(i, t, "x", True) for i, t in enumerate(ODD)] + [(None, "no id", "y", False), (3, ODD[3], "x", True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, round_trip boolean")


def all_docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(odd_docs(spark).select("doc_id", "text").where("doc_id is not null")
                            .selectExpr("doc_id + 1000000 as doc_id", "text").distinct())


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tc.vocabulary(tc.TOKENIZER))
    docs = all_docs(spark)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.token_counts(docs).collect())
    rows = docs.collect()
    n = [len(e.ids) for e in lib.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]
    assert got == sorted((r["doc_id"], len((r["text"] or "").encode()), k, k > 2048) for r, k in zip(rows, n))
    assert tc.token_counts(odd_docs(spark)).count() == len(ODD) + 2
    assert tc.token_counts(docs.limit(0)).count() == 0


def test_prefix_table_answers_every_prefix(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tc.vocabulary(tc.TOKENIZER))
    own = tc.counter(tc.vocabulary(tc.TOKENIZER))
    for t in ("The unbelievable, isn't it? Naïve  façade\nand so on 2024!", "internationalisation"):
        raw = t.encode()
        table = own.prefix_counts(raw)
        for i in range(len(t) + 1):
            end = len(t[:i].encode())
            assert own.tokens_before(raw, end, table) == len(lib.encode(t[:i], add_special_tokens=False).ids), t[:i]
        for budget in range(int(table[1][-1]) + 2):
            cut = own.within(raw, budget, table)
            assert own.tokens_before(raw, cut, table) <= budget
            later = [e for e in table[0] if e > cut]
            assert not later or own.tokens_before(raw, int(later[0]), table) > budget
    row = tc.token_counts(spark.createDataFrame([(1, "a bc  d")], "doc_id long, text string"), with_prefixes=True).first()
    assert row["ends"] == [1, 4, 7] and row["counts"][-1] == row["n_tokens"]


def test_pieces_equal_the_library_and_come_back(spark):
    docs = all_docs(spark)
    rows = sp.encode(docs).collect()
    lib = sp.codec(sp.model_path(sp.MODEL)).library
    for r in rows:
        assert r["piece_ids"] == lib.encode(r["text"] or ""), r["text"]
        assert r["n_pieces"] == len(r["piece_ids"])
        assert r["round_trip"] or "▁" in r["text"]
    back = {r["doc_id"]: r["decoded"] for r in sp.decode(sp.encode(docs)).collect()}
    assert all(back[r["doc_id"]] == lib.decode(r["piece_ids"]) for r in rows)
    out = sp.encode(odd_docs(spark))
    assert out.columns == ["doc_id", "text", "n_tokens", "piece_ids", "n_pieces", "round_trip"] and out.count() == len(ODD) + 2
    assert sp.encode(docs.limit(0)).count() == 0


def test_words_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(sp, "MEMO", 20)
    own = sp.Codec(sp.model_path(sp.MODEL))
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeé, .") for _ in range(6)) for _ in range(30)) for _ in range(20)]
    for at in range(0, 20, 4):
        got = [np.frombuffer(p, own.dtype).tolist() for p in own.encode_batch(texts[at:at + 4])]
        assert got == own.library.encode(texts[at:at + 4])


def test_unigram_states_are_viterbi():
    """The same trie pass with unigram scores gives the best sum of scores."""
    own = sp.Codec(sp.model_path(sp.MODEL), unigram=True)
    own.scores = {p: -float(len(p)) ** 0.5 - (hash_ % 97) / 50 for p, hash_ in ((p, sum(map(ord, p)) * 31) for p in own.scores)}
    own.low = min(own.scores.values()) - 10
    words = ["▁abcabd", "▁abc", "▁hello", "▁help", "▁helping"]
    own.learn(set(words))
    for w in words:
        best = [0.0] + [-1e9] * len(w)
        for i in range(1, len(w) + 1):
            best[i] = max(best[j] + own.scores.get(w[j:i], own.low if i - j == 1 else -1e9) for j in range(i))
        pieces = [own.library.id_to_piece(int(i)) for i in np.frombuffer(own.memo[w], own.dtype)]
        assert "".join(pieces) == w
        assert sum(own.scores[p] for p in pieces) == pytest.approx(best[-1])


def test_packing_is_lossless_and_tight(spark):
    docs = all_docs(spark)
    rows = packing.pack(docs, row=256, buffer=100_000).collect()
    coder, end = packing.encoding(packing.VOCABULARY)
    back = {}
    for r in rows:
        ids, pos, cu = np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["positions"], np.uint32), r["cu_seqlens"]
        assert len(ids) == r["n_tokens"] == cu[-1] <= 256 and len(cu) == len(r["doc_ids"]) + 1
        for d, o, a, z in zip(r["doc_ids"], r["offsets"], cu, cu[1:]):
            assert pos[a:z].tolist() == list(range(z - a))
            back.setdefault(d, []).append((o, ids[a:z].tolist()))
    want = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] is not None}
    assert set(back) == set(want)
    for d, parts in back.items():
        ids = [i for _, p in sorted(parts) for i in p]
        assert ids[-1] == end and coder.decode(ids[:-1]) == want[d]
    assert sum(r["n_tokens"] for r in rows) / (256 * len(rows)) > 0.97
    assert packing.padded_ids(rows[0]["ids"], 256).shape == (256,)
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_against_a_plain_search():
    rng = random.Random(2)
    lengths = [rng.randint(1, 64) for _ in range(500)]
    got = packing.best_fit_decreasing(lengths, 64)
    left, rows = [], []
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fits = [r for r in left if r >= lengths[i]]
        if fits:
            left[left.index(min(fits))] -= lengths[i]
        else:
            left.append(64 - lengths[i])
    assert sorted(x for r in got for x in r) == list(range(500))
    assert sorted(64 - sum(lengths[i] for i in r) for r in got) == sorted(left)


def test_licences(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    full = licenses.TEMPLATES["GPL-notice"]
    changed = full.replace("redistribute it and/or", "share it or").upper().replace(" ", "\n * ")
    docs = [(1, f"{filler(50)} {licenses.TEMPLATES['MIT']} {filler(9)}"), (2, f"{filler(3)}. {changed}"), (3, filler(400)),
            (4, None), (5, ""), (6, full[:40]), (None, licenses.TEMPLATES["BSD"]),
            (7, f"{licenses.TEMPLATES['CC-BY-NC-4.0']} {filler(300)} {licenses.TEMPLATES['CC-BY-NC-4.0']}"),
            (8, " ".join([licenses.TEMPLATES["MIT"]] * 3))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in got) == [
        ("1", "MIT"), ("2", "GPL-notice"), ("7", "CC-BY-NC-4.0"), ("7", "CC-BY-NC-4.0"), ("8", "MIT"), ("8", "MIT"), ("8", "MIT"), ("None", "BSD")]
    by = {r["doc_id"]: r for r in got}
    assert by[1]["coverage"] == 1 and docs[0][1].encode()[by[1]["first_byte"]:by[1]["end_byte"]].decode() == licenses.TEMPLATES["MIT"][:-1]
    assert 0.8 <= by[2]["coverage"] < 1
    assert licenses.scan(df, {"short": "b a"}).count() == 0
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, {}).count() == 0


def test_licence_scan_finds_every_notice(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    plain = {(r["doc_id"], n) for r in docs.collect() for n, t in licenses.TEMPLATES.items() if t.lower() in r["text"].lower()}
    assert plain <= got


def test_licence_scan_finds_every_notice_with_one_word_changed(spark):
    """Against an alignment that is not pruned: its band holds the whole text."""
    rng = random.Random(6)
    filler = lambda: [rng.choice(["alpha", "the", "license", "under", "of", "software"]) for _ in range(rng.randint(0, 9))]
    docs, meant = [], []
    for name, notice in {**licenses.TEMPLATES, **licenses.NOTICES}.items():
        words = re.findall("[a-z0-9]+", notice.lower())
        changes = [words]
        for i in range(len(words)):
            changes += [words[:i] + words[i + 1:], [*words[:i], "x", *words[i + 1:]], [*words[:i], "x", *words[i:]]]
        for changed in changes:
            text = filler() + changed + filler()
            matched, _a, _z = licenses.align([w.encode() for w in words], [w.encode() for w in text], 0, band=len(text))
            assert matched >= len(words) - 1
            meant.append((len(docs), name, matched))
            docs.append((len(docs), " ".join(text)))
    templates = {**licenses.TEMPLATES, **licenses.NOTICES}
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()
    assert set(meant) <= {(r["doc_id"], r["license"], r["matched_words"]) for r in got}


def test_licence_scan_equals_an_alignment_at_every_shift(spark):
    rng = random.Random(7)
    names = ["MIT", "Apache-2.0", "CC-BY-NC-4.0"]
    words = {n: re.findall("[a-z0-9]+", licenses.TEMPLATES[n].lower()) for n in names}
    pool = [w for n in names for w in words[n]]
    docs, meant = [], []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 3)):
            part = list(words[rng.choice(names)])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(part))
                part[at:at + rng.randint(0, 1)] = rng.choice([[], ["x"], [rng.choice(pool)]])
            text += [rng.choice(pool) for _ in range(rng.randint(0, 4))] + part
        docs.append((i, " ".join(text)))
        for n in names:
            t, w = [x.encode() for x in words[n]], [x.encode() for x in text]
            every = [licenses.align(t, w, s, band=len(t) // 2) for s in range(-2 * len(t), len(w) + len(t))]
            spans = []
            for m, a, z in sorted({x for x in every if x[0] >= 0.8 * len(t)}, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(z <= b or y <= a for _m, b, y in spans):
                    spans.append((m, a, z))
            meant += [(i, n, *x) for x in spans]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), {n: licenses.TEMPLATES[n] for n in names}).collect()
    got = [(r["doc_id"], r["license"], r["matched_words"], r["first_word"], r["end_word"]) for r in rows]
    assert sorted(got) == sorted(meant)


def test_licence_query_finds_whole_licences(spark, tmp_path):
    texts = licenses.full_texts()
    assert {"Apache-2.0-text", "GPL-3-text", "LGPL-3-text", "MPL-2.0-text", "CC0-1.0-text"} <= set(texts)
    docs = [(i, f"alpha beta\n{t}\ngamma") for i, (_n, t) in enumerate(sorted(texts.items()))]
    words = texts["Apache-2.0-text"].split()
    del words[700]
    docs += [(100, " ".join(words)), (101, licenses.NOTICES["AGPL-notice"]), (102, licenses.NOTICES["ISC-grant"])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["license"], r["coverage"]) for r in licenses.op4_license_scan(spark, str(tmp_path)).collect()}
    assert {(i, n, 1.0) for i, n in enumerate(sorted(texts))} <= got
    assert any(i == 100 and n == "Apache-2.0-text" and 0.99 < c < 1 for i, n, c in got)
    assert {(101, "AGPL-notice", 1.0), (102, "ISC-grant", 1.0)} <= got


def test_alignment_against_full_table():
    rng = random.Random(4)
    for _ in range(40):
        template = [rng.choice(["a", "b", "c", "d"]).encode() for _ in range(rng.randint(1, 12))]
        body = list(template)
        if len(body) > 3:
            body[rng.randrange(len(body))] = b"z"
            body.insert(rng.randrange(len(body)), b"y")
        at = rng.randint(0, 9)
        words = [b"q"] * at + body + [b"q"] * 5
        matched, a, z = licenses.align(template, words, at, band=30)
        m, n = len(template), len(words)
        best = np.zeros((m + 1, n + 1))
        for i in range(1, m + 1):
            best[i, 0] = -0.5 * i
            for j in range(1, n + 1):
                best[i, j] = max(best[i - 1, j - 1] + (1 if template[i - 1] == words[j - 1] else -0.5), best[i - 1, j] - 0.5, best[i, j - 1] - 0.5)
        assert matched >= len(template) - 1 and at <= a <= z <= at + len(body)
        assert best[m].max() <= matched


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.9]
    p = np.zeros(20_000, np.int64)
    for a in right:
        vote = np.where(rng.random(20_000) < a, good, ~good)
        p = p * 3 + np.where(rng.random(20_000) < 0.3, 0, np.where(vote, 2, 1))
    names, n = np.unique(p, return_counts=True)
    model = quality.fit_labels(names, n)
    assert abs(model.share - 0.8) < 0.05
    assert ((model.posterior(p) > 0.5) == good).mean() > 0.95


def test_quality_agrees_with_gold(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.scored(docs, quality.fit(docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = out[out.quality == 1].quality_keep.mean()
    bad = out[out.quality == 0].quality_keep.mean()
    assert good > 0.98 and bad < 0.1
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns


def test_quality_edge_rows(spark):
    df = odd_docs(spark).withColumnRenamed("n_tokens", "quality_score")
    out = quality.scored(df, quality.fit(df))
    assert out.count() == df.count() and out.columns.count("quality_score") == 1
    assert quality.scored(df.limit(0), quality.fit(df.limit(0))).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert quality.scored(empty, quality.fit(empty)).count() == 2


def test_field_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(6)
    field = toxicity.Field(rng.normal(size=toxicity.SIZE), -0.3, rng.normal(size=2), rng.normal(size=(2, 2)))
    features = rng.integers(0, toxicity.SIZE, size=(9, 5))
    first = np.array([0, 4, 5, 9])
    prob, expected, norm = field.marginals(features, first, pairs=True)
    want, total, pairs = np.zeros(9), 0.0, np.zeros((2, 2))
    for lo, hi in zip(first, first[1:]):
        weights = {}
        for path in product((0, 1), repeat=hi - lo):
            s = field.begin[path[0]] + sum(field.weights[features[lo + i]].sum() + field.bias for i, y in enumerate(path) if y)
            s += sum(field.move[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(s)
        z = sum(weights.values())
        total += np.log(z)
        for path, w in weights.items():
            want[lo:hi] += np.array(path) * w / z
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w / z
    assert np.allclose(prob, want) and np.allclose(expected, pairs) and np.isclose(norm, total)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, field).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 50 and (held.predicted == held.toxic).mean() > 0.9
    assert out.score.between(0, 1).all()
    # labels of held-out rows and other columns change nothing
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    again = toxicity.fit(docs.selectExpr("doc_id", "text", "'z' as lang", "'s' as source"), flipped)
    assert np.array_equal(field.weights, again.weights)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out[out.spans.map(len) > 0].head(5).itertuples():
        for s in r.spans:
            texts[r.doc_id].encode()[s.start:s.end].decode()


def test_toxicity_edge_rows(spark):
    df = odd_docs(spark).withColumnRenamed("n_tokens", "score")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    field = toxicity.fit(df, labels)
    assert field is None
    out = toxicity.scored(df, field).collect()
    assert len(out) == len(ODD) + 2 and all(r["score"] == 0 and r["predicted"] == 0 for r in out)
    assert toxicity.scored(df.limit(0), None).count() == 0
    long_ = toxicity.tokens(pa.array(["x " * 1000 + ". y", None, "", "z"]))
    assert np.diff(long_.first).max() <= toxicity.LONGEST and long_.first[-1] == 1002 and (np.diff(long_.first) > 0).all()
