"""Substring dedup, SimHash classes and decontamination against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gradewise.llm import decontaminate as dc
from gradewise.llm import simhash, substring_dedup as sd

WORDS = [f"w{i}" for i in range(60)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage = text(rng, 60)
    rows = [(i, text(rng, rng.randint(0, 80))) for i in range(40)]
    rows += [(100 + i, text(rng, 10) + "\t" + passage + "\n" + text(rng, 9)) for i in range(12)]
    rows += [(200 + i, rows[5][1]) for i in range(3)]
    rows += [(300, None), (301, ""), (302, "  \n"), (None, passage), (303, passage), (303, passage)]
    rows += [(304, "a " * 400), (305, "a " * 30), (306, " ".join(passage.split()[:13])), (307, " ".join(passage.split()[:12]))]
    rows += [(400, text(rng, 20_000))]
    return rows


def brute_substring(rows, window):
    first = {}
    for d, t in rows:
        if d is not None and t:
            w = t.split()
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w, hit = (t or "").split(), set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    hit.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        out.append((d, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,group", [(13, 1_000_000), (13, 50), (3, 200)])
def test_substring(spark, window, group):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, places string")
    out = sd.substring_dedup(df, window=window, group_suffixes=group)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()), key=str)
    assert got == brute_substring(rows, window)
    assert "places" in out.columns


def test_hot_prefix_is_spread_over_groups():
    """One passage in most documents: no group gets more than its share."""
    counts = [np.zeros(1 << 14, np.int64) for _ in sd.prefix_lengths(13)]
    for c in counts:
        c[:] = 10
        c[5] = 1_000_000
    plan = sd.Plan(counts, 20)
    ids = np.arange(100_000)
    grp = plan.of([np.full(100_000, 5)] * len(counts), ids)
    assert plan.spread > 1 and grp.min() >= plan.groups
    assert np.bincount(grp - plan.groups).max() < 1.3 * 100_000 / plan.spread


def test_spread_repeats_meet(spark):
    rng = random.Random(4)
    passage = text(rng, 20)
    rows = [(i, passage + " " + text(rng, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sd.substring_dedup(df, group_suffixes=20)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect())
    assert got == sorted(brute_substring(rows, 13))


def test_substring_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.substring_dedup(df).count() == 0


def brute_fingerprint(t, n=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", " ".join(w))]
    if not w:
        return 0
    s = [" ".join(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fp, radius):
    keys, parent = list(dict.fromkeys(fp)), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_simhash(spark):
    rng = random.Random(5)
    rows = corpus()
    base = text(rng, 200).split()
    for i in range(60):  # near copies with one word changed
        w = list(base)
        w[rng.randrange(200)] = "Ü" + str(i)
        rows.append((500 + i, " ".join(w)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    fp = [brute_fingerprint(t) for _, t in rows]
    root = classes(fp, simhash.RADIUS)
    least = defaultdict(list)
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[root[f]].append(d)
    want = sorted(((d, f, min(least[root[f]], default=None)) for (d, _), f in zip(rows, fp)), key=str)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    n_classes = len(set(root.values()))
    assert kept.count() == n_classes
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(min(v) for v in least.values())


def test_simhash_transcodes_every_length():
    for t in ("", "One", "a b c", "a b c d", "a b c d e", "É é A", "x\x0by\x0cz\x1cw"):
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_covering_masks_lose_no_pair(radius):
    masks = simhash.covering_masks(radius, list(range(64)))
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not bits & m for m in masks)


@pytest.mark.parametrize("limit", [1 << 15, 8])
def test_links_in_large_buckets(spark, limit):
    """A dense cluster of fingerprints, with buckets divided further or not."""
    rng = random.Random(2)
    fps = {0}
    while len(fps) < 300:
        x = rng.choice(list(fps))
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    signed = [(simhash._signed(f),) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), limit=limit)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = classes(sorted(fps), 4)
    got = defaultdict(set)
    for f in fps:
        got[root.get(simhash._signed(f), f)].add(f)
    ours = sorted(map(sorted, got.values()))
    theirs = defaultdict(set)
    for f in fps:
        theirs[want[f]].add(f)
    assert ours == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def brute_contained(docs, items, n=5, t=0.8):
    cut = lambda w, k: {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}
    words = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").encode().split()
    out = []
    for d, x in docs:
        dw = [w.decode() for w in words(x)]
        for i, y in items:
            iw = [w.decode() for w in words(y)]
            if iw:
                k = min(n, len(iw))
                own = cut(iw, k)
                held = len(own & cut(dw, k))
                if held >= np.ceil(t * len(own) - 1e-9):
                    out.append((d, i, len(own), held))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination(spark, block):
    rng = random.Random(6)
    items = [(i, text(rng, rng.choice([1, 3, 5, 12, 30, 57]))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 W2")]
    docs = corpus()
    for i, t in items[:20]:
        w = (t or "").split()
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
        docs.append((1000 + i, text(rng, 300) + " " + " ".join(w).upper() + " " + text(rng, 40)))
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n_held int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_held"])
                  for r in dc.contaminated(d, b, block_bytes=block).collect()), key=str)
    want = brute_contained(docs, items)
    assert got == want and len(want) > 20
    kept = dc.decontaminate(d, b, block_bytes=block)
    assert kept.columns == d.columns
    bad = {str(x[0]) for x in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x) for x, _ in docs if str(x) not in bad)


def test_decontamination_without_items(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(d, none).count() == 0 and dc.decontaminate(d, none).count() == 1
    assert dc.contaminated(d.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
