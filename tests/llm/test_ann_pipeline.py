"""Nearest neighbours against brute force, the pipeline, entries and oracles."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from gradewise.llm import ann, quality, simhash, toxicity
from tests.llm.test_dedup import brute_contained, brute_fingerprint, classes

SF = "/root/testdata/sf0.001"


def brute_neighbours(ids, x, query, k):
    q = x[ids.index(query)]
    d = sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for i, v in zip(ids, x) if i != query)
    return [(i, s) for s, i in d[:k]]


@pytest.mark.parametrize("bucket", [ann.BUCKET, 40])
def test_recall_and_scores(spark, monkeypatch, bucket):
    monkeypatch.setattr(ann, "BUCKET", bucket)
    monkeypatch.setattr(ann, "LEAST", min(bucket, ann.LEAST))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], [np.array(r["embedding"], np.float64) for r in rows]
    v = spark.createDataFrame([(r["vec_id"], r["embedding"], "x") for r in rows], "vec_id long, embedding array<float>, key string")
    got = ann.neighbours(v, v.where("vec_id % 100 = 0")).collect()
    hit = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        exact = dict(brute_neighbours(ids, x, q, len(ids)))
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hit += len({i for _, i, _ in own} & {i for i, _ in brute_neighbours(ids, x, q, 10)})
        total += 10
    assert hit / total >= 0.9


def test_vector_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (100, [5.0, 5.0])]
    rows += [(i, [1.0, 0.0]) for i in range(200, 240)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.neighbours(v, v.where("vec_id % 100 = 0")).collect())
    same = [i for i in (0, 1, 2, *range(200, 240))]
    of = lambda q: [(r[2], r[3]) for r in got if r[0] == q]
    assert of(0) == [(i, 0.0) for i in same if i != 0][:10]
    assert of(200) == [(i, 0.0) for i in same if i != 200][:10]
    assert of(100)[0] == (0, pytest.approx(np.sqrt(16 + 25)))
    assert 5 not in {r[0] for r in got} and {r[0] for r in got} == {0, 100, 200}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-9.0, 0.5])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in sorted(ann.neighbours(few, few.where("vec_id = 0")).collect(), key=lambda r: r["rank"])] == [1, 2]
    assert ann.neighbours(v.limit(0), v.limit(0)).count() == 0
    assert ann.neighbours(v, v.limit(0)).count() == 0


def test_rows_that_share_an_id_only_are_each_compared(spark):
    ids, x = np.array([3, 3, 1, 3, 3]), np.array([[9.0, 9.0], [1.0, 0.0], [2.0, 0.0], [9.0, 9.0], [1.0, 0.0]])
    n = ann.row_numbers(ids, x).tolist()
    assert n[0] == n[3] and n[1] == n[4] and len(set(n)) == 3
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 2)]) for i in range(300)]
    rows += [(i, [v + 0.05 for v in e]) for i, e in rows if i % 100]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 100 = 0")
    got = {(r["query_id"], r["vec_id"], round(r["score"], 9)) for r in ann.neighbours(v, asked).collect()}
    hit = 0
    for q, e in ((i, e) for i, e in rows if i % 100 == 0):
        best = sorted((float(np.sqrt(((np.array(w) - e) ** 2).sum())), i) for i, w in rows if i != q)[:10]
        hit += len({(q, i, round(d, 9)) for d, i in best} & got)
    assert hit >= 27


def test_recall_of_queries_in_sparse_regions(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.1, (3000, 8)) + 5, rng.normal(0, 0.25, (400, 8)) - 5, rng.normal(0, 2, (400, 8))])
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(3000, 3800, 20))
    got = ann.neighbours(v, v.where(F.col("vec_id").isin(asked))).select("query_id", "vec_id").collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    hit = sum((q, i) in found for q in asked for i, _d in brute_neighbours(list(range(len(x))), x, q, 10))
    assert hit >= 0.96 * 10 * len(asked)


def test_clustered_rows_are_found_among_a_tenth(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (400, 32))[rng.integers(400, size=20_000)] + rng.normal(0, 0.2, (20_000, 32))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = ann.neighbours(v, v.where("vec_id % 100 = 0")).collect()
    asked = range(0, 20_000, 100)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    hit = 0
    for q in asked:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += sum((q, int(i)) in found for i in np.argpartition(d, 10)[:10])
    assert hit >= 0.95 * 10 * len(asked)
    compared = {r["query_id"]: r["compared"] for r in got}
    assert len(compared) == len(asked) and sum(compared.values()) < 0.1 * len(x) * len(asked)


@pytest.mark.parametrize("hashes,width", [(3, 1.0), (5, 2.0)])
def test_visits_follow_the_estimated_chance(hashes, width):
    """Against the whole grid of slots: the same chances in the same order."""
    h = ann.Hashes(6, 0.7, 2, hashes, width)
    place = h.project(np.random.default_rng(3).normal(size=(1, 6)))[0][1]
    keys, reached = h.visits(place, 0.9, 0.8)
    grid = np.stack(np.meshgrid(*[np.arange(-8, 9) if hashes == 3 else np.arange(-4, 5)] * hashes, indexing="ij"), axis=-1).reshape(-1, hashes)
    low = (grid - (place - np.floor(place))) * h.width / (0.9 * np.sqrt(2))
    chance = np.prod(0.5 * (ann._NORMAL(low + h.width / (0.9 * np.sqrt(2))) - ann._NORMAL(low)), axis=1)
    want = np.cumsum(np.sort(chance)[::-1])
    n = int(np.searchsorted(want, 0.8)) + 1
    assert len(keys) == n and reached == pytest.approx(want[:n], abs=1e-9)
    best = np.argsort(-chance, kind="stable")[:20]
    assert set(keys[:19].tolist()) <= set(h.key(np.floor(place) + grid[best]).tolist())
    assert h.visits(place, 0.9, 0.8, most=2) is None


def test_pipeline_against_brute_force(spark):
    """Every stage against a plain version on the stage's own input."""
    from tests.llm.test_dedup import brute_substring

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fields = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, SF)
        got = out.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == fields
        if name == "quality classifier":
            score = {r["doc_id"]: r["quality_keep"] for r in quality.scored(docs, quality.fit(docs)).collect()}
            assert sorted(r["doc_id"] for r in got) == sorted(d for d, keep in score.items() if keep)
        elif name == "SimHash near-dedup":
            fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
            root = classes(list(fp.values()), 4)
            least = {}
            for d, f in fp.items():
                least[root[f]] = min(least.get(root[f], d), d)
            assert sorted(r["doc_id"] for r in got) == sorted(least.values())
        elif name == "substring dedup":
            want = {d: (n, h) for d, _, n, h in brute_substring([(r["doc_id"], r["text"]) for r in rows], 13)}
            before = {r["doc_id"]: r["text"] for r in rows}
            for r in got:
                n, digest = want[r["doc_id"]]
                if n:
                    assert hashlib.sha256(r["text"].encode()).hexdigest() == digest and r["n_chars"] == len(r["text"])
                else:
                    assert r["text"] == before[r["doc_id"]]
            assert len(got) == len(rows)
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {d for d, *_ in brute_contained([(r["doc_id"], r["text"]) for r in rows], items)}
            assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows if r["doc_id"] not in bad)
        else:
            assert all(r["round_trip"] for r in got) and len(got) == len(rows)
        docs = spark.createDataFrame(got, out.schema)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_ten_operators_are_registered():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in queries()


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op8_benchmark_decontamination"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    cols = sorted(want.columns)
    norm = lambda f: sorted(map(tuple, f[cols].astype(str).to_numpy().tolist()))
    assert norm(got) == norm(want) and len(got)


def test_op_queries_keep_their_contract(spark):
    for name, cols in (("op2_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
                       ("op3_simhash_near_dedup", ["doc_id", "fingerprint", "component_id"]),
                       ("op7_nearest_neighbours", ["query_id", "rank", "vec_id", "score"]),
                       ("op9_toxicity", ["doc_id", "held_out", "score", "predicted"])):
        assert queries()[name](spark, SF).columns[:len(cols)] == cols
    row = queries()["op3_simhash_near_dedup"](spark, SF).first()
    assert re.fullmatch("[0-9a-f]{16}", row["fingerprint"])
    assert toxicity.HELD_OUT == 2 and simhash.SEED == 42
