import numpy as np
import pytest

from verdigris.llm import hnsw


def brute(rows, queries, k):
    out = {}
    for qid, q in queries:
        found = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in rows if i != qid and len(v) == len(q))
        out[qid] = found[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 4
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(300)] + [(7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = hnsw.nearest(df, lambda c: c % 100 == 0, shard_rows=800, block_rows=10).collect()
    want = brute(rows[:-1], [(i, v) for i, v in rows[:-1] if i % 100 == 0], 10)
    hits = total = 0
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        true = dict((i, d) for d, i in brute(rows[:-1], [(q, rows[q][1])], 4000)[q])
        assert all(abs(r.score - true[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in best})
        total += 10
    assert hits / total > 0.95
    copies = [r.vec_id for r in sorted((r for r in got if r.query_id == 3000), key=lambda r: r["rank"])]
    assert copies == [7, *range(3001, 3010)]


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (100, [2.0, 0.0]), (200, [-inf, 0.0]), (300, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(df, lambda c: c % 100 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1), (300, 1, 8)]
    assert hnsw.nearest(df.limit(0), lambda c: c % 100 == 0).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    got = hnsw.nearest(df, lambda c: c % 100 == 0).collect()
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hits / sum(map(len, want.values())) >= 0.95


@pytest.mark.parametrize("move, unit", [(0.0, 1.0), (1e3, 1e-2), (1e4, 1e-3), (0.0, 1e30), (0.0, 1e-30), (0.0, 1e200)])
def test_offsets_and_units_cost_no_recall(move, unit):
    x = np.random.default_rng(3).normal(size=(2000, 16)) * unit + move
    graph = hnsw.Graph.build(x)
    queries = x[::40]
    hits = 0
    for q, got in zip(queries, graph.search(queries, 160)):
        d = ((x - q) / unit) ** 2
        hits += len(set(np.argsort(d.sum(1), kind="stable")[:10].tolist()) & set(got[:10].tolist()))
    assert hits / (10 * len(queries)) >= 0.95
    want = np.sqrt((((x - x[0]) / unit) ** 2).sum(1)) * unit
    assert np.allclose(hnsw.distance(x, x[0]), want, rtol=1e-12)


def recall(spark, rows, *queries):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, lambda c: c.isin(*queries), shard_rows=700).collect()
    x, hits, total = np.array([v for _, v in rows]), 0, 0
    for q in queries:
        d = hnsw.distance(x, x[q])
        d[q] = np.inf
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 10 and all(r.score == d[r.vec_id] for r in mine)
        # a far query is as far from all near ones to the last digit: any of the tied counts
        hits, total = hits + int((d[[r.vec_id for r in mine]] <= np.sort(d)[9]).sum()), total + 10
    return hits / total


@pytest.mark.parametrize("far", [1e14, 1e20, 1e60, 1e300])
def test_one_far_vector_costs_no_recall(spark, far):
    x = np.random.default_rng(5).normal(size=(2000, 16))
    x[777] = far
    assert recall(spark, list(enumerate(x)), *range(0, 2000, 100)) >= 0.95


def test_mixed_scales_in_one_table_cost_no_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2400, 16)) * np.repeat([1e-3, 1.0, 1e4, 1e20, 1e90, 1e-90], 400)[:, None]
    assert recall(spark, list(enumerate(x)), *range(0, 2400, 100)) >= 0.95
