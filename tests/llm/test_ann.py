import numpy as np

from colloquy.llm.ann import Index, nearest_neighbours

SHAPE = "vec_id long, embedding array<float>, v string, key string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SHAPE)


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    codes[:500] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    index = Index(codes)
    for radius in (0, 1, 7, 8, 20, 31, 64):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= radius)
        assert (index.within(codes[0], radius) == want).all()


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[1000:1400] = x[0]  # one vector many times
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(3000, None), (3100, [0.0] * 24), (3200, [float("nan")] * 24), (3300, [None] * 24), (3400, [1.0]), (None, [1.0] * 24), rows[500]]
    got = {}
    for r in nearest_neighbours(table(spark, rows + odd)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert sorted(got) == list(range(0, 3000, 100))
    found = 0
    y = x.astype(float)
    for q, rs in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r["rank"] for r in rs] == list(range(1, 11)) and len({r["vec_id"] for r in rs}) == 10
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in rs)
        assert [(r["score"], r["vec_id"]) for r in rs] == sorted((r["score"], r["vec_id"]) for r in rs)
        found += len({r["vec_id"] for r in rs} & set(want.tolist()))
    assert found / (10 * len(got)) >= 0.9
    assert [r["vec_id"] for r in got[0]] == list(range(1000, 1010))


def test_few_and_no_rows(spark):
    few = nearest_neighbours(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in few) == [(1, 1, 0.0), (2, 2, 2.0)]
    assert nearest_neighbours(table(spark, [])).collect() == []
    assert nearest_neighbours(table(spark, [(0, [1.0])])).collect() == []
