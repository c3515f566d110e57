import numpy as np

from corpusgraph.llm import ann, exact_topk, vectors
from tests.compare import assert_same

DIR = "/root/testdata/sf0.001"


def test_exact_query(spark):
    assert_same(exact_topk.op7_exact_topk(spark, DIR), DIR, exact_topk.OP7_SQL)


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def exact(scores, ids, own, k):
    order = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != own)[:k]
    return [i for _, i in order]


def test_branch_and_bound_on_clusters_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(vectors, "CANDIDATE_NUMBERS", 60 * 40)
    monkeypatch.setattr(vectors, "QUERY_NUMBERS", 30 * 40)
    monkeypatch.setattr(exact_topk, "FIRST", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 4, (150, 40)), np.repeat(rng.integers(-30, 31, (1, 40)), 80, axis=0) + rng.integers(0, 2, (80, 40))])
    ids = np.arange(len(x)) * 7
    v = vectors.usable_vectors(frame(spark, x, ids))
    q = v.filter("vec_id % 14 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in exact_topk.exact_top_k(v, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {int(i): exact(x @ x[n], ids, i, 5) for n, i in enumerate(ids) if i % 14 == 0}


def test_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (50, [float("nan"), 1.0]), (51, None), (52, [None, 1.0]), (53, [1.0]), (54, []), (55, [0.0, 0.0]), (56, [float("inf"), 0.0]), (57, [2.0, 0.0]), (57, [2.0, 0.0]), (None, [1.0, 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = vectors.usable_vectors(t)
    assert sorted(r.vec_id for r in v.collect()) == [0, 53, 55, 57]
    q = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    assert [(r.rank, r.vec_id) for r in exact_topk.exact_top_k(v, q, 5).orderBy("rank").collect()] == [(1, 57), (2, 55)]
    assert [(r.rank, r.vec_id, r.score) for r in ann.nearest_cosine(v, q, 5).collect()] == [(1, 57, 1.0)]
    assert vectors.usable_vectors(t.limit(0)).count() == 0


def test_hadamard_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 48))
    y = ann.hadamard_rotate(x, ann.table_signs(48, 1)[0])
    assert y.shape == (20, 64) and np.allclose(y @ y.T, x @ x.T)


def test_ann_recall_and_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 32))
    x[100:140] = x[100]
    ids = np.arange(600)
    v = vectors.usable_vectors(frame(spark, x, ids))
    q = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ann.nearest_cosine(v, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = [len(set(got[i]) & set(exact(np.round(unit @ unit[i], 12), ids, i, 5))) / 5 for i in range(0, 600, 20)]
    assert np.mean(hits) >= 0.9
    assert got[100] == [101, 102, 103, 104, 105] and got[120] == [100, 101, 102, 103, 104]


def test_ann_rows_are_complete_on_few_and_on_clustered_vectors(spark):
    rng = np.random.default_rng(11)
    few = vectors.usable_vectors(frame(spark, rng.normal(size=(4, 64)), range(4)))
    got = ann.nearest_cosine(few, few.withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(q, c) for q in range(4) for c in range(4) if q != c]
    middle = rng.normal(size=64)
    tight = middle / np.linalg.norm(middle) + rng.normal(size=(400, 64)) * 0.02 / 8
    outside = frame(spark, rng.normal(size=(30, 64)), range(1000, 1030)).toDF("query_id", "v")
    got = ann.nearest_cosine(vectors.usable_vectors(frame(spark, tight, range(400))), outside, 5).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in range(1000, 1030) for n in range(1, 6)]


def test_lengths_meet_only_their_like(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [0.5]), (50, [3.0]), (3, [0.0, 2.0, 1.0])]
    v = vectors.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    assert [(r.query_id, r.vec_id) for r in exact_topk.exact_top_k(v, q, 5).orderBy("rank").collect()] == [(50, 1), (50, 2)]
    assert sorted((r.query_id, r.vec_id, r.score) for r in ann.nearest_cosine(v, q, 5).collect()) == [(50, 1, 1.0), (50, 2, 1.0)]


def test_extreme_norms(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [1e300, 1e300]), (4, [-1e308, 1e308]), (5, [5e-324, 0.0])]
    v = vectors.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = v.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    got = [(r.vec_id, r.score) for r in ann.nearest_cosine(v, q, 5).orderBy("rank").collect()]
    assert [i for i, _ in got] == [2, 5, 1, 3, 4] and np.allclose([s for _, s in got], [1, 1, 0.5**0.5, 0.5**0.5, -(0.5**0.5)], atol=1e-15)
    whole = v.withColumn("v", exact_topk.quantize("v"))
    got = exact_topk.exact_top_k(whole, whole.withColumnRenamed("vec_id", "query_id"), 2).collect()
    best = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    most = (1 << 63) - 1
    assert best[3, 1] == (2, most) and best[2, 1] == (3, most) and best[4, 1][0] in (0, 1, 5) and best[4, 1][1] == 0


def test_ann_query_against_all_vectors(spark):
    """The query itself: exact scores, whole lists and recall, and fewer candidates than all."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.op1_ann(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    place, hits = {i: n for n, i in enumerate(ids.tolist())}, []
    for i, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - unit[place[i]] @ unit[place[j]]) < 1e-12 for _, j, s in found)
        hits.append(len({j for _, j, _ in found} & set(exact(unit @ unit[place[i]], ids.tolist(), i, 5))) / 5)
    assert np.mean(hits) >= 0.9


def test_probed_share_falls_with_the_number_of_vectors():
    shares = [ann.plan(n, 64)[1] / 128 ** ann.plan(n, 64)[0] for n in (500, 2000, 10_000, 100_000, 1_000_000, 10_000_000)]
    assert shares == sorted(shares, reverse=True) and shares[-1] < shares[0] / 50


def test_near_vectors_are_probed_alike_at_any_size():
    """Planted at the cosines of the five nearest of n random vectors: the tail of the cosine's density holds 1 / n for each."""
    rng = np.random.default_rng(17)
    cosines = np.linspace(1, -1, 1 << 17)
    tail = np.cumsum((1 - cosines**2) ** 30.5)
    q, away = ann.units(rng.normal(size=(100, 64))), rng.normal(size=(100, 5, 64))
    away = away - (away @ q[:, :, None]) * q[:, None, :]
    away /= np.linalg.norm(away, axis=2, keepdims=True)
    for n in (500, 20_000, 1_000_000, 3_999_999, 4_000_000, 40_000_000, 400_000_000):
        t = np.interp(np.cumsum(rng.exponential(size=(100, 5)), axis=1) / n, tail / tail[-1], cosines)[:, :, None]
        near = (t * q[:, None, :] + np.sqrt(1 - t**2) * away).reshape(-1, 64)
        hashes, probes = ann.plan(n, 64)
        found = np.zeros((100, 5), dtype=bool)
        for signs in ann.table_signs(64, ann.TABLES * hashes).reshape(ann.TABLES, hashes, ann.ROUNDS, 64):
            codes = []
            for rows, most in ((q, probes), (near, 1)):
                turned = [ann.hadamard_rotate(rows, s) for s in signs]
                codes.append(ann.probed_buckets([np.concatenate([y, -y], axis=1) for y in turned], most))
            found |= (codes[0][:, None, :] == codes[1].reshape(100, 5, 1)).any(axis=2)
        assert found.mean() >= 0.9, n


def test_plan_has_no_switch_by_size():
    plans = [ann.plan(int(2 ** (e / 8)), 64) for e in range(40, 264)]
    assert len({hashes for hashes, _ in plans}) == 1
    assert all(b <= a <= 1.1 * b + 1 for (_, a), (_, b) in zip(plans, plans[1:], strict=False))
