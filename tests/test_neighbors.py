import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.operators import smote as S
from wardflow.operators.neighbors import nearest_of, nearest_rows
from wardflow.operators.smote import smote


def brute(x, k):
    """Ids of the k nearest other rows and their squared distances."""
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def frame(spark, groups):
    rows = [(g, i, [float(v) for v in x]) for g, xs in groups.items() for i, x in xs]
    return spark.createDataFrame(rows, "grp string, id long, x array<double>")


def lists(df):
    return {r["id"]: [(n["id"], n["distance"]) for n in r["near"]] for r in df.collect()}


def test_a_group_of_one_window_is_exact(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(120, 6)), rng.normal(size=(40, 6))
    b[10:20] = b[0]  # repeated rows
    got = lists(nearest_rows(frame(spark, {"a": list(enumerate(a)), "b": [(1000 + i, x) for i, x in enumerate(b)]}), k=5))
    for base, x in ((0, a), (1000, b)):
        _, want = brute(x, 5)
        for i in range(len(x)):
            near = got[base + i]
            assert len({j for j, _ in near}) == 5 and base + i not in {j for j, _ in near}
            assert all(base <= j < base + len(x) for j, _ in near)
            assert np.allclose([d for _, d in near], want[i])


@pytest.mark.parametrize("columns", [4, 12])
def test_recall_beyond_one_window(spark, columns):
    """Clustered rows in several windows: at least 0.9 of the true five neighbours, and all distances are real."""
    rng = np.random.default_rng(2)
    centres = rng.normal(scale=4, size=(12, columns))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, columns))
    got = lists(nearest_rows(frame(spark, {"g": list(enumerate(x))}), k=5, block=512))
    truth, far = brute(x, 5)
    hits = sum(len({j for j, _ in got[i]} & set(truth[i].tolist())) for i in range(len(x)))
    assert hits / (5 * len(x)) >= 0.9
    for i in range(0, len(x), 97):
        for j, d in got[i]:
            assert d == pytest.approx(((x[i] - x[j]) ** 2).sum()) and d >= far[i][0] - 1e-9


def test_one_value_in_a_third_of_the_rows(spark):
    """Repeated rows are cut into windows too, and find each other at distance zero."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    x[:300] = 0.5
    got = lists(nearest_rows(frame(spark, {"g": list(enumerate(x))}), k=3, block=64))
    assert all(len(got[i]) == 3 and all(d == 0 for _, d in got[i]) for i in range(300))


def test_small_groups_and_empty_frame(spark):
    df = frame(spark, {"one": [(1, [1.0])], "two": [(2, [1.0]), (3, [4.0])]})
    assert lists(nearest_rows(df)) == {1: [], 2: [(3, 9.0)], 3: [(2, 9.0)]}
    assert nearest_rows(df.limit(0)).count() == 0


def test_synthetic_rows_lie_between_a_row_and_a_true_neighbour(spark):
    rng = np.random.default_rng(4)
    many, few = rng.normal(size=(150, 3)), rng.normal(size=(40, 3)) + 5
    rows = [("many", *map(float, x)) for x in many] + [("few", *map(float, x)) for x in few] + [("alone", 9.0, 9.0, 9.0)]
    out = smote(spark.createDataFrame(rows, "y string, a double, b double, c double"), ["a", "b", "c"], "y", k=5)
    counts = {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts == {("many", False): 150, ("few", False): 40, ("few", True): 110, ("alone", False): 1, ("alone", True): 149}
    scale = np.vstack([many, few, [[9.0] * 3]]).std(axis=0, ddof=1)
    near, _ = brute(few / scale, 5)
    for r in out.where("synthetic and y = 'few'").collect():
        p = np.array([r.a, r.b, r.c])
        # on the segment between some row and one of its five nearest
        gaps = []
        for i in range(len(few)):
            for j in near[i]:
                step = few[j] - few[i]
                t = ((p - few[i]) @ step) / (step @ step)
                gaps.append(np.abs(p - few[i] - np.clip(t, 0, 1) * step).max())
        assert min(gaps) < 1e-9
    lone = out.where("synthetic and y = 'alone'").select("a").distinct().collect()
    assert [r.a for r in lone] == [9.0]
    assert out.where(F.col("a").isNull()).count() == 0


def test_refinement_exchanges_edges_not_pairs(spark):
    """The lists of a row's neighbours come as one row an edge and hold no candidate beyond the row's last neighbour."""
    from wardflow.operators.neighbors import _second

    rng, n, keep = np.random.default_rng(5), 120, 4
    x = rng.normal(size=(n, 3))
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    lists = {i: sorted((float(far[i, j]), int(j)) for j in rng.choice([j for j in range(n) if j != i], keep, replace=False))
             for i in range(n)}
    lists[0] = lists[0][:2]  # a short list has room for any candidate
    best = spark.createDataFrame([(i, v) for i, v in lists.items()], "id long, near array<struct<distance: double, id: long>>")
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, x array<double>")
    rows = _second(best, vectors, keep, 3).collect()
    assert len(rows) <= sum(map(len, lists.values()))
    got: dict[int, set] = {}
    for r in rows:
        got.setdefault(r.id, set()).update(e.id for e in r.near)
        assert all(e.distance == pytest.approx(far[r.id, e.id]) for e in r.near)
    for a in range(n):
        second = {c for _, b in lists[a] for _, c in lists[b]} - {a}
        worst = lists[a][-1][0] if len(lists[a]) >= keep else np.inf
        assert got.get(a, set()) == {c for c in second if far[a, c] <= worst + 1e-12}


def test_neighbours_of_some_rows_are_exact(spark):
    """Wanted rows against all rows of their group, in several tasks and batches, with repeated rows."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2500, 5)), rng.normal(size=(60, 5))
    a[100:140] = a[0]
    every = frame(spark, {"a": list(enumerate(a)), "b": [(5000 + i, x) for i, x in enumerate(b)], "c": [(9000, [0.0] * 5)]}).repartition(3)
    wanted = every.where("id % 7 = 0 or id = 9000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 400)
    try:
        got = lists(nearest_of(wanted, every, k=5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {r["id"] for r in wanted.collect()} and got[9000] == []
    for base, x in ((0, a), (5000, b)):
        order, far = brute(x, 5)
        for i in got:
            if base <= i < base + len(x):
                assert np.allclose([d for _, d in got[i]], far[i - base])
                assert i not in (105, 112) or [j for j, _ in got[i]] == [0, 100, 101, 102, 103]
    assert lists(nearest_of(wanted.limit(0), every)) == {}
    assert lists(nearest_of(wanted.where("id = 9000"), every.limit(0))) == {9000: []}


def test_only_rows_that_make_a_synthetic_row_are_searched(spark, monkeypatch):
    """Classes of nearly one size: 1,000 and 990 rows, so ten rows need neighbours."""
    rng = np.random.default_rng(7)
    rows = [("ab"[i >= 1000], *map(float, rng.normal(size=3))) for i in range(1990)]
    df = spark.createDataFrame(rows, "y string, a double, b double, c double")
    asked, find = [], S.nearest_of
    monkeypatch.setattr(S, "nearest_of", lambda wanted, *a, **k: asked.append(wanted.count()) or find(wanted, *a, **k))
    out = smote(df, ["a", "b", "c"], "y")
    assert asked == [10] and out.where("synthetic").count() == 10
    new = [[r.a, r.b, r.c] for r in out.where("synthetic").collect()]
    monkeypatch.setattr(S, "FEW", 0)  # all rows of the class are searched
    wide = smote(df, ["a", "b", "c"], "y", k=5)
    assert len(asked) == 1 and wide.where("synthetic").count() == 10 and wide.count() == 2000
    old = [[r.a, r.b, r.c] for r in wide.where("synthetic").collect()]
    assert np.allclose(sorted(new), sorted(old))  # 990 rows fit one window, so both are exact


def test_rows_in_hash_order_make_one_more(spark):
    """7 rows of 40 make 3 synthetic rows, the others 2; also where the bound holds too few rows."""
    base = spark.range(40).selectExpr("'few' as y", "id as _rid", "87L as _need", "40L as _n", "xxhash64(id) as _h")
    need = spark.createDataFrame([("few", 40, 87)], "y string, _n long, _need long")
    for df in (base, base.withColumn("_h", F.lit(2**62) + F.col("_h") % 1000)):
        got = {r["_rid"]: r["_m"] for r in S._drawing_rows(df, need, "y").collect()}
        first = sorted((r["_h"], r["_rid"]) for r in df.collect())[:7]
        assert sum(got.values()) == 87 and {i for i, m in got.items() if m == 3} == {i for _, i in first} and len(got) == 40
    many = spark.range(4000).selectExpr("'few' as y", "id as _rid", "7L as _need", "4000L as _n", "xxhash64(id) as _h")
    need = spark.createDataFrame([("few", 4000, 7)], "y string, _n long, _need long")
    for df in (many, many.withColumn("_h", F.lit(2**62) + F.col("_rid"))):
        first = sorted((r["_h"], r["_rid"]) for r in df.collect())[:7]
        assert {r["_rid"]: r["_m"] for r in S._drawing_rows(df, need, "y").collect()} == {i: 1 for _, i in first}
