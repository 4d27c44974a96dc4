"""Operators on hand-worked rows and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import clusters, frames, groups, poisson, quantiles, reuse, tall_skinny, trend


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "i INT, x INT")
    assert values(frames.keep_rows(df, F.col("x") > 0)) == [(1, 5)]
    assert values(frames.keep_rows(df, F.col("x") > 0, "keep")) == [(1, 5), (None, None)]
    with pytest.raises(ValueError):
        frames.keep_rows(df, F.col("x") > 0, "other")


def test_selectors(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Income1 INT, edu1 INT, income2 INT")
    assert frames.starting_with(df, "income") == ["Income1", "income2"]
    assert frames.columns_first(df, ["income2"]).columns == ["income2", "Income1", "edu1"]
    assert frames.rename_by_position(df, ["edu1"], ["e"]).columns == ["Income1", "e", "income2"]
    assert frames.shape(df) == (1, 3)


def test_stacking(spark):
    a = spark.createDataFrame([(1, "a")], "x INT, y STRING")
    b = spark.createDataFrame([(2.5, 2)], "z DOUBLE, x INT")
    assert values(frames.stack(a, b)) == [(1, "a", None), (2, None, 2.5)]
    assert values(frames.stack_tagged({"m": a, "n": a}, "t")) == [(1, "a", "m"), (1, "a", "n")]


def test_with_row_needs_no_join(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x DOUBLE")
    out = frames.with_row(df, df.agg(F.avg("x").alias("m"), F.max("x").alias("top")))
    assert values(out) == [(1.0, 2.0, 3.0), (3.0, 2.0, 3.0)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_in_box(spark):
    box = (-93.9, 41.4, -93.4, 41.8)
    rows = [("a", -94.0, 41.5, -93.8, 41.6), ("b", -93.3, 41.5, -93.2, 41.6), ("c", -93.4, 41.8, -93.0, 42.0)]
    df = spark.createDataFrame(rows, "zip STRING, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE")
    assert [r[0] for r in values(frames.in_box(df, box))] == ["a", "c"]


def test_join_nulls(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "zip STRING, a INT")
    b = spark.createDataFrame([(None, 3), ("k", 4), ("z", 5)], "zip STRING, b INT")
    assert values(groups.left_join(a, b, "zip")) == [("k", 2, 4), (None, 1, None)]
    assert values(groups.left_join(a, b, "zip", na_matches=True)) == [("k", 2, 4), (None, 1, 3)]
    assert values(groups.full_join(a, b, "zip")) == [("k", 2, 4), ("z", None, 5), (None, 1, None), (None, None, 3)]
    assert values(groups.full_join(a, b, "zip", na_matches=True)) == [("k", 2, 4), ("z", None, 5), (None, 1, 3)]
    assert values(groups.rows_with_key_in(a, b, "zip")) == [("k", 2)]
    c = b.withColumnRenamed("zip", "code")
    assert values(groups.left_join(a, c, {"zip": "code"})) == [("k", 2, 4), (None, 1, None)]


def test_flag_group_min(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 4), (None, 5)], "k STRING, d INT")
    assert values(groups.flag_group_min(df, ["k"], "d", "f")) == [
        ("a", 1, 1), ("a", 2, 0), ("b", None, None), (None, 4, 1), (None, 5, 0)]


def test_first_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 2)
    out = groups.first_per_group(df, ["k"], F.col("id").desc())
    assert values(out) == [(998, 0), (999, 1)]
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_complete_groups(spark):
    rows = [(2021, m) for m in range(1, 13)] * 2 + [(2022, m) for m in range(1, 12)]
    df = spark.createDataFrame(rows, "y INT, m INT")
    assert values(groups.complete_groups(df, F.col("y"), F.col("m"), 12, "year")) == [(2021,)]


def test_wide_counts(spark):
    df = spark.createDataFrame([("m1", 10), ("m1", 2), ("m2", 7)], "m STRING, k INT")
    assert values(groups.wide_counts(df, "m", "k", [10, 2, 7], "edu")) == [("m1", 1, 1, None), ("m2", None, None, 1)]


def test_cut_at_threshold(spark):
    rows = [("a", y, float(y)) for y in range(1, 6)] + [("b", y, 0.0) for y in range(1, 4)]
    df = spark.createDataFrame(rows, "s STRING, y INT, v DOUBLE")
    out = groups.cut_at_threshold(df, ["s"], "y", "v", 2.5)
    assert [(r[0], r[1]) for r in values(out)] == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]


def test_quantile_fixture(spark):
    df = spark.createDataFrame([("z", v) for v in (100.0, 200.0, 300.0, 400.0, None)] + [("n", None)], "k STRING, v DOUBLE")
    assert values(quantiles.group_quantiles(df, ["k"], "v", {"p": 0.95})) == [("n", None), ("z", pytest.approx(385.0))]


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_against_numpy(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b", None, "c"):
        size = rng.choice([1, 2, 7, 400])
        spread = rng.choice([3, 1000, 10**6])
        rows += [(key, None if rng.random() < 0.1 else float(rng.randrange(spread))) for _ in range(size)]
    rows += [("hot", 7.0)] * 300 + [("hot", float(rng.randrange(20))) for _ in range(100)]
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)
    # Few bins: the marks are poor, the answer must not be.
    got = {r["k"]: r for r in quantiles.group_quantiles(df, ["k"], "v", probs, bins=4).collect()}
    for key in {k for k, _ in rows}:
        known = [v for k, v in rows if k == key and v is not None]
        for name, p in probs.items():
            if known:
                assert got[key][name] == pytest.approx(float(np.quantile(known, p)), abs=1e-9)
            else:
                assert got[key][name] is None
    total = [v for _, v in rows if v is not None]
    one = quantiles.value_summary(df, "v").first()
    assert one["q1"] == pytest.approx(np.quantile(total, 0.25)) and one["q3"] == pytest.approx(np.quantile(total, 0.75))
    assert one["n_null"] == sum(v is None for _, v in rows) and one["mean"] == pytest.approx(np.mean(total))


def test_approximate_quantile_stays_in_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    got = quantiles.approx_group_quantiles(df, ["k"], "v", {"p": 0.95}).first()["p"]
    assert abs(got - 949) <= 2


def test_nearest(spark):
    df = spark.createDataFrame([(0.9, 0.2, 0.6), (0.5, 0.5, 0.5), (None, 0.0, 0.0)], "a DOUBLE, b DOUBLE, c DOUBLE")
    label = clusters.nearest(["a", "b", "c"], {1: [0, 0, 0], 2: [1, 1, 1]})
    assert [r[0] for r in df.select(label).collect()] == [2, 1, None]


def test_z_scores(spark):
    params = spark.createDataFrame([(2.0, 0.5)], "center_f DOUBLE, scale_f DOUBLE")
    df = spark.createDataFrame([(3.0,)], "x DOUBLE")
    assert clusters.z_scores(df, params, {"x": "f"}).first()["sc_x"] == 2.0


POINTS = [("p", 0.0, 0.0, 1), ("q", 0.0, 2.0, 1), ("r", 4.0, 0.0, 2), ("s", 4.0, 3.0, 2)]


def test_silhouette_fixture(spark):
    df = spark.createDataFrame(POINTS, "id STRING, x DOUBLE, y DOUBLE, c INT")
    sq = {r["id"]: r["silhouette"] for r in clusters.silhouette_squared(df, ["x", "y"], "c", [1, 2]).collect()}
    assert [round(sq[i], 6) for i in "pqrs"] == [0.804878, 0.783784, 0.5, 0.571429]


def _brute_silhouette(points):
    out = {}
    for i, xi, ci in points:
        means = {}
        for c in {p[2] for p in points}:
            others = [xj for j, xj, cj in points if cj == c and j != i]
            if others:
                means[c] = float(np.mean([float(np.sum((xi - xj) ** 2)) for xj in others]))
        a = means.pop(ci, None)
        b = min(means.values())
        out[i] = 0.0 if a is None else (b - a) / max(a, b)
    return out


def test_silhouettes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    points = [(str(i), rng.normal(size=3), int(rng.integers(1, 4))) for i in range(60)] + [("lone", np.ones(3), 4)]
    df = spark.createDataFrame([(i, *map(float, x), c) for i, x, c in points], "id STRING, x DOUBLE, y DOUBLE, z DOUBLE, c INT")
    expected = _brute_silhouette(points)
    for r in clusters.silhouette_squared(df, ["x", "y", "z"], "c", [1, 2, 3, 4]).collect():
        assert r["silhouette"] == pytest.approx(expected[r["id"]], abs=1e-9)
        assert -1 <= r["silhouette"] <= 1


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    centers = {1: (0.0, 0.0), 2: (10.0, 0.0), 3: (0.0, 100.0), 4: (10.0, 100.0)}
    rows = [(float(a + rng.normal(0, 0.3)), float(b + rng.normal(0, 3)), c) for c, (a, b) in centers.items() for _ in range(40)]
    rows += [(None, 1.0, 0)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c INT")
    model = clusters.fit_kmeans(df, ["a", "b"], seeds=range(6), order_by=["b", "a"])
    assert model.cost <= min(model.seed_costs.values()) + 1e-9
    data = np.array([(a, b) for a, b, _ in rows if a is not None])
    assert [model.centers["a"], model.centers["b"]] == pytest.approx(data.mean(axis=0))
    assert [model.scales["a"], model.scales["b"]] == pytest.approx(data.std(axis=0, ddof=1))
    labelled = df.withColumn("label", model.label()).collect()
    assert all(r["label"] == r["c"] for r in labelled if r["a"] is not None)
    assert [r["label"] for r in labelled if r["a"] is None] == [None]
    z = (data - data.mean(axis=0)) / data.std(axis=0, ddof=1)
    cost = sum(min(float(np.sum((p - np.array(c)) ** 2)) for c in model.centroids.values()) for p in z)
    assert model.cost == pytest.approx(cost, rel=1e-6)


def _lloyd(x, w, centroids, rounds=200):
    for _ in range(rounds):
        own = ((x[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
        centroids = np.array([np.average(x[own == c], axis=0, weights=w[own == c]) if (own == c).any() else centroids[c]
                              for c in range(len(centroids))])
    return centroids, float((w * ((x[:, None] - centroids) ** 2).sum(axis=2).min(axis=1)).sum())


def _transfer_gains(x, w, centroids):
    """What the cost falls by when one point moves to another cluster, by recomputing both centroids."""
    own = ((x[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
    cost = lambda at: float((w[at] * ((x[at] - np.average(x[at], axis=0, weights=w[at])) ** 2).sum(axis=1)).sum())
    for i in range(len(x)):
        a = np.flatnonzero(own == own[i])
        if len(a) > 1:
            for c in set(own) - {own[i]}:
                b = np.flatnonzero(own == c)
                yield cost(a) + cost(b) - cost(a[a != i]) - cost(np.append(b, i))


def test_transfers_end_below_plain_iterations_and_at_an_optimum(spark):
    rng = np.random.default_rng(8)
    better = 0
    for trial in range(3):
        x, w = rng.normal(size=(24, 2)).round(2), rng.integers(1, 4, 24).astype(float)
        df = spark.createDataFrame([(float(a), float(b), float(n)) for (a, b), n in zip(x, w)], "a DOUBLE, b DOUBLE, weight DOUBLE").repartition(3)
        starts = clusters.first_by_hash(df, ["a", "b"], 4, range(trial, trial + 4))
        centroids, costs = clusters.descended(df, starts, float((w * (x**2).sum(axis=1)).sum()), 60)
        for start, found, cost in zip(starts, centroids, costs):
            plain = _lloyd(x, w, start)[1]
            better += cost < plain - 1e-9
            assert cost <= plain + 1e-9
            assert cost == pytest.approx(float((w * ((x[:, None] - found) ** 2).sum(axis=2).min(axis=1)).sum()), abs=1e-9)
            assert max(_transfer_gains(x, w, found)) < 1e-9
    assert better


def test_plain_iterations_and_starts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2))
    rows = [(float(a), float(b), 1.0) for a, b in x]
    frames = [spark.createDataFrame(r, "a DOUBLE, b DOUBLE, weight DOUBLE").repartition(n) for r, n in ((rows, 2), (rows[::-1], 9))]
    starts = [clusters.first_by_hash(df, ["a", "b"], 3, [1, 2]) for df in frames]
    assert (starts[0] == starts[1]).all() and (starts[0][0] != starts[0][1]).any()
    got, _ = clusters.descended(frames[1], starts[0], float((x**2).sum()), 4, transfers=False)
    for start, found in zip(starts[0], got):
        assert found == pytest.approx(_lloyd(x, np.ones(50), start, 4)[0])
    with pytest.raises(ValueError):
        clusters.first_by_hash(frames[0], ["a", "b"], 51, [1])


def test_weighted_points_merge_equal_rows(spark):
    df = spark.createDataFrame([(1, 2)] * 5 + [(1, None), (3, 4)], "a INT, b INT")
    assert values(clusters.weighted_points(df, ["a", "b"])) == [(1.0, 2.0, 5.0), (3.0, 4.0, 1.0)]


def test_poisson_fixture(spark):
    df = spark.createDataFrame([(0.0, 2), (0.0, 4), (1.0, 10), (1.0, 14)], "x DOUBLE, y INT")
    model = poisson.fit_poisson(df, "y", ["x"])
    assert model.intercept == pytest.approx(math.log(3), abs=1e-6)
    assert model.coefficients["x"] == pytest.approx(math.log(4), abs=1e-6)
    assert [round(r["m"], 6) for r in df.select(model.response().alias("m")).collect()] == [3, 3, 12, 12]


def _irls(x, y):
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(y.mean())
    for _ in range(100):
        mu = np.exp(x @ beta)
        beta = beta + np.linalg.solve(x.T @ (mu[:, None] * x), x.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ (np.exp(x @ beta)[:, None] * x))))


def test_poisson_against_newton_and_aliases(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 20, 200), rng.normal(size=200)
    y = rng.poisson(np.exp(0.3 + 0.08 * a - 0.5 * b))
    rows = [(int(i), float(j), int(i) * 2 + 1, 0.0, int(k)) for i, j, k in zip(a, b, y)] + [(None, 1.0, 1, 0.0, 1)]
    df = spark.createDataFrame(rows, "a INT, b DOUBLE, twice INT, zero DOUBLE, y INT").repartition(4)
    model = poisson.fit_poisson(df, "y", ["a", "b", "twice", "zero"])
    assert model.aliased == ("twice", "zero")
    beta, errors = _irls(np.column_stack([np.ones(200), a, b]), y)
    assert [model.intercept, model.coefficients["a"], model.coefficients["b"]] == pytest.approx(list(beta), abs=1e-6)
    assert [model.std_errors[t] for t in ("(Intercept)", "a", "b")] == pytest.approx(list(errors), rel=1e-4)
    fitted = df.dropna().agg(F.sum(F.col("y") - model.response())).first()[0]
    assert abs(fitted) < 1e-4
    table = {r["term"]: r for r in model.table(spark).collect()}
    assert table["twice"]["aliased"] and table["twice"]["estimate"] is None and len(table) == 5


def _qr_irls(x, y):
    """Reweighted least squares by numpy's QR on the whole matrix: coefficients, errors, deviance, AIC."""
    eta = np.log(y + 0.1)
    for _ in range(60):
        mu = np.exp(eta)
        q, r = np.linalg.qr(x * np.sqrt(mu)[:, None])
        beta = np.linalg.solve(r, q.T @ ((eta + (y - mu) / mu) * np.sqrt(mu)))
        eta = x @ beta
    mu = np.exp(eta)
    inverse = np.linalg.inv(np.linalg.qr(x * np.sqrt(mu)[:, None], mode="r"))
    logs = np.array([v * math.log(v) if v else 0.0 for v in y])
    likelihood = sum(v * e - m - math.lgamma(v + 1) for v, e, m in zip(y, eta, mu))
    return beta, np.sqrt((inverse**2).sum(axis=1)), 2 * (logs - y * eta - (y - mu)).sum(), -2 * likelihood + 2 * x.shape[1]


@pytest.mark.parametrize("noise", [1.0, 1e-3, 1e-6])
def test_poisson_with_nearly_collinear_features(spark, noise):
    rng = np.random.default_rng(11)
    a, b, e = rng.normal(size=(3, 600))
    near = a + noise * e
    y = rng.poisson(np.exp(1.0 + 0.4 * a + 0.3 * b)).astype(float)
    rows = [tuple(map(float, r)) for r in np.column_stack([y, a, b, near, a - b])]
    df = spark.createDataFrame(rows, "y DOUBLE, a DOUBLE, b DOUBLE, near DOUBLE, sum DOUBLE").repartition(7)
    model = poisson.fit_poisson(df, "y", ["a", "b", "near", "sum"])
    assert model.aliased == ("sum",) and model.converged
    beta, errors, deviance, aic = _qr_irls(np.column_stack([np.ones(600), a, b, near]), y)
    found = [model.intercept, *(model.coefficients[t] for t in ("a", "b", "near"))]
    # Differences are counted in standard errors, as the coefficients themselves grow with the collinearity.
    assert np.abs((np.array(found) - beta) / errors).max() < 1e-5
    assert [model.std_errors[t] for t in ("(Intercept)", "a", "b", "near")] == pytest.approx(list(errors), rel=1e-6)
    assert (model.deviance, model.aic) == pytest.approx((deviance, aic), rel=1e-9)
    table = {r["term"]: r for r in model.table(spark).collect()}
    for term in ("(Intercept)", "a", "b", "near"):
        r = table[term]
        assert r["z_value"] == pytest.approx(r["estimate"] / r["std_error"]) and r["aic"] is not None
        assert r["p_value"] == pytest.approx(math.erfc(abs(r["z_value"]) / math.sqrt(2)), abs=1e-12)
    assert table["sum"]["aliased"] and table["sum"]["std_error"] is None


def test_poisson_does_not_depend_on_the_partitioning(spark):
    rows = [(float(i % 7), float(i * i % 11), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "x DOUBLE, w DOUBLE, y DOUBLE")
    one, many = (poisson.fit_poisson(df.repartition(n), "y", ["x", "w"]) for n in (1, 40))
    assert one.std_errors == pytest.approx(many.std_errors, rel=1e-9) and one.aic == pytest.approx(many.aic, rel=1e-12)


def test_poisson_rejects_frames_without_counts(spark):
    for rows in ([], [(None, 1.0)], [(1.0, 0.0), (2.0, 0.0)], [(1.0, -3.0), (2.0, 1.0)]):
        with pytest.raises(ValueError):
            poisson.fit_poisson(spark.createDataFrame(rows, "x DOUBLE, y DOUBLE"), "y", ["x"])


def test_triangle_equals_qr_and_log_gamma(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE").repartition(40)
    triangle, totals = tall_skinny.triangle_of(df, lambda b: (b, b.sum(axis=0)))
    assert np.abs(triangle) == pytest.approx(np.abs(np.linalg.qr(x, mode="r")), rel=1e-9) and totals == pytest.approx(x.sum(axis=0))
    values = np.array([0.5, 1.0, 2.0, 3.5, 40.0, 1e6])
    assert poisson.log_gamma(values) == pytest.approx([math.lgamma(v) for v in values], rel=1e-12, abs=1e-11)


def test_gram_matrix(spark):
    df = spark.createDataFrame([(1, 2), (3, 4), (None, 9)], "a INT, b INT").repartition(3)
    assert poisson.gram_matrix(df, ["a", "b"]).tolist() == [[2, 4, 6], [4, 10, 14], [6, 14, 20]]


@pytest.mark.parametrize("degree", [1, 2, 4])
def test_polynomials_against_numpy(spark, degree):
    rng = np.random.default_rng(degree)
    rows, expected = [], {}
    for name, n in (("a", 12), ("b", 40), ("c", 7)):
        x = 1990.0 + np.arange(n) + (rng.integers(0, 3, n) if name == "b" else 0)
        y = rng.normal(size=n) * 50 + 3 * (x - 2000) + 0.2 * (x - 2000) ** 2
        rows += [(name, float(a), float(b)) for a, b in zip(x, y)] + [(name, None, 1.0), (name, 1.0, None)]
        t = (x - x.mean()) / 10
        q, r = np.linalg.qr(np.vander(t, degree + 1, increasing=True))
        q = q * np.sign(np.diag(r))
        fitted = q @ (q.T @ y)
        expected[name] = (x, fitted, q.T @ y, math.sqrt(((y - fitted) ** 2).sum() / (n - degree - 1)),
                          1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    rows += [("few", 2000.0, 1.0), ("few", 2000.0, 2.0)]
    df = spark.createDataFrame(rows, "s STRING, x DOUBLE, y DOUBLE").repartition(5)
    fit = trend.polynomial_fit(df, ["s"], "x", "y", degree)
    for r in fit.collect():
        if r["s"] == "few":
            assert r["coefficients"] is None and r["n"] == 2
            continue
        _, _, coefficients, sigma, r_squared = expected[r["s"]]
        assert r["coefficients"] == pytest.approx(list(coefficients), rel=1e-7, abs=1e-6)
        assert (r["sigma"], r["r_squared"]) == pytest.approx((sigma, r_squared), rel=1e-7)
    found = {(r["s"], r["year"]): r["predicted"] for r in trend.polynomial_forecast(fit, 1990, 2001, degree).collect()}
    x, fitted, *_ = expected["a"]
    assert [found["a", int(v)] for v in x] == pytest.approx(list(fitted), rel=1e-8)
    assert found["few", 1990] is None


def test_quadratic_goldens(spark):
    users = [17730, 19032, 18318, 15509, 16983, 17225]
    df = spark.createDataFrame([("s", 2018 + i, u) for i, u in enumerate(users)] + [("short", 2018, 1), ("short", 2019, 2)],
                               "s STRING, year INT, users INT")
    fit = trend.quadratic_fit(df, ["s"], "year", "users", 2018)
    r = {x["s"]: x for x in fit.collect()}
    assert r["short"]["b0"] is None and r["short"]["n"] == 2
    assert [r["s"][c] for c in ("b0", "b1", "b2", "r_squared")] == pytest.approx([18491.7143, -636.2429, 61.6429, 0.274781], abs=1e-4)
    forecast = {x["year"]: x["predicted"] for x in trend.quadratic_forecast(fit, 2018, 2028, 2018).filter("s = 's'").collect()}
    assert len(forecast) == 11
    for year, value in {2018: 18491.7143, 2023: 16851.5714, 2024: 16893.4, 2028: 18293.5714}.items():
        assert forecast[year] == pytest.approx(value, abs=1e-3)


def test_loess(spark):
    rows = [("q", float(x), float(x * x - 3 * x + 2)) for x in range(30)] + [("few", float(x), float(x)) for x in range(3)]
    out = trend.loess(spark.createDataFrame(rows, "s STRING, x DOUBLE, y DOUBLE"), ["s"], "x", "y").collect()
    quad = {r["x"]: r["smoothed"] for r in out if r["s"] == "q"}
    assert all(v == pytest.approx(x * x - 3 * x + 2, abs=1e-6) for x, v in quad.items()) and len(quad) == 30
    assert sum(r["s"] == "few" for r in out) == 3
    users = [17730, 19032, 18318, 15509, 16983, 17225]
    df = spark.createDataFrame([("u", 2018 + i, u) for i, u in enumerate(users)], "s STRING, x INT, y INT")
    grid = trend.loess(df, ["s"], "x", "y", grid=80).collect()
    assert len(grid) == 80 and all(10000 < r["smoothed"] < 25000 for r in grid)


def test_held_uses_the_named_folder(spark):
    folder = reuse.checkpoint_dir(spark)
    df = spark.range(5)
    with reuse.held(df) as kept:
        assert kept.count() == 5
        plan = kept._jdf.queryExecution().analyzed().toString()
        assert ("LogicalRDD" in plan) == bool(folder)


def test_lookup_with_hot_and_cold_keys(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT_KEYS", 2)
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(300)] + [(f"k{i % 50}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k STRING, i INT")
    table = df.groupBy("k").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n"))
    out = groups.lookup(df, table, ["k"], "n")
    low = {}
    for k, i in rows:
        low[k] = min(i, low.get(k, i))
    assert values(out) == sorted(((k, i, low[k]) for k, i in rows), key=repr)


def test_lookup_partitions_by_key_and_salt(spark):
    df = spark.createDataFrame([("a", 1)], "k STRING, i INT")
    table = df.groupBy("k").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = groups.lookup(df, table, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("__salt" in line for line in exchanges)


def test_lookup_spreads_a_hot_key(spark):
    """A third of all rows share one key; without adaptive help no task may hold them together."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    table = df.groupBy("k").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in groups.lookup(df, table, ["k"], "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 30000 and max(sizes) < 30000 / 8 * 1.3


def test_top_rows_and_inline_table(spark):
    df = frames.inline_table(spark, [(i, -i) for i in range(20)], "a INT, b INT")
    assert [r["a"] for r in frames.top_rows(df, F.col("b").asc()).collect()] == [19, 18, 17, 16, 15, 14]
    assert len(frames.top_rows(df, F.col("a"), n=3).collect()) == 3


def test_scale_and_numbers(spark):
    df = spark.createDataFrame([("1.5", "x", 4.0)], "a STRING, b STRING, `c d` DOUBLE")
    assert values(frames.to_numbers(df, ["a", "b"])) == [(1.5, None, 4.0)]
    assert values(frames.scale_columns(df, ["c d"], F.lit(0.5))) == [("1.5", "x", 2.0)]


def test_approximate_distinct_counts_null(spark):
    from footfall.functions.nulls import approx_n_distinct
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x STRING")
    assert df.agg(approx_n_distinct("x")).first()[0] == 3


def test_quantiles_with_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (-inf, 1.0, 2.0, 3.0, inf)], "v DOUBLE")
    row = quantiles.group_quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert tuple(row) == (1.0, 2.0, 3.0)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v DOUBLE")
    row = quantiles.value_summary(df, "v").first()
    assert row["median"] is None and row["n_null"] == 2


def test_fits_without_a_checkpoint_folder(spark, monkeypatch):
    monkeypatch.setattr(reuse, "checkpoint_dir", lambda _: None)
    df = spark.createDataFrame([(0.0, 2), (0.0, 4), (1.0, 10), (1.0, 14)], "x DOUBLE, y INT")
    assert reuse.written_once(df) is df
    with reuse.held(df) as kept:
        assert kept.is_cached
    assert not df.is_cached
    assert poisson.fit_poisson(df, "y", ["x"]).coefficients["x"] == pytest.approx(math.log(4), abs=1e-6)
    model = clusters.fit_kmeans(df, ["x", "y"], k=2, seeds=range(3))
    assert [r[0] for r in df.orderBy("x", "y").select(model.label()).collect()] == [1, 1, 2, 2]
