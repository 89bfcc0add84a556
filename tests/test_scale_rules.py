"""Results that must hold whatever the size: quantiles, components, solvers, itemsets."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def test_group_quantiles_of_many_distinct_values(spark):
    from tillcast.functions.quantiles import exact_group_quantiles, exact_quantiles
    n = 400_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("x"))
    pdf = df.toPandas()
    qs = [0.25, 0.5, 0.75, 0.995]
    got = exact_group_quantiles(df, ["g"], "x", qs).collect()
    assert len(got) == 2  # all that a driver needs to see
    for r in got:
        assert np.allclose([r[f"q{i}"] for i in range(4)], np.quantile(pdf.x[pdf.g == r.g], qs), rtol=1e-14)
    assert np.allclose(exact_quantiles(df, ["x"], qs)["x"], np.quantile(pdf.x, qs), rtol=1e-14)


@pytest.mark.parametrize("n, band", [(400_000, 50), (10_000_000, 100_000)])
def test_quantile_bands_are_narrowed(spark, monkeypatch, n, band):
    from tillcast.functions import quantiles
    monkeypatch.setattr(quantiles, "BAND", band)
    sizes, keep = [], quantiles.written

    def counted(t):
        out = keep(t)
        sizes.append(out.groupBy("c", "_i").count().agg(F.max("count")).first()[0])
        return out
    monkeypatch.setattr(quantiles, "written", counted)
    shift = 12345
    df = spark.range(n).select(((F.col("id") * 7919 + shift) % n).cast("double").alias("x"))  # every value once, in no order
    qs = [0.0, 0.25, 0.5, 0.995, 1.0]
    assert quantiles.exact_quantiles(df, ["x"], qs)["x"] == pytest.approx([(n - 1) * q for q in qs], rel=1e-14)
    assert sizes[-1] <= band + 1  # and the row of all below
    assert n < 1_000_000 or len(sizes) <= 2


def test_narrowed_bands_of_ties_and_groups(spark, monkeypatch):
    from tillcast.functions import quantiles
    monkeypatch.setattr(quantiles, "BAND", 3)
    monkeypatch.setattr(quantiles, "GRID", 10)
    v = np.random.default_rng(8).normal(size=3000).round(2)
    g = np.arange(3000) % 4
    df = spark.createDataFrame([(None if k == 3 else int(k), float(x)) for k, x in zip(g, v)], "g int, x double")
    qs = [0.1, 0.333, 0.5, 0.9]
    for r in quantiles.exact_group_quantiles(df, ["g"], "x", qs).collect():
        own = v[g == (3 if r.g is None else r.g)]
        assert [r[f"q{i}"] for i in range(4)] == pytest.approx(list(np.quantile(own, qs)), rel=1e-12) or r.g is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 37, 999, 1001, 2500])
def test_quantiles_of_every_size(spark, n):
    from tillcast.functions.quantiles import exact_quantiles
    v = np.random.default_rng(n).integers(0, max(n // 2, 2), n).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    assert exact_quantiles(df, ["x"], qs)["x"] == pytest.approx(list(np.quantile(v, qs)), rel=1e-14)


def test_components_of_chain_and_hub(spark):
    from tillcast.operators.components import connected_components
    edges = [(i, i + 1) for i in range(100, 500)] + [(1000, 1001 + i) for i in range(300)] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 401 + 301 + 1 and got[7] == 7
    assert {got[i] for i in range(100, 501)} == {100} and {got[i] for i in range(1000, 1301)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dbscan_long_chain_and_dense_spot(spark):
    from tillcast.operators.dbscan import dbscan
    rows = [(i, i * 0.9, 0.0) for i in range(330)]
    rows += [(1000 + i, 5000.0 + (i % 10) * 1e-3, i * 1e-4) for i in range(200)]  # one fine cell
    rows += [(2000, 5000.9, 0.0), (3000, -500.0, 0.0)]  # a border point, noise
    got = {r.id: r.cluster for r in dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], 1.0, 3).collect()}
    assert {got[i] for i in range(330)} == {0}
    assert {got[i] for i in range(1000, 1200)} == {1} and got[2000] == 1 and got[3000] == -1


def test_correlation_uses_complete_pairs(spark):
    from tillcast.functions.numeric import guarded_corr
    from tillcast.operators.features import correlation_long
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=60), "b": rng.normal(size=60), "c": 1.0})
    pdf.loc[::3, "a"] = np.nan
    pdf.loc[5:9, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in pdf.to_numpy().tolist()], "a double, b double, c double")
    want = pdf.a.corr(pdf.b)
    assert df.agg(guarded_corr("a", "b")).first()[0] == pytest.approx(want)
    got = {(r.col1, r.col2): r["corr"] for r in correlation_long(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "b"] == got["b", "a"] == pytest.approx(want) and got["a", "c"] is None


def _weeks(n):
    return [dt.date(2010, 1, 1) + dt.timedelta(weeks=i) for i in range(n)]


def test_least_squares_at_real_sales_levels(spark):
    from tillcast.functions.dates import is_holiday_week
    from tillcast.operators.solve import arx_walk_forward
    rng = np.random.default_rng(3)
    days = _weeks(160)
    hol = [float(r[0]) for r in spark.createDataFrame([(d,) for d in days], "date date").select(is_holiday_week("date").cast("double")).collect()]
    y = 5e5 + rng.normal(0, 1e4, 160) + 1.5e5 * np.array(hol)
    df = spark.createDataFrame([("store", 1, d, float(v)) for d, v in zip(days, y)], "level string, store int, date date, y double")
    got = arx_walk_forward(df, season=4, log_target=False).orderBy("date").toPandas()
    x = np.column_stack([np.ones(156), y[3:159], y[2:158], y[:156], hol[4:]])
    for row, t in zip(got.itertuples(), range(128, 136)):
        beta = np.linalg.lstsq(x[:t - 4], y[4:t], rcond=None)[0]
        assert row.forecast == pytest.approx(x[t - 4] @ beta, rel=1e-6)
    logged = arx_walk_forward(df, season=4).toPandas()
    assert np.abs(logged.forecast / logged.actual - 1).mean() < 0.2


def test_grid_chooses_on_validation_weeks(spark):
    from tillcast.operators.solve import grid_search_arx
    rng = np.random.default_rng(4)
    y = 1000 + 300 * np.sin(np.arange(150) * 2 * np.pi / 13) + rng.normal(0, 5, 150)
    df = spark.createDataFrame([("store", 1, d, float(v)) for d, v in zip(_weeks(150), y)], "level string, store int, date date, y double")
    got = grid_search_arx(df, seasons=(13, 26)).toPandas()
    best = got[got.chosen]
    assert len(got) == 4 and len(best) == 1 and best.val_rmse.iloc[0] == got.val_rmse.min()
    assert set(best.params.iloc[0]) == {"season", "log_target"}


def test_itemsets_with_commas_and_of_size_four(spark):
    from tillcast.operators.basket import association_rules, frequent_itemsets
    day = dt.date(2020, 1, 3)
    rows = [(s, day, i) for s in range(8) for i in ("a, b", "c", "d", "e")] + [(9, day, "c"), (10, day, "e")]
    items = spark.createDataFrame(rows, "store int, date date, item string")
    sets = frequent_itemsets(items, 0.5, max_len=4)
    assert {tuple(r["items"]): r.cnt for r in sets.collect()}["a, b", "c", "d", "e"] == 8 and sets.count() == 15
    rules = association_rules(sets, None)
    assert rules.where("antecedents = 'a, b' and consequents = 'c'").count() == 1
    assert rules.where("size(a) + size(c) = 4").count() == 14
    with pytest.raises(ValueError):
        frequent_itemsets(items, 0.5, max_len=0)


def test_stl_takes_its_schema_from_the_input(spark):
    from tillcast.operators.stl import stl_decompose
    rows = [(1, 7, d, 100.0 + 10 * np.sin(i * 2 * np.pi / 52) + i * 0.1) for i, d in enumerate(_weeks(120))]
    rows += [(2, 7, d, 5.0) for d in _weeks(60)]
    df = spark.createDataFrame([(a, b, c, float(v)) for a, b, c, v in rows], "store int, dept int, date date, weekly_sales double")
    for robust in (False, True):
        got = stl_decompose(df, robust=robust).toPandas()
        long = got[got.store == 1]
        assert np.allclose(long.stl_trend + long.stl_season + long.stl_resid, long.weekly_sales)
        assert got[got.store == 2].stl_trend.isna().all() and str(got.dept.dtype) == "int32"


def test_vif_leaves_out_incomplete_rows(spark):
    from tillcast.operators.segment import vif
    rng = np.random.default_rng(0)
    a = rng.normal(size=80)
    b = a * 0.8 + rng.normal(size=80) * 0.3
    rows = [(float(x), float(y), 1.0) for x, y in zip(a, b)] + [(None, 50.0, 1.0), (80.0, None, 1.0)]
    got = {r.feature: r.vif for r in vif(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    want = 1 / (1 - np.corrcoef(a, b)[0, 1] ** 2)
    assert got["a"] == pytest.approx(want) and got["b"] == pytest.approx(want) and got["c"] is None


def test_queries_leave_no_cache(spark):
    from tillcast.plans import catalog
    spark.catalog.clearCache()
    for name in ("seasonal_median_fill", "association_rules"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
