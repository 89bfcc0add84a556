"""Boosted-tree forecasters on MLlib (distributed GBT in a Pipeline)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_predict_gbt(train: DataFrame, test: DataFrame, features: list[str], label: str,
                    max_iter: int = 20, max_depth: int = 5, step: float = 0.1, seed: int = 42,
                    log_target: bool = False, save_to: str | None = None, val=None, tol: float = 0.01) -> DataFrame:
    """Fit ``GBTRegressor`` on ``train`` and return ``test`` with a ``forecast`` column.

    ``val`` (a condition) marks train rows that are kept from the fit; rounds then end, before
    ``max_iter``, where the error on them no longer falls by ``tol`` of itself.

    ``log_target`` fits on log1p(max(y, 0)) and maps predictions back with expm1;
    ``save_to`` writes the fitted pipeline.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    y = F.col(label)
    tgt = F.log1p(F.greatest(y, F.lit(0.0))) if log_target else y
    tr = train.withColumn("_target", tgt.cast("double"))
    more = {}
    if val is not None:
        tr = tr.withColumn("_val", val)
        more = {"validationIndicatorCol": "_val", "validationTol": tol}
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        GBTRegressor(featuresCol="features", labelCol="_target", maxIter=max_iter, maxDepth=max_depth,
                     stepSize=step, seed=seed, **more)])
    model = pipe.fit(tr)
    if save_to:
        from tillcast.sources.tables import save_model
        save_model(model, save_to)
    out = model.transform(test)
    pred = F.expm1("prediction") if log_target else F.col("prediction")
    return out.withColumn("forecast", pred).drop("features", "prediction")


def global_gbt(gf: DataFrame, horizon_weeks: int = 20, **kw) -> DataFrame:
    """Global model on the store-dept-week table: train on dates up to max - horizon.

    The last ``horizon_weeks`` before that decide the number of rounds (``max_iter`` at most);
    the target is log1p(max(sales, 0)) unless ``log_target`` is off.
    """
    last = gf.agg(F.max("date")).first()[0]
    import datetime as dt
    cut = last - dt.timedelta(weeks=horizon_weeks)
    feats = ["store_code", "dept_code", "is_holiday", "fuel_price", "cpi", "unemployment", "size",
             "weekofyear", "month", "year"]
    gf = gf.dropna(subset=["cpi", "unemployment", "fuel_price", "size"])
    kw = {"max_iter": 100, "log_target": True, "val": F.col("date") > cut - dt.timedelta(weeks=horizon_weeks)} | kw
    out = fit_predict_gbt(gf.where(F.col("date") <= cut), gf.where(F.col("date") > cut), feats,
                          "weekly_sales", **kw)
    return out.select("store", "dept", "date", F.col("weekly_sales").alias("actual"), "forecast")


def pooled_series_gbt(feat: DataFrame, features: list[str], model: str, train_frac: float = 0.8,
                      horizon: int | None = None, **kw) -> DataFrame:
    """One pooled model for all series (store code is a feature); per-series position split."""
    keys = ["level", "store"]
    w = Window.partitionBy(*keys).orderBy("date")
    f = (feat.withColumn("_pos", F.row_number().over(w))
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
             .withColumn("store_code", F.coalesce(F.col("store"), F.lit(-1)).cast("double"))
             .withColumn("is_chain", (F.col("level") == "chain").cast("double")))
    tsize = F.floor(F.col("_n") * F.lit(train_frac))
    train = f.where(F.col("_pos") <= tsize)
    test = f.where(F.col("_pos") > tsize)
    if horizon is not None:
        test = test.where(F.col("_pos") <= tsize + horizon)
    out = fit_predict_gbt(train, test, ["store_code", "is_chain", *features], "y", **kw)
    return out.select(*keys, F.lit(model).alias("model"), "date", F.col("y").alias("actual"), "forecast")
