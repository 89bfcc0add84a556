"""Store and department profiles, feature scaling and clustering (MLlib)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.numeric import guarded_corr, safe_div
from tillcast.operators.anomaly import classical_decompose


def weekly_totals(df: DataFrame, key: str, value: str = "weekly_sales_cleaned",
                  flags: tuple[str, ...] = ("rolling_anomaly", "stk_anomaly")) -> DataFrame:
    """One row per (key, date): summed sales, summed markdown, summed anomaly flags."""
    flag_sum = sum((F.sum(f) for f in flags), F.lit(0)) if flags else F.lit(0)
    return df.groupBy(key, "date").agg(F.sum(value).alias("sales"),
                                       F.sum("total_markdown").alias("markdown"),
                                       flag_sum.alias("flags"))


def rolling_iqr(df: DataFrame, key: str, value: str = "sales", window: int = 12) -> DataFrame:
    """IQR of the last ``window`` rows (null until the window is full), per key."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(-(window - 1), 0)
    q = F.percentile(value, [0.25, 0.75]).over(w)
    return df.withColumn("rolling_iqr", F.when(F.count(value).over(w) == window, q[1] - q[0]))


def profile(weekly: DataFrame, key: str, period: int = 52) -> DataFrame:
    """Per-key profile of a weekly series: descriptive stats, seasonality and trend
    strength (moving-average parts), volatility, promotion share, markdown
    correlation, anomalies per week, residual-IQR outlier rate.

    The series is one row per key-week, so its windows partition by key with
    at most a few hundred rows per key; the profile is one grouped aggregate.
    """
    dec = classical_decompose(weekly, value="sales", keys=[key], period=period, prefix="d")
    dec = rolling_iqr(dec, key)
    q = dec.groupBy(key).agg(F.percentile("d_resid", [0.25, 0.75]).alias("_rq"))
    dec = dec.join(q, key, "left")
    rq1, rq3 = F.col("_rq")[0], F.col("_rq")[1]
    riqr = rq3 - rq1
    out_flag = ((F.col("d_resid") < rq1 - 1.5 * riqr) | (F.col("d_resid") > rq3 + 1.5 * riqr))
    s, r, t = F.col("sales"), F.col("d_resid"), F.col("d_trend")
    return dec.groupBy(key).agg(
        F.sum(s).alias("total_sales"), F.stddev_samp(s).alias("std_sales"), F.max(s).alias("max_sales"),
        F.min(s).alias("min_sales"), F.median(s).alias("median_sales"), F.avg(s).alias("mean_sales"),
        (F.lit(1.0) - safe_div(F.var_pop(r), F.var_pop(s))).alias("seasonality_strength"),
        (F.lit(1.0) - safe_div(F.var_pop(r), F.var_pop(r + t))).alias("trend_strength"),
        F.avg("rolling_iqr").alias("volatility"),
        F.avg((F.col("markdown") > 0).cast("double")).alias("promo_share"),
        guarded_corr("markdown", "sales").alias("corr_markdown_sales"),
        F.avg("flags").alias("anomalies_per_week"),
        F.avg("markdown").alias("avg_markdown"),
        F.avg(F.coalesce(out_flag, F.lit(False)).cast("double")).alias("iqr_outlier_rate"))


STORE_FEATURES = ["median_sales", "std_sales", "seasonality_strength", "volatility",
                  "corr_markdown_sales", "anomalies_per_week", "sales_per_size"]
DEPT_FEATURES = ["median_sales", "std_sales", "seasonality_strength", "volatility",
                 "corr_markdown_sales", "anomalies_per_week", "avg_markdown"]


def store_features(cleaned: DataFrame, stores: DataFrame) -> DataFrame:
    return store_profile(weekly_totals(cleaned, "store"), stores)


def store_profile(weekly: DataFrame, stores: DataFrame) -> DataFrame:
    """``store_features`` from the stores' weekly totals, for instance a layer of them."""
    prof = profile(weekly, "store")
    prof = prof.join(stores.select("store", "size"), "store", "left")
    return prof.withColumn("sales_per_size", safe_div("mean_sales", "size")) \
               .select("store", *STORE_FEATURES)


def dept_features(cleaned: DataFrame) -> DataFrame:
    prof = profile(weekly_totals(cleaned, "dept", value="weekly_sales", flags=("rolling_anomaly",)),
                   "dept")
    return prof.select("dept", *DEPT_FEATURES)


def log_minmax(df: DataFrame, key: str, cols: list[str], clip_at: float | None = None) -> DataFrame:
    """log1p (optionally after clipping below), then min-max scaling of each column.

    Without clipping, values <= -1 give null (left out of the range); with
    clipping, -inf and null become 0 before scaling. The bounds are 2 scalars per column.
    """
    from tillcast.operators.features import minmax_scale
    logged = []
    for c in cols:
        x = F.col(c)
        if clip_at is not None:
            x = F.greatest(x, F.lit(clip_at))
            logged.append(F.coalesce(F.when(x > -1, F.log1p(x)), F.lit(0.0)).alias(c))
        else:
            logged.append(F.when(x > -1, F.log1p(x)).alias(c))
    out = minmax_scale(df.select(key, *logged), cols, suffix="_scaled")
    return out.select(key, *[f"{c}_scaled" for c in cols])


# ---- clustering (MLlib) -------------------------------------------------------

def assemble(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(
        df.fillna(0.0, subset=cols)).select(key, "features")


STARTS = range(10)  # k-means starts; the one of least cost is kept
MAX_ITER = 300
PARALLEL = 10  # fits or evaluations that run side by side


def side_by_side(vec: DataFrame, work, items) -> list:
    """[work(i) for i in items], PARALLEL at a time.

    A fit is dozens of short jobs, one after the other; on few rows each keeps one core
    busy and waits for the driver most of its time.
    """
    from multiprocessing.pool import ThreadPool
    from pyspark import inheritable_thread_target
    with ThreadPool(PARALLEL) as pool:
        return pool.map(inheritable_thread_target(vec.sparkSession)(work), items, chunksize=1)


def best_kmeans(vec: DataFrame, k: int, seeds=STARTS):
    """The k-means model of least training cost over the starts, each run to tolerance."""
    from pyspark.ml.clustering import KMeans
    fits = side_by_side(vec, lambda s: KMeans(k=k, seed=s, maxIter=MAX_ITER).fit(vec), seeds)
    return min(fits, key=lambda m: m.summary.trainingCost)


def elbow(vec: DataFrame, ks=range(1, 11), seeds=STARTS) -> DataFrame:
    """Within-cluster sum of squares per k: best training cost over a few seeded starts."""
    from pyspark.ml.functions import vector_to_array
    rows = []
    for k in ks:
        if k == 1:
            # one cluster: WCSS = sum over features of n * population variance (closed form)
            arr = vec.select(vector_to_array("features").alias("v"))
            p = len(vec.first()["features"])
            agg = arr.agg(*[(F.count(F.lit(1)) * F.var_pop(F.col("v")[i])).alias(f"w{i}") for i in range(p)]).first()
            rows.append((1, float(sum(agg))))
            continue
        rows.append((int(k), float(best_kmeans(vec, k, seeds).summary.trainingCost)))
    return vec.sparkSession.createDataFrame(rows, "k int, wcss double")


def silhouette_sweep(vec: DataFrame, ks=range(2, 11), seeds=STARTS) -> DataFrame:
    """Silhouette (squared Euclidean, MLlib) of k-means labels for each k."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    models = [best_kmeans(vec, k, seeds) for k in ks]
    scores = side_by_side(vec, lambda m: float(ev.evaluate(m.transform(vec))), models)
    rows = [(int(k), s) for k, s in zip(ks, scores)]
    return vec.sparkSession.createDataFrame(rows, "k int, silhouette double")


def _relabel(pred: DataFrame, key: str) -> DataFrame:
    """Deterministic cluster ids: clusters numbered by their smallest member key."""
    first = pred.groupBy("prediction").agg(F.min(key).alias("_m"))
    first = first.select("prediction", (F.dense_rank().over(Window.orderBy("_m")) - 1).cast("int").alias("cluster"))
    return pred.join(first, "prediction").drop("prediction")


def kmeans_segments(vec: DataFrame, key: str, k: int = 2, seeds=STARTS) -> DataFrame:
    pred = best_kmeans(vec, k, seeds).transform(vec)
    return _relabel(pred, key).select(key, "cluster")


def bisecting_segments(vec: DataFrame, key: str, k: int = 2, seed: int = 0) -> DataFrame:
    """Divisive hierarchical clustering (re-aim of Ward linkage, which is quadratic in memory)."""
    from pyspark.ml.clustering import BisectingKMeans
    pred = BisectingKMeans(k=k, seed=seed).fit(vec).transform(vec)
    return _relabel(pred, key).select(key, "cluster")


def pca(vec: DataFrame, key: str, p: int, keep: float = 0.95) -> DataFrame:
    """Centred PCA: 2-D coordinates per row plus the component count reaching ``keep`` variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    cen = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(vec) \
        .transform(vec)
    model = PCA(k=p, inputCol="centred", outputCol="pcs").fit(cen)
    ev = model.explainedVariance.toArray()
    cum, n95 = 0.0, p
    for i, v in enumerate(ev):
        cum += v
        if cum >= keep:
            n95 = i + 1
            break
    from pyspark.ml.functions import vector_to_array
    out = model.transform(cen).select(key, vector_to_array("pcs").alias("_v"))
    return out.select(key, F.col("_v")[0].alias("pc1"), F.col("_v")[1].alias("pc2"),
                      F.lit(n95).alias("n_components_95"), F.lit(float(ev[0])).alias("explained_pc1"))


def pca_space(vec: DataFrame, key: str, keep: float = 0.95) -> tuple[DataFrame, int]:
    """(key, features) in the fewest principal components that hold ``keep`` of the variance, and their number."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    p = len(vec.first()["features"])
    cen = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(vec).transform(vec)
    model = PCA(k=p, inputCol="centred", outputCol="pcs").fit(cen)
    share = model.explainedVariance.toArray().cumsum()
    k = min(int((share < keep).sum()) + 1, p)
    parts = F.slice(vector_to_array("pcs"), 1, k)
    return model.transform(cen).select(key, array_to_vector(parts).alias("features")), k


def cluster_box(features: DataFrame, labels: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Box-plot numbers of every feature by cluster, long form (cluster, feature, quartiles, whiskers, outliers)."""
    from tillcast.operators.profile import box_stats
    long = features.join(labels.select(key, "cluster"), key).select("cluster", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("f"))
    return box_stats(long.select("cluster", "f.feature", "f.value"), ["cluster", "feature"], "value")


def segment_methods(vec: DataFrame, key: str, k: int = 2, seed: int = 0,
                    dbscan_input: tuple | None = None) -> DataFrame:
    """Silhouette of each clustering method on the same features.

    ``dbscan_input`` = (points DataFrame, feature columns, eps, min_samples) adds Ward
    linkage of those points, and DBSCAN, scored without its noise points and -1 when it
    finds fewer than two clusters.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    labelled = [("kmeans", kmeans_segments(vec, key, k)),
                ("bisecting_kmeans", bisecting_segments(vec, key, k, seed))]
    if dbscan_input is not None:
        from tillcast.operators.dbscan import dbscan
        from tillcast.operators.ward import ward
        pts, cols, eps, min_samples = dbscan_input
        labelled.append(("ward", ward(pts, key, cols, k)))
        labelled.append(("dbscan", dbscan(pts, key, cols, eps, min_samples).where(F.col("cluster") >= 0)))
    rows = []
    for name, lab in labelled:
        lab = lab.join(vec, key)
        n = lab.select("cluster").distinct().count()
        rows.append((name, float(ev.evaluate(lab)) if n > 1 else -1.0, int(n)))
    return vec.sparkSession.createDataFrame(rows, "method string, silhouette double, n_clusters int")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix.

    The p x p correlation matrix (p = a handful of features) comes from one
    MLlib aggregate; only that matrix reaches the driver. Incomplete rows are left
    out; a constant column has no factor (null).
    """
    import numpy as np
    from pyspark.ml.stat import Correlation
    vec = assemble(df.dropna(subset=cols).withColumn("_k", F.lit(0)), "_k", cols)
    m = Correlation.corr(vec, "features").first()[0].toArray()
    np.fill_diagonal(m, np.nan_to_num(np.diag(m)))
    live = [i for i in range(len(cols)) if np.isfinite(np.delete(m[i], i)).any() or len(cols) == 1]
    inv = np.linalg.pinv(m[np.ix_(live, live)])
    factor = {i: float(inv[k, k]) for k, i in enumerate(live)}
    rows = [(c, factor.get(i)) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")
