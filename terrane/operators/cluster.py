"""Components and clusters of vectors, with the library's distributed learners."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame, unit: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(unit, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def pca(df: DataFrame, unit: str, vector: str, k: int) -> DataFrame:
    """unit, coordinates: the first k principal components of standardised vectors."""
    v = _vectors(df, unit, vector)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(v).transform(v)
    return PCA(k=k, inputCol="scaled", outputCol="pcs").fit(scaled).transform(scaled).select(unit, vector_to_array("pcs").alias("coordinates"))


def kmeans(df: DataFrame, unit: str, vector: str, k: int, seed: int) -> DataFrame:
    """unit, cluster, distance to the cluster's centre."""
    v = _vectors(df, unit, vector)
    model = KMeans(k=k, seed=seed).fit(v)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    centre = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("prediction") + 1)
    out = model.transform(v).withColumn("_x", vector_to_array("features")).withColumn("_c", centre)
    far = F.sqrt(F.aggregate(F.zip_with("_x", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return out.select(unit, F.col("prediction").alias("cluster"), far.alias("distance"))


def k_selection(df: DataFrame, unit: str, vector: str, ks: list[int], seed: int) -> DataFrame:
    """k, inertia, silhouette, calinski (between over within variance, each by its degrees of freedom) for each k: one fit each."""
    v = _vectors(df, unit, vector).cache()
    rows = []
    n = v.count()
    # squares about the mean: sample variances of the components, times n - 1
    total = float(v.select(Summarizer.variance(F.col("features")).alias("s")).first()["s"].toArray().sum()) * (n - 1) if n > 1 else 0.0
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(v)
        inertia = float(model.summary.trainingCost)
        rows.append((k, inertia, float(ClusteringEvaluator().evaluate(model.transform(v))), (total - inertia) / (k - 1) / (inertia / (n - k)) if n > k > 1 and inertia > 0 else None))
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, calinski double")


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information of two labellings over the mean of their entropies (nmi), from their contingency table; 1 if
    neither has more than one label."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    x, y = (cells.groupBy(c).agg(F.sum("n").alias(f"_{k}")) for c, k in ((a, "x"), (b, "y")))
    n = cells.agg(F.sum("n").alias("_t"))
    entropy = lambda d, c, out: d.join(n).agg((-F.sum(F.col(c) / F.col("_t") * F.log(F.col(c) / F.col("_t")))).alias(out))
    shared = cells.join(x, a).join(y, b).join(n).agg(F.sum(F.col("n") / F.col("_t") * F.log(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))).alias("_i"))
    both = shared.join(entropy(x, "_x", "_hx")).join(entropy(y, "_y", "_hy"))
    return both.select(F.coalesce(F.try_divide(F.col("_i"), (F.col("_hx") + F.col("_hy")) / 2), F.lit(1.0)).alias("nmi"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labellings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda d: d.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2))
    x = pairs(cells.groupBy(a).agg(F.sum("n").alias("n"))).toDF("x")
    y = pairs(cells.groupBy(b).agg(F.sum("n").alias("n"))).toDF("y")
    both = pairs(cells).toDF("i").join(x).join(y).join(cells.agg(F.sum("n").alias("t")))
    chance = F.col("x") * F.col("y") / (F.col("t") * (F.col("t") - 1) / 2)
    return both.select(F.try_divide(F.col("i") - chance, (F.col("x") + F.col("y")) / 2 - chance).alias("ari"))
