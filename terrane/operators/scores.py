"""Percentile scores kept in a table and refreshed where the values have changed.

Ranks of all units change with any one value of a variable, so a variable is the unit of refreshing: a fingerprint over its values
tells whether the stored scores still hold. Changed variables are ranked in one plan and written under their fingerprint; a
manifest row makes them valid only once the whole write has succeeded, so a lost run leaves nothing that is read. Readers take
the versions of the fingerprints that they ask for, and read the folders of those variables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.position import neutral_long, percent_rank

SCORES, MANIFEST = "scores", "manifest"


def fingerprints(long: DataFrame, key: str) -> DataFrame:
    """(variable, version) over (key, variable, raw): a count and sums of two hashes of key and value, whatever the order of rows."""
    mark = lambda seed: F.sum(F.xxhash64(key, "raw", F.lit(seed)).cast("decimal(38,0)"))
    return long.groupBy("variable").agg(F.sha2(F.concat_ws("|", F.count("*"), F.count("raw"), mark(1), mark(2)), 256).alias("version"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def refreshed(units: DataFrame, key: str, variables: list[str], path: str) -> tuple[DataFrame, list[str]]:
    """(key, variable, raw, score) of all ``variables`` by percent_rank, and the names of those that had to be ranked anew.

    ``variables`` is a catalog: one fingerprint of each comes to the driver. ``path`` is a folder that the cluster shares.
    """
    spark, kind = units.sparkSession, dict(units.dtypes)[key]
    long = neutral_long(units, key, variables)
    now = {r.variable: r.version for r in fingerprints(long, key).collect()}
    valid = {(r.variable, r.version) for r in _stored(spark, f"{path}/{MANIFEST}", "variable string, version string").collect()}
    stale = sorted(v for v in now if (v, now[v]) not in valid)
    if stale:
        versions = F.create_map(*(F.lit(x) for v in stale for x in (v, now[v])))
        scored = percent_rank(neutral_long(units, key, stale), "raw", ["variable"]).withColumn("version", versions[F.col("variable")])
        # a version that an earlier, lost run has begun is replaced
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variable", "version").parquet(f"{path}/{SCORES}")
        spark.createDataFrame([(v, now[v]) for v in stale], "variable string, version string").coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    wanted = None
    for v in now:
        one = (F.col("variable") == v) & (F.col("version") == now[v])
        wanted = one if wanted is None else wanted | one
    scores = _stored(spark, f"{path}/{SCORES}", f"{key} {kind}, raw double, score double, variable string, version string")
    return scores.where(F.lit(False) if wanted is None else wanted).select(key, "variable", "raw", "score"), stale
