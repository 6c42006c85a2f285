"""Readers and sinks: typed text tables, feature collections, header texts, gridded records, resumable and merged writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.lookup import keep_last, upsert_new


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text with a header and a declared schema; empty cells are null, also in integer columns."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, nullValue="", mode="FAILFAST", enforceSchema=False)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON-like collection as (feature_no, id, title, geometry_type, x, y, properties as JSON text)."""
    feature = "STRUCT<`@id`: STRING, id: STRING, properties: STRING, geometry: STRUCT<type: STRING, coordinates: STRING>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"features ARRAY<{feature}>").alias("c"))
    f = whole.select(F.posexplode("c.features").alias("feature_no", "f"))
    point = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", "ARRAY<DOUBLE>"))
    return f.select(
        "feature_no",
        F.coalesce("f.@id", "f.id").alias("id"),
        F.get_json_object("f.properties", "$.title").alias("title"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.get(point, 0).alias("x"),
        F.get(point, 1).alias("y"),
        F.col("f.properties").alias("properties"),
    )


def read_event_table(spark: SparkSession, path: str, names: list[str], comment_end: str = "*/") -> DataFrame:
    """A table of tab-separated text below a comment header that ends with a line of ``comment_end``; columns take ``names``
    in order, numbers where they can be read as such."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split("value", rf"\Q{comment_end}\E\s*\n"), -1).alias("t"))
    rows = text.select(F.posexplode(F.split("t", "\r?\n")).alias("n", "line")).where("n > 0 AND trim(line) <> ''")
    cells = F.split("line", "\t")
    return rows.select(*(F.nullif(F.trim(F.get(cells, i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def read_header_records(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """Texts whose comment lines hold "Key: value": one row for each file with the columns named in ``keys`` (name -> key).
    Values that aren't numbers stay text; numeric(name) turns a column into a number or null."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_extract("value", r"^#\s*([^:]+?)\s*:\s*(.*?)\s*$", 1).alias("k"), F.regexp_extract("value", r"^#\s*([^:]+?)\s*:\s*(.*?)\s*$", 2).alias("v")).where("k <> ''")
    wanted = lines.where(F.col("k").isin(*keys.values())).groupBy("file").pivot("k", list(keys.values())).agg(F.first(F.nullif(F.col("v"), F.lit(""))))
    return wanted.select("file", *(F.col(f"`{k}`").alias(n) for n, k in keys.items()))


def numeric(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def ensemble_mean(runs: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """keys, values: means over runs by step, as an array in order of step."""
    means = runs.groupBy(*keys, step).agg(F.avg(value).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, "_m"))), lambda x: x["_m"]).alias("values"))


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else None


def insert_ignore(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table lacks. Also what makes a batch resumable: done keys are skipped."""
    upsert_new(_existing(rows.sparkSession, path), rows, keys).write.mode("append").parquet(path)


def merge_last(staged: DataFrame, target: DataFrame | None, keys: list[str], batch: str) -> DataFrame:
    """Staged and existing rows, the last batch's for each key."""
    return keep_last(staged if target is None else target.unionByName(staged, allowMissingColumns=True), keys, batch)


def write_steps(df: DataFrame, path: str, step: str) -> None:
    """One folder for each step, so that a query of one step reads that folder alone. A large step is split over tasks and files."""
    df.hint("rebalance", step).write.mode("overwrite").partitionBy(step).parquet(path)


def read_steps(spark: SparkSession, path: str, step: str, steps: list[int]) -> DataFrame:
    """The rows of some steps of ``write_steps``, from their folders alone."""
    return spark.read.parquet(path).where(F.col(step).isin(*steps))
