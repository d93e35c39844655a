"""Scans and sinks: catalog tables, SQL with parameters, CSV, Parquet, run-tagged and partitioned outputs."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelplan.operators.ranking import with_running
from panelplan.spec import RunTags


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_sql(spark: SparkSession, sql: str, args: dict) -> DataFrame:
    """SQL with named parameters (:name), never text pasted together."""
    return spark.sql(sql, args=args)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """Many part files as one table."""
    return spark.read.parquet(pattern)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Save as a catalog table; with a path, its files lie there instead of in the warehouse."""
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def append_run(df: DataFrame, path: str, tags: RunTags) -> None:
    """Publish a run: tagged, and written over the same run's earlier rows and no others."""
    tagged = df.withColumns({k: F.lit(v) for k, v in asdict(tags).items()})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_version").parquet(path)


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_panel(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value of `by` (a dealer, not a series: there may be too many of those)."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_series_table(df: DataFrame, name: str, series: str, buckets: int, path: str | None = None) -> None:
    """A table bucketed by series, which later joins and groupings on the series need not shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, series).sortBy(series)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def split_parts(df: DataFrame, key: str, per_file: int) -> DataFrame:
    """Add `part`: per_file keys to a part, in the order of the key. Only the distinct keys are ranked; rows without a key are left out."""
    keys = with_running(df.select(key).filter(F.col(key).isNotNull()).distinct(), [F.col(key)], "__place")
    return df.join(keys.select(key, F.floor((F.col("__place") - 1) / per_file).cast("int").alias("part")), key)


def write_split(df: DataFrame, path: str, key: str, per_file: int) -> None:
    split_parts(df, key, per_file).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def write_report(frames: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Several named outputs, a folder for each."""
    for name, df in frames.items():
        export(df, f"{folder}/{name}", fmt)


def write_audit(checks: DataFrame, path: str) -> None:
    checks.write.mode("append").parquet(path)


def write_audited(df: DataFrame, path: str, keys: list[str], source: str, audit_path: str) -> dict[str, int]:
    """Write df, and append its rows, columns and duplicate keys to an audit table; the counts come from the write's own job.

    Each key's second row is marked by a window over the keys and counted, with all rows, as they pass by on their way
    to the files; nothing is read again."""
    seen = Observation()
    second = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.lit(0)])) == 2
    counted = df.withColumn("__second", second).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("__second").alias("duplicate_keys"))
    counted.drop("__second").write.mode("overwrite").parquet(path)
    found = {"rows": seen.get["rows"], "columns": len(df.columns), "duplicate_keys": seen.get["duplicate_keys"]}
    write_audit(from_rows(df.sparkSession, [(source, k, v) for k, v in found.items()], "source string, check_name string, value bigint"), audit_path)
    return found


def use_buckets(spark: SparkSession) -> None:
    """Let this session join bucketed tables on their series and more columns without dealing them out again.

    Without it Spark asks that tables be bucketed by all columns of a join."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def unfinished(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def run_stage(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write the rows whose keys the path lacks, one folder per key; a rerun goes on where it stopped."""
    spark = df.sparkSession
    try:
        todo = unfinished(df, spark.read.parquet(path), keys)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        todo = df
    todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
