"""Shared pieces: the cluster's scratch folder, written intermediates, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelplan.sources.scratch import discard, scratch_dir, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; raises on a cluster that sets none."""
    return scratch_dir(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there, and the shuffles behind it go."""
    return staged(df, name)


def replaced(before: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """df written, which `before` and nothing else was needed for: its folder goes."""
    out = written(df, name)
    discard(before)
    return out


def min_component(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b): the smallest node reachable.

    Alternates the large-star and small-star steps until the edge set is stable; each step is a
    grouped minimum and an equi-join, and every round is written out so that lineage stays short.
    Nodes without an edge to another node do not appear."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        edges = replaced(edges, small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first())
        if now == last or now[0] == now[2] and not edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = now


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank", spread: int = 1) -> DataFrame:
    """The first k rows of each key; Spark trims each partition to k before the shuffle.

    spread: for few keys, first the first k of each key in so many shares (by a hash of the order), then those
    of the key; no task then sees more than k rows of every partition over `spread`, or spread times k."""
    if spread > 1:
        share = F.pmod(F.hash(*order, F.lit(17)), F.lit(spread))
        inner = F.row_number().over(Window.partitionBy(*keys, "__share").orderBy(*order))
        df = df.withColumn("__share", share).withColumn(rank, inner).filter(F.col(rank) <= k).drop("__share", rank)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where lambdas in body refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)
