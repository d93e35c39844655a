"""SKU master, successor re-key, family and parent-dealer mapping, monthly sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelplan.functions.columns import is_active, net_sales


def sku_master(sku: DataFrame, families: DataFrame) -> DataFrame:
    """The SKU source with model_family, and family codes made of it and what follows the first <>."""
    rest = F.expr("CASE WHEN locate('<>', uniquefamilycode) > 0 THEN substring(uniquefamilycode, locate('<>', uniquefamilycode) + 2) ELSE uniquefamilycode END")
    out = sku.join(families, "model", "left").withColumn("model_family_code", F.concat_ws("<>", "model_family", rest))
    return out.withColumn("sku_unique_family_code", F.concat_ws("<>", "sku", "model_family_code"))


def successors(obd: DataFrame, skus: DataFrame, active_only: bool = True, on_multi: str = "least") -> DataFrame:
    """(sku, current_sku): the smallest (active) successor of each SKU; one row for each, so that sales never multiply.

    on_multi="error": a SKU with several (active) successors stops the job that meets it."""
    out = obd.select(F.col("previous_obd_sku").alias("sku"), F.col("current_obd_sku").alias("current_sku"))
    if active_only:
        out = out.join(skus.filter(is_active()).select(F.col("sku").alias("current_sku")), "current_sku", "left_semi")
    least, most = F.min("current_sku"), F.max("current_sku")
    if on_multi == "error":
        several = F.raise_error(F.concat(F.lit("several successors of "), F.col("sku"))).cast("string")
        return out.groupBy("sku").agg(least.alias("current_sku"), most.alias("__most")).select("sku", F.when(F.col("current_sku") < F.col("__most"), several).otherwise(F.col("current_sku")).alias("current_sku"))
    return out.groupBy("sku").agg(least.alias("current_sku"))


def rekey_sku(df: DataFrame, next_sku: DataFrame) -> DataFrame:
    """sku replaced by its successor, where it has one."""
    return df.join(next_sku, "sku", "left").withColumn("sku", F.coalesce("current_sku", "sku")).drop("current_sku")


def several_successors(obd: DataFrame) -> DataFrame:
    found = obd.groupBy("previous_obd_sku").agg(F.count_distinct("current_obd_sku").alias("successors"))
    return found.filter("successors > 1")


def parent_dealer(hierarchy: DataFrame) -> DataFrame:
    """(dealer_code, parent_dealer_code): one row per dealer, codes without the name behind the first hyphen."""
    return (
        hierarchy.filter("x_dealer_code_hier IS NOT NULL")
        .select(F.col("x_dealer_code_hier").alias("dealer_code"), F.trim(F.split_part("par_org_name", F.lit("-"), F.lit(1))).alias("parent_dealer_code"))
        .distinct()
    )


def with_family(retail: DataFrame, skus: DataFrame, keys: tuple[str, ...] = ("sku",), how: str = "inner") -> DataFrame:
    columns = dict.fromkeys([*keys, "model_family", "model_family_code"])
    return retail.drop(*[c for c in columns if c not in keys]).join(skus.select(*columns), list(keys), how)


def mapped_sales(retail: DataFrame, skus: DataFrame, obd: DataFrame, hierarchy: DataFrame, family_from: str = "current", active_only: bool = True, clip: bool = False) -> DataFrame:
    """Retail rows with net_sales, re-keyed to current SKUs and mapped to family and parent dealer.

    family_from: `current` looks the family up after the re-key, `original` before it. Rows without
    dealer, family or SKU are left out."""
    rows = retail.withColumn("net_sales", net_sales(clip)).select("cal_date", "dealer_code", "sku", "net_sales")
    following = successors(obd, skus, active_only)
    if family_from == "current":
        rows = with_family(rekey_sku(rows, following), skus)
    else:
        rows = rekey_sku(with_family(rows, skus), following)
    rows = rows.join(parent_dealer(hierarchy), "dealer_code")
    return rows.dropna(subset=["parent_dealer_code", "model_family", "sku"])


def series_key() -> Column:
    return F.concat_ws("<>", F.trim("parent_dealer_code"), F.trim("model_family"))


def monthly_sales(mapped: DataFrame, keys: tuple[str, ...] = ("parent_dealer_code", "model_family")) -> DataFrame:
    """Net sales by keys and month; one shuffle, on the keys."""
    return mapped.groupBy(*keys, F.trunc("cal_date", "MM").alias("month_of_sale")).agg(F.sum("net_sales").alias("net_sales"))


def latest_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def latest_snapshot(df: DataFrame, column: str) -> DataFrame:
    """Rows of the newest value of a column."""
    newest = df.agg(F.max(column).alias(column))
    return df.join(F.broadcast(newest), column, "left_semi")


def latest_cycle(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the newest run date and, in it, the newest cycle, as `runs` has them."""
    newest = runs.agg(F.max(F.struct("run_date", "run_cycle_id")).alias("m")).select("m.run_date", "m.run_cycle_id")
    return df.join(F.broadcast(newest), ["run_date", "run_cycle_id"], "left_semi")


def dispatch_extract(df: DataFrame, runs: DataFrame, limit: str = "obl_cr_limit_avail", threshold: float = 100_000) -> DataFrame:
    """The newest cycle with a flag for enough credit; no limit: no funds."""
    from panelplan.functions.columns import flag_at_least

    return latest_cycle(df, runs).withColumn("fund_status", flag_at_least(F.col(limit), threshold))
