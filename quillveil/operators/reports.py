"""Report tables: selection, backfill, budgets, bootstrap intervals, quality checks."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Distinct on the keys, the first row by the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def top_with_backfill(rows: DataFrame, tier: str, tiers: list[str], order: list[Column], per_tier: int, total: int) -> DataFrame:
    """Up to ``per_tier`` of each listed tier, then any other rows, ``total`` in all; adds pick."""
    rank = F.coalesce(*[F.when(F.col(tier) == t, k) for k, t in enumerate(tiers)], F.lit(len(tiers)))
    own = F.row_number().over(Window.partitionBy(tier).orderBy(*order))
    first = rows.withColumn("_own", own).withColumn("_part", F.when((F.col("_own") <= per_tier) & F.col(tier).isin(tiers), rank).otherwise(len(tiers)))
    # only the rows that any part could need meet in one task
    first = first.where((F.col("_part") < len(tiers)) | (F.col("_own") <= total + per_tier))
    return first.withColumn("pick", F.row_number().over(Window.orderBy("_part", *order))).where(F.col("pick") <= total).drop("_own", "_part")


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def against_baseline(rows: DataFrame, key: str, value: str, baseline: str) -> DataFrame:
    """Add the difference to the row named ``baseline``."""
    base = rows.where(F.col(key) == baseline).select(F.col(value).alias("_base"))
    return rows.crossJoin(F.broadcast(base)).withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder of spark.checkpoint.dir; a local session may go without one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def numbered(keys: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Number the distinct keys from 0 in their order, and the number of all (one row, total).

    Keys are range partitioned and numbered within partitions; offsets come from one row a partition.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = keys.select(key).distinct().repartitionByRange(n, key).withColumn("_part", F.spark_partition_id())
    # spark_partition_id belongs to this layout, so both uses read one written result
    parts = written(parts)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    return own.join(F.broadcast(offsets), "_part").select(key, (F.col("_own") + F.col("_before")).alias(name)), counts.agg(F.sum("_n").alias("total"))


def batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """Add the number of the fixed-size batch that each distinct key falls in, keys in order."""
    ranked, _ = numbered(keys, key, "_nth")
    return keys.join(ranked.select(key, F.floor(F.col("_nth") / size).cast("int").alias("batch")), key)


def token_estimate(rows: DataFrame, condition: str, chars: Column, tokens: Column) -> DataFrame:
    """Mean token rate by condition with the global rate where a condition has none; half-even rounding."""
    rate = tokens / F.greatest(chars, F.lit(1))
    own = rows.groupBy(condition).agg(F.avg(rate).alias("own"))
    return rows.join(F.broadcast(own), condition).crossJoin(F.broadcast(rows.agg(F.avg(rate).alias("all")))).withColumn("estimated", F.bround(chars * F.coalesce("own", "all"), 0).cast("long")).drop("own", "all")


def bootstrap_mean(rows: DataFrame, by: str, value: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile intervals of the mean by group: (by, mean, low, high).

    A resample draws n values with replacement, which is a multinomial count for each distinct value;
    so a group ships its distinct values and their numbers, not its rows.
    """
    counted = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    kind = dict(rows.dtypes)[by]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(value)
        n, x = part["n"].to_numpy(np.int64), part[value].to_numpy(float)
        draws = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=resamples) @ x / n.sum()
        low, high = np.quantile(draws, [0.025, 0.975])
        return pd.DataFrame({by: [part[by].iloc[0]], "mean": [float(n @ x / n.sum())], "low": [low], "high": [high]})

    return counted.groupBy(by).applyInPandas(run, f"{by} {kind}, mean double, low double, high double")


def checks(facts: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """One PASS or FAIL row per rule (name, condition, observed column) from a one-row table."""
    rows = [F.struct(F.lit(n).alias("check_id"), F.when(c, "PASS").otherwise("FAIL").alias("status"), F.col(o).cast("string").alias("observed")) for n, c, o in rules]
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
