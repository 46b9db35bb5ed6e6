"""Statistics as column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_by(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, mean) of a value over the rows of each kind; kinds without any value have a null mean."""
    return rows.groupBy(kind).agg(F.avg(value).alias("mean"))


def outcomes(rows: DataFrame, failed: Column) -> DataFrame:
    """(failed, done): how many rows failed, and how many did not (those of which it isn't known among them)."""
    return rows.agg(F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"), F.count_if(~F.coalesce(failed, F.lit(False))).alias("done"))


def mutual_information(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Mutual information, in bits, of the 2x2 table of a term and a set of documents; empty cells add nothing."""
    n = n11 + n10 + n01 + n00

    def part(cell: Column, row: Column, column: Column) -> Column:
        return F.when(cell > 0, cell / n * F.log2(n * cell / (row * column))).otherwise(F.lit(0.0))

    r1, r0, c1, c0 = n11 + n10, n01 + n00, n11 + n01, n10 + n00
    return part(n11, r1, c1) + part(n01, r0, c1) + part(n10, r1, c0) + part(n00, r0, c0)


def chi_square(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Chi-square of the 2x2 table; null where a row or column is empty."""
    n = n11 + n10 + n01 + n00
    below = (n11 + n01) * (n11 + n10) * (n10 + n00) * (n01 + n00)
    return F.when(below != 0, n * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01) / below)


def latency_stats(rows: DataFrame, seconds: str) -> DataFrame:
    """One row: max, min, median, mean, harmonic mean, 95th and 99th percentile (linear), sample standard deviation, count."""
    x = F.col(seconds)
    return rows.agg(
        F.max(x).alias("max"),
        F.min(x).alias("min"),
        F.percentile(x, 0.5).alias("median"),
        F.avg(x).alias("mean"),
        (F.count(x) / F.sum(1 / x)).alias("harmonic_mean"),
        F.percentile(x, 0.95).alias("p95"),
        F.percentile(x, 0.99).alias("p99"),
        F.stddev_samp(x).alias("stdev"),
        F.count(x).alias("n"),
    )


def slowest(rows: DataFrame, seconds: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(seconds), key).limit(n)


def mean_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the element-wise mean of each key's vectors; partial sums by position keep hot keys small."""
    parts = rows.select(key, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))
