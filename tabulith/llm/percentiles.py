"""Percentiles of very large numeric columns (problem 4).

Method: values are counted in signed logarithmic buckets of fixed relative width; counts of
equal buckets of other partitions or days are added; percentiles are read from the counts
with a guaranteed relative error of the value.

Bucket i > 0 holds the values v with gamma ** (i - 1) < v <= gamma ** i, where
gamma = (1 + error) / (1 - error); bucket numbers are moved by OFFSET so that they stay
positive for every double, negative values have the negative number of their absolute
value, zero has bucket 0. The value given for a bucket, 2 * gamma ** i / (gamma + 1), is at
most `error` away from any value in it, relative to that value. All expressions are
built in, so counting combines partially before it shuffles, and no group is ever
collected: ranks are found by running sums over the buckets of a group, whose number is
bounded by the range of doubles (about 71,000 at an error of 1 %), not by the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.session import table

ERROR = 0.01
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: No absolute value of a double has a smaller bucket number than this at an error from 0.0001.
OFFSET = 10_000_000


def gamma(error: float = ERROR) -> float:
    if not 0.0001 <= error < 1:
        raise ValueError("error must be from 0.0001 to below 1")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """Number of the signed logarithmic bucket of a value; null for null and NaN. Infinite values have buckets of their own at either end."""
    v = value.cast("double")
    size = F.abs(v)
    number = F.ceil(F.log(size) / F.lit(math.log(gamma(error)))).cast("long") + F.lit(OFFSET)
    number = F.when(size == F.lit(float("inf")), F.lit(2 * OFFSET + 1)).otherwise(number)
    return F.when(F.isnan(v) | v.isNull(), None).when(v == 0, F.lit(0)).when(v > 0, number).otherwise(-number)


def bucket_value(number: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket."""
    g = gamma(error)
    size = F.when(F.abs(number) > 2 * OFFSET, F.lit(float("inf"))).otherwise(F.lit(2 / (g + 1)) * F.exp((F.abs(number) - F.lit(OFFSET)) * F.lit(math.log(g))))
    return F.when(number == 0, F.lit(0.0)).when(number > 0, size).otherwise(-size)


def sketch(df: DataFrame, groups: list[str], value: str, error: float = ERROR) -> DataFrame:
    """Counts per group and bucket: (groups, bucket, n). Null and NaN values are left out; null groups are groups."""
    rows = df.select(*groups, bucket(F.col(value), error).alias("bucket")).where("bucket is not null")
    return rows.groupBy(*groups, "bucket").agg(F.count("*").alias("n"))


def combine(*sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sum of sketches made with the same error, also to fewer groups: equal to the sketch of all their rows."""
    both = sketches[0].select(*groups, "bucket", "n")
    for s in sketches[1:]:
        both = both.unionByName(s.select(*groups, "bucket", "n"))
    return both.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], quantiles: tuple[float, ...] = QUANTILES, error: float = ERROR) -> DataFrame:
    """(groups, quantile, value, n) for each group of a sketch and each quantile.

    The value is at most `error` away, relative to it, from the value at index
    min(n - 1, floor(q * n)) of the sorted values of the group (nearest rank).
    """
    w = Window.partitionBy(*groups).orderBy("bucket") if groups else Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all_n", F.sum("n").over(whole))
    asked = F.array(*(F.lit(float(q)) for q in quantiles))
    # a bucket answers the quantiles whose index falls among its own
    index = lambda q: F.least(F.floor(q * F.col("all_n")), F.col("all_n") - 1)
    mine = F.filter(asked, lambda q: (index(q) < F.col("upto")) & (index(q) >= F.col("upto") - F.col("n")))
    return ranked.select(*groups, F.explode(mine).alias("quantile"), bucket_value(F.col("bucket"), error).alias("value"), F.col("all_n").alias("n"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each rec_id with a latency: model, agent, day, latency_ms."""
    rows = table(spark, sf_dir, "run_records").where("latency_ms is not null").select("rec_id", "model", "agent", F.to_date("finished_at").alias("day"), "latency_ms")
    # redelivered rows are equal but for their arrival
    return rows.distinct()


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of latency for each model and agent, per day and over all days (day null).

    Only the days' sketches see the rows; those over all days are sums of them.
    """
    groups = ["model", "agent", "day"]
    daily = sketch(latencies(spark, sf_dir), groups, "latency_ms")
    total = combine(daily, groups=["model", "agent"])
    per_day = percentiles(daily, groups).withColumn("scope", F.lit("day"))
    overall = percentiles(total, ["model", "agent"]).withColumn("day", F.lit(None).cast("date")).withColumn("scope", F.lit("all"))
    rounded = F.round("value", 6).alias("value")
    return per_day.unionByName(overall).select("scope", "model", "agent", "day", "quantile", rounded, "n")


def p4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial results that can be combined: bucket counts by model, agent and day."""
    return sketch(latencies(spark, sf_dir), ["model", "agent", "day"], "latency_ms")


_G = gamma()
_LATENCIES = "(SELECT DISTINCT rec_id, model, agent, CAST(finished_at AS DATE) AS day, latency_ms FROM run_records WHERE latency_ms IS NOT NULL)"
_BUCKET = f"CASE WHEN latency_ms = 0 THEN 0 ELSE CAST(ceil(ln(CAST(latency_ms AS DOUBLE)) / {math.log(_G)!r}) AS BIGINT) + {OFFSET} END"
P4_SKETCH_SQL = f"SELECT model, agent, day, {_BUCKET} AS bucket, count(*) AS n FROM {_LATENCIES} GROUP BY ALL"
P4_SQL = f"""
WITH daily AS (SELECT 'day' AS scope, model, agent, day, {_BUCKET} AS bucket, count(*) AS n FROM {_LATENCIES} GROUP BY ALL),
every_day AS (SELECT 'all' AS scope, model, agent, CAST(NULL AS DATE) AS day, bucket, CAST(sum(n) AS BIGINT) AS n FROM daily GROUP BY ALL),
counts AS (SELECT * FROM daily UNION ALL SELECT * FROM every_day),
ranked AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY scope, model, agent, day ORDER BY bucket) AS BIGINT) AS upto,
         CAST(sum(n) OVER (PARTITION BY scope, model, agent, day) AS BIGINT) AS all_n FROM counts),
asked AS (SELECT unnest([{", ".join(f"CAST({q} AS DOUBLE)" for q in QUANTILES)}]) AS quantile)
SELECT scope, model, agent, day, quantile,
       round(CASE WHEN bucket = 0 THEN 0.0 ELSE {2 / (_G + 1)!r} * exp((bucket - {OFFSET}) * {math.log(_G)!r}) END, 6) AS value, all_n AS n
FROM ranked, asked
WHERE least(CAST(floor(quantile * all_n) AS BIGINT), all_n - 1) < upto AND least(CAST(floor(quantile * all_n) AS BIGINT), all_n - 1) >= upto - n
"""
