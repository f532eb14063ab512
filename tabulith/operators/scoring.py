"""Scores of check runs: rates with intervals, confusion, percentiles, overrides, paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.stats import nearest_rank, rate, wilson

#: The verdicts.
VERDICTS = ("supported", "not_supported", "wrong_target")


def is_flag(verdict: Column) -> Column:
    """Whether a verdict flags a claim; null stays null."""
    return verdict != "supported"


def scored(records: DataFrame, items: DataFrame) -> DataFrame:
    """Records with their item's label and error type; records of unknown items are left out.

    Failed checks have a null verdict. Only the columns that scores need are joined.
    """
    known = items.select(F.col("id").alias("item_id"), "label", "error_type", "claim", "citation", "reviewed")
    own = records.select("rec_id", "run_name", "item_id", "model", "agent", F.col("result.verdict").alias("verdict"), "quote_grounded", "usage", "latency_ms", "resolution", "hybrid", "cues")
    return own.join(known, "item_id")


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Labels replaced by reviewed ones that differ and whose recorded claim and citation, if any, still stand.

    Adds `override`: 'applied', 'stale' (the text has changed) or null (none, or the same label).
    """
    reviewed = overrides.select(F.col("id").alias("item_id"), F.col("label").alias("new_label"), F.col("claim").alias("old_claim"), F.col("citation").alias("old_citation"))
    joined = rows.join(reviewed, "item_id", "left")
    differs = F.col("new_label").isNotNull() & ~F.col("new_label").eqNullSafe(F.col("label"))
    stands = F.coalesce(F.col("old_claim") == F.col("claim"), F.col("old_claim").isNull()) & F.coalesce(F.col("old_citation") == F.col("citation"), F.col("old_citation").isNull())
    state = F.when(differs & stands, F.lit("applied")).when(differs, F.lit("stale"))
    return joined.withColumn("override", state).withColumn("label", F.when(F.col("override") == "applied", F.col("new_label")).otherwise(F.col("label"))).drop("new_label", "old_claim", "old_citation")


def _counts() -> list[Column]:
    bad, good, flag = is_flag(F.col("label")), F.col("label") == "supported", is_flag(F.col("verdict"))
    return [
        F.count("*").alias("n"),
        F.count_if(F.col("verdict").isNull()).alias("failed"),
        F.count_if(bad & flag).alias("tp"),
        F.count_if(bad & ~flag).alias("fn"),
        F.count_if(good & flag).alias("fp"),
        F.count_if(good & ~flag).alias("tn"),
        F.count_if(F.col("verdict") == F.col("label")).alias("exact"),
        F.count_if(F.col("verdict").isNotNull() & F.col("quote_grounded")).alias("grounded"),
        F.count_if(F.col("verdict").isNotNull() & F.col("quote_grounded").isNotNull()).alias("quoted"),
        F.sum(F.coalesce(F.col("usage.cost_usd"), F.lit(0.0)).cast("decimal(20,9)")).cast("double").alias("total_cost"),
        F.sum(F.coalesce(F.col("usage.prompt_tokens"), F.lit(0))).alias("prompt_tokens"),
    ]


def latency_ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Nearest-rank latency percentiles per group from counts of distinct values; null latencies are left out."""
    counts = rows.where("latency_ms is not null").groupBy(*by, "latency_ms").agg(F.count("*").alias("k"))
    pairs = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("latency_ms").alias("value"), F.col("k").alias("n")))).alias("c"), F.sum("k").alias("total"))
    return pairs.select(*by, nearest_rank(F.col("c"), F.col("total"), 0.5).alias("p50"), nearest_rank(F.col("c"), F.col("total"), 0.95).alias("p95"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: counts, rates with intervals, cost and latency. Failed checks count in n, cost and latency only."""
    s = rows.groupBy(*by).agg(*_counts())
    ok = F.col("n") - F.col("failed")
    bad, good = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    s = s.select(
        *by, "n", "failed", "tp", "fn", "fp", "tn",
        rate(F.col("tp"), bad).alias("catch_rate"), wilson(F.col("tp"), bad, False).alias("catch_low"), wilson(F.col("tp"), bad, True).alias("catch_high"),
        rate(F.col("fp"), good).alias("false_alarm_rate"), wilson(F.col("fp"), good, False).alias("false_alarm_low"), wilson(F.col("fp"), good, True).alias("false_alarm_high"),
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("flag_precision"), rate(F.col("exact"), ok).alias("accuracy"), rate(F.col("grounded"), F.col("quoted")).alias("quote_grounded"),
        "total_cost", (F.col("total_cost") / F.col("n")).alias("cost_per_check"), (F.col("prompt_tokens") / F.col("n")).alias("avg_prompt_tokens"),
    )
    lat = latency_ranks(rows, by)
    return s.join(lat, by, "left") if by else s.crossJoin(lat)


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """Dense confusion matrix: a row for each group, label and verdict, zeros kept."""
    spark = rows.sparkSession
    cells = [F.count_if((F.col("label") == a) & (F.col("verdict") == b)).alias(f"{a}|{b}") for a in VERDICTS for b in VERDICTS]
    wide = rows.groupBy(*by).agg(*cells)
    flat = F.explode(F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("verdict"), F.col(f"`{a}|{b}`").alias("n")) for a in VERDICTS for b in VERDICTS)))
    del spark
    return wide.select(*by, flat.alias("c")).select(*by, "c.label", "c.verdict", "c.n")


def by_type(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of flagged checks for each error type, failed checks left out."""
    g = rows.where("verdict is not null").groupBy(*by, "error_type").agg(F.count_if(is_flag(F.col("verdict"))).alias("flagged"), F.count("*").alias("n"))
    return g.withColumn("rate", F.col("flagged") / F.col("n"))


def paired(rows: DataFrame, reference: str) -> DataFrame:
    """Each run against a reference run on their common items: what only one of them gets right.

    The reference's checks are joined by item; of several checks of an item the last counts.
    """
    ok = rows.where("verdict is not null").select("run_name", "item_id", "rec_id", "label", is_flag(F.col("verdict")).alias("flag"))
    last = ok.groupBy("run_name", "item_id").agg(F.max_by(F.struct("label", "flag"), "rec_id").alias("r")).select("run_name", "item_id", "r.label", "r.flag")
    ref = last.where(F.col("run_name") == reference).select("item_id", F.col("flag").alias("ref_flag"))
    both = last.where(F.col("run_name") != reference).join(ref, "item_id")
    bad = is_flag(F.col("label"))
    a, b = F.col("flag"), F.col("ref_flag")
    return both.groupBy("run_name").agg(
        F.count("*").alias("shared"),
        F.count_if(bad & a & ~b).alias("only_run_bad"), F.count_if(bad & ~a & b).alias("only_reference_bad"),
        F.count_if(~bad & ~a & b).alias("only_run_good"), F.count_if(~bad & a & ~b).alias("only_reference_good"),
    )


def complete_runs(records: DataFrame, items: DataFrame, share: float = 0.9) -> DataFrame:
    """Runs with checks of at least this share of their dataset's items, all of which are current."""
    size = items.groupBy("dataset").agg(F.ceil(F.count("*") * F.lit(share)).alias("least"))
    known = items.select(F.col("id").alias("item_id"), F.lit(True).alias("current"))
    runs = records.join(known, "item_id", "left").groupBy("run_name", "dataset").agg(F.countDistinct("item_id").alias("checked"), F.bool_and(F.coalesce("current", F.lit(False))).alias("all_current"))
    return runs.join(F.broadcast(size), "dataset").select("run_name", "dataset", "checked", "least", "all_current", ((F.col("checked") >= F.col("least")) & F.col("all_current")).alias("complete"))


def first_attempts(rows: DataFrame) -> DataFrame:
    """Rows with the verdict of the first of several attempts (array column `attempts` of structs with a verdict)."""
    return rows.withColumn("verdict", F.when(F.size("attempts") > 1, F.col("attempts")[0]["verdict"]).otherwise(F.col("verdict")))


def escalation_reason(verdict: Column, cues: Column, judgment: Column, confidence: Column, options: set[str]) -> Column:
    """Why a fast verdict goes on to the strong model; null where it stands. The first reason counts."""
    none = F.lit(None).cast("string")
    chain = F.when(verdict != "supported", F.lit("flag") if "flags" in options else none)
    if "passes" in options:
        return chain.otherwise(F.lit("pass"))
    if "cues" in options:
        chain = chain.when(F.coalesce(cues, F.lit("")) != "", F.lit("pass despite cues"))
    if "judgment" in options:
        chain = chain.when(judgment, F.lit("judgment claim"))
    if "lowconf" in options:
        chain = chain.when(confidence == "low", F.lit("low-confidence pass"))
    return chain.otherwise(none)
