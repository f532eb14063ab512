"""Samples that match target category proportions (problem 5).

Method: swap repair. Rows are grouped by their category signature; of each plan a random
sample that satisfies the floors is the start, held as counts of signatures; exchanges of
rows of one signature for rows of another are made while they lower the deviation from the
targets; the counts are then materialised by drawing rows of each signature at random.

The exchange works on signature counts only, whose number is bounded by the categories;
rows are drawn by hash order. As a plan's categories are whole signatures, the deviation is
convex in each count, so exchanges that each lower it end at its least value.
"""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.session import cut, table

SEED = 17
#: Signatures with rows, at most; targets name categories, not keys.
MAX_SIGNATURES = 100_000


@dataclass
class Plan:
    """A plan's targets by signature, and what came of them."""

    size: int
    targets: dict[tuple, list[tuple[int, float, int]]]
    counts: dict[tuple, int] = field(default_factory=dict)
    swaps: int = 0


def _floors(plan: Plan, available: dict[tuple, int]) -> dict[tuple, int]:
    return {s: min(available.get(s, 0), max((m for _, _, m in t), default=0)) for s, t in plan.targets.items()}


def _start(plan: Plan, available: dict[tuple, int], rng: random.Random) -> dict[tuple, int]:
    """Counts of a random sample with every floor: floors first, then rows at random from what is left.

    Where the floors together exceed the sample size they are kept, and the sample is larger.
    """
    floors = _floors(plan, available)
    counts = dict(floors)
    left = {s: n - counts.get(s, 0) for s, n in available.items() if n > counts.get(s, 0)}
    need = plan.size - sum(counts.values())
    total = sum(left.values())
    for s in sorted(left, key=str):
        if need <= 0 or total <= 0:
            break
        # as many of this signature as a draw of `need` rows from all that is left would have, up to rounding at random
        expected = need * left[s] / total
        take = min(left[s], math.floor(expected) + (rng.random() < expected % 1))
        total -= left[s]
        take = max(take, need - total)
        counts[s] = counts.get(s, 0) + min(take, need)
        need -= min(take, need)
    return counts


def repair(plan: Plan, available: dict[tuple, int], rng: random.Random) -> None:
    """Exchanges signature counts while the squared deviation from the targets becomes less."""
    wanted = {s: sum(share for _, share, _ in t) * plan.size for s, t in plan.targets.items()}
    floors = _floors(plan, available)
    counts = _start(plan, available, rng)
    off = lambda s: counts.get(s, 0) - wanted.get(s, 0.0)
    # signatures by how far they are from their target, with room for more or rows to give;
    # every change adds a fresh entry, and entries that no longer hold are dropped when met
    short = [(off(s), str(s), s) for s in available if counts.get(s, 0) < available[s]]
    over = [(-off(s), str(s), s) for s in counts if counts[s] > floors.get(s, 0)]
    heapq.heapify(short)
    heapq.heapify(over)
    while short and over:
        lack, _, a = short[0]
        excess, _, b = over[0]
        if lack != off(a) or counts.get(a, 0) >= available[a]:
            heapq.heappop(short)
            continue
        if -excess != off(b) or counts.get(b, 0) <= floors.get(b, 0):
            heapq.heappop(over)
            continue
        gap = -excess - lack
        # an exchange of one row lowers the squared deviation if the two are more than one row apart
        if a == b or gap <= 1 + 1e-9:
            break
        rows = min(max(1, math.floor(gap / 2)), available[a] - counts.get(a, 0), counts[b] - floors.get(b, 0))
        counts[a] = counts.get(a, 0) + rows
        counts[b] -= rows
        plan.swaps += rows
        for s in (a, b):
            heapq.heappush(short, (off(s), str(s), s))
            heapq.heappush(over, (-off(s), str(s), s))
    plan.counts = {s: n for s, n in counts.items() if n}


class Sample:
    """The plans of `targets` carried out on `items`; see the module's text.

    items and targets share the columns `by`; values are compared exactly and nulls are a
    value of their own. A key that comes several times counts once: of unequal rows the
    one whose values come first. Null keys take no part. Targets with a null share or floor
    count as 0. Plans without targets do not exist; without items every target with a
    positive need is unmet.
    """

    def __init__(self, items: DataFrame, targets: DataFrame, key: str = "item_no", by: tuple[str, ...] = ("label", "error_type"), plan: str = "plan_name", share: str = "sample_share", seed: int = SEED):
        self.spark, self.by, self.key = items.sparkSession, by, key
        rows = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*(F.col(c) for c in by))).alias("s"))
        self.rows = cut(rows.select("key", *(F.col(f"s.{c}").alias(f"s{i}") for i, c in enumerate(by))))
        names = [f"s{i}" for i in range(len(by))]
        found = self.rows.groupBy(*names).count().limit(MAX_SIGNATURES + 1).collect()
        if len(found) > MAX_SIGNATURES:
            raise ValueError(f"more than {MAX_SIGNATURES} signatures: the columns {by} are not categories")
        self.available = {tuple(r[n] for n in names): r["count"] for r in found}
        self.total = sum(self.available.values())
        self.plans: dict = {}
        self.targets = targets.select("target_no", plan, share, *by, "target_share", "min_rows").collect()
        for r in sorted(self.targets, key=lambda r: r["target_no"]):
            p = self.plans.setdefault(r[plan], Plan(math.floor((r[share] or 0) * self.total + 1e-9), {}))
            p.targets.setdefault(tuple(r[c] for c in by), []).append((r["target_no"], r["target_share"] or 0.0, r["min_rows"] or 0))
        for name in sorted(self.plans, key=str):
            repair(self.plans[name], self.available, random.Random(f"{seed}/{name}"))

    def report(self) -> DataFrame:
        """A row for each target: (plan_name, target_no, by, target_rows, min_rows, available, sampled, actual_share, met).

        sampled counts the rows that were drawn. A target is met if the sample reaches its
        target and its floor, or lacks no more than rows that exist could fill, which
        happens where a target is no whole number or the floors of others take its place.
        """
        names = [f"s{i}" for i in range(len(self.by))]
        asked, sizes = [], {}
        for name, p in self.plans.items():
            sizes[name] = sum(p.counts.values())
            for s, targets in p.targets.items():
                for no, share, floor in targets:
                    asked.append((name, no, *s, float(share * p.size), floor, self.available.get(s, 0), sizes[name]))
        columns = ", ".join(f"{c} string" for c in names)
        wanted = self.spark.createDataFrame(asked, f"plan_name string, target_no bigint, {columns}, target_rows double, min_rows int, available bigint, size bigint")
        drawn = self.draw().groupBy(F.col("plan_name").alias("d_plan"), *(F.col(c).alias(f"d{i}") for i, c in enumerate(self.by))).agg(F.count("*").alias("n"))
        same = F.col("plan_name").eqNullSafe(F.col("d_plan"))
        for i, n in enumerate(names):
            same = same & F.col(n).eqNullSafe(F.col(f"d{i}"))
        both = wanted.join(drawn, same, "left").withColumn("sampled", F.coalesce("n", F.lit(0)))
        lacking = F.greatest("target_rows", F.col("min_rows").cast("double")) - F.col("sampled")
        return both.select(
            "plan_name", "target_no", *(F.col(n).alias(c) for n, c in zip(names, self.by, strict=True)), "target_rows", "min_rows", "available", "sampled",
            F.when(F.col("size") > 0, F.col("sampled") / F.col("size")).alias("actual_share"), (lacking <= F.col("available") - F.col("sampled")).alias("met"),
        )

    def draw(self) -> DataFrame:
        """The samples: (plan_name, key, by). Rows of a signature are drawn in hash order of their keys.

        A signature's rows are ranked in hash buckets, so one that holds most rows is spread
        over all tasks; only bucket totals, of bounded number, come before a bucket's rows.
        """
        names = [f"s{i}" for i in range(len(self.by))]
        wanted = [(name, *s, n) for name, p in self.plans.items() for s, n in p.counts.items()]
        plans = self.spark.createDataFrame(wanted, "plan_name string, " + ", ".join(f"w{i} string" for i in range(len(names))) + ", take bigint")
        same = F.lit(True)
        for i, n in enumerate(names):
            same = same & F.col(n).eqNullSafe(F.col(f"w{i}"))
        per = self.rows
        drawn = per.join(plans, same).withColumn("rank", F.xxhash64("key", "plan_name", F.lit(SEED))).withColumn("bucket", F.shiftrightunsigned("rank", 56))
        drawn = drawn.select("plan_name", *names, "key", "take", "rank", "bucket")
        group = ["plan_name", *names]
        totals = drawn.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
        before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        before = before.select(*(F.col(c).alias(f"b_{c}") for c in [*group, "bucket"]), "before")
        match = F.lit(True)
        for c in [*group, "bucket"]:
            match = match & F.col(c).eqNullSafe(F.col(f"b_{c}"))
        # whole buckets beyond the wanted count are dropped before any ranking
        kept = drawn.join(before, match).where("before < take")
        rank = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("rank", "key"))
        kept = kept.withColumn("place", rank + F.col("before")).where("place <= take")
        return kept.select("plan_name", F.col("key").alias(self.key), *(F.col(n).alias(c) for n, c in zip(names, self.by, strict=True)))


def _sample(spark: SparkSession, sf_dir: str) -> Sample:
    return Sample(table(spark, sf_dir, "bench_items"), table(spark, sf_dir, "sample_targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).report().where("not met").select("target_no").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with what is available and what the sample holds of it."""
    return _sample(spark, sf_dir).report()


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of all plans."""
    return _sample(spark, sf_dir).draw()


P5_FOUND_SQL = """
WITH items AS (SELECT item_no, min((label, error_type)) AS s FROM bench_items WHERE item_no IS NOT NULL GROUP BY item_no),
total AS (SELECT count(*) AS n FROM items)
SELECT t.target_no FROM sample_targets t, total
WHERE (SELECT count(*) FROM (SELECT DISTINCT item_no, label, error_type FROM bench_items) i
       WHERE i.label IS NOT DISTINCT FROM t.label AND i.error_type IS NOT DISTINCT FROM t.error_type)
      < greatest(t.target_share * floor(t.sample_share * total.n), t.min_rows)
"""
