"""Queries on check runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.functions.stats import wilson_sql
from tabulith.functions.text import JUDGMENT
from tabulith.operators import scoring as S
from tabulith.sources.tables import SQL as T
from tabulith.sources.tables import items, overrides, records


def _rows(spark, sf):
    return S.scored(records(spark, sf), items(spark, sf))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def run_summary(spark, sf):
    return _rounded(S.summary(_rows(spark, sf), ["run_name"]), "total_cost", "cost_per_check", "avg_prompt_tokens")


def model_summary(spark, sf):
    return _rounded(S.summary(_rows(spark, sf), ["model", "agent"]), "total_cost", "cost_per_check", "avg_prompt_tokens")


def adjusted_summary(spark, sf):
    rows = S.apply_overrides(_rows(spark, sf), overrides(spark, sf))
    return _rounded(S.summary(rows, ["run_name"]), "total_cost", "cost_per_check", "avg_prompt_tokens")


def override_states(spark, sf):
    rows = S.apply_overrides(items(spark, sf).select(F.col("id").alias("item_id"), "label", "claim", "citation"), overrides(spark, sf))
    return rows.where("override is not null").select(F.col("item_id").alias("id"), "label", "override")


def confusion_matrix(spark, sf):
    return S.confusion(_rows(spark, sf), ["run_name"])


def flagged_by_type(spark, sf):
    return S.by_type(_rows(spark, sf), ["run_name"])


def error_type_counts(spark, sf):
    return items(spark, sf).groupBy("dataset", "error_type", "label").agg(F.count("*").alias("n"))


def paired_runs(spark, sf):
    """Against the run that comes first by name."""
    rows = _rows(spark, sf)
    first = rows.agg(F.min("run_name")).first()[0]
    return S.paired(rows, first) if first is not None else S.paired(rows, "")


def complete_runs(spark, sf):
    return S.complete_runs(records(spark, sf), items(spark, sf))


def leaderboard(spark, sf):
    """Runs by catch rate, then false alarms, with reviewed false alarms and subtle overstatements."""
    rows = S.apply_overrides(_rows(spark, sf), overrides(spark, sf))
    flag, ok = S.is_flag(F.col("verdict")), F.col("verdict").isNotNull()
    extra = rows.groupBy("run_name").agg(
        F.count_if(ok & flag & (F.col("label") == "supported") & F.coalesce("reviewed", F.lit(False))).alias("reviewed_false_alarms"),
        F.count_if(ok & (F.col("label") == "supported") & F.coalesce("reviewed", F.lit(False))).alias("reviewed_good"),
        F.count_if(ok & flag & (F.col("error_type") == "overstated_subtle")).alias("subtle_flagged"),
        F.count_if(ok & (F.col("error_type") == "overstated_subtle")).alias("subtle_n"),
    )
    s = S.summary(rows, ["run_name"]).select("run_name", "n", "failed", "catch_rate", "false_alarm_rate", "p50", "p95")
    return s.join(extra, "run_name").orderBy(F.desc_nulls_last("catch_rate"), F.asc_nulls_last("false_alarm_rate"), "run_name")


def resolution_counts(spark, sf):
    return records(spark, sf).groupBy("run_name", F.col("hybrid.decided_by").alias("decided_by"), "resolution").agg(F.count("*").alias("n"))


def fast_latency(spark, sf):
    """Upper median of the fast model's latency."""
    rows = records(spark, sf).select("run_name", F.col("hybrid.fast_latency_ms").alias("latency_ms"))
    return S.latency_ranks(rows, ["run_name"]).select("run_name", F.col("p50").alias("fast_p50"))


def usage_totals(spark, sf):
    r = records(spark, sf).groupBy("model").agg(F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"), F.sum(F.col("usage.cost_usd").cast("decimal(20,9)")).cast("double").alias("cost_usd"))
    return r


def escalations(spark, sf):
    """Which fast verdicts would go on to the strong model, by reason, with all options but 'passes'."""
    rows = records(spark, sf).where("result is not null").join(items(spark, sf).select(F.col("id").alias("item_id"), "claim"), "item_id")
    reason = S.escalation_reason(F.col("result.verdict"), F.col("cues"), F.col("claim").rlike(JUDGMENT), F.col("result.confidence"), {"cues", "judgment", "lowconf", "flags"})
    return rows.groupBy("run_name", reason.alias("reason")).agg(F.count("*").alias("n"))


_ROWS = f"""{T["items"]}, {T["records"]},
rows_ AS (SELECT r.rec_id, r.run_name, r.item_id, r.model, r.agent, r.result.verdict AS verdict, r.quote_grounded, r.usage, r.latency_ms, i.label, i.error_type, i.claim, i.citation, i.reviewed
          FROM records r JOIN items i ON r.item_id = i.id)"""
_ADJUSTED = f"""{_ROWS}, {T["overrides"]},
adjusted AS (SELECT rows_.* REPLACE (CASE WHEN o.label IS NOT NULL AND o.label IS DISTINCT FROM rows_.label AND (o.claim IS NULL OR coalesce(o.claim = rows_.claim, false)) AND (o.citation IS NULL OR coalesce(o.citation = rows_.citation, false)) THEN o.label ELSE rows_.label END AS label)
             FROM rows_ LEFT JOIN overrides o ON o.id = rows_.item_id)"""


def _summary_sql(prelude: str, rows: str, by: str) -> str:
    bad, good = "(tp + fn)", "(fp + tn)"
    return f"""
    WITH {prelude},
    c AS (SELECT {by}, count(*) AS n, count(*) FILTER (verdict IS NULL) AS failed,
      count(*) FILTER (label <> 'supported' AND verdict <> 'supported') AS tp, count(*) FILTER (label <> 'supported' AND verdict = 'supported') AS fn,
      count(*) FILTER (label = 'supported' AND verdict <> 'supported') AS fp, count(*) FILTER (label = 'supported' AND verdict = 'supported') AS tn,
      count(*) FILTER (label = verdict) AS exact, count(*) FILTER (verdict IS NOT NULL AND quote_grounded) AS grounded,
      count(*) FILTER (verdict IS NOT NULL AND quote_grounded IS NOT NULL) AS quoted,
      CAST(sum(CAST(coalesce(usage.cost_usd, 0) AS DECIMAL(20, 9))) AS DOUBLE) AS cost, sum(coalesce(usage.prompt_tokens, 0)) AS tokens,
      list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL)) AS l
    FROM {rows} GROUP BY ALL)
    SELECT {by}, n, failed, tp, fn, fp, tn,
      tp / nullif({bad}, 0) AS catch_rate, {wilson_sql("tp", bad, False)} AS catch_low, {wilson_sql("tp", bad, True)} AS catch_high,
      fp / nullif({good}, 0) AS false_alarm_rate, {wilson_sql("fp", good, False)} AS false_alarm_low, {wilson_sql("fp", good, True)} AS false_alarm_high,
      tp / nullif(tp + fp, 0) AS flag_precision, exact / nullif(n - failed, 0) AS accuracy, grounded / nullif(quoted, 0) AS quote_grounded,
      round(cost, 9) AS total_cost, round(cost / n, 9) AS cost_per_check, round(tokens / n, 9) AS avg_prompt_tokens,
      CAST(l[least(len(l), floor(0.5 * len(l))::INT + 1)] AS DOUBLE) AS p50, CAST(l[least(len(l), floor(0.95 * len(l))::INT + 1)] AS DOUBLE) AS p95
    FROM c"""


_REASONS = JUDGMENT.replace("'", "''")
QUERIES = {f.__name__: f for f in (run_summary, model_summary, adjusted_summary, override_states, confusion_matrix, flagged_by_type, error_type_counts, paired_runs, complete_runs, leaderboard, resolution_counts, fast_latency, usage_totals, escalations)}
SQL = {
    "run_summary": _summary_sql(_ROWS, "rows_", "run_name"),
    "model_summary": _summary_sql(_ROWS, "rows_", "model, agent"),
    "adjusted_summary": _summary_sql(_ADJUSTED, "adjusted", "run_name"),
    "override_states": f"""
        WITH {T["items"]}, {T["overrides"]},
        m AS (SELECT i.id, i.label AS old_label, o.label AS new_label, (o.claim IS NULL OR coalesce(o.claim = i.claim, false)) AND (o.citation IS NULL OR coalesce(o.citation = i.citation, false)) AS stands
              FROM items i JOIN overrides o ON i.id = o.id WHERE o.label IS NOT NULL AND o.label IS DISTINCT FROM i.label)
        SELECT id, CASE WHEN stands THEN new_label ELSE old_label END AS label, CASE WHEN stands THEN 'applied' ELSE 'stale' END AS override FROM m""",
    "confusion_matrix": f"""
        WITH {_ROWS}, v AS (SELECT unnest(['supported', 'not_supported', 'wrong_target']) AS x), runs AS (SELECT DISTINCT run_name FROM rows_)
        SELECT runs.run_name, a.x AS label, b.x AS verdict, count(r.rec_id) AS n
        FROM runs, v a, v b LEFT JOIN rows_ r ON r.run_name = runs.run_name AND r.label = a.x AND r.verdict = b.x GROUP BY ALL""",
    "flagged_by_type": f"WITH {_ROWS} SELECT run_name, error_type, count(*) FILTER (verdict <> 'supported') AS flagged, count(*) AS n, count(*) FILTER (verdict <> 'supported') / count(*) AS rate FROM rows_ WHERE verdict IS NOT NULL GROUP BY ALL",
    "error_type_counts": f"WITH {T['items']} SELECT dataset, error_type, label, count(*) AS n FROM items GROUP BY ALL",
    "paired_runs": f"""
        WITH {_ROWS}, ok AS (SELECT run_name, item_id, label, verdict <> 'supported' AS flag FROM rows_ WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_name, item_id ORDER BY rec_id DESC) = 1),
        first_run AS (SELECT min(run_name) AS f FROM rows_)
        SELECT a.run_name, count(*) AS shared,
          count(*) FILTER (a.label <> 'supported' AND a.flag AND NOT b.flag) AS only_run_bad, count(*) FILTER (a.label <> 'supported' AND NOT a.flag AND b.flag) AS only_reference_bad,
          count(*) FILTER (a.label = 'supported' AND NOT a.flag AND b.flag) AS only_run_good, count(*) FILTER (a.label = 'supported' AND a.flag AND NOT b.flag) AS only_reference_good
        FROM ok a JOIN ok b ON a.item_id = b.item_id, first_run WHERE b.run_name = f AND a.run_name <> f GROUP BY ALL""",
    "complete_runs": f"""
        WITH {T["items"]}, {T["records"]}, size AS (SELECT dataset, CAST(ceil(count(*) * 0.9) AS BIGINT) AS least FROM items GROUP BY dataset),
        runs AS (SELECT r.run_name, r.dataset, count(DISTINCT r.item_id) AS checked, bool_and(i.id IS NOT NULL) AS all_current FROM records r LEFT JOIN items i ON r.item_id = i.id GROUP BY ALL)
        SELECT run_name, dataset, checked, least, all_current, checked >= least AND all_current AS complete FROM runs JOIN size USING (dataset)""",
    "leaderboard": f"""
        WITH {_ADJUSTED}, s AS (SELECT run_name, count(*) AS n, count(*) FILTER (verdict IS NULL) AS failed,
          count(*) FILTER (label <> 'supported' AND verdict <> 'supported') / nullif(count(*) FILTER (label <> 'supported' AND verdict IS NOT NULL), 0) AS catch_rate,
          count(*) FILTER (label = 'supported' AND verdict <> 'supported') / nullif(count(*) FILTER (label = 'supported' AND verdict IS NOT NULL), 0) AS false_alarm_rate,
          list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL)) AS l,
          count(*) FILTER (verdict <> 'supported' AND label = 'supported' AND reviewed) AS reviewed_false_alarms,
          count(*) FILTER (verdict IS NOT NULL AND label = 'supported' AND reviewed) AS reviewed_good,
          count(*) FILTER (verdict <> 'supported' AND error_type = 'overstated_subtle') AS subtle_flagged,
          count(*) FILTER (verdict IS NOT NULL AND error_type = 'overstated_subtle') AS subtle_n FROM adjusted GROUP BY run_name)
        SELECT * EXCLUDE (l), CAST(l[least(len(l), floor(0.5 * len(l))::INT + 1)] AS DOUBLE) AS p50, CAST(l[least(len(l), floor(0.95 * len(l))::INT + 1)] AS DOUBLE) AS p95
        FROM s ORDER BY catch_rate DESC NULLS LAST, false_alarm_rate NULLS LAST, run_name""",
    "resolution_counts": f"WITH {T['records']} SELECT run_name, hybrid.decided_by AS decided_by, resolution, count(*) AS n FROM records GROUP BY ALL",
    "fast_latency": f"""
        WITH {T["records"]}, g AS (SELECT run_name, list_sort(list(hybrid.fast_latency_ms)) AS l FROM records WHERE hybrid.fast_latency_ms IS NOT NULL GROUP BY run_name)
        SELECT run_name, CAST(l[least(len(l), len(l) // 2 + 1)] AS DOUBLE) AS fast_p50 FROM g""",
    "usage_totals": f"WITH {T['records']} SELECT model, CAST(sum(usage.prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(usage.completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(CAST(usage.cost_usd AS DECIMAL(20, 9))) AS DOUBLE) AS cost_usd FROM records GROUP BY model",
    "escalations": f"""
        WITH {T["items"]}, {T["records"]},
        r AS (SELECT run_name, result.verdict AS v, result.confidence AS c, cues, claim FROM records JOIN items ON item_id = items.id WHERE result IS NOT NULL)
        SELECT run_name, CASE WHEN v <> 'supported' THEN 'flag' WHEN coalesce(cues, '') <> '' THEN 'pass despite cues' WHEN regexp_matches(claim, '{_REASONS}') THEN 'judgment claim' WHEN c = 'low' THEN 'low-confidence pass' END AS reason, count(*) AS n
        FROM r GROUP BY ALL""",
}
