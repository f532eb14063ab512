"""Queries of the audits and cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.operators import reviewing as V
from tabulith.plans.evidence import _targets
from tabulith.sources.tables import SQL as T
from tabulith.sources.tables import items, sections


def table_rows(spark, sf):
    c = V.table_cells(sections(spark, sf))
    return c.select("section_id", "row_no", F.size("cells").alias("cells"), F.size("header").alias("columns"), F.col("cells")[0].alias("row_label"))


def percent_audit(spark, sf):
    return V.percent_findings(sections(spark, sf))


def interval_audit(spark, sf):
    return V.interval_findings(sections(spark, sf))


def audit_tallies(spark, sf):
    s = sections(spark, sf)
    found = V.percent_findings(s).select("section_id", F.lit("percent_mismatch").alias("code"), "severity").unionByName(V.interval_findings(s).select("section_id", "code", F.lit("major").alias("severity")))
    return found.groupBy("severity", "code").agg(F.count("*").alias("findings"), F.countDistinct("section_id").alias("tables"))


def overstatement_cues(spark, sf):
    rows = _targets(spark, sf).select("item_no", F.explode(V.cues(F.col("claim"), F.col("text"))).alias("cue"))
    return rows


def claim_cues(spark, sf):
    """Claims with wording that asserts more than a p-value, or no difference at all."""
    i = items(spark, sf)
    p = V.p_values(F.col("claim"))
    return i.select(
        "item_no",
        F.exists(p, lambda x: x > 0.05).alias("nonsignificant"),
        (F.exists(p, lambda x: x > 0.05) & V.has(F.col("claim"), V.CERTAIN) & ~V.has(F.col("claim"), V.HEDGED)).alias("certain"),
        (V.has(F.col("claim"), V.NO_DIFFERENCE) & ~V.has(F.col("claim"), V.NO_SIGNIFICANT_DIFFERENCE)).alias("absolute"),
        (V.has(F.col("claim"), V.SCOPE) & ~V.has(F.col("claim"), V.TIME_POINT)).alias("unscoped"),
    ).where("nonsignificant is not null")


def sign_conflicts(spark, sf):
    return V.sign_conflicts(_targets(spark, sf), "item_no", "claim", "number_text")


_ROWS = f"""{T["sections"]},
t AS (SELECT section_id, doc_id, label, heading, list_transform(string_split(split_part(text, chr(10) || chr(10) || 'Notes:', 1), chr(10)), lambda r: string_split(r, ' | ')) AS rows_ FROM sections WHERE kind = 'table' AND text IS NOT NULL),
h AS (SELECT *, coalesce(list_filter(rows_, lambda r: len(r) > 1)[1], ['']) AS header FROM t),
table_rows AS (SELECT section_id, doc_id, label, heading, header, CAST(u.i - 1 AS INT) AS row_no, u.c AS cells FROM h, unnest(rows_) WITH ORDINALITY AS u(c, i))"""
_PERCENT = f"""
WITH {_ROWS},
cell AS (SELECT section_id, row_no, cells[1] AS row_label, CAST(u.i - 1 AS INT) AS col_no, u.c AS cell, header[u.i] AS head FROM table_rows, unnest(cells) WITH ORDINALITY AS u(c, i) WHERE len(cells) = len(header) AND u.i > 1),
f0 AS (SELECT section_id, col_no, row_no, trim(cell) AS cell, regexp_matches(coalesce(row_label, ''), '{V.SUBGROUP}') AS sub, CAST(regexp_extract(cell, '{V.COUNT_PERCENT}', 1) AS BIGINT) AS k, regexp_extract(cell, '{V.COUNT_PERCENT}', 2) AS p,
       TRY_CAST(replace(regexp_extract(head, '{V.GROUP_SIZE}', 1), ',', '') AS BIGINT) AS size FROM cell WHERE regexp_matches(cell, '{V.COUNT_PERCENT}') AND NOT regexp_matches(head, '{V.SPREAD_HEADER}')),
f AS (SELECT *, CAST(p AS DOUBLE) AS pct, 0.5 * pow(10.0, -CASE WHEN contains(p, '.') THEN length(split_part(p, '.', -1)) ELSE 0 END) + {V.PERCENT_SLACK} AS slack FROM f0 WHERE k > 0 AND CAST(p AS DOUBLE) > 0 AND CAST(p AS DOUBLE) < 100),
g AS (SELECT *, count(*) OVER (PARTITION BY section_id, col_no) AS n, row_number() OVER (PARTITION BY section_id, col_no ORDER BY row_no) AS i, CAST(floor(100 * k / pct + 0.5) AS BIGINT) AS implied FROM f QUALIFY n >= {V.CELLS}),
cand AS (SELECT section_id, col_no, d, min(o) AS o FROM (SELECT section_id, col_no, implied AS d, i AS o FROM g UNION ALL SELECT section_id, col_no, size, 1000000 FROM g WHERE size IS NOT NULL) GROUP BY ALL),
sup AS (SELECT c.section_id, c.col_no, c.d, c.o, count(*) FILTER (g.k <= c.d AND abs(100 * g.k / c.d - g.pct) <= g.slack) AS support, any_value(g.size) AS size, any_value(g.n) AS n FROM cand c JOIN g USING (section_id, col_no) GROUP BY ALL),
best AS (SELECT section_id, col_no, d AS usual, support, size, n FROM sup QUALIFY row_number() OVER (PARTITION BY section_id, col_no ORDER BY support DESC, coalesce(d = size, false) DESC, o) = 1),
ok AS (SELECT * FROM best WHERE support >= {V.SUPPORT} AND support >= {V.SUPPORT_SHARE} * n),
odd AS (SELECT g.*, ok.usual, ok.support, abs(100 * g.k / ok.usual - g.pct) > g.slack AS off FROM g JOIN ok USING (section_id, col_no) WHERE NOT coalesce(ok.size > 0 AND ok.size <> ok.usual, false)),
lone AS (SELECT *, (lag(off) OVER w AND abs(100 * lag(k) OVER w / implied - lag(pct) OVER w) <= lag(slack) OVER w) AS before, (lead(off) OVER w AND abs(100 * lead(k) OVER w / implied - lead(pct) OVER w) <= lead(slack) OVER w) AS after FROM odd WINDOW w AS (PARTITION BY section_id, col_no ORDER BY row_no))
SELECT section_id, col_no, CAST(NULL AS INT) AS row_no, 'major' AS severity, CAST(NULL AS VARCHAR) AS cell, usual, support, n AS cells FROM ok WHERE coalesce(size > 0 AND size <> usual, false)
UNION ALL SELECT section_id, col_no, row_no, CASE WHEN abs(100 * k / usual - pct) > {V.MAJOR} THEN 'major' ELSE 'minor' END, cell, usual, support, n FROM lone
WHERE off AND NOT (k > usual AND size IS DISTINCT FROM usual) AND NOT sub AND NOT coalesce(before, false) AND NOT coalesce(after, false)"""
_PV = f"list_transform(regexp_extract_all({{0}}, '{V.P_VALUE}', 1), lambda x: TRY_CAST(x AS DOUBLE))"
_NUMBER = r"([-−–]?\s?\d+(?:\.\d+)?)"
_EST = rf"(?:[A-Za-z]{{1,4}}\s*=\s*)?(?:\+\s?)?{_NUMBER}\s*[(\[]\s*{_NUMBER}\s*(?:,|;|to|–|—|-)\s*{_NUMBER}\s*[)\]]"
_N = lambda x: f"TRY_CAST(regexp_replace(regexp_replace({x}, '[−–]', '-', 'g'), '\\s+', '', 'g') AS DOUBLE)"

QUERIES = {f.__name__: f for f in (table_rows, percent_audit, interval_audit, audit_tallies, overstatement_cues, claim_cues, sign_conflicts)}
SQL = {
    "table_rows": f"WITH {_ROWS} SELECT section_id, row_no, CAST(len(cells) AS INT) AS cells, CAST(len(header) AS INT) AS columns, cells[1] AS row_label FROM table_rows",
    "percent_audit": _PERCENT,
    "interval_audit": f"""
        WITH {_ROWS},
        r AS (SELECT *, cells[1] AS lab, array_to_string(cells, ' | ') AS line, list_position(list_transform(header, lambda x: regexp_matches(x, '{V.P_HEADER}')), true) AS pc FROM table_rows),
        k AS (SELECT * FROM r WHERE NOT (regexp_matches(coalesce(lab, ''), '{V.DESCRIPTIVE}') OR (regexp_matches(coalesce(heading, ''), '{V.DESCRIPTIVE}') AND NOT regexp_matches(line, '{V.RATIO}') AND NOT regexp_matches(line, '{V.DIFFERENCE}')))),
        c AS (SELECT k.*, CAST(u.i - 1 AS INT) AS col_no, u.c AS cell, coalesce(header[u.i], '') AS head FROM k, unnest(cells) WITH ORDINALITY AS u(c, i)),
        e0 AS (SELECT *, unnest(regexp_extract_all(cell, '(^|[^\\w.±])({_EST})', 2)) AS estimate FROM c),
        e1 AS (SELECT *, {_N(f"regexp_extract(estimate, '{_EST}', 1)")} AS est, {_N(f"regexp_extract(estimate, '{_EST}', 2)")} AS a, {_N(f"regexp_extract(estimate, '{_EST}', 3)")} AS b FROM e0),
        e2 AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, concat_ws(' ', lab, head, cell) AS ctx, CASE WHEN pc > 1 THEN cells[pc] ELSE list_filter(cells[col_no + 2:], lambda x: regexp_matches(x, '{V.P_CELL}'))[1] END AS pt FROM e1
               WHERE NOT (contains(estimate, '[') AND NOT regexp_matches(concat_ws(' ', lab, head, heading), '\\bCI\\b|confidence') AND NOT regexp_matches(concat_ws(' ', lab, head, heading), '{V.RATIO}'))),
        e3 AS (SELECT *, est < lo - {V.EDGE} * greatest(1.0, abs(est)) OR est > hi + {V.EDGE} * greatest(1.0, abs(est)) AS outside,
               CASE WHEN regexp_matches(ctx, '{V.RATIO}') AND a > 0 AND b > 0 AND est > 0 THEN 1.0 WHEN regexp_matches(ctx, '{V.DIFFERENCE}') THEN 0.0 END AS z, regexp_extract(pt, '{V.P_CELL}', 1) AS bound, TRY_CAST(regexp_extract(pt, '{V.P_CELL}', 2) AS DOUBLE) AS p FROM e2),
        e4 AS (SELECT *, CASE WHEN outside THEN 'estimate_outside_ci' WHEN least(abs(lo - z), abs(hi - z)) > {V.MARGIN} * greatest(1.0, abs(z)) AND
               (((lo > z OR hi < z) AND NOT starts_with(bound, '<') AND p > {V.P_HIGH}) OR (NOT (lo > z OR hi < z) AND CASE WHEN starts_with(bound, '<') THEN p <= {V.P_BOUND} ELSE p < {V.P_LOW} END)) THEN 'ci_p_disagree' END AS code FROM e3)
        SELECT section_id, row_no, col_no, code, trim(estimate) AS estimate FROM e4 WHERE code IS NOT NULL""",
    "claim_cues": f"""
        WITH {T["items"]} SELECT item_no, len(list_filter({_PV.format("claim")}, lambda x: x > 0.05)) > 0 AS nonsignificant,
          len(list_filter({_PV.format("claim")}, lambda x: x > 0.05)) > 0 AND regexp_matches(claim, '{V.CERTAIN}') AND NOT regexp_matches(claim, '{V.HEDGED}') AS certain,
          regexp_matches(claim, '{V.NO_DIFFERENCE}') AND NOT regexp_matches(claim, '{V.NO_SIGNIFICANT_DIFFERENCE}') AS absolute,
          regexp_matches(claim, '{V.SCOPE}') AND NOT regexp_matches(claim, '{V.TIME_POINT}') AS unscoped
        FROM items WHERE claim IS NOT NULL""",
}

