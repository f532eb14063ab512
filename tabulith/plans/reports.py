"""Queries of reports: suggestions, decided items, issues at citations, planted errors, fixes, tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.operators import evidence as E
from tabulith.operators import reporting as P
from tabulith.operators import reviewing as V
from tabulith.operators import scoring as S
from tabulith.operators import toolbox as B
from tabulith.plans.building import _BI
from tabulith.plans.evidence import SQL as EVIDENCE_SQL
from tabulith.plans.evidence import _GROUNDED
from tabulith.plans.evidence import section_numbers
from tabulith.plans.review import _PERCENT
from tabulith.plans.review import SQL as REVIEW_SQL
from tabulith.session import table
from tabulith.sources.tables import SQL as T
from tabulith.sources.tables import items, records, sections, studies


def location_suggestions(spark, sf):
    """Of moved citations, how many suggestions name the true table."""
    i = items(spark, sf).select(F.col("id").alias("item_id"), "label", "mutation", "citation", "source_paper")
    r = records(spark, sf).where("result is not null").select("model", "item_id", F.col("result.suggested_location").alias("suggested"))
    return P.location_suggestions(r.join(i, "item_id"), ["model"]).select("model", "right", "n", F.round("value", 9).alias("value"))


def model_decided(spark, sf):
    """Flags on items that code alone does not decide: those whose target exists."""
    i = items(spark, sf)
    r = records(spark, sf).select("run_name", "item_id", F.col("result.verdict").alias("verdict")).join(i.select(F.col("id").alias("item_id"), "label"), "item_id")
    return P.model_decided(r, i.where("target_id is null").select(F.col("id").alias("item_id")), ["run_name"])


def source_issues(spark, sf):
    """Audit findings at the place that an item's citation begins with."""
    found = P.findings(sections(spark, sf))
    return P.issues_at(items(spark, sf).select("item_no", "citation"), found, "item_no", "citation").select("item_no", "section_id", "code", "severity", "row_no")


def check_report(spark, sf):
    """Saved checks in the order of a report: flags that code decided, other flags, passes."""
    r = records(spark, sf).where("result.verdict is not null").select("rec_id", "item_id", F.col("result.verdict").alias("verdict"), F.col("hybrid.decided_by").alias("decided_by"))
    checked = r.join(items(spark, sf).select(F.col("id").alias("item_id"), "citation"), "item_id")
    return P.check_report(checked, P.findings(sections(spark, sf)), "rec_id").select("rec_id", "flagged", "block", "place", "issues")


def first_findings(spark, sf):
    """The first findings of all audits, major ones first."""
    return P.shown(P.findings(sections(spark, sf))).select("section_id", "code", "severity", "row_no")


def suggestion_accuracy(spark, sf):
    """How often the numbers of a claim alone lead to the section that it was taken from."""
    i = items(spark, sf).where("target_id is not null").select("item_no", F.col("source_paper").alias("own"), "claim", F.replace("target_id", F.lit("/"), F.lit(", ")).alias("place"))
    return P.suggestion_accuracy(i, section_numbers(spark, sf), "item_no")


def planted_recall(spark, sf):
    """Planted errors that the audits find."""
    return P.planted_recall(sections(spark, sf))


def fix_scores(spark, sf):
    """Originals taken as fixes of rewritten claims, scored by what they restore."""
    i = items(spark, sf).where("original_claim is not null")
    cite = F.when(F.col("mutation").rlike("^Table "), F.col("citation"))
    return P.fix_scores(i.select("error_type", "original_claim", "mutation", "source_paper", F.col("claim").alias("fix_text"), cite.alias("fix_citation"), F.array().cast("array<string>").alias("candidates")))


def document_outlines(spark, sf):
    """What the outline tool shows of each document."""
    s = studies(spark, sf).where("id is not null")
    calls = s.select(F.col("id").alias("call"), F.lit("get_outline").alias("tool"), F.create_map(F.lit("doc_id"), F.col("id")).alias("args"))
    out = B.run_tools(calls, s.select("id", "title", "kind", "aliases"), sections(spark, sf))
    return out.select(F.col("call").alias("id"), F.md5("text").alias("text_md5"), F.size("evidence").alias("evidence"))


def tool_answers(spark, sf):
    """How long the answers of the tools are on calls made from claims."""
    i = items(spark, sf).where("item_no % 50 = 0 and claim is not null")
    args = F.create_map(F.lit("query"), F.col("claim"), F.lit("doc_id"), F.coalesce("source_paper", F.lit("")), F.lit("section"), F.coalesce("citation", F.lit("")))
    calls = i.select(F.explode(F.array(*(F.struct(F.concat_ws("/", "item_no", F.lit(t)).alias("call"), F.lit(t).alias("tool"), args.alias("args")) for t in B.TOOLS))).alias("c")).select("c.*")
    s = studies(spark, sf).where("id is not null").select("id", "title", "kind", "aliases")
    return B.run_tools(calls, s, sections(spark, sf)).select("call", "error", F.length("text").alias("chars"), F.size("evidence").alias("evidence"))


def half_tables(spark, sf):
    """Numbers that the first half of a table's rows keeps of all: recall by table."""
    t = sections(spark, sf).where("kind = 'table' and text is not null").select(F.col("doc_id").alias("id"), F.col("section_id").alias("number"), F.split("text", "\n").alias("rows"), F.lit(None).cast("string").alias("foot"))
    half = t.withColumn("rows", F.slice("rows", F.lit(1), F.ceil(F.size("rows") / 2).cast("int")))
    return P.table_recall(t, half).select("id", "number", "found", "numbers", F.round("recall", 9).alias("recall"), "xml_rows", "page_rows")


def half_table_totals(spark, sf):
    t = half_tables(spark, sf)
    return P.table_recall_totals(t).withColumn("mean_recall", F.round("mean_recall", 6))


def _order_sections(spark, sf):
    """Tables of order counts by nation and priority: a wrong percentage in every fifth nation, a wrong N in every seventh."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("p")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") != "F").alias("o"))
    whole = n.groupBy("nation").agg(F.sum("f").alias("nf"), F.sum("o").alias("no"), F.min("p").alias("first"))
    share = lambda k, whole, wrong: F.format_string("%d (%d)", k, F.floor(100 * k / whole + 0.5).cast("bigint") + wrong)
    off = F.when((F.col("nation") % 5 == 0) & (F.col("p") == F.col("first")), F.lit(9)).otherwise(F.lit(0))
    rows = n.join(whole, "nation").withColumn("row", F.concat_ws(" | ", "p", share(F.col("f"), F.col("nf"), off), share(F.col("o"), F.col("no"), F.lit(0))))
    size = F.col("nf") + F.when(F.col("nation") % 7 == 3, F.col("nf")).otherwise(F.lit(0))
    head = F.format_string("Priority | F (N=%d) | O (N=%d)", size, "no")
    g = rows.groupBy("nation", "nf", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "row"))), lambda x: x["row"]), "\n").alias("body"))
    return g.select(F.col("nation").cast("bigint").alias("section_id"), F.lit("orders").alias("doc_id"), F.lit(0).alias("pos"), F.col("nation").cast("string").alias("label"), F.lit(None).cast("string").alias("heading"), F.lit("table").alias("kind"), F.concat(head, F.lit("\n"), "body").alias("text"))


def percent_audit_orders(spark, sf):
    """The audit of percentages on tables of orders, some of them wrong."""
    return V.percent_findings(_order_sections(spark, sf))


def duplicate_quotes(spark, sf):
    """Whether quotes stand in the section that their record names as their place."""
    r = records(spark, sf).where("result.quote is not null and result.location is not null").select("rec_id", F.replace("result.location", F.lit(", "), F.lit("/")).alias("item_id"), F.col("result.quote").alias("quote"))
    s = sections(spark, sf).withColumn("item_id", F.concat_ws("/", "doc_id", "label"))
    return E.ground_quotes(r, E.plain_sources(s, "item_id", ["pos", "section_id"]), "rec_id", "item_id")


QUERIES = {
    f.__name__: f
    for f in (
        location_suggestions, model_decided, source_issues, check_report, first_findings, suggestion_accuracy, planted_recall, fix_scores, document_outlines, tool_answers, half_tables, half_table_totals, percent_audit_orders, duplicate_quotes,
    )
}
_FINDINGS = f"""{T["sections"]}, percent AS ({_PERCENT}), interval_ AS ({REVIEW_SQL["interval_audit"]}),
found AS (SELECT section_id, doc_id, label, code, severity, row_no FROM (SELECT section_id, 'percent_mismatch' AS code, severity, row_no FROM percent UNION ALL SELECT section_id, code, 'major', row_no FROM interval_) JOIN sections USING (section_id)),
issues AS (SELECT DISTINCT item_no, items.id AS item_id, section_id, code, severity, row_no FROM items JOIN found ON starts_with(citation, concat_ws(', ', doc_id, found.label)) WHERE doc_id IS NOT NULL AND found.label IS NOT NULL)"""
_TABLE = r"(?i)\b(?:Supplementa(?:ry|l)\s+)?Tables?\s*(S?\d+(?:\.\d+)*[a-z]?)\b"
_DOC = r"upper(regexp_replace(coalesce(nullif(regexp_extract({0}, '(?i)\bPMC\d+\b'), ''), nullif(regexp_extract({0}, '\b(?:CSR|RPT)[-\s]?[A-Z]*-?\d[\w-]*|\b[A-Z]{{2,}}-\d[\w-]*'), '')), '\s+', '-', 'g'))"
SQL = {
    "location_suggestions": rf"""
        WITH {T["items"]}, {T["records"]}, x AS (SELECT model, coalesce(source_paper, {_DOC.format("citation")}) AS doc, regexp_extract(mutation, '^Table (\S+) ->', 1) AS t,
          coalesce({_DOC.format("coalesce(result.suggested_location, '')")}, {_DOC.format("citation")}) AS d, nullif(regexp_extract(coalesce(result.suggested_location, ''), '{_TABLE}', 1), '') AS s
          FROM records JOIN items ON items.id = item_id WHERE result IS NOT NULL AND label = 'wrong_target' AND regexp_matches(mutation, '^Table \S+ ->'))
        SELECT model, count(*) FILTER (coalesce(d = doc AND lower(s) = lower(t), false)) AS right, count(*) AS n, round(count(*) FILTER (coalesce(d = doc AND lower(s) = lower(t), false)) / count(*), 9) AS value FROM x GROUP BY model""",
    "model_decided": f"""
        WITH {T["items"]}, {T["records"]}, r AS (SELECT run_name, label, result.verdict <> 'supported' AS flag FROM records JOIN items ON items.id = item_id WHERE result.verdict IS NOT NULL AND item_id NOT IN (SELECT id FROM items WHERE target_id IS NULL AND id IS NOT NULL))
        SELECT run_name, count(*) FILTER (label <> 'supported') AS bad, count(*) FILTER (label <> 'supported' AND flag) AS bad_flagged, count(*) FILTER (label = 'supported') AS good, count(*) FILTER (label = 'supported' AND flag) AS good_flagged FROM r GROUP BY run_name""",
    "source_issues": f"WITH {T['items']}, {_FINDINGS} SELECT item_no, section_id, code, severity, row_no FROM issues",
    "check_report": f"""
        WITH {T["items"]}, {T["records"]}, {_FINDINGS}, k AS (SELECT rec_id, citation, result.verdict <> 'supported' AS flagged, hybrid.decided_by AS decider FROM records JOIN items ON items.id = item_id WHERE result.verdict IS NOT NULL),
        n AS (SELECT rec_id, count(*) AS issues FROM (SELECT DISTINCT rec_id, section_id, code, severity, row_no FROM k JOIN found ON starts_with(citation, concat_ws(', ', doc_id, label)) WHERE doc_id IS NOT NULL AND label IS NOT NULL) GROUP BY rec_id),
        b AS (SELECT rec_id, flagged, CASE WHEN flagged AND decider = 'code' THEN 0 WHEN flagged THEN 1 ELSE 2 END AS block, coalesce(issues, 0) AS issues FROM k LEFT JOIN n USING (rec_id))
        SELECT rec_id, flagged, CAST(block AS INT) AS block, CAST(row_number() OVER (PARTITION BY block ORDER BY rec_id) AS INT) AS place, issues FROM b""",
    "first_findings": f"WITH {T['items']}, {_FINDINGS} SELECT section_id, code, severity, row_no FROM found ORDER BY severity <> 'major', section_id, row_no NULLS FIRST, code LIMIT {P.SHOWN_FINDINGS}",
    "audit_tallies": f"WITH {T['items']}, {_FINDINGS} SELECT severity, code, count(*) AS findings, count(DISTINCT section_id) AS tables FROM found GROUP BY ALL",
    "suggestion_accuracy": f"""
        WITH {T["items"]}, s AS ({EVIDENCE_SQL["suggest_sources"]}), a AS ({EVIDENCE_SQL["informative_numbers"]}),
        q AS (SELECT item_no, replace(target_id, '/', ', ') AS place FROM items WHERE target_id IS NOT NULL AND item_no IN (SELECT item_no FROM a))
        SELECT count(*) AS asked, count(suggestions) AS answered, count(*) FILTER (list_contains(string_split(suggestions, '; '), place)) AS right FROM q LEFT JOIN s USING (item_no)""",
    "document_outlines": f"""
        WITH {T["sections"]}, l AS (SELECT doc_id, list(line ORDER BY pos, section_id) AS lines FROM (SELECT doc_id, pos, section_id, '- "' || coalesce(label, '') || '"' || CASE WHEN kind = 'table' AND coalesce(heading, '') <> '' THEN ' (caption: ' || heading || ')' ELSE '' END || ' [' || length(coalesce(text, '')) || ' chars'
             || CASE WHEN length(coalesce(text, '')) > {B.PAGE_CHARS} THEN ', ' || CAST(ceil(length(text) / {B.PAGE_CHARS}) AS INT) || ' pages' ELSE '' END || ']' AS line FROM sections) GROUP BY doc_id),
        o AS (SELECT id, coalesce(lines, []) AS lines, id || ': ' || coalesce(title, '') || chr(10) || 'Sections (' || len(coalesce(lines, [])) || '; pass the quoted label to read_section):' || chr(10) || array_to_string(coalesce(lines, []), chr(10)) AS t FROM study_docs LEFT JOIN l ON l.doc_id = id WHERE id IS NOT NULL)
        SELECT id, md5(CASE WHEN length(t) > {B.PAGE_CHARS} THEN t[:{B.PAGE_CHARS}] || chr(10) || '[truncated]' ELSE t END) AS text_md5, CAST(len(lines) + 1 AS INT) AS evidence FROM o""",
    "half_tables": f"""
        WITH {T["sections"]}, t AS (SELECT doc_id AS id, section_id AS number, string_split(text, chr(10)) AS rows_ FROM sections WHERE kind = 'table' AND text IS NOT NULL),
        h AS (SELECT *, rows_[1:CAST(ceil(len(rows_) / 2) AS INT)] AS half FROM t),
        n AS (SELECT *, list_distinct({_BI.format("(array_to_string(rows_, chr(10)) || ' ')")}) AS a, list_distinct({_BI.format("array_to_string(half, chr(10))")}) AS b FROM h)
        SELECT id, number, true AS found, CAST(len(a) AS INT) AS numbers, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a) END, 9) AS recall, CAST(len(rows_) AS INT) AS xml_rows, CAST(len(half) AS INT) AS page_rows FROM n""",
    "percent_audit_orders": _PERCENT.replace(
        T["sections"],
        """n_ AS (SELECT c_nationkey AS nation, o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'F') AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
w_ AS (SELECT nation, sum(f) AS nf, sum(o) AS no_, min(p) AS first_ FROM n_ GROUP BY nation),
r_ AS (SELECT nation, nf, no_, string_agg(p || ' | ' || f || ' (' || CAST(floor(100 * f / nf + 0.5) + CASE WHEN nation % 5 = 0 AND p = first_ THEN 9 ELSE 0 END AS BIGINT) || ') | ' || o || ' (' || CAST(floor(100 * o / no_ + 0.5) AS BIGINT) || ')', chr(10) ORDER BY p) AS body FROM n_ JOIN w_ USING (nation) GROUP BY ALL),
sections AS (SELECT CAST(nation AS BIGINT) AS section_id, 'orders' AS doc_id, CAST(nation AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS heading, 'table' AS kind, 'Priority | F (N=' || CAST(nf + CASE WHEN nation % 7 = 3 THEN nf ELSE 0 END AS BIGINT) || ') | O (N=' || CAST(no_ AS BIGINT) || ')' || chr(10) || body AS text FROM r_)""",
    ),
    "duplicate_quotes": f"""
        WITH {T["sections"]}, {T["records"]}, places AS (SELECT concat_ws('/', doc_id, label) AS item_id, arg_min({{'t': text}}, (pos, section_id)) AS s FROM sections GROUP BY 1),
        q AS (SELECT rec_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(result.quote, '(?i)^\\s*Title:\\s*', ''), '\\.\\.\\.|…|\\n'), lambda f: {_GROUNDED.format("f")}), lambda f: length(f) > 0) AS fs, {_GROUNDED.format("coalesce(s.t, '')")} AS src
              FROM records JOIN places ON places.item_id = replace(result.location, ', ', '/') WHERE result.quote IS NOT NULL)
        SELECT rec_id, len(fs) > 0 AND len(list_filter(fs, lambda f: NOT contains(src, f))) = 0 AS grounded FROM q""",
}
SQL["half_table_totals"] = f"""SELECT count(*) AS tables, count(*) FILTER (found) AS found, count(*) FILTER (recall >= 0.999) AS exact, count(*) FILTER (recall >= 0.9) AS good, round(avg(recall), 6) AS mean_recall FROM ({SQL["half_tables"]})"""
