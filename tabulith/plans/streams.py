"""Queries on extraction, parsing of replies, objective failures and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.operators import checking as C
from tabulith.operators import extracting as E
from tabulith.operators import fixing as D
from tabulith.operators import toolbox as B
from tabulith.plans.evidence import _targets
from tabulith.session import table

from tabulith.sources.tables import items, records, sections, studies
from tabulith.streaming import session_counts, windowed_counts


def _paragraphs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("paragraph"), "text", "paper_id")


def extracted_claims(spark, sf):
    c = E.extract_claims(_paragraphs(spark, sf), own_doc="paper_id")
    return c.select("paragraph", "sentence", F.md5("claim").alias("claim_md5"), "citation", "marker")


def uncited_sentences(spark, sf):
    return E.uncited(_paragraphs(spark, sf)).select("paragraph", "sentence", F.size("numbers").alias("numbers"))


def scan_report(spark, sf):
    """How the citations of all documents resolve."""
    s = E.scan(_paragraphs(spark, sf), studies(spark, sf), sections(spark, sf), own_doc="paper_id")
    return s.groupBy("kind", "problem").agg(F.count("*").alias("claims"))


def parsed_props(spark, sf):
    """Events by a property of their JSON column."""
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


def event_windows(spark, sf):
    w = windowed_counts(table(spark, sf, "events"))
    return w.select("event_type", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n", F.round("total", 4).alias("total"))


def sliding_windows(spark, sf):
    w = windowed_counts(table(spark, sf, "events"), width="2 hours", slide="1 hour")
    return w.select("event_type", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n", F.round("total", 4).alias("total"))


def user_sessions(spark, sf):
    """Events of one user with less than an hour between them."""
    s = session_counts(table(spark, sf, "events"), "user_id", gap="1 hour")
    return s.select("user_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("begin"), F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"), "n")


def failure_codes(spark, sf):
    """What is objectively wrong with each saved result, counted by code; locations are looked up in the store."""
    i = items(spark, sf)
    r = records(spark, sf).where("result is not null").select("rec_id", "item_id", "result.*")
    read = _targets(spark, sf).select(F.col("id").alias("item_id"), F.array("text").alias("evidence"))
    results = r.join(read, "item_id").select("rec_id", "verdict", "quote", "location", "evidence", F.lit(False).alias("exhausted"))
    checks = r.select("rec_id", "item_id").join(i.select(F.col("id").alias("item_id"), "claim", "citation"), "item_id").select("rec_id", "claim", "citation", F.lit(False).alias("number_checked"))
    codes = B.failures_of(results, checks, studies(spark, sf), sections(spark, sf), "rec_id")
    return codes.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def rewrite_diffs(spark, sf):
    """Word differences of rewritten claims."""
    i = items(spark, sf).where("original_claim is not null and claim is not null and claim <> original_claim")
    return i.select("item_no", F.md5(D.word_diff(F.col("original_claim"), F.col("claim"))).alias("diff_md5"), D.same_numbers(F.col("original_claim"), F.col("claim")).alias("same_numbers"))


def orders_by_nation(spark, sf):
    """Star schema: revenue and orders of customers by nation and year."""
    o, c, n, line = (table(spark, sf, t) for t in ("orders", "customer", "nation", "lineitem"))
    revenue = line.groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,6)")).alias("revenue"))
    joined = o.join(revenue, o.o_orderkey == revenue.l_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders"), F.round(F.sum("revenue"), 2).cast("double").alias("revenue"))


QUERIES = {f.__name__: f for f in (extracted_claims, uncited_sentences, scan_report, parsed_props, event_windows, sliding_windows, user_sessions, failure_codes, rewrite_diffs, orders_by_nation)}
SQL = {
    "parsed_props": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL",
    "event_windows": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_windows": """
        WITH w AS (SELECT event_type, value, date_trunc('hour', ts) - INTERVAL (u.i) HOUR AS b FROM events, unnest([0, 1]) AS u(i) WHERE ts IS NOT NULL)
        SELECT event_type, strftime(b, '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""",
    "user_sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS begin, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM s GROUP BY user_id, no""",
    "orders_by_nation": """
        WITH r AS (SELECT l_orderkey, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 6))) AS revenue FROM lineitem GROUP BY l_orderkey)
        SELECT n_name, CAST(year(o_orderdate) AS INT) AS y, count(*) AS orders, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue
        FROM orders JOIN r ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
}
