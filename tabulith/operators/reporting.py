"""Reports on check runs and documents: first attempts, tool use, planted errors, fixes, issues at citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions import numbers as N
from tabulith.functions import text as X
from tabulith.functions.stats import rate
from tabulith.operators import reviewing as V
from tabulith.operators import scoring as S

# Planted errors, and how much of a list is shown.
PLANTED_PERCENT = r"\| (\d{2,}) \((\d+(?:\.\d+)?)%?\)"
PLANTED_INTERVAL = r"(-?\d+\.\d+) ?\((-?\d+\.\d+), ?(-?\d+\.\d+)\)"
PLANTED_ROWS_FROM = 2
SHOWN_FINDINGS = 40
# End of fixed values.


def same_location(location: Column, target: Column) -> Column:
    """Whether a location (doc, table, section) is the target or lies in it; a target that is a whole document holds all of it."""
    table = F.lower(location["table"]) == F.lower(target["table"])
    section = X.id_key(location["section"]) == X.id_key(target["section"])
    inside = F.when(target["table"].isNotNull(), F.coalesce(table, F.lit(False))).when(target["section"].isNotNull(), F.coalesce(section, F.lit(False))).otherwise(F.lit(True))
    return F.coalesce((location["doc"] == target["doc"]) & inside, F.lit(False))


def location(text: Column, default: Column) -> Column:
    """Struct (doc, table, section) of a written location; the document defaults."""
    table = X.table_in(text)
    section = F.when(table.isNull(), F.nullif(X.section_in(text), F.lit("")))
    return F.struct(F.coalesce(X.document_in(text), default).alias("doc"), table.alias("table"), section.alias("section"))


def location_suggestions(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, right, n, value): of wrong targets whose true table is known from their mutation, how many suggestions name it.

    rows: (by, label, mutation, citation, source_paper, suggested). Failed checks are left out before.
    """
    truth = X.extract(F.col("mutation"), r"^Table (\S+) ->", 1)
    cited = X.document_in(F.col("citation"))
    known = rows.where((F.col("label") == "wrong_target") & truth.isNotNull())
    target = F.struct(F.coalesce("source_paper", cited).alias("doc"), truth.alias("table"), F.lit(None).cast("string").alias("section"))
    right = same_location(location(F.coalesce("suggested", F.lit("")), cited), target)
    return known.groupBy(*by).agg(F.count_if(right).alias("right"), F.count("*").alias("n")).withColumn("value", rate(F.col("right"), F.col("n")))


def first_attempts(rows: DataFrame) -> DataFrame:
    """Rows with the verdict of their first attempt where there were several; `retried` tells which."""
    again = F.coalesce(F.size("attempts") > 1, F.lit(False))
    return rows.withColumn("verdict", F.when(again, F.get("attempts", F.lit(0))["verdict"]).otherwise(F.col("verdict"))).withColumn("retried", again)


def report(rows: DataFrame, overrides: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of three readings one below the other: scope 'raw', 'adjusted' by reviewed labels, 'first attempt'.

    rows as scored() gives them, with attempts where runs have them. Runs without an applied
    override have no 'adjusted' row, and runs without retries no 'first attempt' row.
    """
    raw = S.summary(rows, by).withColumn("scope", F.lit("raw"))
    reviewed = S.apply_overrides(rows, overrides)
    applied = reviewed.where("override = 'applied'").select(*by).distinct()
    out = raw.unionByName(S.summary(reviewed, by).join(applied, by, "left_semi").withColumn("scope", F.lit("adjusted")))
    if "attempts" in rows.columns:
        firsts = first_attempts(rows)
        retried = firsts.where("retried").select(*by).distinct()
        out = out.unionByName(S.summary(firsts, by).join(retried, by, "left_semi").withColumn("scope", F.lit("first attempt")))
    return out


def agent_report(runs: DataFrame, by: str = "run_name") -> DataFrame:
    """Per run: tool calls (mean, p95, most), peaks, use per tool and check, failures by code, retries and flips.

    runs: (by, verdict, trace) with trace as in schemas.TRACE; runs without any trace give no row.
    """
    traced = runs.where("trace is not null")
    flag = lambda v: v != "supported"
    attempts = F.col("trace.attempts")
    first, again = flag(F.get(attempts, F.lit(0))["result"]["verdict"]), F.coalesce(F.size(attempts) > 1, F.lit(False)) & F.col("verdict").isNotNull()
    last_failures = F.size(F.coalesce(F.element_at(attempts, -1)["failures"], F.array().cast("array<struct<code:string,message:string>>")))
    basic = traced.groupBy(by).agg(
        F.count("*").alias("checks_with_tools"), F.avg("trace.toolCalls").alias("avg_tool_calls"), F.max("trace.toolCalls").alias("max_tool_calls"), F.count_if("trace.budgetExhausted").alias("budget_exhausted"),
        F.avg("trace.peakPromptTokens").alias("avg_peak_prompt_tokens"), F.max("trace.peakPromptTokens").alias("max_peak_prompt_tokens"), F.count_if(F.coalesce(F.size(attempts) > 1, F.lit(False))).alias("retried"),
        F.count_if(F.coalesce(last_failures > 0, F.lit(False)) & (F.size(attempts) > 0)).alias("unresolved"), F.count_if(again & first & ~flag(F.col("verdict"))).alias("flag_to_pass"), F.count_if(again & ~first & flag(F.col("verdict"))).alias("pass_to_flag"),
    )
    ranks = S.latency_ranks(traced.select(by, F.col("trace.toolCalls").alias("latency_ms")), [by]).select(by, F.col("p95").alias("p95_tool_calls"))
    checks = runs.groupBy(by).agg(F.count("*").alias("checks"))
    use = traced.select(by, F.explode("trace.steps").alias("s")).groupBy(by, "s.tool").agg(F.count("*").alias("k"))
    use = use.join(basic.select(by, "checks_with_tools"), by).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", (F.col("k") / F.col("checks_with_tools")).alias("v"))))).alias("tool_use"))
    codes = traced.select(by, F.explode(F.flatten(F.transform(attempts, lambda a: a["failures"]))).alias("f")).groupBy(by, "f.code").agg(F.count("*").alias("v"))
    codes = codes.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "v")))).alias("failures"))
    return basic.join(ranks, by, "left").join(checks, by).join(use, by, "left").join(codes, by, "left")


def model_decided(rows: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """(by, bad, bad_flagged, good, good_flagged) over the items that code alone does not decide. decided: (item_id)."""
    rest = rows.where("verdict is not null").join(decided.select("item_id").distinct(), "item_id", "left_anti")
    bad, flag = F.coalesce(F.col("label") != "supported", F.lit(False)), S.is_flag(F.col("verdict"))
    return rest.groupBy(*by).agg(F.count_if(bad).alias("bad"), F.count_if(bad & flag).alias("bad_flagged"), F.count_if(F.col("label") == "supported").alias("good"), F.count_if((F.col("label") == "supported") & flag).alias("good_flagged"))


def findings(sections: DataFrame) -> DataFrame:
    """(section_id, doc_id, label, code, severity, row_no) of all audits of tables."""
    percent, interval = V.percent_findings(sections), V.interval_findings(sections)
    own = sections.select("section_id", "doc_id", "label")
    both = percent.select("section_id", F.lit("percent_mismatch").alias("code"), "severity", "row_no").unionByName(interval.select("section_id", "code", F.lit("major").alias("severity"), "row_no"))
    return both.join(own, "section_id").select("section_id", "doc_id", "label", "code", "severity", "row_no")


def shown(found: DataFrame, most: int = SHOWN_FINDINGS) -> DataFrame:
    """The first findings: major ones first, then in the order of sections and rows."""
    return found.orderBy(F.col("severity") != "major", "section_id", F.asc_nulls_first("row_no"), "code").limit(most)


def issues_at(cited: DataFrame, found: DataFrame, key: str, citation: str) -> DataFrame:
    """(key, section_id, code, severity, row_no): findings at the place that a citation begins with.

    As "DOC, Table 1" begins "DOC, Table 14" too, findings of Table 1 come with it: results
    are those of the plain beginning. Places meet by equality: a citation brings its beginnings.
    """
    places = found.withColumn("place", F.concat_ws(", ", "doc_id", "label")).where("doc_id is not null and label is not null")
    longest = places.agg(F.max(F.length("place")), F.min(F.length("place"))).first()
    low, high = longest[1] or 1, longest[0] or 0
    sizes = F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length(citation))))
    begun = cited.where(F.col(citation).isNotNull()).select(key, F.explode(F.array_distinct(F.transform(sizes, lambda n: F.substring(citation, F.lit(1), n)))).alias("place"))
    return begun.join(places, "place").select(key, "section_id", "code", "severity", "row_no").distinct()


def check_report(checked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, flagged, decided_by, place, issues): flags first, of these what code decided, then passes; order is in place.

    checked: (key, citation, verdict, decided_by).
    """
    from pyspark.sql import Window

    issues = issues_at(checked, found, key, "citation").groupBy(key).agg(F.count("*").alias("issues"))
    rows = checked.join(issues, key, "left").select(key, S.is_flag(F.col("verdict")).alias("flagged"), "decided_by", F.coalesce("issues", F.lit(0)).alias("issues"))
    block = F.when(F.col("flagged") & (F.col("decided_by") == "code"), 0).when(F.col("flagged"), 1).otherwise(2)
    return rows.withColumn("block", block).withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(key)))


def plant(sections: DataFrame) -> DataFrame:
    """Tables with one planted error each: (planted, and the columns of sections), a row for each kind that a table allows.

    'percent': the first cell "k (x%)" with k of two digits, from the third line on, gets 1.4 k + 1;
    'interval': the first estimate with an interval moves beyond its upper end.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    texts = sections.where("kind = 'table'").withColumn("lines", lines)
    first = lambda test: F.array_position(F.transform("lines", test), True)
    percent = first(lambda line, i: (i >= PLANTED_ROWS_FROM) & line.rlike(PLANTED_PERCENT))
    # an estimate after ± is a spread, not an estimate
    interval = first(lambda line, i: line.rlike(PLANTED_INTERVAL) & ~F.regexp_extract(line, rf"^(.*?){PLANTED_INTERVAL}", 1).rlike(r"±\s*$"))

    def with_line(at: Column, change) -> Column:
        return F.array_join(F.transform("lines", lambda line, i: F.when(i == at - 1, change(line)).otherwise(line)), "\n")

    def more(line: Column) -> Column:
        k, share = F.regexp_extract(line, PLANTED_PERCENT, 1), F.regexp_extract(line, PLANTED_PERCENT, 2)
        grown = (F.floor(k.cast("double") * 1.4 + 0.5) + 1).cast("bigint").cast("string")
        return F.concat(F.regexp_extract(line, rf"^(.*?){PLANTED_PERCENT}", 1), F.lit("| "), grown, F.lit(" ("), share, F.lit(")"), F.regexp_extract(line, rf"^.*?{PLANTED_PERCENT}(.*)$", 3))

    def beyond(line: Column) -> Column:
        a, b = (F.regexp_extract(line, PLANTED_INTERVAL, g) for g in (2, 3))
        low, high = F.least(a.cast("double"), b.cast("double")), F.greatest(a.cast("double"), b.cast("double"))
        return F.concat(F.regexp_extract(line, rf"^(.*?){PLANTED_INTERVAL}", 1), F.format_string("%.2f", high + (high - low) + 0.5), F.lit(" ("), a, F.lit(", "), b, F.lit(")"), F.regexp_extract(line, rf"^.*?{PLANTED_INTERVAL}(.*)$", 4))

    kinds = F.array(F.when(percent > 0, F.struct(F.lit("percent").alias("planted"), with_line(percent, more).alias("text"))), F.when(interval > 0, F.struct(F.lit("interval").alias("planted"), with_line(interval, beyond).alias("text"))))
    made = texts.withColumn("m", F.explode(F.array_compact(kinds))).drop("lines", "text")
    return made.select("m.planted", *(c if c != "text" else F.col("m.text").alias("text") for c in sections.columns))


def planted_recall(sections: DataFrame) -> DataFrame:
    """(planted, found, n): planted errors after which the audit of the table finds more than before."""
    made = plant(sections).withColumn("own_", F.col("section_id")).withColumn("section_id", F.xxhash64("section_id", "planted"))
    before = findings(sections).groupBy("section_id").agg(F.count("*").alias("before")).withColumnRenamed("section_id", "own_")
    after = findings(made.drop("planted", "own_")).groupBy("section_id").agg(F.count("*").alias("after"))
    both = made.select("planted", "own_", "section_id").join(before, "own_", "left").join(after, "section_id", "left")
    return both.groupBy("planted").agg(F.count_if(F.coalesce("after", F.lit(0)) > F.coalesce("before", F.lit(0))).alias("found"), F.count("*").alias("n"))


def fix_scores(fixes: DataFrame) -> DataFrame:
    """(error_type, n, offered, restored, citation_fixes, citation_right, pointers) of suggested fixes; error_type null for all.

    fixes: (error_type, original_claim, mutation, source_paper, fix_text, fix_citation, candidates). A fix of wording restores if its numbers are those
    of the original claim, one of a citation if it ends with the true table or begins with the true paper.
    """
    norms = lambda t: F.array_sort(F.transform(N.informative(t), lambda n: N.unsigned(n["norm"])))
    table = X.extract(F.col("mutation"), r"^Table (\S+) ->", 1)
    right = F.when(table.isNotNull(), F.col("fix_citation").endswith(F.concat(F.lit("Table "), table))).otherwise(F.col("fix_citation").startswith(F.coalesce("source_paper", F.lit("?"))))
    cites, words = F.col("fix_citation").isNotNull(), F.col("fix_citation").isNull() & F.col("fix_text").isNotNull()
    restored = F.when(cites, right).when(words, norms(F.col("fix_text")) == norms(F.col("original_claim"))).otherwise(F.lit(False))
    pointer = ~cites & ~words & F.coalesce(F.size("candidates") > 0, F.lit(False))
    flagged = fixes.select("error_type", cites.alias("c"), words.alias("w"), F.coalesce(restored, F.lit(False)).alias("r"), pointer.alias("p"))
    tallies = [F.count("*").alias("n"), F.count_if(F.col("c") | F.col("w")).alias("offered"), F.count_if("r").alias("restored"), F.count_if("c").alias("citation_fixes"), F.count_if(F.col("c") & F.col("r")).alias("citation_right"), F.count_if("p").alias("pointers")]
    return flagged.groupBy("error_type").agg(*tallies).unionByName(flagged.agg(F.lit(None).cast("string").alias("error_type"), *tallies))


def suggestion_accuracy(claims: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(asked, answered, right): claims with a known place whose numbers alone are asked for it.

    claims: (key, own, claim, place); places: (norm, doc_id, label).
    """
    from tabulith.operators.evidence import suggest

    asked = claims.where(F.size(N.informative(F.col("claim"))) > 0)
    both = asked.select(key, "place").join(suggest(asked, places, key), key, "left")
    return both.agg(F.count("*").alias("asked"), F.count("pick").alias("answered"), F.count_if(F.coalesce(F.array_contains("pick", F.col("place")), F.lit(False))).alias("right"))


def table_recall(xml_tables: DataFrame, page_tables: DataFrame) -> DataFrame:
    """(id, number, found, numbers, recall, xml_rows, page_rows) of tables read from pages against those of the article.

    Both: (id, number, rows array<string>, foot). A table without numbers has recall 1 if it was found.
    """
    from tabulith.operators.building import build_informative

    text = F.concat_ws(" ", F.array_join("rows", "\n"), F.coalesce("foot", F.lit("")))
    a = xml_tables.select("id", "number", F.array_distinct(build_informative(text)).alias("wanted"), F.size("rows").alias("xml_rows"))
    b = page_tables.select("id", "number", F.array_distinct(build_informative(F.array_join("rows", "\n"))).alias("got"), F.size("rows").alias("page_rows"))
    both = a.join(b, ["id", "number"], "left")
    hit = F.size(F.array_intersect("wanted", "got")) / F.size("wanted")
    recall = F.when(F.col("got").isNull(), F.lit(0.0)).when(F.size("wanted") == 0, F.lit(1.0)).otherwise(hit)
    return both.select("id", "number", F.col("got").isNotNull().alias("found"), F.size("wanted").alias("numbers"), recall.alias("recall"), "xml_rows", "page_rows")


def table_recall_totals(scores: DataFrame) -> DataFrame:
    """One row: tables, found, exact (recall of at least 0.999), good (0.9), and the mean recall of found ones."""
    found = F.col("found")
    return scores.agg(F.count("*").alias("tables"), F.count_if(found).alias("found"), F.count_if(found & (F.col("recall") >= 0.999)).alias("exact"), F.count_if(found & (F.col("recall") >= 0.9)).alias("good"), F.avg(F.when(found, F.col("recall"))).alias("mean_recall"))


def extraction_misses(extracted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(key, sentence, citation, kind): 'missed' citations that are true but not found, 'extra' ones the other way round."""
    columns = [key, "sentence", "citation"]
    a, b = extracted.select(*columns).distinct(), truth.select(*columns).distinct()
    return b.join(a, columns, "left_anti").withColumn("kind", F.lit("missed")).unionByName(a.join(b, columns, "left_anti").withColumn("kind", F.lit("extra")))


def percent_text(value: Column, places: int = 1) -> Column:
    """A share as text, '-' without one."""
    return F.coalesce(F.concat(F.format_string(f"%.{places}f", value * 100), F.lit("%")), F.lit("-"))


def rate_text(value: Column, n: Column, low: Column, high: Column) -> Column:
    """A rate with its interval and its n as text."""
    return F.when(n > 0, F.format_string("%s [%s, %s] (n=%s)", percent_text(value), percent_text(low), percent_text(high), n)).otherwise(F.lit("-"))
