"""Review without a model: audits of tables and cues of overstatement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions import numbers as N
from tabulith.functions.numbers import let


def ascii_words(pattern: str) -> str:
    r"""A pattern whose \b means the edge of a run of ASCII word characters, as in DuckDB."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


# Results depend on these patterns and limits.
DESCRIPTIVE = r"(?i)\b(?:median|IQR|range|min|max|quartile)\b"
RATIO = r"\b(?:a?OR|RR|HR|IRR|aHR|aRR|[Oo]dds|[Hh]azard|[Rr]isk ratio|[Rr]ate ratio|[Rr]atio)\b"
DIFFERENCE = r"(?i)\b(?:difference|diff\.?|change|MD|SMD|β|beta|B|coefficient|effect|estimate|LS ?mean)\b"
P_HEADER = r"(?i)(?:^|[^A-Za-z0-9_])(?:p|p[-\s]?value|sig\.?)(?:[^A-Za-z0-9_]|$)"
P_CELL = r"(?i)^\s*(?:p\s*[=<>]\s*)?([<>≤≥]?)\s*(0?\.\d+|1(?:\.0+)?)\s*[*†‡a-z]*\s*$"
_NUMBER = r"[-−–]?\s?\d+(?:\.\d+)?"
ESTIMATE = rf"(?<![\w.])(?:[A-Za-z]{{1,4}}\s*=\s*)?(\+\s?)?({_NUMBER})\s*[(\[]\s*({_NUMBER})\s*(?:,|;|to|–|—|-(?=\s?\d))\s*({_NUMBER})\s*[)\]]"
COUNT_PERCENT = r"^\s*(\d+)\s*\(\s*(\d+(?:\.\d+)?)\s*%?\s*\)\s*$"
GROUP_SIZE = r"\b[nN]\s*=\s*(\d[\d,]*)"
SPREAD_HEADER = r"(?i)\b(?:mean|SD|median|IQR)\b"
SUBGROUP = r"(?i)\b(?:among|only|of those|subgroup|users|tested)\b"
EDGE, MARGIN, P_HIGH, P_LOW, P_BOUND = 0.011, 0.01, 0.06, 0.04, 0.05
CELLS, SUPPORT, SUPPORT_SHARE, PERCENT_SLACK, MAJOR = 4, 3, 0.6, 0.051, 5.0
P_VALUE = r"(?i)\bp\s*(?:[=<>≤≥]|value\s*(?:of|=)?)\s*(0?\.\d+|1(?:\.0+)?)"
CERTAIN = r"(?i)\b(?:show(?:s|ed|ing|n)?|demonstrat\w*|prov\w*|confirm\w*|establish\w*)\b"
HEDGED = r"(?i)\b(?:suggest\w*|may|might|could|appear\w*|possibl\w*|indicat\w*|trend\w* toward)\b"
SIGNIFICANT = r"(?i)\b(?:statistically\s+)?significan\w*"
NO_DIFFERENCE = r"(?i)\bno\s+(?:\w+\s+)?differen\w*"
NO_SIGNIFICANT_DIFFERENCE = r"(?i)\bno\s+(?:\w+\s+)?significant\s+(?:\w+\s+)?differen"
TREND = r"(?i)\btrend\w*\b"
TREND_QUALIFIED = r"(?i)non-?\s?significant|not\s+(?:statistically\s+)?significant|did not reach"
NOT_SIGNIFICANT_MARK = r"\bNS\b|n\.s\."
TIME_POINT = r"(?i)\b(?:\d+\s*(?:weeks?|months?|days?|years?|hours?|wk|mo)|week\s*\d+|month\s*\d+|day\s*\d+|baseline|follow[- ]?up|post[- ]?(?:test|intervention|op\w*)|pre[- ]?(?:test|intervention|op\w*))\b"
SCOPE = r"(?i)\b(?:overall|at all time ?points|throughout|across all|in all (?:patients|groups|subgroups)|consistently|always|every)\b"
UP = r"(?i)\b(?:higher|greater|larger|more|bigger|superior|better|longer)\b"
DOWN = r"(?i)\b(?:lower|smaller|less|fewer|shorter|inferior|worse)\b"
BETWEEN = r"(?i)\b(?:than|vs\.?|versus|compared (?:with|to)|relative to|over)\b"
CONCEDED = r"(?i)\b(?:numerically|slightly|marginally|non-?\s?significant\w*|not\s+(?:statistically\s+)?significant\w*|did not reach|similar|comparable|trend\w*|no\s+(?:\w+\s+)?differen\w*|insignificant\w*)\b"
SPREAD = r"[±]\s*\d+(?:\.\d+)?|[\[(][^\[\]()]*[,–][^\[\]()]*[\])]"
DECREASE = r"(?i)\b(?:decreas\w*|reduc\w*|fell|fall\w*|drop\w*|declin\w*|lower\w*|loss|lost)\b[^.;]{0,40}$"
INCREASE = r"(?i)\b(?:increas\w*|rose|rise|rising|gain\w*|grew|elevat\w*|rais\w*)\b[^.;]{0,40}$"
CHANGE = r"(?i)\b(increas\w*|decreas\w*|rose|fell|dropped|declined|improved|reduced)\s+(?:\w+\s+){0,2}to\s+[^\d−-]{0,12}([−-]?\d[\d.,]*)"
TIME_SPAN = r"(?i)\b(?:week|month|day|year)s?\s*\d+\b|\b\d+[\s-]*(?:week|month|day|year|hour|minute)s?\b"
NAMED_TIME = r"(?i)\b(?:week|month|day|year)s?\s*\d+\b|\b\d+[\s-]*(?:week|month|day|year)s?\b"
VERSUS = r"(?i)\bvs\.?|versus\b"
P_COLUMN = r"(?i)(?:^|[\s(])p(?:[\s-]*value)?(?![A-Za-z0-9_])|p\s*[<=]"
# End of fixed values.


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(ascii_words(pattern))


def table_cells(sections: DataFrame) -> DataFrame:
    """(section_id, doc_id, label, heading, row_no, cells, header) of each row of each table, notes left out.

    The header is the first row with more than one cell; rows are numbered from 0.
    """
    body = F.split_part(F.col("text"), F.lit("\n\nNotes:"), F.lit(1))
    rows = F.transform(F.split(body, "\n"), lambda r: F.split(r, r" \| "))
    header = F.coalesce(F.get(F.filter(rows, lambda r: F.size(r) > 1), F.lit(0)), F.array(F.lit("")))
    tables = sections.where("kind = 'table' and text is not null")
    return tables.select("section_id", "doc_id", "label", "heading", header.alias("header"), F.posexplode(rows).alias("row_no", "cells"))


def percent_findings(sections: DataFrame) -> DataFrame:
    """Cells "k (x%)" that do not fit their column's usual denominator, and headers that name another one.

    (section_id, col_no, row_no, severity, cell, usual, support, cells); row_no is null for
    a header. All cells of one column are at hand together: a column is part of one text.
    """
    rows = table_cells(sections).where(F.size("cells") == F.size("header"))
    cell = rows.select("section_id", "row_no", "header", F.col("cells")[0].alias("row_label"), F.posexplode("cells").alias("col_no", "cell")).where("col_no > 0")
    head = F.get(F.col("header"), F.col("col_no"))
    k, pct = F.regexp_extract("cell", COUNT_PERCENT, 1).try_cast("bigint"), F.regexp_extract("cell", COUNT_PERCENT, 2)
    found = cell.where(F.col("cell").rlike(COUNT_PERCENT) & ~has(head, SPREAD_HEADER)).select(
        "section_id", "col_no", "row_no", F.trim("cell").alias("cell"), has(F.col("row_label"), SUBGROUP).alias("sub"), k.alias("k"), pct.cast("double").alias("pct"),
        F.when(F.contains(pct, F.lit(".")), F.length(F.substring_index(pct, ".", -1))).otherwise(0).alias("dec"),
        F.regexp_replace(F.regexp_extract(head, ascii_words(GROUP_SIZE), 1), ",", "").try_cast("bigint").alias("size"),
    ).where("k > 0 and pct > 0 and pct < 100")
    column = found.groupBy("section_id", "col_no", "size").agg(F.array_sort(F.collect_list(F.struct("row_no", "k", "pct", "dec", "sub", "cell"))).alias("c")).where(F.size("c") >= CELLS)
    fits = lambda c, d: F.abs(100 * c["k"] / d - c["pct"]) <= 0.5 * F.pow(F.lit(10.0), -c["dec"]) + PERCENT_SLACK
    implied = lambda c: F.floor(100 * c["k"] / c["pct"] + 0.5)

    def best(cells: Column, size: Column) -> Column:
        candidates = F.array_distinct(F.concat(F.transform(cells, implied), F.when(size.isNotNull(), F.array(size)).otherwise(F.array().cast("array<bigint>"))))
        ranked = F.transform(candidates, lambda d, i: F.struct(F.size(F.filter(cells, lambda c: (c["k"] <= d) & fits(c, d))).alias("support"), (F.coalesce(d == size, F.lit(False))).alias("declared"), (-i).alias("first"), d.alias("usual")))
        return F.array_max(ranked)

    chosen = column.withColumn("b", let(F.col("c"), lambda c: best(c, F.col("size")))).select("section_id", "col_no", "size", "c", "b.usual", "b.support")
    chosen = chosen.where((F.col("support") >= SUPPORT) & (F.col("support") >= SUPPORT_SHARE * F.size("c")))
    declared_other = F.coalesce((F.col("size") > 0) & (F.col("size") != F.col("usual")), F.lit(False))
    usual, size = F.col("usual"), F.col("size")

    def isolated(cells: Column) -> Column:
        odd = lambda c: ~fits(c, usual)
        near = lambda i, d: F.exists(F.filter(F.array(F.when(i > 0, F.get(cells, i - 1)), F.get(cells, i + 1)), lambda n: n.isNotNull()), lambda n: odd(n) & fits(n, d))
        return F.filter(cells, lambda c, i: odd(c) & ~((c["k"] > usual) & ~size.eqNullSafe(usual)) & ~c["sub"] & ~near(i, implied(c)))

    header = chosen.where(declared_other).select("section_id", "col_no", F.lit(None).cast("int").alias("row_no"), F.lit("major").alias("severity"), F.lit(None).cast("string").alias("cell"), "usual", "support", F.size("c").alias("cells"))
    off = chosen.where(~declared_other).withColumn("odd", F.explode(let(F.col("c"), isolated)))
    single = off.select("section_id", "col_no", F.col("odd.row_no").alias("row_no"), F.when(F.abs(100 * F.col("odd.k") / usual - F.col("odd.pct")) > MAJOR, F.lit("major")).otherwise(F.lit("minor")).alias("severity"), F.col("odd.cell").alias("cell"), "usual", "support", F.size("c").alias("cells"))
    return header.unionByName(single)


def interval_findings(sections: DataFrame) -> DataFrame:
    """Estimates outside their own interval, and intervals that disagree with the p-value of their row.

    (section_id, row_no, col_no, code, estimate). Descriptive rows are passed over.
    """
    rows = table_cells(sections)
    label = F.col("cells")[0]
    line = F.array_join("cells", " | ")
    descriptive = has(label, DESCRIPTIVE) | (has(F.col("heading"), DESCRIPTIVE) & ~has(line, RATIO) & ~has(line, DIFFERENCE))
    rows = rows.where(~descriptive)
    p_column = F.array_position(F.transform("header", lambda h: h.rlike(P_HEADER)), True) - 1
    cell = rows.withColumn("p_column", p_column).select("*", F.posexplode("cells").alias("col_no", "cell"))
    one = cell.select("*", F.explode(F.regexp_extract_all("cell", F.lit(r"(?<!±)(?<!±\s)" + ESTIMATE), F.lit(0))).alias("estimate"))
    number = lambda g: F.regexp_replace(F.regexp_replace(F.regexp_extract("estimate", ESTIMATE, g), "[−–]", "-"), r"\s+", "").try_cast("double")
    head = F.coalesce(F.get(F.col("header"), F.col("col_no")), F.lit(""))
    e = one.withColumns({"est": number(2), "a": number(3), "b": number(4), "head": head}).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    effect = F.concat_ws(" ", label, "head", "heading")
    e = e.where(~(F.contains(F.col("estimate"), F.lit("[")) & ~has(effect, r"\bCI\b|(?i)confidence") & ~has(effect, RATIO)))
    slack = EDGE * F.greatest(F.lit(1.0), F.abs("est"))
    outside = (F.col("est") < F.col("lo") - slack) | (F.col("est") > F.col("hi") + slack)
    context = F.concat_ws(" ", label, "head", "cell")
    zero = F.when(has(context, RATIO) & (F.col("a") > 0) & (F.col("b") > 0) & (F.col("est") > 0), F.lit(1.0)).when(has(context, DIFFERENCE), F.lit(0.0))
    own_p = F.get(F.filter("cells", lambda c, i: (i > F.col("col_no")) & c.rlike(P_CELL)), F.lit(0))
    p_text = F.when(F.col("p_column") > 0, F.get(F.col("cells"), F.col("p_column").cast("int"))).otherwise(own_p)
    e = e.withColumns({"outside": outside, "zero": zero, "p_text": p_text}).withColumns({"bound": F.regexp_extract("p_text", P_CELL, 1), "p": F.regexp_extract("p_text", P_CELL, 2).try_cast("double")})
    excludes = (F.col("lo") > F.col("zero")) | (F.col("hi") < F.col("zero"))
    clear = F.least(F.abs(F.col("lo") - F.col("zero")), F.abs(F.col("hi") - F.col("zero"))) > MARGIN * F.greatest(F.lit(1.0), F.abs("zero"))
    below = F.col("bound").startswith("<")
    disagrees = clear & ((excludes & ~below & (F.col("p") > P_HIGH)) | (~excludes & F.when(below, F.col("p") <= P_BOUND).otherwise(F.col("p") < P_LOW)))
    code = F.when(F.col("outside"), F.lit("estimate_outside_ci")).when(disagrees, F.lit("ci_p_disagree"))
    return e.withColumn("code", code).where("code is not null").select("section_id", "row_no", "col_no", "code", F.trim("estimate").alias("estimate"))


def p_values(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ascii_words(P_VALUE)), F.lit(1)), lambda p: p.try_cast("double"))


def _before_after(claim: Column) -> tuple[Column, Column]:
    """The text before and after the first comparison word."""
    parts = F.split(claim, ascii_words(BETWEEN), 2)
    return F.when(F.size(parts) == 2, parts[0]), F.when(F.size(parts) == 2, parts[1])


def changed_wrongly(claim: Column) -> Column:
    """Whether a claim's word of change contradicts the value it goes to and the last one named before."""
    word, target = F.regexp_extract(claim, ascii_words(CHANGE), 1), N.informative(F.regexp_extract(claim, ascii_words(CHANGE), 2))
    before = F.regexp_extract(claim, "(?s)^(.*?)" + ascii_words(CHANGE), 1)
    earlier = N.informative(F.regexp_replace(F.regexp_replace(before, ascii_words(TIME_SPAN), " "), SPREAD, " "))
    start, end = F.element_at(earlier, -1)["value"], F.get(target, F.lit(0))["value"]
    wrong = F.when(word.rlike("(?i)increas|rose"), end < start).otherwise(end > start)
    return F.coalesce((word != "") & ~word.rlike("(?i)improved|reduced") & (F.size(earlier) > 0) & (F.size(target) > 0) & wrong, F.lit(False))


def comparison_direction(claim: Column) -> Column:
    """Whether a claim's comparative word contradicts the two values that it gives itself.

    The values stand on both sides of the comparison, or both after it with "vs" between.
    """
    up, down = has(claim, UP), has(claim, DOWN)
    before, after = _before_after(claim)
    values = lambda t: N.informative(F.regexp_replace(t, SPREAD, " "))
    late = F.split(after, ascii_words(VERSUS), 2)
    apart = F.size(values(before)) > 0
    left = F.when(apart, values(before)).when(F.size(late) == 2, values(late[0]))
    right = F.when(apart, values(after)).when(F.size(late) == 2, values(late[1]))
    a, b = F.element_at(left, -1)["value"], F.get(right, F.lit(0))["value"]
    wrong = F.when(up, a < b).otherwise(a > b)
    return F.coalesce((up != down) & (F.size(left) > 0) & (F.size(right) > 0) & (a >= 0) & (b >= 0) & (a != b) & wrong, F.lit(False))


def time_points(text: Column) -> Column:
    """Time points of a text, as "week 12"."""
    found = F.regexp_extract_all(text, F.lit(ascii_words(NAMED_TIME)), F.lit(0))
    return F.transform(found, lambda m: F.concat(F.lower(F.regexp_extract(m, "(?i)(week|month|day|year)", 1)), F.lit(" "), F.regexp_extract(m, r"(\d+)", 1)))


def comparison_nonsignificant(claim: Column, source: Column) -> Column:
    """Whether a comparison stated as fact stands on table rows whose p-values are all above 0.05.

    The rows are those that hold every informative number of the claim, or, for a claim
    without one, those whose first cell names a time point of the claim.
    """
    lines = F.filter(F.split(source, "\n"), lambda line: F.contains(line, F.lit("|")))
    split = lambda line: F.transform(F.split(line, r"\|"), F.trim)
    wanted = F.transform(N.informative(claim), lambda n: n["norm"])
    numbered = F.size(N.informative(claim)) > 0

    def check(ls: Column) -> Column:
        header = split(ls[0])
        columns = F.transform(header, lambda h: h.rlike(P_COLUMN))
        p_of = lambda cell: F.get(N.numbers_in(F.regexp_replace(cell, r"^[<>≤≥=\s]+", "")), F.lit(0))["value"]
        named = lambda line: F.arrays_overlap(time_points(F.coalesce(F.get(split(line), F.lit(0)), F.lit(""))), time_points(claim))
        holds = lambda line: F.when(numbered, let(F.transform(N.informative(line), lambda n: n["norm"]), lambda own: F.forall(wanted, lambda w: F.array_contains(own, w) | F.array_contains(own, N.unsigned(w))))).otherwise(named(line))
        row_ps = lambda line: let(
            split(line), lambda cells: F.when(F.size(cells) == F.size(header), F.filter(F.transform(cells, lambda c, i: F.when(F.coalesce(F.get(columns, i), F.lit(False)), p_of(c))), lambda p: p.between(0, 1))).otherwise(F.array().cast("array<double>"))
        )
        ps = F.flatten(F.transform(F.filter(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))), holds), row_ps))
        return let(ps, lambda x: (F.size(x) > 0) & F.forall(x, lambda p: p > 0.05))

    asked = (has(claim, UP) != has(claim, DOWN)) & has(claim, BETWEEN) & ~has(claim, CONCEDED) & ~F.exists(p_values(claim), lambda p: p <= 0.05)
    return F.when(asked & (F.size(lines) >= 2) & (numbered | (F.size(time_points(claim)) > 0)), let(lines, check)).otherwise(F.lit(False))


#: What each cue says to whoever answers it.
CUE_MESSAGES = {
    "absolute_no_difference": "the claim says that there is no difference at all; a source can seldom show more than that none was significant",
    "certainty_on_nonsignificant": "the claim is worded as certain, but its own p-value is above 0.05",
    "unqualified_trend": "the claim speaks of a trend without saying that it was not significant",
    "scope_dropped": "the claim speaks of all times, but the source reports several time points",
    "comparison_direction": "the claim's word of direction does not go with the values that it gives",
    "comparison_nonsignificant": "the claim states a difference as a fact, but the p-values of its row are not significant",
}


def cue_messages(codes: Column) -> Column:
    """Messages of cue codes, in their order."""
    known = F.create_map(*(F.lit(x) for kv in CUE_MESSAGES.items() for x in kv))
    return F.transform(codes, lambda c: known[c])


def cues(claim: Column, source: Column) -> Column:
    """Codes of the ways in which a claim may say more than its source, in fixed order."""
    source_p = p_values(source)
    times = F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(ascii_words(TIME_POINT)), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))))
    trend_open = F.exists(source_p, lambda p: p > 0.05) | has(source, NOT_SIGNIFICANT_MARK) | (F.size(source_p) == 0)
    codes = F.array(
        F.when(has(claim, NO_DIFFERENCE) & ~has(claim, NO_SIGNIFICANT_DIFFERENCE), F.lit("absolute_no_difference")),
        F.when(F.exists(p_values(claim), lambda p: p > 0.05) & has(claim, CERTAIN) & ~has(claim, HEDGED), F.lit("certainty_on_nonsignificant")),
        F.when(has(claim, TREND) & ~has(claim, TREND_QUALIFIED) & ~has(claim, SIGNIFICANT) & trend_open, F.lit("unqualified_trend")),
        F.when(has(claim, SCOPE) & ~has(claim, TIME_POINT) & (F.size(times) >= 2), F.lit("scope_dropped")),
        F.when(changed_wrongly(claim) | comparison_direction(claim), F.lit("comparison_direction")),
        F.when(comparison_nonsignificant(claim, source), F.lit("comparison_nonsignificant")),
    )
    return F.array_compact(codes)


def sign_conflicts(claims: DataFrame, key: str, claim: str, source: str) -> DataFrame:
    """(key, number, direction, source_number): numbers whose direction contradicts an explicit sign in the source.

    The text before a number tells its direction, so a claim is cut at its numbers.
    """
    signed = F.transform(F.regexp_extract_all(F.col(source), F.lit(r"(?<![\w.])([+\-−])\s?(\d+(?:\.\d+)?)"), F.lit(0)), lambda s: F.struct(s.alias("raw"), F.when(s.startswith("+"), 1).otherwise(-1).alias("sign"), N.unsigned(N.parse(F.regexp_replace(s, r"[+\s]", ""))["norm"]).alias("norm")))
    raws = F.regexp_extract_all(F.col(claim), F.lit(N.NUMBER), F.lit(0))
    pieces = F.split(F.col(claim), N.NUMBER)
    rows = claims.select(F.col(key), signed.alias("signed"), pieces.alias("pieces"), raws.alias("raws")).select("*", F.posexplode("raws").alias("i", "raw"))
    before = F.col("before")
    joined = F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(""), lambda a, j: F.concat(a, F.get(F.col("pieces"), j), F.when(j < F.col("i"), F.get(F.col("raws"), j)).otherwise(F.lit(""))))
    rows = rows.withColumn("before", joined).withColumn("n", N.parse(F.col("raw"))).where(F.size(N.informative(F.col("raw"))) > 0)
    direction = F.when(F.col("raw").rlike("^[-−]"), -1).when(before.rlike(r"\+\s?$"), 1).when(before.rlike(ascii_words(DECREASE)), -1).when(before.rlike(ascii_words(INCREASE)), 1)
    matches = F.filter("signed", lambda s: s["norm"] == N.unsigned(F.col("n.norm")))
    rows = rows.withColumn("direction", direction).withColumn("matches", matches).where("direction is not null and size(matches) > 0")
    rows = rows.where(~F.exists("matches", lambda s: s["sign"] == F.col("direction")))
    return rows.select(key, F.col("raw").alias("number"), F.when(F.col("direction") < 0, F.lit("decrease")).otherwise(F.lit("increase")).alias("direction"), F.col("matches")[0]["raw"].alias("source_number"))
