"""Scoring, resolving, audits, cues and edits on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.operators import building as G
from tabulith.operators import evidence as E
from tabulith.operators import resolving as R
from tabulith.operators import retrieval as I
from tabulith.operators import reviewing as V
from tabulith.operators import scoring as S
from tabulith.sources.tables import latest

SECTIONS = "section_id bigint, doc_id string, pos int, label string, heading string, kind string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_latest_counts_redelivered_rows_once(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "2024-01-02"), (2, "c", None), (None, "d", "2024-01-01")], "k int, v string, at string").withColumn("at", F.to_timestamp("at"))
    assert rows(latest(df, "k", "at").select("k", "v")) == [(1, "b"), (2, "c")]


def _scored(spark, data):
    schema = "rec_id bigint, run_name string, item_id string, label string, verdict string, quote_grounded boolean, usage struct<prompt_tokens:bigint, cost_usd:double>, latency_ms bigint, claim string, citation string"
    return spark.createDataFrame(data, schema)


def test_summary(spark):
    u = (10, 0.5)
    data = [(1, "r", "a", "supported", "supported", True, u, 5, "c", "x"), (2, "r", "b", "supported", "wrong_target", None, u, 1, "c", "x"), (3, "r", "c", "not_supported", "not_supported", False, u, 9, "c", "x"), (4, "r", "d", "wrong_target", None, None, None, None, "c", "x")]
    s = S.summary(_scored(spark, data), ["run_name"]).first()
    assert (s["n"], s["failed"], s["tp"], s["fn"], s["fp"], s["tn"]) == (4, 1, 1, 0, 1, 1)
    assert s["catch_rate"] == 1.0 and s["false_alarm_rate"] == 0.5 and s["flag_precision"] == 0.5 and s["quote_grounded"] == 0.5
    assert s["total_cost"] == 1.5 and s["p50"] == 5.0 and s["p95"] == 9.0
    assert S.summary(_scored(spark, []), ["run_name"]).count() == 0
    dense = S.confusion(_scored(spark, data), ["run_name"])
    assert dense.count() == 9 and dense.agg(F.sum("n")).first()[0] == 3


def test_overrides(spark):
    rows_ = spark.createDataFrame([("a", "supported", "c", "x"), ("b", "supported", "c", "x"), ("c", "supported", "c", "x"), ("d", "supported", None, "x")], "item_id string, label string, claim string, citation string")
    o = spark.createDataFrame([("a", "not_supported", None, "x"), ("b", "not_supported", "old", None), ("c", "supported", "old", None), ("d", "wrong_target", "c", None)], "id string, label string, claim string, citation string")
    got = {r["item_id"]: (r["label"], r["override"]) for r in S.apply_overrides(rows_, o).collect()}
    assert got == {"a": ("not_supported", "applied"), "b": ("supported", "stale"), "c": ("supported", None), "d": ("supported", "stale")}


def test_escalation_reasons(spark):
    df = spark.createDataFrame([("wrong_target", "cue", True, "low"), ("supported", "cue", True, "low"), ("supported", "", True, "low"), ("supported", None, False, "low"), ("supported", None, False, "high")], "v string, c string, j boolean, f string")
    reason = lambda o: [r[0] for r in df.select(S.escalation_reason(F.col("v"), F.col("c"), F.col("j"), F.col("f"), o)).collect()]
    assert reason({"flags", "cues", "judgment", "lowconf"}) == ["flag", "pass despite cues", "judgment claim", "low-confidence pass", None]
    assert reason({"passes"}) == [None, "pass", "pass", "pass", "pass"]
    assert reason(set()) == [None] * 5


@pytest.fixture(scope="module")
def store(spark):
    studies = spark.createDataFrame([("PMC1", "One", ["Trial A-7"]), ("CSR-XY12", "Two", None), ("CSR-XY1", "Three", [])], "id string, title string, aliases array<string>")
    sections = spark.createDataFrame([(1, "PMC1", 0, "Table 1", "Base", "table", "a | b"), (2, "PMC1", 1, "Table 12", "More", "table", "c | d"), (3, "PMC1", 2, "Supplementary Table S2", "Sup", "table", "e"), (4, "CSR-XY12", 0, "Table 14.2.1", "Main", "table", "ff"), (5, "CSR-XY12", 1, "Table 14.2.1", "Again", "table", "gg")], SECTIONS)
    return studies, sections


@pytest.mark.parametrize(
    ("citation", "kind", "doc", "ids"),
    [
        ("PMC1, Table 1", "section", "PMC1", [1]), ("PMC1, Table 12", "section", "PMC1", [2]), ("PMC1, Table 2", "missing", "PMC1", None), ("Trial A 7, Table S2", "section", "PMC1", [3]),
        ("csr xy12, Table 14.2.1", "section", "CSR-XY12", [4]), ("CSR-XY12, Tables 14.2.1 and 14.2.2", "missing", "CSR-XY12", None), ("CSR-XY12, Section 5", "document", "CSR-XY12", None), ("PMC1", "document", "PMC1", None),
        ("CSR-ZZ9, Table 1", "missing", None, None), ("Table 1", "missing", None, None), ("", "missing", None, None),
    ],
)
def test_resolving(spark, store, citation, kind, doc, ids):
    studies, sections = store
    cited = spark.createDataFrame([(1, citation), (2, None)], "item_no bigint, citation string")
    r = {x["item_no"]: x for x in R.resolve(cited, "item_no", "citation", studies, sections).collect()}
    assert (r[1]["kind"], r[1]["doc_id"], r[1]["section_ids"]) == (kind, doc, ids)
    assert r[2]["kind"] == "missing"


def test_search_ranks(spark, store):
    studies, _ = store
    sections = spark.createDataFrame([(1, "PMC1", 0, "Table 1", "h", "table", "name | value\nrare 12.50 | x\ncommon | 7"), (2, "PMC1", 1, "Text", "h", "text", "common words\n\nmore common words"), (3, "CSR-XY1", 0, None, None, None, ""), (4, "CSR-XY1", 1, "T", "h", "table", None)], SECTIONS)
    chunks = I.chunks(sections, studies)
    assert chunks.count() == 5
    q = spark.createDataFrame([(1, "rare 12.5"), (2, "unknownterm"), (3, None)], "q int, t string")
    assert [(r["query"], r["section_id"], r["chunk_no"], r["place"]) for r in I.search(q, "q", "t", chunks, limit=2).collect()] == [(1, 1, 1, 1)]
    many = spark.createDataFrame([(i, "common words" if i % 2 else "rare 12.5 common", ["PMC1", "CSR-XY1", None][i % 3]) for i in range(70)], "q int, t string, d string")
    whole, split = (rows(I.search(many, "q", "t", chunks, limit=2, block=b, document="d")) for b in (256, 2))
    assert whole == split and {r[0] % 3 for r in whole} == {0, 2} and len(whole) > 60
    assert I.search(q.limit(0), "q", "t", chunks).count() == 0


def test_sections_by_pasted_lines(spark):
    """By label, by heading, by the longest label that a pasted line begins with; never Table 1 for Table 12 or 1.2."""
    sections = spark.createDataFrame([(1, "D", 0, "Table 1", "Base", "table", "a"), (2, "D", 1, "Table 14", "More", "table", "b"), (3, "D", 2, "Results", "Table 9", "text", "c"), (4, "D", 3, "Results > Safety", "Harms", "text", "d"), (5, "D", 4, "Table 1", "Base", "table", "again"), (6, "E", 0, "Table 1", "x", "table", "e"), (7, "D", 5, "", None, "text", "f")], SECTIONS)
    cases = {"Table 1: caption of it": 1, "table  1 (page 2)": 1, "Table 14.2.1": None, "Table 1a": None, "Table 12": None, "Harms": 4, "Table 9": 3, "Results > Safety > Deaths": 4, "Results, first part": 3, "": None, "Table 1. Base": 1, "\"Table 14\", row 2": 2}
    wanted = spark.createDataFrame([("D", k) for k in cases], "doc_id string, label string")
    assert {r["label"]: r["section_id"] for r in R.find_sections(wanted, sections).collect()} == cases


def test_names_of_any_length(spark):
    long = "A very long trial name of more than ten separate words 2031"
    studies = spark.createDataFrame([("CSR-1", "t", [long, None]), ("CSR-2", "t", None)], "id string, title string, aliases array<string>")
    cited = spark.createDataFrame([(1, f"see {long}, Table 2"), (2, "CSR 2"), (3, None), (4, "very long trial")], "k int, c string")
    assert rows(R.match_documents(cited, "k", "c", studies)) == [(1, "CSR-1"), (2, "CSR-2")]


TABLE = "Event | Drug (N=50) | Placebo (N=40)\nA | 10 (20.0) | 4 (10.0)\nB | 5 (10.0) | 8 (20.0)\nC | 25 (50.0) | 2 (5.0)\nD | 6 (19.0) | 10 (25.0)\n\nNotes: E | 1 (90.0) | 1 (90.0)"


def test_percent_audit(spark):
    sections = spark.createDataFrame([(1, "d", 0, "T1", "h", "table", TABLE), (2, "d", 1, "T2", "h", "table", TABLE.replace("N=40", "N=80")), (3, "d", 2, "x", "h", "text", TABLE), (4, "d", 3, "x", "h", "table", None), (5, "d", 3, "x", "h", "table", "")], SECTIONS)
    got = rows(V.percent_findings(sections).select("section_id", "col_no", "row_no", "severity", "usual"))
    assert got == [(1, 1, 4, "major", 50), (2, 1, 4, "major", 50), (2, 2, None, "major", 40)]


def test_interval_audit(spark):
    text = "Outcome | Difference (95% CI) | p-value\nx | 2.0 (3.0, 4.0) | 0.2\ny | 2.0 (1.0, 3.0) | 0.5\nz | 2.0 (-1.0, 5.0) | <0.05\nok | 2.0 (1.0, 3.0) | 0.01\nodds ratio | 1.5 (0.8, 2.9) | 0.02\nMedian | 2.0 (3.0, 4.0) | 0.2"
    sections = spark.createDataFrame([(1, "d", 0, "T", "h", "table", text)], SECTIONS)
    assert rows(V.interval_findings(sections).select("row_no", "code")) == [(1, "estimate_outside_ci"), (2, "ci_p_disagree"), (3, "ci_p_disagree"), (5, "ci_p_disagree")]


@pytest.mark.parametrize(
    ("claim", "source", "codes"),
    [
        ("There was no difference (p = 0.7).", "", ["absolute_no_difference"]),
        ("No significant difference was seen.", "", []),
        ("The result (p = 0.23) shows benefit.", "", ["certainty_on_nonsignificant"]),
        ("The result (p = 0.23) may show benefit.", "", []),
        ("A favourable trend was seen.", "p = 0.3", ["unqualified_trend"]),
        ("A favourable trend was seen.", "p = 0.01", []),
        ("Overall the gap grew.", "week 4 and week 8", ["scope_dropped"]),
        ("It was higher with A (18.07) than with B (18.90).", "", ["comparison_direction"]),
        ("A was higher than B with 21.5.", "g | v | p-value\nA | 21.5 | 0.231", ["comparison_nonsignificant"]),
        ("A was higher than B with 21.5.", "g | v | p-value\nA | 21.5 | 0.01", []),
    ],
)
def test_cues(spark, claim, source, codes):
    df = spark.createDataFrame([(claim, source)], "c string, s string")
    assert df.select(V.cues(F.col("c"), F.col("s"))).first()[0] == codes


def test_sign_conflicts(spark):
    data = [(1, "decreased by 2.7 points", "change +2.7"), (2, "decreased by 2.7", "change -2.7"), (3, "a rise of 14.5", "was −14.5"), (4, "was 14.5", "-14.5"), (5, None, "+2.7"), (6, "fell by 2.7", None)]
    df = spark.createDataFrame(data, "k int, c string, s string")
    assert rows(V.sign_conflicts(df, "k", "c", "s")) == [(1, "2.7", "decrease", "+2.7"), (3, "14.5", "increase", "−14.5")]


def test_edits(spark):
    df = spark.createDataFrame([("Scores were higher at week 12.", "week 12 and week 24 or week 2"), ("It was not significantly better, not higher.", ""), ("Significantly lower values at 3 months", "6 months"), (None, None)], "c string, s string")
    got = df.select(G.direction_flip(F.col("c")), G.significance_flip(F.col("c")), G.timepoint_swap(F.col("c"), F.col("s"))).collect()
    assert got[0][0] == "Scores were lower at week 12." and got[1][0] is None and got[2][0] == "Significantly higher values at 3 months"
    assert got[1][1] == "It was significantly better, not higher."
    assert got[2][1] == "not significantly lower values at 3 months"
    assert got[2][2] == "Significantly lower values at 6 months"
    assert tuple(got[3]) == (None, None, None)


def test_perturbations_keep_form(spark):
    out = spark.createDataFrame([("12.50",), ("7",), ("10",)], "n string").select("n", G.perturbations(F.col("n")).alias("p")).collect()
    by = {r["n"]: r["p"] for r in out}
    assert set(by["12.50"]) == {"21.50", "15.20", "12.05", "12.51", "12.52", "12.53"}
    assert set(by["7"]) == {"8", "9", "6", "5", "4"}
    assert set(by["10"]) == {"11", "12", "13"}


def test_linking_and_coverage(spark):
    claims = spark.createDataFrame([(1, "p", ["12.5", "40"]), (2, "p", ["12.5", "99"]), (3, None, ["40"]), (4, "p", [])], "k int, paper string, numbers array<string>")
    places = spark.createDataFrame([("p", "T1", "12.5"), ("p", "T1", "40"), ("p", "T2", "77"), (None, "T3", "40")], "paper string, label string, norm string")
    assert rows(G.coverage(claims, places, "k", "paper", "label")) == [(1, "p", "T1", 1.0), (2, "p", "T1", 0.5)]
    assert rows(G.link_claims(claims, places, "k", "paper", "label")) == [(1, "T1", 1.0)]


def test_round_robin_and_samples(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 20 else None) for i in range(23)], "k int, t string")
    given = G.round_robin(df, "k", ["x", "y"]).orderBy("k").collect()
    assert [r["place"] for r in given] == list(range(23)) and [r["kind"] for r in given] == ["xy"[i % 2] for i in range(23)]
    assert G.balanced(df, "t", "k", 8).groupBy("t").count().agg(F.max("count")).first()[0] == 2
    assert G.capped(df, "t", "k", 3).count() == 12


def test_leaks_of_claims(spark):
    paragraphs = spark.createDataFrame([(1, "p", "We saw 12.5 and 40.1 points in all."), (2, "p", "Nothing here"), (3, "q", "We saw 12.5 and 40.1 points"), (4, "p", None)], "doc_id int, paper string, text string")
    claims = spark.createDataFrame([(1, "p", "The means were 12.5 and 40.1."), (2, "p", None)], "claim_no int, paper string, text string")
    assert rows(G.leaking(paragraphs, claims, "doc_id", "paper")) == [(1,)]


def test_leaks_meet_by_words(spark):
    """Beginnings of any number of words, against looking for each in every paragraph."""
    import itertools

    texts = ["The mean score rose by 12.5 points in the treated group and fell later", "alpha beta", "gamma", "one two three", "", "x!", None, "rose by 12.5"]
    paragraphs = [(i, "p", f"Before {t or ''} after." if i % 2 else t) for i, t in enumerate(texts)] + [(50, "q", texts[0]), (51, "p", "xone two threex"), (52, "p", "the MEAN, score rose by 12.5 points; in the treated group and fell later on")]
    df = spark.createDataFrame(paragraphs, "k int, g string, text string")
    claims = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "claim_no int, g string, text string")
    plain = {r["k"]: r["p"] for r in df.select("k", G.plain_text(F.col("text")).alias("p")).collect()}
    begin = [r["p"][:80] for r in claims.select(G.plain_text(F.col("text")).alias("p")).collect() if r["p"]]
    want = {k for (k, g, _), b in itertools.product(paragraphs, begin) if g == "p" and plain[k] is not None and b in plain[k]}
    assert {r["k"] for r in G.leaking(df, claims, "k", "g").collect()} == want and 52 in want and 50 not in want
    kept = df.withColumn("section", F.when(F.col("k") == 51, F.lit("Results > x")).otherwise(F.lit("Methods")))
    assert {r["k"] for r in G.without_leaks(kept, claims, "k", "g").collect()} == set(plain) - want - {51}


def test_long_sections_come_in_parts(spark):
    df = spark.createDataFrame([("a", i, "x" * 40 if i != 3 else None) for i in range(10)], "s string, o int, t string")
    parts = G.text_sections(df, ["s"], "o", "t", chars=100).orderBy("part").collect()
    assert [r["first"] for r in parts] == sorted(r["first"] for r in parts) and len(parts) > 2 and sum(r["paragraphs"] for r in parts) == 10
    assert "\n\n".join(r["text"] for r in parts) == "\n\n".join("x" * 40 if i != 3 else "" for i in range(10))


def test_direction_of_changes(spark):
    cases = [("a score of 55.89, which decreased to 98.12", True), ("a score of 55.89, which decreased to 42.5", False), ("from 40.5 it rose to 30.5", True), ("from 40.5 it improved to 30.5", False), ("at week 24 it fell to 30.5", False), ("smaller than the control group (15.5 vs. 10.5)", True), ("smaller than the control group (10.5 vs. 15.5)", False), (None, False)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    got = [r[0] for r in df.select(F.array_contains(V.cues(F.col("c"), F.lit("x")), "comparison_direction")).collect()]
    assert got == [w if c is not None else got[-1] for c, w in cases] and not got[-1]
    table = "Visit | A | B | p-value\nWeek 12 | 1 | 2 | 0.4\nWeek 24 | 1 | 2 | 0.01"
    claims = [("Scores were lower than placebo at week 12", True), ("Scores were lower than placebo at week 24", False), ("Scores were lower than placebo", False)]
    df = spark.createDataFrame([(c, table) for c, _ in claims], "c string, t string")
    assert [r[0] for r in df.select(V.comparison_nonsignificant(F.col("c"), F.col("t"))).collect()] == [w for _, w in claims]
    assert [len(r[0]) for r in df.limit(1).select(V.cue_messages(F.array(*(F.lit(c) for c in V.CUE_MESSAGES)))).collect()] == [6]


def test_kinds_with_fallback_and_full_documents(spark):
    rows_ = spark.createDataFrame([(i,) for i in range(6)], "k int")
    possible = spark.createDataFrame([(0, "a"), (1, "a"), (2, "c"), (2, "b"), (3, "a"), (3, "b"), (4, "z")], "k int, kind string")
    assert rows(G.assigned(rows_, possible, "k", ["a", "b", "c"])) == [(0, "a"), (1, "a"), (2, "c"), (3, "a")]
    unit = "id string, unit_no int, kind string, label string, text string"
    studies = spark.createDataFrame([("s", 0, "abstract", "Abstract", "x"), ("s", 1, "paragraph", "Methods > A", "one"), ("s", 2, "paragraph", "Results", "two"), ("s", 3, "paragraph", "Methods > A", "three"), ("s", 4, "paragraph", "Methods > B", "the mean was 12.5 and 30.1 here"), ("s", 5, "table", "Table 1", "rows")], unit)
    refs = spark.createDataFrame([("r", 0, "abstract", "Abstract", "x"), ("r", 1, "paragraph", "Results", "y"), ("r", None, "title", "", "t")], unit)
    claims = spark.createDataFrame([(1, "s", "A mean of 12.5 against 30.1")], "claim_no int, id string, text string")
    got = rows(G.full_documents(studies, claims, refs).select("doc_id", "kind", "pos", "label", "text"))
    assert got == [("r", "reference", 0, "Abstract", "x"), ("r", "reference", 1, "Results", "y"), ("s", "study", 1, "Methods > A", "one\n\nthree"), ("s", "study", 5, "Table 1", "rows")]


def test_fixes_are_checked_again(spark):
    from tabulith.operators import fixing as D

    schema = "k string, claim string, citation string, doc_id string, source string, verdict string"
    data = [("1", "was 12.5", "d1, T1", "d1", "mean 99.5", "not_supported"), ("2", "was 44.5", "d1, T1", "d1", "mean 44.6", "not_supported"), ("3", "was 12.5", "d9, T1", "d9", None, "wrong_target"), ("4", "fine", "x", "x", "y", "supported"), ("5", "was 55.5 and 66.5", "d1, T1", "d1", "mean 1.5", "not_supported")]
    places = spark.createDataFrame([("12.5", "d1", "T2"), ("12.5", "d3", "T3")], "norm string, doc_id string, label string")
    recheck = lambda df: df.select("k", F.when(F.col("citation") == "d3, T3", F.lit("not_supported")).otherwise(F.lit("supported")).alias("verdict"))
    got = {r["k"]: r for r in D.suggest_fixes(spark.createDataFrame(data, schema), places, "k", lambda p: "was 44.6" if "44.5" in p else None, recheck).collect()}
    assert got["1"]["citation"] == got["3"]["citation"] == "d1, T2" and got["2"]["text"] == "was 44.6" and "4" not in got
    assert got["5"]["text"] is None and got["5"]["note"] == "no fix passed"
    cache = spark.createDataFrame([("s", "a", "A!"), ("s", "b", None)], "style string, claim string, rewrite string")
    claims = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "a"), ("s", None)], "style string, claim string")
    assert rows(D.cached_rewrites(claims, cache, lambda s, c: c.upper() if c != "c" else "")) == [("s", "a", "A!"), ("s", "b", None), ("s", "c", None), ("t", "a", "A")]
    assert ("s", "b", "B") in rows(D.cached_rewrites(claims, cache, lambda s, c: c.upper(), again=True))


def test_rotated_text(spark):
    from tabulith.sources import layout

    spans = [("d", 1, 10.0, 20.0, 60.0, 30.0, 1.0, 0.0, "across"), ("d", 1, 100.0, 300.0, 110.0, 350.0, 0.0, -1.0, "first"), ("d", 1, 100.0, 200.0, 110.0, 280.0, 0.0, -1.0, "second"), ("d", 1, 120.0, 300.0, 130.0, 350.0, 0.0, -1.0, "below"), ("d", 1, 50.0, 10.0, 60.0, 40.0, 0.0, 1.0, "down"), ("d", 1, 1.0, 1.0, 2.0, 2.0, None, None, " ")]
    df = spark.createDataFrame(spans, "doc string, page int, x0 double, y0 double, x1 double, y1 double, dx double, dy double, text string")
    got = [(r["rotated"], r["text"]) for r in layout.page_lines(layout.upright(df)).orderBy("line_no").collect()]
    assert got == [(False, "across"), (True, "first | second"), (True, "below"), (True, "down")]


def test_quotes_never_broadcast_their_sources(spark, monkeypatch):
    """Sources go through a shuffle however small they look, and an item with many quotes is split without change."""
    text = "The rate was 12.5 % in arm A."
    quotes = spark.createDataFrame([(i, "hot" if i < 30 else "b", ["rate was 12.5 %", "arm B", "", "The rate ... arm A"][i % 4]) for i in range(40)] + [(40, "none", "rate"), (41, None, "rate")], "k int, item string, quote string")
    texts = spark.createDataFrame([("hot", 2, "other"), ("hot", 1, text), ("b", 1, None)], "item string, pos int, text string")
    sources = E.plain_sources(texts, "item", ["pos"])
    found = E.ground_quotes(quotes, sources, "k", "item")
    assert rows(found) == sorted(((i, i < 30 and i % 4 in (0, 3)) for i in range(40)), key=repr)
    monkeypatch.setattr(E, "HOT", 7)
    split = E.ground_quotes(quotes, sources, "k", "item")
    assert rows(split) == rows(found)
    # with broadcasts allowed for anything, the hot items alone are broadcast
    split.write.format("noop").mode("overwrite").save()
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [item" in plan and "plain" not in "".join(line for line in plan.splitlines() if "BroadcastExchange" in line)


def test_search_in_blocks_is_brute_force(spark):
    """Rough sums, ties and running bounds leave what scoring every chunk term by term gives; a block of 8,192 queries reads the chunks once."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(words[min(59, int(k))] for k in rng.exponential(8, n))
    data = [(i // 5, i % 5, f"d{i % 3}", draw(int(rng.integers(0, 9))), draw(3)) for i in range(400)]
    asked = [(i, draw(int(rng.integers(1, 7)))) for i in range(30)]
    chunks = spark.createDataFrame(data, "section_id bigint, chunk_no int, doc_id string, text string, context string").repartition(3, "section_id")
    found = I.search(spark.createDataFrame(asked, "q int, t string"), "q", "t", chunks)
    want = []
    fields = [([d[k].split() for d in data], w) for k, w in ((3, I.WEIGHTS["text"]), (4, I.WEIGHTS["context"]))]
    for q, text in asked:
        scored = []
        for i, (section, chunk, *_) in enumerate(data):
            total, held = 0.0, set()
            for docs, weight in fields:
                average = sum(len(set(d)) for d in docs) / len(docs)
                for t in sorted(set(text.split()) & set(docs[i])):
                    df = sum(t in d for d in docs)
                    tf = docs[i].count(t)
                    total += weight * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * (I.FLOOR + tf * (I.K1 + 1) / (tf + I.K1 * (1 - I.B + I.B * len(set(docs[i])) / average)))
                    held.add(t)
            if held:
                scored.append((-round(total * len(held), 6), section, chunk))
        want += [(q, s, c, -v, p) for p, (v, s, c) in enumerate(sorted(scored)[: I.HITS], 1)]
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[4]))
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert I.QUERY_BLOCK >= 8192
