"""Mutations, citing sets and reports against brute force and on awkward rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tabulith.operators import citing as C
from tabulith.operators import evidence as E
from tabulith.operators import mutating as M
from tabulith.operators import reporting as P

SECTIONS = "section_id bigint, doc_id string, pos int, label string, heading string, kind string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replaced_numbers(spark):
    data = [("was 12.50 and 12.5 of 1,200", "12.5", "13.5"), ("1,200 of 1200", "1200", "2100"), ("none", "5", "6"), (None, "5", "6"), ("12.5", None, "6"), ("a 7, b 7", "7", "9"), ("at -4.2 now", "-4.2", "-2.4")]
    df = spark.createDataFrame(data, "t string, o string, n string")
    got = [r[0] for r in df.select(M.replace_number(F.col("t"), F.col("o"), F.col("n"))).collect()]
    assert got == ["was 13.5 and 12.5 of 1,200", "2,100 of 1200", None, None, None, "a 9 b 7", "at -2.4 now"]  # a number pattern takes the comma after it


def test_changed_values_are_absent_from_the_source(spark):
    data = [(i, f"The mean was {v} against 30.1", ["30.1", v, "13.5"]) for i, v in enumerate(("12.5", "31.5", "17", "20.75"))] + [(9, "no number", ["1"]), (10, "12.5 here", []), (11, None, ["12.5"])]
    df = spark.createDataFrame(data, "k int, c string, held array<string>")
    got = df.select("k", "c", "held", M.changed_value(F.col("c"), F.col("held"), F.col("k")).alias("m")).where("m is not null").collect()
    assert {r["k"] for r in got} == {0, 1, 2, 3}
    for r in got:
        assert r["m"]["old"] in r["held"] and r["m"]["new"] not in r["held"] and r["m"]["text"] == r["c"].replace(r["m"]["old"], r["m"]["new"])


@pytest.mark.parametrize(
    ("claim", "table", "want"),
    [
        ("Scores were 138.85 vs 130.62 points", ["x | y", "score | 138.85 | 130.62"], "Scores were 130.62 vs 138.85 points"),
        ("Scores were 138.85 vs 130.6 points", ["score | 138.85 | 130.6"], None),
        ("Scores were 138.85 vs 30.62 points", ["score | 138.85 | 30.62"], None),
        ("Means 24.5 (SD 21.5) and 22.5", ["m | 24.5 (21.5) | 22.5"], "Means 22.5 (SD 21.5) and 24.5"),
        ("Means 24.5 and 22.5", ["a | 24.5", "b | 22.5"], None),
        ("Means 24.5 and 24.5", ["a | 24.5 | 24.5"], None),
        ("no numbers", ["a | 1"], None),
        (None, ["a"], None),
    ],
)
def test_swapped_values(spark, claim, table, want):
    df = spark.createDataFrame([(claim, table)], "c string, r array<string>")
    assert df.select(M.swapped_values(F.col("c"), F.col("r"))).first()[0] == want


def test_wrong_targets(spark):
    items = spark.createDataFrame([(1, "A", "Table 1", ["12.5", "30.1"]), (2, "B", "Table 1", ["99.9"]), (3, "C", "Table 7", ["1.5"]), (4, "A", "Table 1", [])], "k int, doc_id string, label string, numbers array<string>")
    places = spark.createDataFrame([("A", "Table 1", ["12.5", "30.1"]), ("A", "Table 2", ["12.5"]), ("A", "Table 3", ["5"]), ("B", "Table 1", ["99.9"]), ("C", "Table 7", ["1.5"])] + [(f"D{i}", "Table 1", ["12.5", "30.1"] if i < 30 else ["0"]) for i in range(31)], "doc_id string, label string, norms array<string>")
    got = {(r["k"], r["kind"]): (r["doc_id"], r["label"]) for r in M.wrong_targets(items, places, "k").collect()}
    assert got[1, "wrong_location"] == ("A", "Table 3") and (2, "wrong_location") not in got
    # all but two other papers hold the numbers, and one of the two is found
    assert got[1, "wrong_study"][0] in ("D30", "B") and got[2, "wrong_study"][0] != "B" and (3, "wrong_study") not in got
    assert got[1, "nonexistent_target"][0] == "A" and int(got[1, "nonexistent_target"][1][6:]) in (4, 5, 6) and got[3, "nonexistent_target"][1] in ("Table 8", "Table 9", "Table 10")


def test_changed_ids(spark):
    ids = spark.createDataFrame([(1, "PMC1234"), (2, "CSR-XY"), (3, None), (4, "PMC100")], "k int, id string")
    taken = spark.createDataFrame([(f"PMC{i:03d}",) for i in range(1000) if i != 107], "id string")
    got = dict(rows(M.changed_ids(ids, "k", taken)))
    assert got[4] == "PMC107" and re.fullmatch(r"PMC1\d{3}", got[1]) and sum(a != b for a, b in zip(got[1], "PMC1234", strict=True)) == 1 and set(got) == {1, 4}


def test_twice_capped_is_the_greedy_choice(spark):
    rng = random.Random(3)
    for _ in range(4):
        data = [(i, rng.choice("abc"), rng.choice("uvwxyz")) for i in range(60)] + [(100, None, "u"), (101, "a", None)]
        kept, by = [], {}
        for k, a, b in data[:60]:
            if by.get(("c", a), 0) < 6 and by.get(("d", b), 0) < 3:
                kept.append(k)
                by["c", a], by["d", b] = by.get(("c", a), 0) + 1, by.get(("d", b), 0) + 1
        df = spark.createDataFrame(data, "k int, a string, b string")
        assert sorted(r["k"] for r in C.twice_capped(df, "k", "a", "b").collect()) == kept
    assert C.twice_capped(df.limit(0), "k", "a", "b").count() == 0


def test_attribution(spark):
    cases = [("Smith et al. reported a rise", None, True), ("The trial showed a rise", None, True), ("This study showed a rise", None, False), ("Samples were kept cold", "Roe 2019", False), ("As Roe noted, it rose", "Roe and Poe 2019", True), ("As previously described by Roe", "Roe 2019", False), ("It rose in their study", None, True), ("Heroes fell", "Roe 2019", False), ("Li saw it", "Li 2019", False)]
    df = spark.createDataFrame([(c, a) for c, a, _ in cases], "c string, a string")
    assert [r[0] for r in df.select(C.is_attributive(F.col("c"), F.col("a"))).collect()] == [w for *_, w in cases]
    df = spark.createDataFrame([("FGF-21 fell by 12.5 in 240 of 240",)], "c string")
    assert df.select(C.claim_numbers(F.col("c"))).first()[0] == ["12.5", "240"]


def test_best_units_and_sources(spark):
    units = spark.createDataFrame([("p", 0, "Abstract", "a 1.5", ["1.5"]), ("p", 1, "Results", "b 1.5 2.5", ["1.5", "2.5"]), ("p", 2, "Results", "c", []), ("p", 3, "Table 1", "d 2.5 1.5", ["2.5", "1.5"]), ("p", None, "", "Title 9.5", ["9.5"])], "id string, unit_no int, label string, text string, norms array<string>")
    claims = spark.createDataFrame([(1, "p", ["1.5", "2.5"]), (2, "p", ["7.7"]), (3, "q", ["1.5"]), (4, "p", [])], "k int, id string, numbers array<string>")
    assert rows(C.best_units(claims, units.where("unit_no is not null"), "k")) == [(1, "Table 1", 1.0), (2, "Table 1", 0.0), (3, None, 0.0)]
    assert rows(C.source_text(units)) == [("p", "Abstract\na 1.5\n\nResults\nb 1.5 2.5\nc\n\nTable 1\nd 2.5 1.5")]
    assert ("p", "9.5") in rows(C.all_numbers(units)) and ("p", "Abstract", "1.5") in rows(C.unit_numbers(units))


def test_look_up_keeps_unknown_ids(spark):
    cache = spark.createDataFrame([("1", "PMC1")], "id string, pmcid string")
    wanted = spark.createDataFrame([("1",), ("2",), ("3",), (None,), ("2",)], "id string")
    got = rows(C.look_up(wanted, cache, "doi", lambda ids: {"2": "PMC2"}))
    assert got == [("1", "PMC1"), ("2", "PMC2"), ("3", None)]
    refs = spark.createDataFrame([("r", None, "2", None), ("s", "PMC9", "2", None), ("t", None, None, "x")], "ref_id string, pmcid string, pmid string, doi string")
    found = C.resolved_references(refs, C.look_up(wanted, cache, "pmid", lambda ids: {"2": "PMC2"}), cache)
    assert dict((r["ref_id"], r["target"]) for r in found.collect()) == {"r": "PMC2", "s": "PMC9", "t": None}


def test_evidence_items(spark):
    schema = "claim_id int, claim string, cited array<string>, evidence map<string, array<struct<label: string, sentences: array<int>>>>"
    df = spark.createDataFrame([(1, "c", ["a", "b"], {"a": [("CONTRADICT", [3, 1]), ("SUPPORT", [1])]}), (2, "d", ["a"], None), (3, "e", [], None)], schema)
    assert rows(C.evidence_items(df)) == [(1, "a", "c", "not_supported", "CONTRADICT", [1, 3]), (1, "b", "c", "not_supported", "NOINFO", []), (2, "a", "d", "not_supported", "NOINFO", [])]
    docs = spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string")
    swapped = C.swapped_items(df, docs, 10).collect()
    assert {r["claim_id"]: r["doc_id"] for r in swapped}[1] == "z" and len(swapped) == 3 and all(r["doc_id"] != "a" for r in swapped if r["claim_id"] == 2)
    sample = C.quota_sample(spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(20)] + [(90, None)], "k int, t string"), "t", "k", {"x": 3, "y": 50})
    assert sorted(r["t"] for r in sample.collect()) == ["x"] * 3 + ["y"] * 10


def test_sections_that_hold_all_numbers(spark):
    rng = random.Random(2)
    places = {(f"d{d}", f"t{t}"): {str(rng.randint(1, 6)) for _ in range(4)} for d in range(6) for t in range(3)}
    asked = {k: sorted({str(rng.randint(1, 7)) for _ in range(rng.randint(1, 3))}) for k in range(30)}
    p = spark.createDataFrame([(n, *place) for place, ns in places.items() for n in ns], "norm string, doc_id string, label string")
    a = spark.createDataFrame(list(asked.items()), "k int, numbers array<string>")
    want = sorted((k, *place) for (k, ns), (place, held) in itertools.product(asked.items(), places.items()) if set(ns) <= held)
    assert sorted(tuple(r) for r in E.sections_holding(a, p, "k").collect()) == want


def test_planted_errors_are_found(spark):
    text = "Event | Drug (N=50) | Placebo (N=40)\nA | 10 (20.0) | 4 (10.0)\nB | 15 (30.0) | 8 (20.0)\nC | 25 (50.0) | 2 (5.0)\nD | 20 (40.0) | 10 (25.0)"
    ci = "Outcome | Difference (95% CI)\nx | 2.0 (1.0, 3.0)\ny | 2.5 ± 1.1 (1.0, 3.0)"
    df = spark.createDataFrame([(1, "d", 0, "T1", "h", "table", text), (2, "d", 1, "T2", "h", "table", ci), (3, "d", 2, "x", "h", "text", text), (4, "d", 3, "y", None, "table", None)], SECTIONS)
    made = {(r["planted"], r["section_id"]): r["text"] for r in P.plant(df).collect()}
    assert set(made) == {("percent", 1), ("interval", 2)} and "B | 22 (30.0) | 8 (20.0)" in made["percent", 1] and "x | 5.50 (1.0, 3.0)" in made["interval", 2]
    assert rows(P.planted_recall(df)) == [("interval", 1, 1), ("percent", 1, 1)]


def test_issues_and_reports(spark):
    found = spark.createDataFrame([(1, "D", "Table 1", "c", "minor", 3), (2, "D", "Table 14", "c", "major", None), (3, "E", "x", "c", "major", 1), (4, None, "x", "c", "major", 1)], "section_id bigint, doc_id string, label string, code string, severity string, row_no int")
    checked = spark.createDataFrame([(1, "D, Table 14", "supported", "fast"), (2, "D, Table 1", "wrong_target", "strong"), (3, "E", "not_supported", "code"), (4, None, "supported", None)], "k int, citation string, verdict string, decided_by string")
    assert rows(P.issues_at(checked, found, "k", "citation").select("k", "section_id")) == [(1, 1), (1, 2), (2, 1)]
    report = {r["k"]: (r["block"], r["place"], r["issues"]) for r in P.check_report(checked, found, "k").collect()}
    assert report == {3: (0, 1, 0), 2: (1, 1, 1), 1: (2, 1, 2), 4: (2, 2, 0)}
    assert [r["section_id"] for r in P.shown(found, 3).collect()] == [2, 3, 4]
    assert P.issues_at(checked, found.limit(0), "k", "citation").count() == 0


def test_agent_report_and_first_attempts(spark):
    from tabulith import schemas

    schema = f"run_name string, verdict string, trace {schemas.TRACE.simpleString()}"
    attempt = lambda v, *codes: ((v, None, None, None, None, None), [(c, "m") for c in codes])
    step = lambda tool: (tool, {}, 5, None, 0)
    data = [("r", "supported", ([step("search"), step("search")], 2, 3, False, 50, [attempt("not_supported", "bad_location"), attempt("supported")])), ("r", "not_supported", ([step("read_section")], 1, 2, True, 90, [attempt("not_supported", "missing_quote")])), ("r", None, None), ("q", "supported", None)]
    r = P.agent_report(spark.createDataFrame(data, schema)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["checks"], r["checks_with_tools"], r["max_tool_calls"], r["p95_tool_calls"], r["budget_exhausted"], r["retried"], r["unresolved"], r["flag_to_pass"], r["pass_to_flag"]) == (3, 2, 2, 2.0, 1, 1, 1, 1, 0)
    assert r["tool_use"] == {"search": 1.0, "read_section": 0.5} and r["failures"] == {"bad_location": 1, "missing_quote": 1}
    rows_ = spark.createDataFrame([("a", "supported", [("not_supported",), ("supported",)]), ("b", "supported", [("supported",)]), ("c", None, None)], "k string, verdict string, attempts array<struct<verdict:string>>")
    assert rows(P.first_attempts(rows_).select("k", "verdict", "retried")) == [("a", "not_supported", True), ("b", "supported", False), ("c", None, False)]


def test_fix_scores_and_rates(spark):
    schema = "error_type string, original_claim string, mutation string, source_paper string, fix_text string, fix_citation string, candidates array<string>"
    data = [("v", "was 12.5", "12.5 -> 15.2", "P", "is 12.50", None, []), ("v", "was 12.5", "12.5 -> 15.2", "P", "is 15.2", None, None), ("w", "x", "Table 2 -> Table 3", "P", None, "P, Table 2", []), ("w", "x", "P -> Q", "P", None, "Q, Table 2", []), ("w", "x", None, None, None, None, ["P, Table 1"])]
    got = {r["error_type"]: tuple(r)[1:] for r in P.fix_scores(spark.createDataFrame(data, schema)).collect()}
    assert got == {"v": (2, 2, 1, 0, 0, 0), "w": (3, 2, 1, 2, 1, 1), None: (5, 4, 2, 2, 1, 1)}
    a = spark.createDataFrame([(1, 0, "c"), (1, 1, "d")], "k int, sentence int, citation string")
    b = spark.createDataFrame([(1, 0, "c"), (1, 2, "e")], "k int, sentence int, citation string")
    assert rows(P.extraction_misses(a, b, "k")) == [(1, 1, "d", "extra"), (1, 2, "e", "missed")]
    rates = spark.createDataFrame([(0.5, 4, 0.25, 0.75), (None, 0, None, None)], "v double, n int, l double, h double")
    assert [r[0] for r in rates.select(P.rate_text(*(F.col(c) for c in "vnlh"))).collect()] == ["50.0% [25.0%, 75.0%] (n=4)", "-"]
