"""Extraction, checks with a scripted judge, fixes, sources and streams."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tabulith import schemas
from tabulith.operators import checking as C
from tabulith.operators import extracting as E
from tabulith.operators import fixing as D
from tabulith.operators import scoring as S
from tabulith.sources import files, layout, markup
from tabulith.streaming import claims_of, read_lines, two_phases, windowed_counts

# judges of this module go to Python workers as they are
cloudpickle.register_pickle_by_value(sys.modules[__name__])
SECTIONS = "section_id bigint, doc_id string, pos int, label string, heading string, kind string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_extracting(spark):
    text = "Pain fell by 12.5 points (PMC1, Table 2). It rose later [Table 3]. As shown in Table 4, all did well. Nothing here. It was 44.5 in all (see Figure 2a). Uncited 77.1 here. Both (Tables 5-6)."
    df = spark.createDataFrame([(1, text, "DOC-9"), (2, "First (Table 1). Then (CSR-AB12, Table 14.2.1).", "DOC-9"), (3, "Alone (Table 1).", None), (4, None, "DOC-9"), (5, "", "DOC-9")], "paragraph int, text string, own string")
    got = {(r["paragraph"], r["citation"]): r["claim"] for r in E.extract_claims(df, own_doc="own").collect()}
    assert set(got) == {(1, "PMC1, Table 2"), (1, "PMC1, Table 3"), (1, "PMC1, Table 4"), (1, "PMC1, Figure 2a"), (1, "PMC1, Table 5"), (1, "PMC1, Table 6"), (2, "DOC-9, Table 1"), (2, "CSR-AB12, Table 14.2.1")}
    assert got[1, "PMC1, Table 2"] == "Pain fell by 12.5 points."
    assert rows(E.uncited(df).select("paragraph", "claim", "numbers")) == [(1, "Uncited 77.1 here.", ["77.1"])]
    scores = E.marker_scores(E.extract_claims(df, own_doc="own"), spark.createDataFrame([(1, 0, "PMC1, Table 2"), (9, 0, "x")], "paragraph int, sentence int, citation string")).first()
    assert (scores["hits"], scores["extracted"], scores["true"], scores["recall"]) == (1, 8, 2, 0.5)


GOOD = '{"verdict": "supported", "quote": "q", "location": "l", "reason": "r"}'


@pytest.mark.parametrize(
    "reply",
    [GOOD, f"Here it is:\n```json\n{GOOD}\n```", '{"verdict": "supported", "quote": "a\tb\nc", "location": "l", "reason": "r",}', '{"verdict": "supported", "quote": "q", "location": "l", "reason": "cut of', '{"verdict": "supported", "quote": "q", "location": "l", "reason": "r", "confidence": "sure"}'],
)
def test_replies_are_repaired(reply):
    got = C.parse_reply(reply)
    assert got["verdict"] == "supported" and got["confidence"] is None


@pytest.mark.parametrize("reply", ["", None, "no json", '{"verdict": "maybe", "quote": "", "location": "", "reason": ""}', "{]", "[1]"])
def test_bad_replies_fail(reply):
    with pytest.raises(ValueError):
        C.parse_reply(reply)


def test_parse_replies_keeps_bad_rows(spark):
    df = spark.createDataFrame([(1, GOOD), (2, "nothing"), (None, None)], "k int, reply string")
    got = {r["k"]: (r["verdict"], r["error"] is None) for r in C.parse_replies(df, "k", "reply").collect()}
    assert got == {1: ("supported", True), 2: (None, False), None: (None, False)}


def _reply(verdict, confidence="high"):
    return json.dumps({"verdict": verdict, "quote": "", "location": "", "reason": "", "confidence": confidence})


def scripted(prompt):
    if "fails" in prompt:
        raise RuntimeError("down")
    if "Before you answer" in prompt:
        return _reply("not_supported")
    return _reply("supported", "low" if "unsure" in prompt else "high")


@pytest.fixture(scope="module")
def checked(spark):
    studies = spark.createDataFrame([("PMC1", "One", None)], "id string, title string, aliases array<string>")
    sections = spark.createDataFrame([(1, "PMC1", 0, "Table 1", "Means", "table", "Group | Mean\nA | 12.5\nB | 40"), (2, "PMC1", 1, "Table 2", "Long", "table", "x" * 9000)], SECTIONS)
    items = spark.createDataFrame([(1, "A was 12.5", "PMC1, Table 1"), (2, "A was 99.5", "PMC1, Table 1"), (3, "A was 12.5", "PMC1, Table 7"), (4, "A was 12.5", "PMC1"), (5, "this fails", "PMC1, Table 1"), (6, "A, unsure, was 12.5", "PMC1, Table 1"), (7, "long", "PMC1, Table 2")], "item_no int, claim string, citation string")
    return items, C.check(items, studies, sections, scripted, whole=lambda p: _reply("wrong_target"))


def test_check_paths(checked):
    got = {r["item_no"]: (r["path"], r["verdict"], r["error"] is None) for r in checked[1].collect()}
    assert got == {1: ("section", "supported", True), 2: ("section", "not_supported", True), 3: ("code", "wrong_target", True), 4: ("whole", "wrong_target", True), 5: ("section", None, False), 6: ("section", "supported", True), 7: ("whole", "wrong_target", True)}


def test_hybrid_escalates(spark, checked):
    items, fast = checked
    prompts = items.select("item_no", F.col("claim").alias("prompt"))
    out = {r["item_no"]: (r["verdict"], r["decided_by"], r["escalation_reason"]) for r in C.hybrid(fast, items, lambda p: _reply("not_supported"), prompts, {"lowconf"}).collect()}
    assert out[6] == ("not_supported", "strong", "low-confidence pass") and out[1] == ("supported", "fast", None) and out[3][1] == "code"


def test_replay(spark):
    ask = C.replay(spark.createDataFrame([("p", "r")], "prompt string, reply string"))
    assert ask("p") == "r"
    with pytest.raises(KeyError):
        ask("other")


def test_objective_failures(spark):
    data = [("mean 4", "supported", "the mean 4 here", True, True, [], False), ("mean 5", "supported", "the mean 4", False, False, ["5"], False), ("", "supported", "x", True, True, [], False), (None, "not_supported", "x", True, True, ["5"], False), ("zzz", "supported", "x", True, True, [], True)]
    df = spark.createDataFrame(data, "q string, v string, s string, k boolean, t boolean, m array<string>, x boolean")
    got = [r[0] for r in df.select(C.objective_failures(*(F.col(c) for c in "qvsktmx"))).collect()]
    assert got == [[], ["ungrounded_quote", "bad_location", "off_target", "number_missing"], ["missing_quote"], [], ["budget_exhausted"]]


def test_word_diff_and_gates(spark):
    df = spark.createDataFrame([("the mean rose by 4.5", "the score fell by 4.5 points"), ("same", "same"), (None, "x"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(D.word_diff("a", "b")).collect()] == ["the [-mean rose-] {+score fell+} by 4.5 {+points+}", "same", None, "{+a+}"]
    ok = df.select(D.overstatement_passes(F.col("a"), F.col("b"), False)).collect()
    assert [bool(r[0]) for r in ok] == [True, False, False, True]
    flagged = spark.createDataFrame([(1, "A was 99.5 points", "A was 12.5 points"), (2, "B was 7.5", "none")], "k int, claim string, source string")
    got = {r["k"]: r for r in D.suggest_rewrites(flagged, "k", lambda p: "A was 12.5 points").collect()}
    assert got[1]["rewrite"] == "A was 12.5 points" and "[-99.5-]" in got[1]["diff"] and got[2]["rewrite"] is None and got[2]["note"]
    places = spark.createDataFrame([("12.5", "d1", "T1"), ("12.5", "d2", "T9"), ("40", "d2", "T9")], "norm string, doc_id string, label string")
    asked = spark.createDataFrame([(1, "was 12.5", "d2"), (2, "12.5 and 40.0 and 41", "d1"), (3, "no number", "d1")], "k int, claim string, doc_id string")
    assert rows(D.citation_candidates(asked, places, "k")) == [(1, ["d2, T9", "d1, T1"])]


def test_json_lines_and_runs(spark, tmp_path):
    run = {"item": {"id": "a", "label": "wrong_target", "claim": "c", "citation": "x", "errorType": "e"}, "model": "m", "agent": "g", "result": {"verdict": "supported", "quote": "q", "location": "l", "reason": "r"}, "usage": {"promptTokens": 5, "costUsd": 0.25}, "latencyMs": 9}
    trace = {"toolCalls": 3, "budgetExhausted": False, "peakPromptTokens": 70, "steps": [{"tool": "search", "args": {"q": "x"}}], "attempts": [{"result": {"verdict": "wrong_target"}, "failures": [{"code": "missing_quote"}]}, {"result": {"verdict": "supported"}, "failures": []}]}
    (tmp_path / "one_pmc_x.jsonl").write_text(json.dumps(run) + "\n\n" + json.dumps(run | {"result": None, "trace": trace, "item": run["item"] | {"id": "b"}}) + "\n")
    runs = files.flat_runs(files.read_runs(spark, str(tmp_path / "*.jsonl")))
    s = S.summary(runs, ["run_name"]).first()
    assert (s["run_name"], s["n"], s["failed"], s["fn"], s["total_cost"]) == ("one_pmc_x", 2, 1, 1, 0.5)
    first = S.summary(S.first_attempts(runs), ["run_name"]).first()
    assert (first["failed"], first["tp"], first["fn"]) == (0, 1, 1)
    stats = files.agent_stats(runs).first()
    assert (stats["checks"], stats["retried"], stats["unresolved"], stats["max_tool_calls"]) == (1, 1, 0, 3)
    files.write_summary(S.summary(runs, ["run_name"]), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["n"] == 2
    (tmp_path / "bad.txt").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.txt"), schemas.SOURCE).collect()


def test_papers_and_paragraphs(spark, tmp_path):
    paper = spark.createDataFrame([("P1", "T", [(1, "Table 1", "Cap", ["a | b", "1 | 2"], "note"), (2, "Table 2", "Cap2", ["x"], None)], [])], schemas.PAPER)
    docs = files.paper_documents(paper)
    assert [r["text"] for r in files.document_sections(docs).orderBy("pos").collect()] == ["a | b\n1 | 2\n\nNotes: note", "x"]
    assert files.document_text(docs).first()["text"].startswith("T\nCap\na | b")
    with pytest.raises(ValueError, match="no such table"):
        files.expand_items(spark.createDataFrame([("P1", "Table 9")], "doc_id string, label string"), docs)
    (tmp_path / "s.txt").write_text("One.\n\n  Two\nlines. \n\n\n")
    assert rows(files.read_paragraphs(spark, str(tmp_path / "s.txt")).select("paragraph_no", "text")) == [(0, "One."), (1, "Two\nlines.")]


XML = """<article><front><article-meta><title-group><article-title>A <i>good</i> title</article-title></title-group><abstract abstract-type="lay"><p>Lay.</p></abstract><abstract><p>Short text 4.5.</p></abstract></article-meta></front><body><sec><title>Results</title><p>Seen in <xref>Table 1</xref> all.<table-wrap><label>Table 1</label></table-wrap> Tail.</p>
<sec><title>Safety</title><p>Fine (Smith et al. 2020)<xref ref-type="bibr" rid="r1 r2">[1-3]</xref>. New one <xref ref-type="bibr" rid="r2">2</xref> here.</p></sec></sec><table-wrap><label>Table 2.</label><caption><p>Caption</p></caption><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td/></tr><tr><td/><td/></tr></table><table-wrap-foot><p>foot</p></table-wrap-foot></table-wrap></body>
<back><ref id="r1"><surname>Roe</surname><surname>Poe</surname><surname>Doe</surname><year>2020</year><pub-id pub-id-type="pmcid">77</pub-id></ref><ref id="r2"><collab>Big Group</collab><year>2019a</year><pub-id pub-id-type="pmid">5</pub-id></ref><ref id="r3"><surname>Solo</surname></ref></back></article>"""


def test_markup(spark):
    df = spark.createDataFrame([("a", XML), ("b", "<broken"), ("c", None)], "id string, xml string")
    got = {r["id"]: r for r in markup.parse_papers(df).collect()}
    assert got["a"]["title"] == "A good title" and [t["number"] for t in got["a"]["tables"]] == [2]
    assert got["a"]["tables"][0]["rows"] == ["a | b", "1 | "] and got["a"]["tables"][0]["foot"] == "foot"
    assert [p["section"] for p in got["a"]["paragraphs"]] == ["Results", "Results > Safety"] and got["a"]["paragraphs"][0]["text"] == "Seen in Table 1 all. Tail."
    assert set(got) == {"a"}
    assert rows(markup.references(df)) == [("a", "r1", "PMC77", None, None, "Roe et al. 2020"), ("a", "r2", None, "5", None, "Big Group 2019"), ("a", "r3", None, None, None, None)]
    cited = rows(markup.cited_sentences(df).select("section", "sentence", "ref_ids"))
    assert ("Results > Safety", "Fine (Smith et al. 2020).", ["<range>", "r1", "r2"]) in cited and ("Results > Safety", "New one here.", ["r2"]) in cited
    units = {(r["kind"], r["label"]): r["text"] for r in markup.evidence_units(df).collect()}
    assert units["abstract", "Abstract"] == "Short text 4.5." and units["table", "Table 2"].startswith("Caption a | b") and units["title", ""] == "A good title"
    page = spark.createDataFrame([("<html><script>x<y</script><p>One &amp; <b>two</b></p><p>three</p></html>",), (None,)], "h string")
    assert [r[0] for r in page.select(markup.html_text(F.col("h"))).collect()] == ["One & two\nthree", None]


def test_layout(spark):
    spans = [("d", 1, 10.0, 60.0, 100.0, "Table 3. Means of"), ("d", 1, 10.0, 40.0, 112.0, "all groups"), ("d", 1, 10.0, 30.0, 130.0, "Group"), ("d", 1, 60.0, 80.0, 131.0, "12.5"), ("d", 1, 82.0, 95.0, 130.5, "(3)"), ("d", 1, 10.0, 30.0, 150.0, " ")]
    spans += [("d", 1, 10.0, 300.0, 170.0 + 12 * i, "this is running text of many words that ends the table here") for i in range(3)]
    df = spark.createDataFrame(spans, "doc string, page int, x0 double, x1 double, y double, text string")
    lines = layout.page_lines(df)
    assert [r["text"] for r in lines.orderBy("line_no").limit(3).collect()] == ["Table 3. Means of", "all groups", "Group | 12.5 (3)"]
    assert rows(layout.layout_tables(lines)) == [("d", 3, "Means of all groups", ["Group | 12.5 (3)"])]


def test_streams(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("Pain fell by 12.5 (PMC1, Table 2).\nexit\n\nAll 44.5 fine.\n")
    fast = lambda b: claims_of(b).select("claim", "numbers")
    strong = lambda b: claims_of(b).where("marker is not null").select("claim", "numbers")
    two_phases(read_lines(spark, str(source)), fast, strong, str(sink), str(tmp_path / "cp")).awaitTermination(60)
    got = rows(spark.read.parquet(str(sink)).select("phase", "claim"))
    assert got == [("final", "Pain fell by 12.5."), ("provisional", "All 44.5 fine."), ("provisional", "Pain fell by 12.5.")]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [r["total"] for r in windowed_counts(events).orderBy("begin").collect()] == [3.0, 4.0]
