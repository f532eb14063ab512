"""The tool agent with scripted judges, and its tools on a small store."""

import json

import pytest

from tabulith.operators import toolbox as T

SECTIONS = "section_id bigint, doc_id string, pos int, label string, heading string, kind string, text string"


@pytest.fixture(scope="module")
def store(spark):
    studies = spark.createDataFrame([("PMC1", "First trial", "study", ["Trial A"]), ("CSR-X2", "Second report", None, None), ("PMC3", None, None, [])], "id string, title string, kind string, aliases array<string>")
    sections = spark.createDataFrame(
        [(1, "PMC1", 0, "Table 1", "Means", "table", "arm | mean\ndrug | 12.5\nplacebo | 30.1"), (2, "PMC1", 1, "Results", None, "text", "The mean was 12.5 on drug.\n\n" + "long line " * 1500), (3, "CSR-X2", 0, "Table 1", "x", "table", "a | 77.7")],
        SECTIONS,
    )
    return studies, sections


def test_arguments():
    assert T.arguments('{"a": 1}') == {"a": 1} and T.arguments("") == {} and T.arguments("[1]") is None and T.arguments("{a") is None
    assert [T.whole_number(v) for v in (3, "4", 2.9, "x", None, True, "nan")] == [3, 4, 2, None, None, None, None]


def test_tools(spark, store):
    asked = [
        (0, "list_documents", {}), (1, "list_documents", {"filter": "REPORT", "page": "9"}), (2, "list_documents", {"filter": "zzz"}), (3, "get_outline", {"doc_id": "pmc1"}), (4, "get_outline", {"doc_id": "nope"}),
        (5, "read_section", {"doc_id": "trial a", "section": "Table 1: Means"}), (6, "read_section", {"doc_id": "PMC1", "section": "results", "page": "2"}), (7, "read_section", {"doc_id": "PMC1", "section": "Table 9"}),
        (8, "search", {"query": "12.50 mean"}), (9, "search", {"query": "77.7", "doc_id": "PMC1"}), (10, "search", {"query": " "}), (11, "fly", {}), (12, "search", {"query": "12.5", "doc_id": "none"}),
    ]
    calls = spark.createDataFrame(asked, "call int, tool string, args map<string,string>")
    got = {r["call"]: r for r in T.run_tools(calls, *store).collect()}
    assert got[0]["text"].startswith("3 documents (page 1 of 1):\n- CSR-X2: Second report (1 sections)\n- PMC1 [study]: First trial (2 sections)")
    assert got[1]["text"].startswith("1 documents (page 1 of 1)") and got[2]["error"] and not got[3]["error"]
    assert '- "Table 1" (caption: Means) [' in got[3]["text"] and "2 pages" in got[3]["text"] and got[4]["error"]
    assert got[5]["text"].startswith("PMC1, Table 1: Means\n\narm | mean") and got[5]["evidence"]
    assert "[page 2 of 3; call again with page=3 for more]" in got[6]["text"]
    assert got[7]["error"], got[7]
    assert "Available: Table 1, Results" in got[7]["text"]
    assert got[8]["text"].startswith('4 results for "12.50 mean":\n1. PMC1, Results: The mean') and got[9]["text"].startswith('No results for "77.7" in PMC1')
    assert got[10]["error"] and got[11]["error"] and got[12]["error"] and len(got) == len(asked)
    assert T.run_tools(calls.limit(0), *store).count() == 0


def make_judge():
    """A judge that workers get by value."""

    def call(name, **args):
        return {"content": None, "tool_calls": [{"name": name, "arguments": json.dumps(args)}], "prompt_tokens": 100}

    def verdict(kind, quote="", location="PMC1, Table 1"):
        return call("submit_verdict", verdict=kind, quote=quote, location=location, reason="r")

    def judge(messages):
        """Reads the cited table, then says what the claim's script asks for."""
        claim = messages[1]["content"]
        turns = sum(m["role"] == "assistant" for m in messages)
        if "broken judge" in claim:
            raise OSError("away")
        if "endless" in claim:
            return call("search", query="12.5")
        if turns == 0:
            return call("read_section", doc_id="PMC1", section="Table 1")
        if "chatty" in claim and turns == 1:
            return {"content": "I think so", "tool_calls": [], "prompt_tokens": 120}
        if "bad args" in claim and turns == 1:
            return {"content": "", "tool_calls": [{"name": "search", "arguments": "{oops"}]}
        if "misquote" in claim and "rejected" not in claim:
            return verdict("supported", "drug | 99.9")
        if "stubborn" in claim:
            return verdict("supported", "never there")
        return verdict("supported", "drug | 12.5")

    return judge


def test_checks_with_tools(spark, store):
    checks = spark.createDataFrame([(1, "mean 12.5", "PMC1, Table 1"), (2, "endless", "PMC1"), (3, "broken judge", "PMC1"), (4, "chatty", "PMC1"), (5, "bad args", "PMC1")], "item_no int, claim string, citation string")
    got = {r["item_no"]: r for r in T.check_with_tools(checks, *store, make_judge(), budget=3).collect()}
    assert got[1]["verdict"] == "supported" and got[1]["tool_calls"] == 1 and got[1]["turns"] == 2 and got[1]["peak_tokens"] == 100 and got[1]["evidence"][0].startswith("PMC1, Table 1")
    assert got[2]["exhausted"] and got[2]["verdict"] == "not_supported" and got[2]["tool_calls"] == 3 and len(got[2]["steps"]) == 3
    assert got[3]["error"].startswith("OSError") and got[3]["verdict"] is None
    assert got[4]["tool_calls"] == 2 and got[5]["tool_calls"] == 2 and got[5]["steps"][1]["error"] == "true"
    assert T.check_with_tools(checks.limit(0), *store, make_judge()).count() == 0


def test_retries(spark, store):
    checks = spark.createDataFrame([(1, "mean 12.5", "PMC1, Table 1"), (2, "misquote", "PMC1, Table 1"), (3, "stubborn", "PMC1, Table 1"), (4, "mean 55.5 stays", "PMC1, Table 1"), (5, "mean 12.5", "CSR-X2, Table 1")], "item_no int, claim string, citation string")
    got = {r["item_no"]: r for r in T.check_with_retries(checks, *store, make_judge()).collect()}
    assert got[1]["verdict"] == "supported" and len(got[1]["attempts"]) == 1
    assert got[2]["verdict"] == "supported" and [a["codes"] for a in got[2]["attempts"]] == [["ungrounded_quote"], []]
    assert got[3]["verdict"] == "not_supported" and len(got[3]["attempts"]) == 3 and got[3]["reason"].startswith("Could not verify")
    # numbers are held against a check once
    assert [a["codes"] for a in got[4]["attempts"]] == [["number_missing"], []] and got[4]["verdict"] == "supported"
    assert got[5]["attempts"][0]["codes"][:1] == ["off_target"] and {s["attempt"] for s in got[5]["steps"]} == {0, 1, 2}
