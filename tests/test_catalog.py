"""Data sets, stores, settings and kept downloads."""

import json
from datetime import datetime

import pytest

from tabulith.sources import catalog as C


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_data_sets_and_stores(spark, tmp_path):
    root = str(tmp_path)
    lines(tmp_path / "data/pmc/items.jsonl", [{"id": "a"}, {"id": "b"}])
    lines(tmp_path / "data/pmc/corpus.jsonl", [{"id": "x", "text": "old"}, {"id": "x", "text": "new"}])
    lines(tmp_path / "data/pmc/papers.jsonl", [{"id": "P", "title": "t", "tables": [{"number": 1, "label": "Table 1", "caption": "c", "rows": ["a | b"], "foot": "n"}]}])
    lines(tmp_path / "fixtures/mini/docs.jsonl", [{"id": "F", "sections": []}])
    lines(tmp_path / "fixtures/mini/items_sample.jsonl", [{"id": "m"}])
    lines(tmp_path / "fixtures/mini/corpus.jsonl", [{"id": "F", "text": "t"}])
    lines(tmp_path / "labels/pmc_overrides.jsonl", [{"id": "a", "label": "x"}, {"id": "a", "label": "y"}])
    items, corpus = C.load_dataset(spark, root, "pmc", "full")
    assert items.count() == 2 and [r["text"] for r in corpus.collect()] == ["new"]
    assert C.load_dataset(spark, root, "mini")[0].first()["id"] == "m"
    assert C.load_store(spark, root, "mini").first()["id"] == "F"
    assert C.load_store(spark, root, "pmchard").first()["sections"][0]["text"] == "a | b\n\nNotes: n"
    for name, variant, error in (("pmcrefs", "tables", ValueError), ("other", "tables", ValueError), ("pmc", "full", FileNotFoundError), ("pmc", "x", ValueError)):
        with pytest.raises(error):
            C.load_store(spark, root, name, variant)
    assert [r["label"] for r in C.load_overrides(spark, root, "pmc").collect()] == ["y"] and C.load_overrides(spark, root, "none").count() == 0
    assert C.latest_run(spark, f"{root}/data/pmc/*.jsonl").endswith("papers.jsonl") and C.latest_run(spark, f"{root}/none/*") is None


def test_names_and_settings(tmp_path):
    assert C.variant_name("resolve", prompt="v2", cues=True) == "resolve-tables-v2-cues" and C.variant_name("tool", corpus="full", retries=0) == "tool-full-r0"
    assert C.variant_name("hybrid", escalate="flags,cues", strong="a/b") == "hybrid-v1-flags+cues-b" and C.variant_name("baseline") == "baseline"
    assert C.escalation_options("flags, cues,") == {"flags", "cues"} and C.run_stamp(datetime(2024, 1, 2, 3, 4, 5)) == "2024-01-02T03-04-05"
    with pytest.raises(ValueError, match="nope"):
        C.escalation_options("flags,nope")
    (tmp_path / "env").write_text("# c\nA=1\n\nB = x=y\nnothing\n")
    assert C.read_settings(str(tmp_path / "env"), {"A": "0"}) == {"A": "0", "B": "x=y"} and C.read_settings("/nowhere") == {}


def test_kept_downloads(spark, tmp_path):
    pages = {None: (["a", "b", "a"], "2"), "2": (["c", "k"], None)}
    got = C.paged(spark, str(tmp_path / "ids"), pages.__getitem__, known={"k"})
    assert [tuple(r) for r in got.collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert C.paged(spark, str(tmp_path / "ids"), None).count() == 3
    fetch = lambda i, v: f"%PDF {i}{v}".encode() if (i, v) in (("a", 2), ("b", 1)) else b"<html>" if i == "c" else None
    landed = C.land(got, str(tmp_path / "objects"), fetch, magic=b"%PDF")
    assert sorted((r["id"], r["version"]) for r in landed.collect()) == [("a", 2), ("b", 1)]
    assert C.land(got, str(tmp_path / "objects"), lambda i, v: b"%PDF late" if i == "c" else None, magic=b"%PDF").count() == 3
    assert {r["xml"] for r in C.as_xml(landed).collect()} >= {"%PDF a2"}


def test_run_filters_and_json(spark):
    records = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r3", "a"), ("r3", "z")], "run_name string, item_id string")
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in C.complete_enough(records, items).collect()] == [("r1", 2)]
    assert C.complete_enough(records, items, 1).count() == 2
    assert [r["item_id"] for r in C.limited(records, "item_id", 1, "r1").collect()] == ["a"]
    rows = spark.createDataFrame([("c", "D, Table 1", "supported"), ("d", "E", None)], "claim string, citation string, verdict string")
    issues = spark.createDataFrame([("D, Table 1", ("major",))], "citation string, issue struct<severity:string>")
    out = [json.loads(r["json"]) for r in C.as_json_rows(rows, issues).collect()]
    assert {"claim": "c", "citation": "D, Table 1", "verdict": "supported", "sourceIssues": [{"severity": "major"}]} in out and len(out) == 2
