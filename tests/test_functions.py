"""Numbers, labels, quotes, citations and pages: expected values written for this library."""

import pytest
from pyspark.sql import functions as F

from tabulith.functions import numbers as N
from tabulith.functions import stats
from tabulith.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "norms"),
    [
        ("1,234 of 20 and .50", ["1234", "20", "0.5"]),
        ("a fall of −3.10 and -0", ["-3.1", "0"]),
        ("IL-17 and SF-12 scored 8.0", ["8"]),
        ("", []),
        ("v1.2.3 x", []),
    ],
)
def test_numbers(spark, text, norms):
    assert one(spark, F.transform(N.numbers_in(F.col("t")), lambda n: n["norm"]), t=text) == norms


def test_informative_numbers(spark):
    col = F.transform(N.informative(F.col("t")), lambda n: n["norm"])
    assert one(spark, col, t="In 2019, 12 of 340 (95% CI 1.5 to 2.50) had p = 0.05; 340 again, 100 and 13") == ["340", "1.5", "2.5", "13"]
    assert one(spark, col, t=None) is None


def test_rounding_and_derived_percentages(spark):
    miss = F.transform(N.missing(F.col("c"), F.col("s")), lambda m: m["number"])
    assert one(spark, miss, c="fell by 41.7 to 88", s="change -41.70 | 87.6") == []
    assert one(spark, miss, c="0.66 against 55%", s="0.630 | 11 of 20\nother 40 80") == ["0.66"]
    assert one(spark, miss, c="44 points", s="") == ["44"]
    near = F.flatten(F.transform(N.missing(F.col("c"), F.col("s")), lambda m: m["nearest"]))
    assert one(spark, near, c="score 50.5", s="10 | 51.2 | 49.9 | 80") == ["49.9", "51.2"]


def test_quotes(spark):
    ok = X.grounded(F.col("q"), F.col("s"))
    source = "Mean change was 4.5 points.\nNo “serious” event was seen."
    assert one(spark, ok, q="mean CHANGE was 4.5 ... no serious event", s=source)
    assert not one(spark, ok, q="mean change was 4.6", s=source)
    assert not one(spark, ok, q=" ... ", s=source)
    assert not one(spark, ok, q="anything", s=None)


@pytest.mark.parametrize(("a", "b", "same"), [("Table 1.4", "TABLE 1.4.", True), ("Table 1.4", "Table 14", False), ("Table 14.2.3", "table 14.2.3", True), ("Results > Safety", "results>safety", True)])
def test_label_keys(spark, a, b, same):
    assert (one(spark, X.label_key(F.col("t")), t=a) == one(spark, X.label_key(F.col("t")), t=b)) is same


@pytest.mark.parametrize(
    ("text", "tables"),
    [("Tables 3-5 of PMC77", ["3", "4", "5"]), ("Tables 14.2.1 and 14.2.2", ["14.2.1", "14.2.2"]), ("Table 2, 3 & 3", ["2", "3"]), ("Table S1", ["S1"]), ("Tables 1-90", ["1", "90"]), ("Figure 2", []), ("", [])],
)
def test_tables(spark, text, tables):
    assert one(spark, X.tables_in(F.col("t")), t=text) == tables


def test_documents_and_parts(spark):
    assert one(spark, X.document_in(F.col("t")), t="see pmc123, Table 2") == "PMC123"
    assert one(spark, X.document_in(F.col("t")), t="the CSR ABC-7 report") == "CSR-ABC-7"
    assert one(spark, X.document_in(F.col("t")), t="nothing here") is None
    assert one(spark, X.section_in(F.col("t")), t="fig. 3a of it") == "Figure 3a"


def test_terms_and_sentences(spark):
    assert one(spark, X.terms(F.col("t")), t="Dose 1,234.50 mg; Überdosis 3.0") == ["dose", "1234.5", "mg", "überdosis", "3"]
    assert one(spark, X.sentences(F.col("t")), t="It fell. See Fig. A here (p = 0.05). Smith et al. Found it! Done") == ["It fell.", "See Fig. A here (p = 0.05).", "Smith et al. Found it!", "Done"]
    assert one(spark, X.sentences(F.col("t")), t="") == []


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_pages(spark, size):
    text = "first line\n\nx\n" + "long " * 9 + "\nend"
    pages = one(spark, X.paginate(F.col("t"), size), t=text)
    assert all(0 < len(p) <= size or p == "" for p in pages)
    want, current = [], ""
    for line in text.split("\n"):
        for k in range(0, max(len(line), 1), size):
            piece = line[k : k + size]
            if current and len(current) + 1 + len(piece) > size:
                want.append(current)
                current = piece
            else:
                current = f"{current}\n{piece}" if current else piece
    assert pages == [*want, current] if current or not want else want
    assert one(spark, X.paginate(F.col("t"), size), t="") == [""]


def test_rates_and_ranks(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k int, n int")
    got = df.select(stats.rate(F.col("k"), F.col("n")), stats.wilson(F.col("k"), F.col("n"), False), stats.wilson(F.col("k"), F.col("n"), True)).collect()
    assert tuple(got[0]) == (None, None, None)
    assert got[1][0] == 0.5 and got[1][1] == pytest.approx(0.2366, abs=1e-4) and got[1][2] == pytest.approx(0.7634, abs=1e-4)
    assert got[2][2] == 1.0
    pairs = spark.createDataFrame([([(1, 2), (5, 1), (9, 1)], 4), ([], 0)], "c array<struct<value bigint, n bigint>>, t bigint")
    assert [r[0] for r in pairs.select(stats.nearest_rank(F.col("c"), F.col("t"), 0.5)).collect()] == [5.0, 0.0]
