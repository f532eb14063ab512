"""Numbers in text as column expressions: extraction, comparison and their order of nearness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these patterns and limits.
NUMBER = r"(?<![\w.])(?<![A-Za-z][-‐−])[-−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|(?<![\w.])\.\d+"
CONFIDENCE = r"(?i)95\s?%\s?(?:CI|confidence)"
IGNORED = ("0.05", "0.01", "0.001", "0.0001", "95", "100")
SMALLEST_INTEGER = 13
FIRST_YEAR, LAST_YEAR = 1900, 2100
TOLERANCE = 1e-9
INTEGERS_PER_LINE = 12
NEAREST = 2
# End of fixed values.


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def parse(raw: Column) -> Column:
    """Struct (raw, value, decimals, norm) of a written number."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "−", "-"), ",", ""), r"^(-?)\.", "$10.")
    decimals = F.when(F.contains(plain, F.lit(".")), F.length(F.substring_index(plain, ".", -1))).otherwise(F.lit(0))
    short = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.struct(raw.alias("raw"), plain.cast("double").alias("value"), decimals.alias("decimals"), F.when(short == "-0", F.lit("0")).otherwise(short).alias("norm"))


def numbers_in(text: Column) -> Column:
    """All numbers of a text in order; digits that belong to a name ("IL-27") are none. Null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), parse)


def first_by_norm(numbers: Column) -> Column:
    """The first number of each spelling."""
    return let(numbers, lambda ns: let(F.transform(ns, lambda n: n["norm"]), lambda norms: F.filter(ns, lambda n, i: F.array_position(norms, n["norm"]) == i + 1)))


def informative(text: Column) -> Column:
    """Distinct numbers that carry data: decimals, and whole numbers from 13 that are no years."""
    size = lambda n: F.abs(n["value"])
    numbers = numbers_in(F.regexp_replace(text, CONFIDENCE, " "))
    telling = F.filter(numbers, lambda n: ~n["norm"].isin(*IGNORED) & ((n["decimals"] > 0) | ((size(n) >= SMALLEST_INTEGER) & ~size(n).between(FIRST_YEAR, LAST_YEAR))))
    return first_by_norm(telling)


def present(number: Column, source: Column) -> Column:
    """Whether the numbers of a source hold a number, leaving aside its sign, or a more precise one that rounds to it."""
    size = F.abs(number["value"])
    slack = 0.5 * F.pow(F.lit(10.0), -number["decimals"]) + TOLERANCE
    return F.exists(source, lambda s: (F.abs(s["value"]) == size) | ((s["decimals"] > number["decimals"]) & (F.abs(F.abs(s["value"]) - size) <= slack)))


def counts_by_line(text: Column) -> Column:
    """The positive whole numbers of each line with at most INTEGERS_PER_LINE of them."""
    counts = lambda line: F.transform(F.filter(numbers_in(line), lambda n: (n["decimals"] == 0) & (n["value"] > 0)), lambda n: n["value"])
    return F.filter(F.transform(F.split(text, "\n"), counts), lambda c: (F.size(c) > 1) & (F.size(c) <= INTEGERS_PER_LINE))


def derived_percent(number: Column, lines: Column) -> Column:
    """Whether two counts on one of the lines (counts_by_line) give a number as their percentage."""
    size = F.abs(number["value"])
    slack = 0.5 * F.pow(F.lit(10.0), -number["decimals"]) + TOLERANCE
    return F.exists(lines, lambda c: F.exists(c, lambda k: F.exists(c, lambda n: (k < n) & (F.abs(100 * k / n - size) <= slack))))


def percents(text: Column) -> Column:
    """Norms of the numbers followed by a per cent sign."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})\\s?%"), F.lit(1))
    return F.transform(found, lambda r: parse(r)["norm"])


def missing(claim: Column, source_text: Column) -> Column:
    """The claim's informative numbers that the source lacks: array of structs (number, nearest)."""

    def among(source: Column) -> Column:
        absent = F.filter(informative(claim), lambda n: ~present(n, source))
        shares = percents(claim)
        # a percentage may follow from two counts; lines are parsed only where a number is absent
        kept = F.when(F.size(absent) > 0, let(counts_by_line(source_text), lambda lines: let(shares, lambda sh: F.filter(absent, lambda n: ~(F.array_contains(sh, n["norm"]) & derived_percent(n, lines)))))).otherwise(absent)
        return let(first_by_norm(source), lambda distinct: F.transform(kept, lambda n: F.struct(n["raw"].alias("number"), nearest(n, distinct).alias("nearest"))))

    return let(numbers_in(source_text), among)


def nearest(number: Column, source: Column, count: int = NEAREST) -> Column:
    """The source's closest numbers as written there, of equally close ones the first."""
    size = F.abs(number["value"])
    ranked = F.array_sort(F.transform(source, lambda s, i: F.struct(F.abs(F.abs(s["value"]) - size).alias("d"), i.alias("i"), s["raw"].alias("raw"))))
    return F.transform(F.slice(ranked, 1, count), lambda s: s["raw"])


def unsigned(norm: Column) -> Column:
    return F.regexp_replace(norm, "^-", "")


# DuckDB's pattern language lacks look-behind; the same numbers in two steps.
_WHOLE = r"(?:\d{1,3}(?:,\d{3})+|\d+)"


def raw_sql(text: str) -> str:
    return f"regexp_extract_all(regexp_replace({text}, '([A-Za-z][-‐−]){_WHOLE}(?:\\.\\d+)?', '\\1 ', 'g'), '(^|[^\\w.])([-−]?{_WHOLE}(?:\\.\\d+)?|\\.\\d+)', 2)"


def plain_sql(raw: str) -> str:
    return f"regexp_replace(replace(replace({raw}, '−', '-'), ',', ''), '^(-?)\\.', '\\10.')"


def norm_sql(raw: str) -> str:
    p = plain_sql(raw)
    return f"(CASE WHEN contains({p}, '.') THEN regexp_replace(regexp_replace({p}, '0+$', ''), '\\.$', '') ELSE {p} END)"


def fixed_sql(raw: str) -> str:
    return f"(CASE WHEN {norm_sql(raw)} = '-0' THEN '0' ELSE {norm_sql(raw)} END)"


def decimals_sql(raw: str) -> str:
    return f"(CASE WHEN contains({raw}, '.') THEN length(split_part({raw}, '.', -1)) ELSE 0 END)"


def informative_sql(raw: str) -> str:
    """Whether a written number carries data."""
    v = f"abs(CAST({plain_sql(raw)} AS DOUBLE))"
    ignored = ", ".join(f"'{x}'" for x in IGNORED)
    return f"({fixed_sql(raw)} NOT IN ({ignored}) AND (contains({raw}, '.') OR ({v} >= {SMALLEST_INTEGER} AND NOT {v} BETWEEN {FIRST_YEAR} AND {LAST_YEAR})))"


def without_confidence_sql(text: str) -> str:
    return f"regexp_replace({text}, '{CONFIDENCE}', ' ', 'g')"
