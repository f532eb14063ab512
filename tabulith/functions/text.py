"""Text as column expressions: quotes, terms, labels, sentences, locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these patterns.
TERM = r"[\p{L}\p{N}]+(?:[.,]\p{N}+)*"
NUMERIC_TERM = r"^\d[\d,]*(\.\d+)?$"
QUOTE_MARKS = "[‘’“”\"'`]"
QUOTE_KEPT = r"[^\p{L}\p{N}%.<>=±-]+"
ABBREVIATIONS = ("al", "Fig", "Tab", "vs", "approx", "e.g", "i.e", "No", "Ref")
TABLE = r"(?i)(?<![A-Za-z0-9_])(?:Supplementa(?:ry|l)\s+)?Tables?\s*(S?\d+(?:\.\d+)*[a-z]?)(?![A-Za-z0-9_])"
TABLES = r"(?i)(?<![A-Za-z0-9_])Tables?\s*((?:S?\d+(?:\.\d+)*[a-z]?)(?:\s*(?:,|and|&|-|–|to)\s*S?\d+(?:\.\d+)*[a-z]?)*)"
OTHER_SECTION = r"(?i)(?<![A-Za-z0-9_])(Figure|Fig\.|Listing|Section|Appendix|Module|Annex)\s*([A-Z]?\d+(?:\.\d+)*[a-z]?|[A-Z](?![A-Za-z0-9_]))"
PMC = r"(?i)(?<![A-Za-z0-9_])PMC\d+(?![A-Za-z0-9_])"
SUBMISSION = r"(?<![A-Za-z0-9_])(?:(?:CSR|RPT)[-\s]?[A-Z]*-?\d[\w-]*|[A-Z]{2,}-\d[\w-]*)"
WIDEST_RANGE = 20
JUDGMENT = (
    r"(?i)\b(significan\w*|no (?:\w+ )?differen\w*|similar\w*|comparable|trend\w*|overall|consistent\w*|superior\w*|inferior\w*|improv\w*|reduc\w*|increas\w*|decreas\w*"
    r"|higher|lower|greater|better|worse|effective\w*|caus\w*|led to|resulted|demonstrat\w*|show\w*|reveal\w*|indicat\w*|suggest\w*|associated|predict\w*|equivalen\w*|well tolerated|safe\w*)\b"
)
# End of fixed values.


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First match or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def plain_quote(text: Column) -> Column:
    """A quote or source without case, quotation marks, lone dots and other marks."""
    out = F.regexp_replace(F.lower(text), QUOTE_MARKS, "")
    out = F.regexp_replace(out, r"(?<!\d)\.|\.(?!\d)", " ")
    return F.trim(F.regexp_replace(out, QUOTE_KEPT, " "))


def fragments(quote: Column) -> Column:
    """The parts of a quote between ellipses and line breaks, in plain form, without empty ones."""
    parts = F.split(F.regexp_replace(quote, r"(?i)^\s*Title:\s*", ""), r"\.\.\.|…|\n")
    return F.filter(F.transform(parts, plain_quote), lambda f: F.length(f) > 0)


def grounded(quote: Column, source: Column) -> Column:
    """Whether a quote has fragments and all of them stand in the source; false for null sources."""
    parts, plain = fragments(quote), plain_quote(F.coalesce(source, F.lit("")))
    return (F.size(parts) > 0) & F.forall(parts, lambda f: F.contains(plain, f))


def term(word: Column) -> Column:
    low = F.lower(word)
    digits = F.regexp_replace(low, ",", "")
    return F.when(low.rlike(NUMERIC_TERM), F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)).otherwise(low)


def terms(text: Column) -> Column:
    """Search terms: words in lower case, numbers whole and without trailing zeros."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), term)


def label_key(label: Column) -> Column:
    """A section label for comparison: letters, digits, '>' and the dots between digits."""
    out = F.regexp_replace(F.lower(label), r"(\d)\.(?=\d)", "$1\u0000")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9>\u0000]+", ""), "\u0000", ".")


def id_key(name: Column) -> Column:
    """An id or alias for comparison: letters and digits in lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def sentences(text: Column) -> Column:
    """Sentences: split after . ! ? before white space and a capital or bracket, not after abbreviations."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marked = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9_])({short})\.(?=\s+[A-Z(\[])", "$1\u0001")
    parts = F.split(marked, r"(?<=[.!?])(?=\s+[A-Z(\[])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "\u0001", "."), r"^\s+|\s+$", ""))), lambda p: F.length(p) > 0)


def document_in(text: Column) -> Column:
    """The report id that a text names, or null."""
    found = F.coalesce(extract(text, PMC), extract(text, SUBMISSION))
    return F.upper(F.regexp_replace(found, r"\s+", "-"))


def table_in(text: Column) -> Column:
    return extract(text, TABLE, 1)


def section_in(text: Column) -> Column:
    """Any other named part, e.g. 'Figure 2'."""
    kind, number = extract(text, OTHER_SECTION, 1), extract(text, OTHER_SECTION, 2)
    return F.concat_ws(" ", F.when(F.lower(kind).startswith("fig"), F.lit("Figure")).otherwise(F.initcap(kind)), number)


def tables_in(text: Column) -> Column:
    """All tables that a citation names, ranges of whole numbers spelled out, each once."""
    listed = F.split(extract(text, TABLES, 1), r"(?i)\s*(?:,|and|&)\s*")
    low = lambda p: F.regexp_extract(p, r"^(\d+)\s*(?:-|–|to)\s*(\d+)$", 1).try_cast("int")
    high = lambda p: F.regexp_extract(p, r"^(\d+)\s*(?:-|–|to)\s*(\d+)$", 2).try_cast("int")
    spelled = lambda p: F.when(
        low(p).isNotNull() & (high(p) - low(p) < WIDEST_RANGE),
        F.when(low(p) <= high(p), F.transform(F.sequence(low(p), F.greatest(low(p), high(p))), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>")),
    ).otherwise(F.filter(F.split(p, r"\s*(?:-|–|to)\s*"), lambda x: F.length(x) > 0))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(listed, spelled))), F.array().cast("array<string>"))


def paginate(text: Column, size: int) -> Column:
    """Pages of at most `size` characters, broken at lines where possible."""
    # Array of full pages, and the open page (null at the start).
    blank = F.struct(F.array().cast("array<string>").alias("pages"), F.lit(None).cast("string").alias("open"))
    cuts = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(line) - 1) / size), F.lit(0)).cast("int")), lambda i: F.substring(line, i * size + 1, F.lit(size)))
    pieces = F.flatten(F.transform(F.split(text, "\n"), cuts))

    def add(state: Column, piece: Column) -> Column:
        held = F.coalesce(state["open"], F.lit(""))
        full = (F.length(held) > 0) & (F.length(held) + 1 + F.length(piece) > size)
        joined = F.when(F.length(held) > 0, F.concat(held, F.lit("\n"), piece)).otherwise(piece)
        return F.struct(F.when(full, F.concat(state["pages"], F.array(held))).otherwise(state["pages"]).alias("pages"), F.when(full, piece).otherwise(joined).alias("open"))

    def close(state: Column) -> Column:
        held = F.coalesce(state["open"], F.lit(""))
        return F.when((F.length(held) > 0) | (F.size(state["pages"]) == 0), F.concat(state["pages"], F.array(held))).otherwise(state["pages"])

    return F.aggregate(pieces, blank, add, close)
