"""Building labelled test sets: linking claims to tables, controlled edits, samples and leak filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions.numbers import CONFIDENCE, IGNORED, let
from tabulith.operators.reviewing import ascii_words

# Results depend on these patterns and limits. The number pattern here is the
# one of the building step, which keeps repeats and knows no leading-dot form.
BUILD_NUMBER = r"(?<![\w.])[-−]?\d[\d,]*(?:\.\d+)?"
BUILD_ABBREVIATIONS = ("vs", "al", "Fig", "Figs", "e.g", "i.e", "approx", "No", "ref", "Refs", "Ref", "n")
REFERENCE_MARK = r"\s*\[[\d,\s–-]+\]"
TABLE_REMARK = r"\s*\((?:[^()]*\b(?:Tables?|Fig\.?|Figures?|Supplementary|Additional file)\b[^()]*)\)"
TABLE_WORD = r"\b(Tables?|Figures?|Fig\.)(?![A-Za-z0-9_])"
CLAIM_CHARS = (40, 400)
RESULTS = r"(?i)result|finding|outcome"
METHODS = r"(?i)method"
BEST_COVERAGE, SECOND_COVERAGE, NUMBERS_PER_CLAIM = 0.8, 0.5, 2
OTHER_COVERAGE = 0.3
LEAK_CHARS, LEAK_COVERAGE = 80, 0.5
DIRECTIONS = (("higher", "lower"), ("increased", "decreased"), ("increase", "decrease"), ("greater", "smaller"), ("rose", "fell"), ("improved", "worsened"))
NEGATION = r"(?i)\b(no|not|neither|without)\b"
NOT_SIGNIFICANT = r"(?i)\bnot (statistically )?significant(ly)?\b"
SIGNIFICANTLY = r"(?i)\b(statistically )?significantly (higher|lower|greater|increased|decreased|improved|reduced|different|better|worse)\b"
TIME = r"(?i)\b(\d+)(\s*|-)(weeks?|months?|days?|years?)\b"
EXCLUDED_TOP_SECTIONS = r"(?i)result|discussion|conclusion|limitation|finding|summary|^outcomes?$"
# End of fixed values.
#: Characters of a part of a joined section, about.
SECTION_CHARS = 1_000_000
#: Neighbouring words by which the beginning of a claim is looked up.
LEAK_WORDS = 4


def build_norm(raw: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(raw, "−", "-"), ",", "")
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)


def build_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(BUILD_NUMBER), F.lit(0)), build_norm)


def build_informative(text: Column) -> Column:
    """Norms of the numbers that carry data, repeats kept."""
    telling = lambda n: ~n.isin(*IGNORED) & (F.contains(n, F.lit(".")) | ((F.abs(n.cast("double")) >= 13) & ~F.abs(n.cast("double")).between(1900, 2100)))
    return F.filter(build_numbers(F.regexp_replace(text, CONFIDENCE, " ")), telling)


def build_sentences(text: Column) -> Column:
    short = "|".join(a.replace(".", r"\.") for a in BUILD_ABBREVIATIONS)
    marked = F.regexp_replace(text, rf"(?<![A-Za-z0-9_])({short})\.", "$1\u0001")
    parts = F.split(marked, r"(?<=[.!?])\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, "\u0001", "."), r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)


def clean_claim(sentence: Column) -> Column:
    """A sentence without reference marks and remarks on tables; null if it still names one or has an unfit length."""
    s = F.regexp_replace(F.regexp_replace(sentence, REFERENCE_MARK, ""), ascii_words(TABLE_REMARK), "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(~s.rlike(ascii_words(TABLE_WORD)) & F.length(s).between(*CLAIM_CHARS), s)


def is_results(section: Column) -> Column:
    return section.rlike(RESULTS) & ~section.rlike(METHODS)


def coverage(claims: DataFrame, places: DataFrame, claim_key: str, group: str, place: str) -> DataFrame:
    """(claim_key, place, coverage): share of a claim's numbers that each place of its group holds.

    claims: (claim_key, group, numbers); places: (group, place, norm), distinct. Places without
    any of the numbers give no row. Numbers meet by equality; repeats of a number weigh.
    """
    asked = claims.where(F.size("numbers") > 0).select(claim_key, group, F.size("numbers").alias("n_"), F.explode("numbers").alias("norm")).groupBy(claim_key, group, "n_", "norm").agg(F.count("*").alias("times_"))
    return asked.join(places, [group, "norm"]).groupBy(claim_key, group, "n_", place).agg(F.sum("times_").alias("held_")).select(claim_key, group, place, (F.col("held_") / F.col("n_")).alias("coverage"))


def link_claims(claims: DataFrame, places: DataFrame, claim_key: str, group: str, place: str) -> DataFrame:
    """(claim_key, place, coverage) of claims that one place covers well and no other one half."""
    covered = coverage(claims, places, claim_key, group, place)
    best = covered.groupBy(claim_key).agg(F.max(F.struct("coverage", place)).alias("b"), F.sort_array(F.collect_list("coverage"), asc=False).alias("all_coverage"))
    second = F.coalesce(F.get("all_coverage", F.lit(1)), F.lit(0.0))
    return best.where((F.col("b.coverage") >= BEST_COVERAGE) & (second < SECOND_COVERAGE)).select(claim_key, F.col(f"b.{place}").alias(place), "b.coverage")


def _keep_case(source: Column, word: str) -> Column:
    return F.when(F.substring(source, 1, 1).rlike("[A-Z]"), F.lit(word.capitalize())).otherwise(F.lit(word))


def direction_flip(claim: Column) -> Column:
    """The claim with its only direction word turned round; null with none, several, or a negation."""
    flips = dict(DIRECTIONS) | {b: a for a, b in DIRECTIONS}
    any_word = ascii_words(r"(?i)\b(" + "|".join(flips) + r")\b")
    hit = F.regexp_extract_all(claim, F.lit(any_word), F.lit(1))
    word = F.get(hit, F.lit(0))
    other = F.lit(None).cast("string")
    for a, b in flips.items():
        other = F.when(F.lower(word) == a, _keep_case(word, b)).otherwise(other)
    turned = F.regexp_replace(claim, F.lit(any_word), other)
    return F.when((F.size(hit) == 1) & ~claim.rlike(ascii_words(NEGATION)), turned)


def significance_flip(claim: Column) -> Column:
    """The claim with its only mark of significance turned round; null otherwise."""
    once = lambda p: F.size(F.regexp_extract_all(claim, F.lit(ascii_words(p)), F.lit(0))) == 1
    first = F.regexp_replace(claim, ascii_words(NOT_SIGNIFICANT), "$1significant$2")
    second = F.regexp_replace(claim, ascii_words(SIGNIFICANTLY), "not $1significantly $2")
    return F.when(once(NOT_SIGNIFICANT), first).when(once(SIGNIFICANTLY), second)


def _times(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ascii_words(TIME)), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^(\d+)", 1).try_cast("int").alias("n"), F.regexp_replace(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)), "s$", "").alias("unit")))


def timepoint_swap(claim: Column, source: Column) -> Column:
    """The claim with its only time point replaced by the source's closest other one of the unit, the smaller of equals."""

    def swapped(own: Column) -> Column:
        here = own[0]
        others = F.filter(_times(source), lambda t: (t["unit"] == here["unit"]) & ~t["n"].isin(0) & (t["n"] != here["n"]))
        nearest = F.get(F.array_sort(F.transform(others, lambda t: F.struct(F.abs(t["n"] - here["n"]).alias("d"), t["n"].alias("n")))), F.lit(0))["n"]
        return F.regexp_replace(claim, F.lit(ascii_words(TIME)), F.concat(nearest.cast("string"), F.lit("$2$3")))

    return let(_times(claim), lambda own: F.when(F.size(own) == 1, swapped(own)))


def perturbations(number: Column) -> Column:
    """Look-alikes of a written number: neighbouring digits swapped, the last digit moved by up to 3; no leading zero."""
    chars = F.split(number, "")
    at = F.filter(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(number, i, F.lit(1)).rlike(r"\d"))
    put = lambda i, c: F.concat(F.substring(number, F.lit(1), i - 1), c, F.substring(number, i + 1, F.length(number)))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1))), lambda k: F.struct(F.get(at, k - 1).alias("a"), F.get(at, k).alias("b"))), lambda p: p["b"].isNotNull())
    digit = lambda i: F.substring(number, i, F.lit(1))
    swaps = F.transform(F.filter(pairs, lambda p: digit(p["a"]) != digit(p["b"])), lambda p: F.concat(F.substring(number, F.lit(1), p["a"] - 1), digit(p["b"]), F.substring(number, p["a"] + 1, p["b"] - p["a"] - 1), digit(p["a"]), F.substring(number, p["b"] + 1, F.length(number))))
    last = F.element_at(at, -1)
    moved = F.transform(F.filter(F.transform(F.array(*(F.lit(d) for d in (1, 2, 3, -1, -2, -3))), lambda d: digit(last).cast("int") + d), lambda d: d.between(0, 9)), lambda d: put(last, d.cast("string")))
    del chars
    return F.filter(F.concat(swaps, moved), lambda c: ~c.rlike(r"^-?0\d"))


def text_sections(paragraphs: DataFrame, by: list[str], order: str, text: str, chars: int = SECTION_CHARS) -> DataFrame:
    """Paragraphs of one section joined in order: (by, part, first, text, paragraphs).

    A section of more than `chars` characters comes in several parts, as one row must not
    grow with the data; a paragraph stays whole. Null texts count as empty ones.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce(F.col(text), F.lit(""))) + 2
    own = paragraphs.select(*by, F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / chars).cast("int").alias("part"))
    g = own.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("p"))
    return g.select(*by, "part", F.col("p")[0]["o"].alias("first"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"), F.size("p").alias("paragraphs"))


def plain_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_.%]+", " "), r"\s+", " "))


def _inner_words(plain: Column) -> Column:
    """The words of a plain text that its ends do not cut."""
    words = F.split(plain, " ")
    return F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))


def leaking(paragraphs: DataFrame, claims: DataFrame, key: str, group: str) -> DataFrame:
    """Keys of paragraphs that give away a claim of their group: by its beginning, or by half of its numbers.

    paragraphs: (key, group, text); claims: (claim_no, group, text). Both ways meet by
    equality within the group: by numbers, or by LEAK_WORDS neighbouring words out of the
    middle of the beginning (the longest word of one that has fewer), and whole beginnings
    are looked for only where these meet. Beginnings of less than three words, which have
    no whole word inside, are looked for in every paragraph of their group. Claims without
    a letter or digit give nothing away.
    """
    own = paragraphs.where("text is not null").select(key, group, plain_text(F.col("text")).alias("plain"), build_numbers(F.col("text")).alias("numbers"))
    asked = claims.where("text is not null").select("claim_no", group, F.substring(plain_text(F.col("text")), 1, LEAK_CHARS).alias("beginning"), build_informative(F.col("text")).alias("wanted"))
    inner = _inner_words(F.col("beginning"))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    begun = asked.where("beginning <> ''").select(group, "beginning", F.when(F.size(inner) >= LEAK_WORDS, F.array_join(F.slice(inner, 1, LEAK_WORDS), " ")).when(F.size(inner) > 0, longest).alias("piece"), F.size(inner).alias("n")).distinct()
    runs = lambda words: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - LEAK_WORDS + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, LEAK_WORDS), " "))
    # the words of a text are made once, not for each of its runs
    pieces = own.select(key, group, F.explode(let(F.split("plain", " "), lambda words: F.array_distinct(F.concat(runs(words), words)))).alias("piece"))
    met = pieces.join(begun.where("n > 0").select(group, "piece", "beginning"), [group, "piece"]).select(key, group, "beginning").distinct()
    begins = met.join(own.select(key, group, "plain"), [key, group]).where(F.contains("plain", "beginning")).select(key)
    short = own.select(key, group, "plain").join(begun.where("n = 0").select(group, "beginning"), group).where(F.contains("plain", "beginning")).select(key)
    places = own.select(group, F.col(key).alias("place"), F.explode(F.array_distinct("numbers")).alias("norm"))
    numeric = coverage(asked.where(F.size("wanted") >= NUMBERS_PER_CLAIM).select("claim_no", group, F.col("wanted").alias("numbers")), places, "claim_no", group, "place").where(F.col("coverage") >= LEAK_COVERAGE).select(F.col("place").alias(key))
    return begins.unionByName(short).unionByName(numeric).distinct()


def without_leaks(paragraphs: DataFrame, claims: DataFrame, key: str, group: str) -> DataFrame:
    """The paragraphs that give no claim away and stand in no section that reports results.

    paragraphs: (key, group, section, text). The section counts by the first name of its path.
    """
    top = F.split(F.coalesce("section", F.lit("")), " > ")[0]
    kept = paragraphs.where(~top.rlike(EXCLUDED_TOP_SECTIONS))
    return kept.join(leaking(kept, claims, key, group), key, "left_anti")


def balanced(rows: DataFrame, kind: str, key: str, total: int) -> DataFrame:
    """At most `total` rows, taken round-robin over the kinds in their order; rows of a kind by key."""
    rn = F.row_number().over(Window.partitionBy(kind).orderBy(key))
    numbered = rows.withColumn("turn", rn).where(F.col("turn") <= total)
    return numbered.orderBy("turn", F.asc_nulls_first(kind), key).limit(total)


def capped(rows: DataFrame, group: str, key: str, cap: int) -> DataFrame:
    """At most `cap` rows of each group, by key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("place") <= cap).drop("place")


def round_robin(rows: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Rows with the kind of their place, in turn; the place is the rank by key.

    Ranks come from counts of key ranges, so no task sees all rows.
    """
    ranged = rows.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1 + F.col("before")
    named = F.array(*(F.lit(k) for k in kinds))
    return ranged.join(F.broadcast(before), "part").withColumn("place", place).withColumn("kind", F.get(named, (F.col("place") % len(kinds)).cast("int"))).drop("part", "before")


def assigned(rows: DataFrame, possible: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """(key, kind): the kind of each row's place in turn if it is possible, else the first possible one in order; rows without any are left out.

    possible: (key, kind), what each row can be made into.
    """
    turn = round_robin(rows.select(key), key, kinds).select(key, F.col("kind").alias("wanted"))
    rank = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("kind"))
    met = turn.join(possible.select(key, "kind").distinct(), key).where(rank > 0)
    return met.groupBy(key).agg(F.min_by("kind", F.struct(F.col("kind") != F.col("wanted"), rank)).alias("kind"))


def full_documents(studies: DataFrame, claims: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, kind, pos, part, label, section_kind, text): whole documents, study reports and the papers they cite.

    studies and references: evidence units (id, unit_no, kind, label, text); claims: (claim_no, id, text). Study reports lose
    sections that report results and paragraphs that give a claim away; cited papers keep
    all, with their abstract. Paragraphs of a section stand together, where its first one stood.
    """
    body = studies.where("unit_no is not null and kind = 'paragraph'").select(F.concat_ws("/", "id", F.col("unit_no").cast("string")).alias("key"), "id", "unit_no", F.col("label").alias("section"), "label", "text")
    kept = without_leaks(body.select("key", "id", "section", "text"), claims, "key", "id").select("key").join(body, "key").select("id", "unit_no", "label", "text")
    tables = studies.where("kind = 'table'").select("id", "unit_no", "label", "text")
    own = text_sections(kept, ["id", "label"], "unit_no", "text").withColumn("section_kind", F.lit("text")).unionByName(text_sections(tables, ["id", "label"], "unit_no", "text").withColumn("section_kind", F.lit("table")))
    cited = references.where("unit_no is not null").withColumn("section_kind", F.when(F.col("kind") == "table", F.lit("table")).otherwise(F.lit("text")))
    theirs = text_sections(cited, ["id", "label", "section_kind"], "unit_no", "text")
    both = own.withColumn("kind", F.lit("study")).unionByName(theirs.withColumn("kind", F.lit("reference")))
    return both.select(F.col("id").alias("doc_id"), "kind", F.col("first").alias("pos"), "part", "label", "section_kind", "text")
