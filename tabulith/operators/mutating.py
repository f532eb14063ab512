"""Controlled edits that make wrong claims out of right ones, and the items that they give.

Choices that need chance take the candidate with the least hash of key and candidate, so they
are the same on every run and spread over the candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.numbers import let
from tabulith.operators import building as G
from tabulith.session import cut

# What stands before a number that is no group value, how far two values of an
# arm mix-up may be apart, and how far a missing table's number is moved.
STATISTIC_BEFORE = r"(?i)(?:\b[pntFdgr]\s*[=<>(]\s*|\bSD\s*[=:]?\s*|±\s*|\(\s*|\[\s*95% CI:?\s*|[\[,]\s*|\bto\s*)$"
LOOK_BACK = 14
WIDEST_RATIO = 3
TABLE_STEPS = 3
LAST_DIGITS = 3
# End of fixed values.


def pick(candidates: Column, key: Column, salt: str = "pick") -> Column:
    """One of an array's candidates by hash; null without any."""
    keyed = F.transform(candidates, lambda c: F.struct(F.xxhash64(key, c, F.lit(salt)).alias("h"), c.alias("c")))
    return F.get(F.array_sort(keyed), F.lit(0))["c"]


def _pieces(text: Column) -> tuple[Column, Column]:
    """The numbers of a text as written, and what stands around them."""
    return F.regexp_extract_all(text, F.lit(G.BUILD_NUMBER), F.lit(0)), F.split(text, G.BUILD_NUMBER, -1)


def _put(gaps: Column, raws: Column) -> Column:
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(raws)), raws, lambda g, r: F.concat(g, r)), ""), F.element_at(gaps, -1))


def replace_number(text: Column, old: Column, new: Column) -> Column:
    """The text with its first number of the norm `old` replaced, thousands marked as before; null if it has none."""
    raws, gaps = _pieces(text)

    def put(rs: Column) -> Column:
        at = F.array_position(F.transform(rs, G.build_norm), old)
        marked = F.when(F.contains(F.get(rs, (at - 1).cast("int")), F.lit(",")) & ~F.contains(new, F.lit(".")), F.format_number(new.try_cast("bigint"), 0)).otherwise(new)
        return F.when(at > 0, _put(gaps, F.transform(rs, lambda r, i: F.when(i == at - 1, marked).otherwise(r))))

    return F.when(old.isNotNull() & new.isNotNull(), let(raws, put))


def forbidden_free(number: Column, forbidden: Column) -> Column:
    """Look-alikes of a number that are not among forbidden norms."""
    return F.filter(G.perturbations(number), lambda c: ~F.array_contains(forbidden, G.build_norm(c)))


def changed_value(claim: Column, source_numbers: Column, key: Column) -> Column:
    """Struct (old, new, text): the claim with one number of its source turned into one that the source lacks; null if none can be."""
    own = F.array_distinct(F.filter(G.build_informative(claim), lambda n: F.array_contains(source_numbers, n)))
    tries = F.transform(own, lambda n: F.struct(n.alias("old"), pick(forbidden_free(n, source_numbers), key, "value").alias("new")))
    good = F.filter(tries, lambda t: t["new"].isNotNull())
    one = F.get(F.array_sort(F.transform(good, lambda t: F.struct(F.xxhash64(key, t["old"]).alias("h"), t.alias("t")))), F.lit(0))["t"]
    made = let(one, lambda t: F.struct(t["old"].alias("old"), t["new"].alias("new"), replace_number(claim, t["old"], t["new"]).alias("text")))
    return F.when(F.size(good) > 0, made)


def swapped_values(claim: Column, rows: Column) -> Column:
    """The claim with two values of different cells of one table row exchanged; null if no two are alike enough.

    rows: the table's rows as written. Values must be informative, equal in decimals, less than
    WIDEST_RATIO apart and no statistic; the first row with such a pair decides, and in it
    the first pair in the order of the claim.
    """
    raws, gaps = _pieces(claim)

    def swap(rs: Column) -> Column:
        norms = F.transform(rs, G.build_norm)
        telling = G.build_informative(claim)
        before = lambda i: F.array_join(F.zip_with(F.slice(gaps, 1, i + 1), F.concat(F.slice(rs, 1, i), F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
        usable = F.filter(F.sequence(F.lit(0), F.greatest(F.size(rs) - 1, F.lit(0))), lambda i: (i < F.size(rs)) & F.array_contains(telling, F.get(norms, i)) & ~F.right(before(i), F.lit(LOOK_BACK)).rlike(STATISTIC_BEFORE))
        value = lambda i: F.abs(F.get(norms, i).try_cast("double"))
        decimals = lambda i: F.when(F.contains(F.get(rs, i), F.lit(".")), F.length(F.substring_index(F.get(rs, i), ".", -1))).otherwise(-F.length(F.get(rs, i)))
        alike = lambda p: (
            (F.get(norms, p["a"]) != F.get(norms, p["b"])) & (decimals(p["a"]) == decimals(p["b"])) & (F.least(value(p["a"]), value(p["b"])) > 0)
            & (F.greatest(value(p["a"]), value(p["b"])) < WIDEST_RATIO * F.least(value(p["a"]), value(p["b"])))
        )
        pairs = F.flatten(F.transform(usable, lambda a: F.transform(F.filter(usable, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        likely = F.filter(pairs, alike)
        cells = F.transform(rows, lambda r: F.transform(F.split(r, r" \| "), lambda c: G.build_numbers(c)))
        cell_of = lambda row, n: F.array_position(F.transform(row, lambda c: F.array_contains(c, n)), True)
        apart = lambda row, p: (cell_of(row, F.get(norms, p["a"])) > 0) & (cell_of(row, F.get(norms, p["b"])) > 0) & (cell_of(row, F.get(norms, p["a"])) != cell_of(row, F.get(norms, p["b"])))
        found = F.flatten(F.transform(cells, lambda row: F.filter(likely, lambda p: apart(row, p))))
        chosen = F.get(found, F.lit(0))
        turned = F.transform(rs, lambda r, i: F.when(i == chosen["a"], F.get(rs, chosen["b"])).when(i == chosen["b"], F.get(rs, chosen["a"])).otherwise(r))
        return F.when(chosen.isNotNull(), _put(gaps, turned))

    return let(raws, swap)


#: Edits of a claim against its table: name and function of (claim, caption and rows as text, rows).
EDITS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "swap_values": lambda claim, text, rows: swapped_values(claim, rows),
    "direction_flip": lambda claim, text, rows: G.direction_flip(claim),
    "significance_flip": lambda claim, text, rows: G.significance_flip(claim),
    "timepoint_swap": lambda claim, text, rows: G.timepoint_swap(claim, text),
}


def hard_items(good: DataFrame, key: str) -> DataFrame:
    """(key, kind, claim, original_claim, label): each right claim that can be edited, with one edit of it.

    good: (key, claim, heading, text) with the text of its table. Of the edits that apply one
    is taken by hash; both the claim and its edit come out (kind null for the claim).
    """
    rows = F.split(F.split(F.coalesce("text", F.lit("")), "\n\nNotes:")[0], "\n")
    whole = F.concat_ws(" ", "heading", "text")
    made = F.array(*(F.struct(F.xxhash64(key, F.lit(name)).alias("h"), F.lit(name).alias("kind"), edit(F.col("claim"), whole, rows).alias("claim")) for name, edit in EDITS.items()))
    chosen = F.get(F.array_sort(F.filter(made, lambda m: m["claim"].isNotNull() & (m["claim"] != F.col("claim")))), F.lit(0))
    both = good.select(key, F.col("claim").alias("original_claim"), chosen.alias("m")).where("m is not null")
    pair = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col("original_claim").alias("claim"), F.lit("supported").alias("label")), F.struct("m.kind", "m.claim", F.lit("not_supported").alias("label")))
    return both.select(key, "original_claim", F.explode(pair).alias("p")).select(key, "p.kind", "p.claim", "original_claim", "p.label")


def _table_number(label: Column) -> Column:
    return F.regexp_extract(label, r"^Table (\d+)$", 1).try_cast("int")


def wrong_targets(items: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, kind, doc_id, label): other tables and other papers to which a claim's citation can be moved.

    items: (key, doc_id, label, numbers); places: (doc_id, label, norms), a row for each table. Moved
    citations hold less than OTHER_COVERAGE of the claim's numbers; another paper's table has
    the same label. Missing tables are numbered beyond the last one.

    Other papers are not all tried on every item: tables of a label stand in buckets by hash,
    and an item looks at one bucket after the other until a table fits.
    """
    share = F.size(F.filter("numbers", lambda n: F.array_contains("norms", n))) / F.size("numbers")
    tables = places.select("doc_id", "label", "norms")
    asked = items.where(F.size("numbers") > 0)
    near = asked.select(key, "doc_id", "numbers", F.col("label").alias("own")).join(tables, "doc_id").where((F.col("label") != F.col("own")) & (share < G.OTHER_COVERAGE))
    location = near.groupBy(key, "doc_id").agg(F.min_by("label", F.xxhash64(F.col(key), F.col("label"))).alias("label")).select(key, F.lit("wrong_location").alias("kind"), "doc_id", "label")
    last = tables.groupBy("doc_id").agg(F.max(_table_number(F.col("label"))).alias("last")).where("last is not null")
    beyond = F.col("last") + 1 + F.pmod(F.xxhash64(key), F.lit(TABLE_STEPS)).cast("int")
    missing = items.select(key, "doc_id").join(last, "doc_id").select(key, F.lit("nonexistent_target").alias("kind"), "doc_id", F.concat(F.lit("Table "), beyond.cast("string")).alias("label"))
    return location.unionByName(missing).unionByName(_wrong_studies(asked, tables, key, share))


#: Tables of a label that an item looks at in one round, about.
STUDY_TRIES = 8


def _wrong_studies(asked: DataFrame, tables: DataFrame, key: str, share: Column) -> DataFrame:
    """Round by round the next bucket of a label's tables, until every item has one that fits or has seen all."""
    size = tables.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / STUDY_TRIES)).cast("int").alias("buckets"))
    offered = tables.join(size, "label").select("label", F.pmod(F.xxhash64("doc_id", "label"), "buckets").alias("bucket"), F.col("doc_id").alias("other"), "norms")
    open_ = cut(asked.select(key, "doc_id", "label", "numbers").join(size, "label"))
    done, turn = [], 0
    while not open_.isEmpty():
        mine = open_.withColumn("bucket", F.pmod(F.xxhash64(key, F.lit("study")) + turn, "buckets"))
        met = mine.join(offered, ["label", "bucket"]).where((F.col("other") != F.col("doc_id")) & (share < G.OTHER_COVERAGE))
        found = cut(met.groupBy(key, "label").agg(F.min_by("other", F.xxhash64(F.col(key), F.col("other"))).alias("doc_id")))
        done.append(found)
        turn += 1
        open_ = cut(open_.join(found.select(key), key, "left_anti").where(F.col("buckets") > turn))
    empty = asked.select(key, "label", "doc_id").limit(0)
    return reduce(DataFrame.unionByName, done, empty).select(key, F.lit("wrong_study").alias("kind"), "doc_id", "label")


def changed_ids(ids: DataFrame, key: str, taken: DataFrame) -> DataFrame:
    """(key, changed): each id with one of its last LAST_DIGITS digits changed so that it is not taken; none if all are.

    ids: (key, id); taken: (id).
    """
    n = F.length("id")
    at = F.sequence(n - LAST_DIGITS + 1, n)
    digit = lambda i: F.substring("id", i, F.lit(1))
    other = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string") != digit(i)), lambda d: F.concat(F.substring("id", F.lit(1), i - 1), d.cast("string"), F.substring("id", i + 1, n)))
    every = ids.where(F.col("id").rlike(rf"\d{{{LAST_DIGITS}}}$")).select(key, F.explode(F.flatten(F.transform(at, other))).alias("changed"))
    free = every.join(taken.select(F.col("id").alias("changed")).distinct(), "changed", "left_anti")
    return free.groupBy(key).agg(F.min_by("changed", F.xxhash64(F.col(key), F.col("changed"))).alias("changed"))


def mutated(items: DataFrame, places: DataFrame, rewrites: DataFrame, key: str) -> DataFrame:
    """(key, kind, claim, doc_id, label, mutation): every wrong item that an item can be made into.

    items: (key, claim, doc_id, label); places: (doc_id, label, norms); rewrites: (claim, kind, rewrite) of
    a judge, kept where their wording changes and their numbers do not.
    """
    from tabulith.operators.fixing import overstatement_passes

    asked = items.withColumn("numbers", G.build_informative(F.col("claim")))
    sourced = asked.join(places, ["doc_id", "label"], "left").withColumn("changed", changed_value(F.col("claim"), F.coalesce("norms", F.array().cast("array<string>")), F.col(key)))
    value = sourced.where("changed.text is not null").select(key, F.lit("value_mismatch").alias("kind"), F.col("changed.text").alias("claim"), "doc_id", "label", F.concat(F.col("changed.old"), F.lit(" -> "), F.col("changed.new")).alias("mutation"))
    moved = wrong_targets(asked, places, key).join(items.select(key, "claim", F.col("doc_id").alias("own_doc"), F.col("label").alias("own_label")), key)
    text = F.when(F.col("kind") == "wrong_study", F.concat_ws(" -> ", "own_doc", "doc_id")).otherwise(F.concat(F.col("own_label"), F.lit(" -> "), F.col("label"), F.when(F.col("kind") == "nonexistent_target", F.lit(" (does not exist)")).otherwise(F.lit(""))))
    moved = moved.select(key, "kind", "claim", "doc_id", "label", text.alias("mutation"))
    made = items.join(rewrites, "claim").where(F.when(F.col("kind") == "overstated_subtle", overstatement_passes(F.col("claim"), F.col("rewrite"), True)).otherwise(overstatement_passes(F.col("claim"), F.col("rewrite"), False)))
    made = made.select(key, "kind", F.col("rewrite").alias("claim"), "doc_id", "label", F.concat("kind", F.lit(" rewrite")).alias("mutation"))
    return value.unionByName(moved).unionByName(made)
