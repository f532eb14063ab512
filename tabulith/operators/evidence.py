"""Where numbers and quotes stand: suggested sources and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions import numbers as N
from tabulith.functions import text as X

# Numbers that a claim needs for another document's section, and suggestions at most.
NUMBERS_ELSEWHERE = 2
SUGGESTIONS = 3
# End of fixed values.
#: Quotes of one item that one task looks up, about; the quotes of an item with more are split over several.
HOT = 10_000


def sections_holding(asked: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, label): the sections that hold all of a row's numbers.

    asked: (key, numbers), numbers distinct; places: (norm, doc_id, label), distinct. Only the
    number that fewest sections hold is looked up, and the others are checked in the
    sections it leads to, so a number that stands everywhere is never joined unless it is
    a row's only one.
    """
    frequency = places.groupBy("norm").agg(F.count("*").alias("df"))
    each = asked.where(F.size("numbers") > 0).select(key, F.explode("numbers").alias("norm")).join(frequency, "norm", "left")
    # a number that no section holds rules a row out
    rarest = each.groupBy(key).agg(F.min_by("norm", F.struct(F.coalesce("df", F.lit(0)), "norm")).alias("norm"))
    held = places.groupBy("doc_id", "label").agg(F.collect_set("norm").alias("held"))
    met = rarest.join(places, "norm").select(key, "doc_id", "label").join(asked.select(key, "numbers"), key).join(held, ["doc_id", "label"])
    return met.where(F.size(F.array_except("numbers", "held")) == 0).select(key, "doc_id", "label")


def suggest(claims: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, pick): up to SUGGESTIONS places that hold every informative number of a claim.

    claims: (key, own, claim). Places of the own document are preferred; elsewhere a claim
    needs NUMBERS_ELSEWHERE numbers. More places than SUGGESTIONS say nothing and give none.
    """
    asked = claims.select(key, "own", F.array_distinct(F.transform(N.informative(F.col("claim")), lambda n: N.unsigned(n["norm"]))).alias("numbers")).where(F.size("numbers") > 0)
    met = sections_holding(asked.select(key, "numbers"), places, key).join(asked.select(key, "own", F.size("numbers").alias("n")), key)
    place = F.concat_ws(", ", "doc_id", "label")
    own = F.coalesce(F.col("doc_id") == F.col("own"), F.lit(False))
    picked = met.groupBy(key, "n").agg(F.array_sort(F.collect_set(F.when(own, place))).alias("mine"), F.array_sort(F.collect_set(place)).alias("every"))
    pick = F.when(F.size("mine") > 0, F.col("mine")).when(F.col("n") >= NUMBERS_ELSEWHERE, F.col("every")).otherwise(F.array().cast("array<string>"))
    return picked.withColumn("pick", pick).where((F.size("pick") > 0) & (F.size("pick") <= SUGGESTIONS)).select(key, "pick")


def plain_sources(texts: DataFrame, item: str, order: list[str]) -> DataFrame:
    """(item, plain): the first text of each item in that order, in plain form."""
    first = texts.groupBy(item).agg(F.min_by(F.struct("text"), F.struct(*order)).alias("s"))
    return first.select(item, X.plain_quote(F.coalesce("s.text", F.lit(""))).alias("plain"))


def ground_quotes(quotes: DataFrame, sources: DataFrame, key: str, item: str) -> DataFrame:
    """(key, grounded) of quotes whose item has a source.

    quotes: (key, item, quote); sources: (item, plain), with the text in plain form. Sources meet quotes in a
    shuffle by item at any size: texts pack so well that what seems small enough to broadcast may not fit the
    driver. A source is copied only for the parts of an item with more than HOT quotes.
    """
    counts = quotes.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = F.broadcast(counts.select(item, F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    asked = quotes.join(hot, item, "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.hash(key), F.col("parts")))).drop("parts")
    plain = sources.join(hot, item, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    parts = X.fragments(F.col("quote"))
    return asked.join(plain.hint("merge"), [item, "part"]).select(key, ((F.size(parts) > 0) & F.forall(parts, lambda f: F.contains("plain", f))).alias("grounded"))
