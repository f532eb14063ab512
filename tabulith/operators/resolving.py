"""From citations to documents and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions import text as X

#: Fixed value: shortest alias that is looked for inside text.
ALIAS_MINIMUM = 3
_SEPARATOR = r"[-\s_./]"


def alias_keys(studies: DataFrame) -> DataFrame:
    """(key, doc_id): ids and aliases for comparison; a key of several documents belongs to the first id."""
    names = studies.where("id is not null").select("id", F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    keyed = names.select(X.id_key(F.col("name")).alias("key"), "id", (X.id_key(F.col("name")) != X.id_key(F.col("id"))).alias("is_alias")).where("length(key) > 0")
    return keyed.groupBy("key").agg(F.min_by("id", F.struct("is_alias", "id")).alias("doc_id"))


def name_candidates(text: Column, most: int) -> Column:
    """Keys of all names that a text may hold: up to `most` neighbouring words joined by single separators."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[-\s_./][a-z0-9]+)*"), F.lit(0))

    def joined(run: Column) -> Column:
        parts = F.split(run, _SEPARATOR)
        starts = F.sequence(F.lit(1), F.size(parts))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(parts) - i + 1)), lambda n: F.array_join(F.slice(parts, i, n), ""))))

    return F.array_distinct(F.flatten(F.transform(runs, joined)))


def match_documents(cited: DataFrame, key: str, text: str, studies: DataFrame) -> DataFrame:
    """(key, doc_id): the document that a text names by id or alias, of several the one with the longest name.

    PMC ids count before other names. Names are met by equality of keys, never by trying
    every alias on every text; texts are cut into names of as many words as the longest
    name of the store has.
    """
    names = alias_keys(studies)
    written = studies.where("id is not null").select(F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    most = written.agg(F.max(F.size(F.split(F.trim("name"), r"[^A-Za-z0-9]+")))).first()[0] or 1
    pmc = X.id_key(X.extract(F.col(text), X.PMC))
    candidates = cited.select(F.col(key), pmc.alias("pmc"), F.explode(name_candidates(F.col(text), most)).alias("key_")).where(F.length("key_") >= ALIAS_MINIMUM)
    met = candidates.join(names.withColumnRenamed("key", "key_"), "key_")
    usable = met.where(~F.col("key_").rlike(r"^pmc\d+$") | (F.col("key_") == F.col("pmc")))
    return usable.groupBy(key).agg(F.max_by("doc_id", F.struct((F.coalesce(F.col("key_") == F.col("pmc"), F.lit(False))).alias("p"), F.length("key_").alias("n"), F.col("key_").alias("k"))).alias("doc_id"))


def wanted_parts(cited: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part_no, label) of each section that a citation names: its tables, or else another part."""
    tables = X.tables_in(F.col(text))
    labels = F.when(F.size(tables) > 0, F.transform(tables, lambda t: F.concat(F.lit("Table "), t))).otherwise(F.when(X.section_in(F.col(text)) != "", F.array(X.section_in(F.col(text)))))
    return cited.select(F.col(key), F.posexplode(labels).alias("part_no", "label"))


def plain_label(label: Column) -> Column:
    """A label as written, without case, quotation marks and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "[\"'`]", ""), r"\s+", " "))


def label_beginnings(label: Column) -> Column:
    """What a pasted outline line may begin with: its parts before a mark that is no letter, digit or dot of a number."""
    plain = plain_label(label)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(plain) - 1, F.lit(1))), lambda i: F.substring(plain, i + 1, F.lit(2)).rlike(r"^(?:[^a-z0-9.]|\.(?!\d))"))
    return F.transform(ends, lambda i: F.substring(plain, F.lit(1), i))


def find_sections(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of each wanted (doc_id, label): by label, else by heading, else the longest label it begins with.

    wanted's own columns are kept; section_id is null where there is none. A label of
    several sections means the first one of the document. All three steps meet by equality
    of keys: a wanted label brings its own beginnings. A table with an S is also looked for
    as a supplementary one.
    """
    base = sections.select(F.col("doc_id"), "pos", "section_id", F.col("label").alias("section_label"), X.label_key(F.col("label")).alias("lk"), X.label_key(F.col("heading")).alias("hk"), plain_label(F.col("label")).alias("pk"), F.length("text").alias("chars"))
    keys = F.explode(F.array(F.struct(F.lit(1).alias("step"), F.col("lk").alias("k")), F.struct(F.lit(2).alias("step"), F.col("hk").alias("k")), F.struct(F.lit(3).alias("step"), F.concat(F.lit("="), F.nullif("pk", F.lit(""))).alias("k"))))
    by_key = base.select("doc_id", "pos", "section_id", "section_label", "chars", keys.alias("s")).select("*", "s.step", "s.k").drop("s").where("k is not null and k <> ''")
    first = by_key.groupBy("doc_id", "k").agg(F.min(F.struct("step", "pos", "section_id", "section_label", "chars")).alias("m"))
    alternatives = F.when(F.col("label").rlike("(?i)^Table S"), F.array(F.col("label"), F.concat(F.lit("Supplementary "), F.col("label")))).otherwise(F.array(F.col("label")))
    asked = wanted.select("*", F.posexplode(alternatives).alias("alt_", "alt_label_"))
    # rank 0 is the whole label; its beginnings follow, the longest first
    tries = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), X.label_key(F.col("alt_label_")).alias("k"))),
        F.transform(label_beginnings(F.col("alt_label_")), lambda b: F.struct((F.length("alt_label_") + 1 - F.length(b)).alias("rank"), F.concat(F.lit("="), b).alias("k"))),
    )
    asked = asked.select("*", F.explode(tries).alias("t_")).select("*", F.col("t_.rank").alias("rank_"), F.col("t_.k").alias("k")).drop("t_")
    return (
        asked.join(first, ["doc_id", "k"], "left")
        .groupBy(*wanted.columns)
        .agg(F.min(F.when(F.col("m").isNotNull(), F.struct("alt_", "rank_", "m"))).alias("best"))
        .select(*wanted.columns, F.col("best.m.section_id").alias("section_id"), F.col("best.m.section_label").alias("section_label"), F.col("best.m.chars").alias("chars"))
    )


def resolve(cited: DataFrame, key: str, text: str, studies: DataFrame, sections: DataFrame) -> DataFrame:
    """(key, kind, doc_id, labels, section_ids, body_chars, problem) of each citation.

    kind is 'section', 'document' or 'missing'; a citation of several tables needs all of
    them; a part that is no table falls back to the whole document with a warning. A
    citation that names a document unknown to the store is missing. Only the citation is
    looked at, never the answer key.
    """
    docs = match_documents(cited, key, text, studies)
    located = cited.select(F.col(key), X.document_in(F.col(text)).alias("named")).join(docs, key, "left")
    wanted = wanted_parts(cited, key, text).join(docs, key)
    found = find_sections(wanted, sections).groupBy(key).agg(
        F.bool_and(F.col("section_id").isNotNull()).alias("all_found"),
        F.bool_or(F.col("label").startswith("Table ")).alias("is_table"),
        F.transform(F.array_sort(F.collect_list(F.struct("part_no", "section_label", "section_id"))), lambda s: s["section_label"]).alias("labels"),
        F.transform(F.array_sort(F.collect_list(F.struct("part_no", "section_label", "section_id"))), lambda s: s["section_id"]).alias("section_ids"),
        F.sum("chars").alias("chars"),
        F.min_by("label", F.when(F.col("section_id").isNull(), F.col("part_no"))).alias("first_missing"),
    )
    whole = sections.groupBy("doc_id").agg(F.sum(F.length("text")).alias("doc_chars"))
    r = located.join(found, key, "left").join(whole, "doc_id", "left")
    kind = (
        F.when(F.col("doc_id").isNull(), F.lit("missing")).when(F.col("all_found"), F.lit("section"))
        .when(F.col("is_table"), F.lit("missing")).otherwise(F.lit("document"))
    )
    problem = (
        F.when(F.col("doc_id").isNull() & F.col("named").isNull(), F.lit("names no document")).when(F.col("doc_id").isNull(), F.lit("unknown document"))
        .when(F.col("all_found") | F.col("all_found").isNull(), None).when(F.col("is_table"), F.lit("no such table")).otherwise(F.lit("part not parsed"))
    )
    section = F.col("kind") == "section"
    return r.withColumn("kind", kind).select(
        key, "kind", "doc_id", F.when(section, F.col("labels")).alias("labels"), F.when(section, F.col("section_ids")).alias("section_ids"),
        F.when(section, F.col("chars")).when(F.col("kind") == "document", F.coalesce("doc_chars", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("body_chars"), problem.alias("problem"),
    )
