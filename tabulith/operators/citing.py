"""Test sets from citing sentences: attribution, evidence units, id look-up, caps, and three-way labelled claims."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.operators import building as G
from tabulith.operators.reviewing import ascii_words
from tabulith.session import cut

# Results depend on these patterns and limits.
NAME_NUMBER = r"\b[A-Za-z]{1,12}[-−‐‒–—]\d+(?:\.\d+)?(?![A-Za-z0-9_])"
OWN_WORK = r"(?i)\b(?:as previously described|previously published in)\b"
OWN_STUDY = r"(?i)\b(?:this|our|the present)\s+(?:study|analysis|trial)\b"
OTHERS = r"(?i)\bet al\.?(?![A-Za-z0-9_])"
STUDY_WORD = r"(?i)\b(?:trial|study|studies|meta-analysis|review)\b"
REPORTING_VERB = r"(?i)\b(?:reported|found|showed|shown|demonstrated|observed|revealed|indicated|estimated|enrolled)\b"
REPORTED = r"(?i)\bin their study\b|\bas reported previously\b"
SHORTEST_AUTHOR = 3
UNIT_COVERAGE = 0.8
PER_CITING, PER_CITED = 6, 3
LOOKUP_BATCH = {"pmid": 100, "doi": 20}
EVIDENCE_LABELS = {"SUPPORT": "supported", "CONTRADICT": "not_supported", "NOINFO": "not_supported"}
QUOTAS = {"SUPPORT": 50, "CONTRADICT": 17, "NOINFO": 17, "SWAPPED": 16}
SWAPPED = 100
# End of fixed values.
#: Buckets in which random choices are made, and documents of a bucket that are offered.
BUCKETS, OFFERED = 64, 16


def is_claim_text(text: Column) -> Column:
    """Whether a sentence can be a claim: of fit length, naming no table or figure."""
    return F.length(text).between(*G.CLAIM_CHARS) & ~text.rlike(ascii_words(G.TABLE_WORD))


def claim_numbers(text: Column) -> Column:
    """Distinct informative numbers without those that belong to a name ("FGF-21")."""
    return F.array_distinct(G.build_informative(F.regexp_replace(text, ascii_words(NAME_NUMBER), " ")))


def first_author(label: Column) -> Column:
    """The first name of an 'Author year' label."""
    return F.regexp_replace(F.split(label, r"\s+(?:et al\.?|and)\s+|\s+\d{4}", 2)[0], r"^[ .,]+|[ .,]+$", "")


def is_attributive(claim: Column, label: Column) -> Column:
    """Whether a sentence reports what the cited paper found, not what its own authors did."""
    text = F.regexp_replace(claim, ascii_words(OWN_STUDY), " ")
    author = first_author(label)
    named = F.coalesce((F.length(author) >= SHORTEST_AUTHOR) & F.concat(F.lit(" "), F.regexp_replace(F.lower(claim), r"[^\p{L}\p{N}_]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(author), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))), F.lit(False))
    told = text.rlike(ascii_words(STUDY_WORD)) & text.rlike(ascii_words(REPORTING_VERB))
    return ~claim.rlike(ascii_words(OWN_WORK)) & (named | claim.rlike(ascii_words(OTHERS)) | told | text.rlike(ascii_words(REPORTED)))


def unit_numbers(units: DataFrame) -> DataFrame:
    """(id, label, norm) of evidence units, distinct."""
    return units.where("unit_no is not null").select("id", "label", F.explode(G.build_numbers(F.col("text"))).alias("norm")).distinct()


def all_numbers(units: DataFrame) -> DataFrame:
    """(id, norm): every number of a paper, its title, section names and captions included."""
    return units.select("id", F.explode(G.build_numbers(F.col("text"))).alias("norm")).distinct()


def best_units(claims: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, label, coverage): the unit of the cited paper that holds most of a claim's numbers, of equal ones the last label.

    claims: (key, id, numbers); units: (id, unit_no, label, norms). A claim of which no unit holds a number has coverage 0.
    """
    asked = claims.where(F.size("numbers") > 0)
    each = asked.select(key, "id", F.size("numbers").alias("n"), F.explode("numbers").alias("norm"))
    places = units.select("id", "unit_no", "label", F.explode("norms").alias("norm")).distinct()
    held = each.join(places, ["id", "norm"]).groupBy(key, "id", "n", "unit_no", "label").agg((F.count("*") / F.col("n")).alias("coverage"))
    best = held.groupBy(key).agg(F.max(F.struct("coverage", "label")).alias("b"))
    # where nothing matches every unit has coverage 0 and the last label wins
    last = units.groupBy("id").agg(F.max("label").alias("last"))
    return asked.select(key, "id").join(best, key, "left").join(last, "id", "left").select(key, F.coalesce("b.label", "last").alias("label"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"))


def source_text(units: DataFrame) -> DataFrame:
    """(id, text): a paper as one text; a heading stands where the section changes."""
    w = Window.partitionBy("id").orderBy("unit_no")
    own = units.where("unit_no is not null").select("id", "unit_no", "label", "text", (F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True))).alias("new"))
    block = F.when(F.col("new"), F.concat(F.when(F.col("unit_no") > 0, F.lit("\n\n")).otherwise(F.lit("")), "label", F.lit("\n"), "text")).otherwise(F.concat(F.lit("\n"), "text"))
    return own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", block.alias("t")))), lambda x: x["t"]), "").alias("text"))


def look_up(wanted: DataFrame, cache: DataFrame, kind: str, ask: Callable[[list[str]], dict]) -> DataFrame:
    """The cache (id, pmcid) with all wanted ids: new ones are asked for in batches; unknown ones are kept with null.

    wanted: (id). A batch that fails is left out and is asked for again next time.
    """
    size = LOOKUP_BATCH[kind]
    todo = wanted.select("id").where("id is not null").distinct().join(cache.select("id"), "id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].tolist()
            for at in range(0, len(ids), size):
                part = ids[at : at + size]
                try:
                    got = ask(part)
                except Exception:  # noqa: BLE001
                    continue
                yield pd.DataFrame({"id": part, "pmcid": [got.get(i) for i in part]})

    # asked once: the answers are kept before anything reads them
    return cache.select("id", "pmcid").unionByName(cut(todo.mapInPandas(run, "id string, pmcid string")))


def resolved_references(refs: DataFrame, pmids: DataFrame, dois: DataFrame) -> DataFrame:
    """References with target: their own PMC id, else that of their PubMed id, else that of their DOI."""
    a, b = pmids.select(F.col("id").alias("pmid"), F.col("pmcid").alias("by_pmid")), dois.select(F.col("id").alias("doi"), F.col("pmcid").alias("by_doi"))
    return refs.join(a, "pmid", "left").join(b, "doi", "left").withColumn("target", F.coalesce("pmcid", "by_pmid", "by_doi")).drop("by_pmid", "by_doi")


def author_labels(citations: DataFrame) -> DataFrame:
    """(target, label): of each cited paper the label of the citation that comes first. citations: (target, label, place)."""
    return citations.where("target is not null and label is not null").groupBy("target").agg(F.min_by("label", "place").alias("label"))


def twice_capped(rows: DataFrame, key: str, citing: str, cited: str, per_citing: int = PER_CITING, per_cited: int = PER_CITED) -> DataFrame:
    """Rows in the order of key, none beyond per_citing of a citing or per_cited of a cited paper.

    Whether a row is kept depends on the rows kept before it, so it is settled in rounds: a
    row is kept once fewer undecided and kept rows stand before it than both caps allow,
    and dropped once a cap is used up by kept ones. Each round decides the first
    undecided row at least. Null papers have no cap of their own and are left out.
    """
    state = cut(rows.where(F.col(key).isNotNull() & F.col(citing).isNotNull() & F.col(cited).isNotNull()).select(key, citing, cited).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        def before(by: str, what: Column) -> Column:
            return F.coalesce(F.sum(what.cast("int")).over(Window.partitionBy(by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

        kept, possible = F.coalesce(F.col("kept"), F.lit(False)), F.coalesce(F.col("kept"), F.lit(True))
        full = (before(citing, kept) >= per_citing) | (before(cited, kept) >= per_cited)
        sure = (before(citing, possible) < per_citing) & (before(cited, possible) < per_cited)
        state = cut(state.withColumn("kept", F.coalesce("kept", F.when(full, F.lit(False)).when(sure, F.lit(True)))))
        if state.where("kept is null").isEmpty():
            return rows.join(state.where("kept").select(key), key, "left_semi")


def evidence_items(claims: DataFrame) -> DataFrame:
    """(claim_id, doc_id, claim, label, kind, gold_sentences): a claim for each document it cites.

    claims: (claim_id, claim, cited array<string>, evidence map<string, array<struct<label, sentences>>>). The
    first evidence of a document gives the kind, none means NOINFO.
    """
    each = claims.select("claim_id", "claim", "evidence", F.explode("cited").alias("doc_id"))
    own = F.try_element_at("evidence", "doc_id")
    kind = F.coalesce(F.get(own, F.lit(0))["label"], F.lit("NOINFO"))
    label = F.create_map(*(F.lit(x) for kv in EVIDENCE_LABELS.items() for x in kv))[kind]
    gold = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda e: e["sentences"])))), F.array().cast("array<int>"))
    return each.select("claim_id", "doc_id", "claim", label.alias("label"), kind.alias("kind"), gold.alias("gold_sentences"))


def swapped_items(claims: DataFrame, docs: DataFrame, count: int = SWAPPED) -> DataFrame:
    """(claim_id, doc_id, claim, label, kind, gold_sentences): `count` claims by hash, each with a document it does not cite.

    Claims and documents meet in hash buckets, of which a bounded number of documents each is offered.
    """
    chosen = claims.orderBy(F.xxhash64("claim_id"), "claim_id").limit(count).withColumn("bucket", F.pmod(F.xxhash64("claim_id", F.lit("doc")), F.lit(BUCKETS)))
    w = Window.partitionBy("bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = docs.select("doc_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= OFFERED)
    # the first documents of all buckets are offered to everyone, as an own bucket may have none to give
    offered = ranked.select("doc_id", "bucket").unionByName(ranked.where("rn = 1").select("doc_id", F.lit(-1).cast("bigint").alias("bucket")))
    tries = chosen.withColumn("bucket", F.explode(F.array("bucket", F.lit(-1).cast("bigint"))))
    met = tries.join(offered, "bucket").where(~F.array_contains(F.coalesce("cited", F.array().cast("array<string>")), F.col("doc_id")))
    one = met.groupBy("claim_id", "claim").agg(F.min_by("doc_id", F.struct(F.col("bucket") < 0, F.xxhash64("claim_id", "doc_id"))).alias("doc_id"))
    return one.select("claim_id", "doc_id", "claim", F.lit("wrong_target").alias("label"), F.lit("SWAPPED").alias("kind"), F.array().cast("array<int>").alias("gold_sentences"))


def quota_sample(rows: DataFrame, kind: str, key: str, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """The first rows of each kind by hash of the key, as many as its quota; kinds without one give none."""
    wanted = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col(kind)]
    return rows.where(F.col(kind).isin(list(quotas))).withColumn("rn", F.row_number().over(Window.partitionBy(kind).orderBy(F.xxhash64(key), key))).where(F.col("rn") <= wanted).drop("rn")
