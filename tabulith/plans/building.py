"""Queries that build labelled test sets from the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.operators import building as G
from tabulith.plans.evidence import _targets
from tabulith.session import table
from tabulith.sources.tables import SQL as T
from tabulith.sources.tables import items, sections


def claim_sentences(spark, sf):
    """Sentences of results sections that can serve as claims: (doc_id, paper_id, pos, claim)."""
    docs = table(spark, sf, "documents").where(G.is_results(F.col("heading")) & F.col("paper_id").isNotNull())
    s = docs.select("doc_id", "paper_id", F.posexplode(G.build_sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select("doc_id", "paper_id", "pos", G.clean_claim(F.col("sentence")).alias("claim")).where("claim is not null")


def results_claims(spark, sf):
    return claim_sentences(spark, sf).select("doc_id", "pos", F.md5("claim").alias("claim_md5"), F.size(G.build_informative(F.col("claim"))).alias("numbers"))


def _table_numbers(spark, sf):
    t = sections(spark, sf).where("kind = 'table'")
    return t.select(F.col("doc_id").alias("paper_id"), "label", F.explode(G.build_numbers(F.col("text"))).alias("norm")).distinct()


def claim_coverage(spark, sf):
    """Share of each rewritten claim's numbers that the tables of its paper hold."""
    c = items(spark, sf).where("source_paper is not null").select("item_no", F.col("source_paper").alias("paper_id"), G.build_informative(F.col("claim")).alias("numbers"))
    return G.coverage(c, _table_numbers(spark, sf), "item_no", "paper_id", "label").select("item_no", "label", F.round("coverage", 9).alias("coverage"))


def linked_claims(spark, sf):
    c = items(spark, sf).where("source_paper is not null").select("item_no", F.col("source_paper").alias("paper_id"), G.build_informative(F.col("claim")).alias("numbers")).where(F.size("numbers") >= G.NUMBERS_PER_CLAIM)
    return G.link_claims(c, _table_numbers(spark, sf), "item_no", "paper_id", "label").select("item_no", "label", F.round("coverage", 9).alias("coverage"))


def other_tables(spark, sf):
    """Tables of an item's paper that do not cover its claim: candidates for a wrong location."""
    i = items(spark, sf).where("source_paper is not null").select("item_no", F.col("source_paper").alias("paper_id"), G.build_informative(F.col("claim")).alias("numbers"))
    covered = G.coverage(i, _table_numbers(spark, sf), "item_no", "paper_id", "label")
    labels = sections(spark, sf).where("kind = 'table'").select(F.col("doc_id").alias("paper_id"), "label").distinct()
    all_ = i.where(F.size("numbers") > 0).select("item_no", "paper_id").join(labels, "paper_id").join(covered.select("item_no", "label", "coverage"), ["item_no", "label"], "left")
    return all_.where(F.coalesce("coverage", F.lit(0.0)) < G.OTHER_COVERAGE).groupBy("item_no").agg(F.count("*").alias("tables"), F.min("label").alias("first_label"))


def flipped_claims(spark, sf):
    i = items(spark, sf)
    return i.select("item_no", G.direction_flip(F.col("claim")).alias("direction"), G.significance_flip(F.col("claim")).alias("significance")).where("direction is not null or significance is not null")


def swapped_timepoints(spark, sf):
    return _targets(spark, sf).select("item_no", G.timepoint_swap(F.col("claim"), F.col("number_text")).alias("claim")).where("claim is not null")


def perturbed_numbers(spark, sf):
    """How many look-alikes each informative number of a claim has."""
    n = items(spark, sf).select(F.explode(F.array_distinct(G.build_informative(F.col("claim")))).alias("number")).distinct()
    return n.select("number", F.array_join(F.array_sort(F.array_distinct(G.perturbations(F.col("number")))), " ").alias("look_alikes"))


def heading_sections(spark, sf):
    """Documents of one paper and heading joined in order of their ids."""
    d = table(spark, sf, "documents").where("paper_id is not null").select("paper_id", F.coalesce("heading", F.lit("Body")).alias("heading"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    s = G.text_sections(d, ["paper_id", "heading"], "doc_id", "text")
    return s.select("paper_id", "heading", "part", F.col("first").alias("first_doc"), "paragraphs", F.md5("text").alias("text_md5"))


def leaking_documents(spark, sf):
    """Documents that give away a claim made from their paper."""
    claims = items(spark, sf).where("source_paper is not null").select(F.col("item_no").alias("claim_no"), F.col("source_paper").alias("paper_id"), F.coalesce(F.nullif("original_claim", F.lit("")), "claim").alias("text"))
    docs = table(spark, sf, "documents").where("paper_id is not null").select("doc_id", "paper_id", "text")
    return G.leaking(docs, claims, "doc_id", "paper_id")


def balanced_sample(spark, sf):
    """100 items: half supported and half flagged, these round-robin over the error types."""
    i = items(spark, sf)
    good = i.where("label = 'supported'").select("item_no", "label", "error_type").orderBy("item_no").limit(50)
    bad = G.balanced(i.where("label <> 'supported'").select("item_no", "label", "error_type"), "error_type", "item_no", 50).drop("turn")
    return good.unionByName(bad)


def capped_items(spark, sf):
    """At most 12 items of each paper."""
    return G.capped(items(spark, sf).where("source_paper is not null").select("source_paper", "item_no"), "source_paper", "item_no", 12)


def assigned_kinds(spark, sf):
    """Mutation kinds given to supported items in turn."""
    good = items(spark, sf).where("label = 'supported'").select("item_no")
    return G.round_robin(good, "item_no", ["value_mismatch", "wrong_location", "wrong_study", "nonexistent_target"]).select("item_no", "place", "kind")


_BN = r"list_transform(regexp_extract_all({0}, '(^|[^\w.])([-−]?\d[\d,]*(?:\.\d+)?)', 2), lambda r: CASE WHEN contains(r, '.') THEN regexp_replace(regexp_replace(replace(replace(r, '−', '-'), ',', ''), '0+$', ''), '\.$', '') ELSE replace(replace(r, '−', '-'), ',', '') END)"
_BI = f"list_filter({_BN.format('regexp_replace({0}, ' + chr(39) + G.CONFIDENCE + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda n: n NOT IN ('0.05', '0.01', '0.001', '0.0001', '95', '100') AND (contains(n, '.') OR (abs(CAST(n AS DOUBLE)) >= 13 AND NOT abs(CAST(n AS DOUBLE)) BETWEEN 1900 AND 2100)))"
_COVER = f"""{T["items"]}, {T["sections"]},
places AS (SELECT DISTINCT doc_id AS paper_id, label, unnest({_BN.format("text")}) AS norm FROM sections WHERE kind = 'table'),
nums AS (SELECT item_no, source_paper AS paper_id, {_BI.format("claim")} AS ns FROM items WHERE source_paper IS NOT NULL),
asked AS (SELECT item_no, paper_id, len(ns) AS n, unnest(ns) AS norm FROM nums),
cover AS (SELECT item_no, label, count(*) / any_value(n) AS coverage, any_value(n) AS n FROM asked JOIN places USING (paper_id, norm) GROUP BY item_no, label)"""
_FLIP = dict(G.DIRECTIONS) | {b: a for a, b in G.DIRECTIONS}
_WORDS = "|".join(_FLIP)
_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _FLIP.items())
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_.%]+', ' ', 'g'), '\s+', ' ', 'g'))"
QUERIES = {
    f.__name__: f
    for f in (results_claims, claim_coverage, linked_claims, other_tables, flipped_claims, swapped_timepoints, perturbed_numbers, heading_sections, leaking_documents, balanced_sample, capped_items, assigned_kinds)
}
SQL = {
    "claim_coverage": f"WITH {_COVER} SELECT item_no, label, round(coverage, 9) AS coverage FROM cover",
    "linked_claims": f"""
        WITH {_COVER}, r AS (SELECT *, row_number() OVER w AS place, lead(coverage) OVER w AS second FROM cover WHERE n >= 2 WINDOW w AS (PARTITION BY item_no ORDER BY coverage DESC, label DESC))
        SELECT item_no, label, round(coverage, 9) AS coverage FROM r WHERE place = 1 AND coverage >= 0.8 AND coalesce(second, 0) < 0.5""",
    "other_tables": f"""
        WITH {_COVER}, l AS (SELECT DISTINCT doc_id AS paper_id, label FROM sections WHERE kind = 'table')
        SELECT item_no, count(*) AS tables, min(label) AS first_label FROM nums JOIN l USING (paper_id) LEFT JOIN cover USING (item_no, label) WHERE len(ns) > 0 AND coalesce(coverage, 0) < 0.3 GROUP BY item_no""",
    "flipped_claims": rf"""
        WITH {T["items"]}, d AS (SELECT item_no, claim, regexp_extract_all(claim, '(?i)\b({_WORDS})\b') AS hits, regexp_matches(claim, '(?i)\b(no|not|neither|without)\b') AS neg FROM items),
        f AS (SELECT *, CASE lower(hits[1]) {_CASES} END AS o FROM d),
        x AS (SELECT item_no, CASE WHEN len(hits) = 1 AND NOT neg THEN regexp_replace(claim, '(?i)\b({_WORDS})\b', CASE WHEN regexp_matches(hits[1], '^[A-Z]') THEN upper(o[1]) || o[2:] ELSE o END) END AS direction,
          CASE WHEN len(regexp_extract_all(claim, '{G.NOT_SIGNIFICANT}')) = 1 THEN regexp_replace(claim, '{G.NOT_SIGNIFICANT}', '\1significant\2') WHEN len(regexp_extract_all(claim, '{G.SIGNIFICANTLY}')) = 1 THEN regexp_replace(claim, '{G.SIGNIFICANTLY}', 'not \1significantly \2') END AS significance FROM f)
        SELECT * FROM x WHERE direction IS NOT NULL OR significance IS NOT NULL""",
    "heading_sections": f"""
        WITH p AS (SELECT paper_id, coalesce(heading, 'Body') AS heading, doc_id, coalesce(text, '') AS t,
          coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY paper_id, coalesce(heading, 'Body') ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE paper_id IS NOT NULL)
        SELECT paper_id, heading, CAST(b // {G.SECTION_CHARS} AS INT) AS part, min(doc_id) AS first_doc, CAST(count(*) AS INT) AS paragraphs, md5(string_agg(t, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5 FROM p GROUP BY 1, 2, 3""",
    "leaking_documents": f"""
        WITH {T["items"]}, c AS (SELECT item_no, source_paper AS paper_id, coalesce(nullif(original_claim, ''), claim) AS text FROM items WHERE source_paper IS NOT NULL),
        d AS (SELECT doc_id, paper_id, {_PLAIN.format("text")} AS plain, {_BN.format("text")} AS ns FROM documents WHERE paper_id IS NOT NULL AND text IS NOT NULL),
        a AS (SELECT item_no, paper_id, left({_PLAIN.format("text")}, 80) AS beginning, {_BI.format("text")} AS w FROM c WHERE text IS NOT NULL)
        SELECT DISTINCT doc_id FROM d JOIN a USING (paper_id) WHERE (beginning <> '' AND contains(plain, beginning)) OR (len(w) >= 2 AND len(list_filter(w, lambda x: list_contains(ns, x))) / len(w) >= 0.5)""",
    "balanced_sample": f"""
        WITH {T["items"]}, good AS (SELECT item_no, label, error_type FROM items WHERE label = 'supported' ORDER BY item_no LIMIT 50),
        bad AS (SELECT item_no, label, error_type, row_number() OVER (PARTITION BY error_type ORDER BY item_no) AS turn FROM items WHERE label <> 'supported' ORDER BY turn, error_type NULLS FIRST, item_no LIMIT 50)
        SELECT * FROM good UNION ALL SELECT item_no, label, error_type FROM bad""",
    "capped_items": f"WITH {T['items']} SELECT source_paper, item_no FROM items WHERE source_paper IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_paper ORDER BY item_no) <= 12",
    "assigned_kinds": f"WITH {T['items']} SELECT item_no, row_number() OVER (ORDER BY item_no) - 1 AS place, ['value_mismatch', 'wrong_location', 'wrong_study', 'nonexistent_target'][(row_number() OVER (ORDER BY item_no) - 1) % 4 + 1] AS kind FROM items WHERE label = 'supported'",
}
