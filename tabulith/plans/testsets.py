"""Queries that make wrong items, and evidence for citing sentences, from the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.operators import building as G
from tabulith.operators import citing as C
from tabulith.operators import mutating as M
from tabulith.operators import resolving as R
from tabulith.plans.building import _BI, _BN, _COVER
from tabulith.plans.building import SQL as BUILDING_SQL
from tabulith.plans.evidence import _LABEL, _targets
from tabulith.session import table
from tabulith.sources.tables import SQL as T
from tabulith.sources.tables import items, sections


def found_sections(spark, sf):
    """Sections found by what may be pasted: labels, headings, outline lines, longer labels."""
    s = sections(spark, sf).where("doc_id is not null")
    pasted = F.array("label", "heading", F.concat("label", F.lit(": "), F.coalesce("heading", F.lit(""))), F.concat(F.upper("label"), F.lit(". x")), F.concat("label", F.lit(".5 y")), F.concat("label", F.lit("7")), F.concat_ws(", ", "label", F.lit("row 2")))
    wanted = s.select("doc_id", F.explode(pasted).alias("label")).where("label is not null").distinct()
    return R.find_sections(wanted, s).select("doc_id", "label", "section_id")


def _claims(spark, sf):
    return items(spark, sf).where("source_paper is not null").select("item_no", F.col("source_paper").alias("id"), G.build_informative(F.col("claim")).alias("numbers"))


def _units(spark, sf):
    text = F.concat_ws(" ", "heading", "text")
    return sections(spark, sf).where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("section_id").alias("unit_no"), F.coalesce("label", F.lit("Body")).alias("label"), text.alias("text"), F.array_distinct(G.build_numbers(text)).alias("norms"))


def best_units(spark, sf):
    """The section of its paper that holds most of a claim's numbers."""
    return C.best_units(_claims(spark, sf), _units(spark, sf), "item_no").select("item_no", "label", F.round("coverage", 9).alias("coverage"))


def paper_numbers(spark, sf):
    """How many different numbers each paper holds."""
    return C.all_numbers(_units(spark, sf)).groupBy("id").agg(F.count("*").alias("numbers"))


def paper_texts(spark, sf):
    """Papers as one text, with a heading where the section changes."""
    first = sections(spark, sf).where("doc_id is not null").groupBy("doc_id", "pos").agg(F.min_by(F.struct("label", "text"), "section_id").alias("s"))
    units = first.select(F.col("doc_id").alias("id"), F.col("pos").alias("unit_no"), F.coalesce("s.label", F.lit("Body")).alias("label"), F.coalesce("s.text", F.lit("")).alias("text"))
    return C.source_text(units).select("id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def attributive_claims(spark, sf):
    """Which claims can stand alone, and which report what a cited paper found."""
    i = items(spark, sf).where("claim is not null")
    return i.select("item_no", C.is_claim_text(F.col("claim")).alias("fit"), C.is_attributive(F.col("claim"), F.col("note")).alias("attributive"), F.size(C.claim_numbers(F.col("claim"))).alias("numbers"))


def author_labels(spark, sf):
    """Of each paper the source of the document that comes first."""
    d = table(spark, sf, "documents").select(F.col("paper_id").alias("target"), F.col("source").alias("label"), F.col("doc_id").alias("place"))
    return C.author_labels(d)


def evidence_items(spark, sf):
    """Items with evidence as claims for each document they cite, with the kind of their first evidence."""
    i = items(spark, sf).where("target_id is not null")
    cited = F.array_distinct(F.array(F.split("target_id", "/")[0], F.coalesce("source_paper", F.split("target_id", "/")[0])))
    known = F.col("error_type").isin("SUPPORT", "CONTRADICT")
    kind = F.struct(F.col("error_type").alias("label"), F.col("gold_sentences").alias("sentences"))
    evidence = F.when(known, F.create_map(F.split("target_id", "/")[0], F.array(kind)))
    made = C.evidence_items(i.select(F.col("item_no").alias("claim_id"), "claim", cited.alias("cited"), evidence.alias("evidence")))
    return made.select("claim_id", "doc_id", "label", "kind", F.size("gold_sentences").alias("gold"))


def swapped_documents(spark, sf):
    """A hundred claims, each with a document that it does not cite."""
    i = items(spark, sf).where("source_paper is not null").select(F.col("item_no").alias("claim_id"), "claim", F.array("source_paper").alias("cited"))
    return C.swapped_items(i, sections(spark, sf).where("doc_id is not null").select("doc_id"))


def quota_sample(spark, sf):
    """The first items of some kinds by hash, as many as each kind's quota."""
    return C.quota_sample(items(spark, sf).select("item_no", "error_type"), "error_type", "item_no", {"SUPPORTED": 50, "overstated": 17, "overstated_subtle": 17, "value_mismatch": 16})


def twice_capped(spark, sf):
    """Documents in order, at most six of a source and heading and three of a paper."""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "heading").alias("citing"), F.col("paper_id").alias("cited"))
    return C.twice_capped(d, "doc_id", "citing", "cited").select("doc_id", "citing", "cited")


def number_look_alikes(spark, sf):
    """Look-alikes of a claim's numbers that its target does not hold, by number."""
    t = _targets(spark, sf).select("item_no", F.array_distinct(G.build_informative(F.col("claim"))).alias("ns"), G.build_numbers(F.col("number_text")).alias("held"))
    each = t.select("item_no", "held", F.explode("ns").alias("number"))
    return each.select("item_no", "number", F.array_join(F.array_sort(F.array_distinct(M.forbidden_free(F.col("number"), F.col("held")))), " ").alias("look_alikes"))


def changed_values(spark, sf):
    """Claims with one number of their target turned into one that it lacks."""
    t = _targets(spark, sf).select("item_no", M.changed_value(F.col("claim"), G.build_numbers(F.col("number_text")), F.col("item_no")).alias("m")).where("m is not null")
    return t.select("item_no", "m.old", "m.new", F.col("m.text").alias("claim"))


def hard_items(spark, sf):
    """Right claims and one edit of each: values swapped, direction, significance or time point turned."""
    good = _targets(spark, sf).join(items(spark, sf).where("label = 'supported'").select("item_no"), "item_no")
    return M.hard_items(good.select("item_no", "claim", "heading", "text"), "item_no")


def _tables(spark, sf):
    return sections(spark, sf).where("kind = 'table' and label is not null").groupBy("doc_id", "label").agg(F.array_distinct(F.flatten(F.collect_list(G.build_numbers(F.col("text"))))).alias("norms"))


def mutated_items(spark, sf):
    """Every wrong item that a supported item can be made into."""
    i = items(spark, sf).where("label = 'supported' and target_id is not null")
    own = i.select("item_no", "claim", F.substring_index("target_id", "/", 1).alias("doc_id"), F.expr("substring(target_id, locate('/', target_id) + 1)").alias("label"))
    rewrites = items(spark, sf).where("mutation like '% rewrite' and original_claim is not null").select(F.col("original_claim").alias("claim"), F.regexp_replace("mutation", " rewrite$", "").alias("kind"), F.col("claim").alias("rewrite")).distinct()
    return M.mutated(own, _tables(spark, sf), rewrites, "item_no").distinct()


def changed_ids(spark, sf):
    """Ids of papers with a digit changed so that no paper has them."""
    ids = table(spark, sf, "study_docs").where("id is not null").select("id").distinct()
    return M.changed_ids(ids.select(F.col("id").alias("old"), "id"), "old", ids)


def clean_documents(spark, sf):
    """Documents outside results sections that give no claim of their paper away."""
    claims = items(spark, sf).where("source_paper is not null").select(F.col("item_no").alias("claim_no"), F.col("source_paper").alias("paper_id"), F.coalesce(F.nullif("original_claim", F.lit("")), "claim").alias("text"))
    docs = table(spark, sf, "documents").where("paper_id is not null").select("doc_id", "paper_id", F.col("heading").alias("section"), "text")
    return G.without_leaks(docs, claims, "doc_id", "paper_id").select("doc_id")


def linked_rows(spark, sf):
    """Tables linked to claims that are their own last rows."""
    t = sections(spark, sf).where("kind = 'table' and text is not null and doc_id is not null")
    rows = F.split(F.split("text", "\n\nNotes:")[0], "\n")
    claims = t.select("section_id", F.col("doc_id").alias("paper_id"), G.build_informative(F.element_at(rows, -1)).alias("numbers")).where(F.size("numbers") >= G.NUMBERS_PER_CLAIM)
    places = t.select(F.col("doc_id").alias("paper_id"), "label", F.explode(G.build_numbers(F.col("text"))).alias("norm")).distinct()
    return G.link_claims(claims, places, "section_id", "paper_id", "label").select(F.col("section_id").alias("item_no"), "label", F.round("coverage", 9).alias("coverage"))


QUERIES = {
    f.__name__: f
    for f in (
        found_sections, best_units, paper_numbers, paper_texts, attributive_claims, author_labels, evidence_items, swapped_documents, quota_sample, twice_capped, number_look_alikes, changed_values, hard_items,
        mutated_items, changed_ids, clean_documents, linked_rows,
    )
}
_PLACES = f"""{T["items"]}, {T["sections"]},
places AS (SELECT concat_ws('/', doc_id, label) AS target_id, arg_min({{'heading': heading, 'text': text}}, (pos, section_id)) AS s FROM sections GROUP BY 1),
targets AS (SELECT item_no, claim, concat_ws(chr(10), s.heading, s.text) AS number_text FROM items JOIN places USING (target_id))"""
_DIGITS = "list_filter(range(1, length({0}) + 1), lambda i: regexp_matches({0}[i], '[0-9]'))"
_SWAPS = "list_transform(list_filter(range(1, len(d)), lambda k: {0}[d[k]] <> {0}[d[k + 1]]), lambda k: {0}[1:d[k] - 1] || {0}[d[k + 1]] || {0}[d[k] + 1:d[k + 1] - 1] || {0}[d[k]] || {0}[d[k + 1] + 1:])"
_MOVES = "list_transform(list_filter(list_transform([1, 2, 3, -1, -2, -3], lambda m: CAST({0}[d[-1]] AS INT) + m), lambda v: v BETWEEN 0 AND 9), lambda v: {0}[1:d[-1] - 1] || CAST(v AS VARCHAR) || {0}[d[-1] + 1:])"
_LOOK_ALIKES = f"list_filter(list_concat({_SWAPS.format('number')}, {_MOVES.format('number')}), lambda c: NOT regexp_matches(c, '^-?0[0-9]'))"
_NORM = r"CASE WHEN contains(c, '.') THEN regexp_replace(regexp_replace(c, '0+$', ''), '\.$', '') ELSE c END"
_BARE = r"trim(regexp_replace(regexp_replace(lower({0}), '[\"''`]', '', 'g'), '\s+', ' ', 'g'))"
_UNIT = f"units AS (SELECT doc_id AS id, section_id, coalesce(label, 'Body') AS label, concat_ws(' ', heading, text) AS t FROM sections WHERE doc_id IS NOT NULL)"
SQL = {
    "found_sections": rf"""
        WITH {T["sections"]}, s AS (SELECT doc_id, section_id, pos, label, {_LABEL.format("label")} AS lk, {_LABEL.format("heading")} AS hk, {_BARE.format("label")} AS pk FROM sections WHERE doc_id IS NOT NULL),
        w0 AS (SELECT DISTINCT doc_id, unnest([label, heading, label || ': ' || coalesce(heading, ''), upper(label) || '. x', label || '.5 y', label || '7', concat_ws(', ', label, 'row 2')]) AS w FROM sections WHERE doc_id IS NOT NULL),
        w AS (SELECT *, {_LABEL.format("w")} AS wk, {_BARE.format("w")} AS wp FROM w0 WHERE w IS NOT NULL),
        c AS (SELECT w.doc_id, w, section_id, pos, s.pk, CASE WHEN lk = wk AND wk <> '' THEN 1 WHEN hk = wk AND wk <> '' THEN 2 WHEN pk <> '' AND starts_with(wp, pk) AND regexp_matches(substr(wp, length(pk) + 1), '^[^a-z0-9]') AND NOT regexp_matches(substr(wp, length(pk) + 1), '^\.\d') THEN 3 END AS step
              FROM w JOIN s ON s.doc_id = w.doc_id),
        b AS (SELECT doc_id, w, section_id FROM c WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY step, CASE WHEN step = 3 THEN -length(pk) ELSE 0 END, pos, section_id) = 1)
        SELECT w.doc_id, w.w AS label, b.section_id FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND b.w = w.w""",
    "best_units": f"""
        WITH {T["items"]}, {T["sections"]}, {_UNIT}, n AS (SELECT item_no, source_paper AS id, {_BI.format("claim")} AS ns FROM items WHERE source_paper IS NOT NULL),
        u AS (SELECT *, {_BN.format("t")} AS h FROM units),
        c AS (SELECT item_no, label, len(list_filter(ns, lambda x: list_contains(h, x))) / len(ns) AS coverage FROM (SELECT * FROM n WHERE len(ns) > 0) n LEFT JOIN u USING (id))
        SELECT item_no, label, round(coalesce(coverage, 0), 9) AS coverage FROM c QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY coalesce(coverage, 0) DESC, label DESC NULLS LAST) = 1""",
    "paper_numbers": f"WITH {T['sections']}, {_UNIT}, x AS (SELECT id, unnest({_BN.format('t')}) AS n FROM units) SELECT id, count(DISTINCT n) AS numbers FROM x GROUP BY id",
    "paper_texts": f"""
        WITH {T["sections"]}, f AS (SELECT doc_id AS id, pos, arg_min({{'l': coalesce(label, 'Body'), 't': coalesce(text, '')}}, section_id) AS s FROM sections WHERE doc_id IS NOT NULL GROUP BY ALL),
        b AS (SELECT id, pos, CASE WHEN s.l IS DISTINCT FROM lag(s.l) OVER (PARTITION BY id ORDER BY pos) THEN CASE WHEN pos > 0 THEN chr(10) || chr(10) ELSE '' END || s.l || chr(10) || s.t ELSE chr(10) || s.t END AS part FROM f)
        SELECT id, md5(string_agg(part, '' ORDER BY pos)) AS text_md5, CAST(length(string_agg(part, '' ORDER BY pos)) AS INT) AS chars FROM b GROUP BY id""",
    "attributive_claims": rf"""
        WITH {T["items"]}, c AS (SELECT item_no, claim, note, regexp_replace(claim, '{C.OWN_STUDY}', ' ', 'g') AS own,
          regexp_replace(split_part(regexp_replace(note, '\s+(?:et al\.?|and)\s+|\s+\d{{4}}', chr(1)), chr(1), 1), '^[ .,]+|[ .,]+$', '', 'g') AS author FROM items WHERE claim IS NOT NULL)
        SELECT item_no, length(claim) BETWEEN 40 AND 400 AND NOT regexp_matches(claim, '\b(Tables?|Figures?|Fig\.)($|[^A-Za-z0-9_])') AS fit,
          NOT regexp_matches(claim, '{C.OWN_WORK}') AND (coalesce(length(author) >= {C.SHORTEST_AUTHOR} AND contains(' ' || regexp_replace(lower(claim), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ', ' ' || trim(regexp_replace(lower(author), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' '), false)
            OR regexp_matches(claim, '(?i)\bet al\.?($|[^A-Za-z0-9_])') OR (regexp_matches(own, '{C.STUDY_WORD}') AND regexp_matches(own, '{C.REPORTING_VERB}')) OR regexp_matches(own, '{C.REPORTED}')) AS attributive,
          CAST(len(list_distinct({_BI.format("regexp_replace(claim, '" + r"\b[A-Za-z]{1,12}[-−‐‒–—]\d+(?:\.\d+)?\b" + "', ' ', 'g')")})) AS INT) AS numbers FROM c""",
    "author_labels": "SELECT paper_id AS target, arg_min(source, doc_id) AS label FROM documents WHERE paper_id IS NOT NULL AND source IS NOT NULL GROUP BY paper_id",
    "evidence_items": f"""
        WITH {T["items"]}, i AS (SELECT item_no, error_type, gold_sentences, split_part(target_id, '/', 1) AS own, unnest(list_distinct([split_part(target_id, '/', 1), coalesce(source_paper, split_part(target_id, '/', 1))])) AS doc_id FROM items WHERE target_id IS NOT NULL),
        k AS (SELECT *, doc_id = own AND coalesce(error_type IN ('SUPPORT', 'CONTRADICT'), false) AS has FROM i)
        SELECT item_no AS claim_id, doc_id, CASE WHEN has AND error_type = 'SUPPORT' THEN 'supported' ELSE 'not_supported' END AS label, CASE WHEN has THEN error_type ELSE 'NOINFO' END AS kind,
          CAST(CASE WHEN has THEN coalesce(len(list_distinct(gold_sentences)), 0) ELSE 0 END AS INT) AS gold FROM k""",
    "number_look_alikes": f"""
        WITH {_PLACES}, n AS (SELECT item_no, unnest(list_distinct({_BI.format("claim")})) AS number, {_BN.format("number_text")} AS held FROM targets), x AS (SELECT *, {_DIGITS.format("number")} AS d FROM n),
        l AS (SELECT item_no, number, held, {_LOOK_ALIKES} AS cs FROM x)
        SELECT item_no, number, array_to_string(list_sort(list_distinct(list_filter(cs, lambda c: NOT list_contains(held, {_NORM})))), ' ') AS look_alikes FROM l""",
    "perturbed_numbers": f"""
        WITH {T["items"]}, n AS (SELECT DISTINCT unnest({_BI.format("claim")}) AS number FROM items), x AS (SELECT *, {_DIGITS.format("number")} AS d FROM n)
        SELECT number, array_to_string(list_sort(list_distinct({_LOOK_ALIKES})), ' ') AS look_alikes FROM x""",
    "clean_documents": f"""
        WITH leaking AS ({BUILDING_SQL["leaking_documents"]})
        SELECT doc_id FROM documents WHERE paper_id IS NOT NULL AND NOT regexp_matches(split_part(coalesce(heading, ''), ' > ', 1), '{G.EXCLUDED_TOP_SECTIONS}') AND doc_id NOT IN (SELECT doc_id FROM leaking)""",
    "linked_rows": BUILDING_SQL["linked_claims"].replace(
        _COVER,
        _COVER.replace(
            T["items"],
            "items AS (SELECT section_id AS item_no, doc_id AS source_paper, string_split(split_part(text, chr(10) || chr(10) || 'Notes:', 1), chr(10))[-1] AS claim FROM (SELECT * FROM doc_sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY ingested_at DESC) = 1) WHERE kind = 'table' AND text IS NOT NULL AND doc_id IS NOT NULL)",
        ),
    ),
    "swapped_timepoints": rf"""
        WITH {_PLACES}, t AS (SELECT item_no, claim, regexp_extract_all(claim, '{G.TIME}') AS own, regexp_extract_all(number_text, '{G.TIME}') AS theirs FROM targets),
        o AS (SELECT item_no, claim, CAST(regexp_extract(own[1], '^(\d+)', 1) AS INT) AS n, regexp_replace(lower(regexp_extract(own[1], '([A-Za-z]+)$', 1)), 's$', '') AS unit, unnest(theirs) AS x FROM t WHERE len(own) = 1),
        c AS (SELECT item_no, claim, n, TRY_CAST(regexp_extract(x, '^(\d+)', 1) AS INT) AS m FROM o WHERE regexp_replace(lower(regexp_extract(x, '([A-Za-z]+)$', 1)), 's$', '') = unit),
        b AS (SELECT item_no, claim, arg_min(m, (abs(m - n), m)) AS m FROM c WHERE m <> 0 AND m <> n GROUP BY ALL)
        SELECT item_no, regexp_replace(claim, '{G.TIME}', m || '\2\3') AS claim FROM b""",
    "results_claims": rf"""
        WITH m AS (SELECT doc_id, regexp_replace(text, '\b({"|".join(a.replace(".", chr(92) + ".") for a in G.BUILD_ABBREVIATIONS)})\.', '\1' || chr(1), 'g') AS t FROM documents WHERE text IS NOT NULL AND paper_id IS NOT NULL AND regexp_matches(heading, '{G.RESULTS}') AND NOT regexp_matches(heading, '{G.METHODS}')),
        s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z(])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: regexp_replace(replace(x, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS ss FROM m),
        c AS (SELECT doc_id, CAST(u.i - 1 AS INT) AS pos, trim(regexp_replace(regexp_replace(regexp_replace(u.x, '{G.REFERENCE_MARK}', '', 'g'), '{G.TABLE_REMARK}', '', 'g'), '\s+', ' ', 'g')) AS claim FROM s, unnest(ss) WITH ORDINALITY AS u(x, i))
        SELECT doc_id, pos, md5(claim) AS claim_md5, CAST(len({_BI.format("claim")}) AS INT) AS numbers FROM c WHERE length(claim) BETWEEN 40 AND 400 AND NOT regexp_matches(claim, '\b(Tables?|Figures?|Fig\.)($|[^A-Za-z0-9_])')""",
}
