"""Queries on numbers, quotes, citations and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.functions import numbers as N
from tabulith.functions import text as X
from tabulith.operators import evidence as E
from tabulith.operators import resolving as R
from tabulith.operators import retrieval as I
from tabulith.session import table
from tabulith.sources.tables import SQL as T
from tabulith.sources.tables import items, latest, sections, studies


def number_extract(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(N.numbers_in(F.col("text"))).alias("pos", "n"))
    return docs.select("doc_id", "pos", "n.raw", "n.norm", "n.decimals")


def informative_numbers(spark, sf):
    return items(spark, sf).select("item_no", F.explode(N.informative(F.col("claim"))).alias("n")).select("item_no", "n.norm")


def section_numbers(spark, sf):
    s = sections(spark, sf)
    return s.select("doc_id", "label", F.explode(N.numbers_in(F.concat_ws("\n", "heading", "text"))).alias("n")).select(N.unsigned(F.col("n.norm")).alias("norm"), "doc_id", "label").distinct()


def number_index(spark, sf):
    """How many sections hold each number."""
    return section_numbers(spark, sf).groupBy("norm").agg(F.count("*").alias("sections"))


def suggest_sources(spark, sf):
    """Sections that hold every informative number of a claim; see operators.evidence for the choice."""
    claims = items(spark, sf).select("item_no", F.col("source_paper").alias("own"), "claim")
    return E.suggest(claims, section_numbers(spark, sf), "item_no").select("item_no", F.array_join("pick", "; ").alias("suggestions"))


def _targets(spark, sf):
    """Items with the text of the section that their target id names (document/label), the first of equal labels."""
    s = sections(spark, sf).groupBy(F.concat_ws("/", "doc_id", "label").alias("target_id")).agg(F.min_by(F.struct("heading", "text"), F.struct("pos", "section_id")).alias("s"))
    return items(spark, sf).join(s, "target_id").select("item_no", "id", "claim", "s.heading", "s.text", F.concat_ws("\n", "s.heading", "s.text").alias("number_text"))


def missing_numbers(spark, sf):
    rows = _targets(spark, sf).select("item_no", F.explode(N.missing(F.col("claim"), F.col("number_text"))).alias("m"))
    return rows.select("item_no", "m.number", F.array_join("m.nearest", "; ").alias("nearest"))


def code_decided(spark, sf):
    """Items that numbers alone decide: a target that does not exist, or a number that it lacks."""
    lacking = missing_numbers(spark, sf).select("item_no").distinct()
    unresolved = items(spark, sf).where("target_id is null").select("item_no")
    return lacking.unionByName(unresolved).distinct()


def quote_grounding(spark, sf):
    """Whether each record's quote stands in its item's section."""
    # only what is needed goes through the shuffles, and a section is made plain once for all its items
    quotes = latest(table(spark, sf, "run_records").select("rec_id", "item_id", F.col("result.quote").alias("quote"), "arrived_at"), "rec_id", "arrived_at").where("quote is not null")
    claims = latest(table(spark, sf, "bench_items").select("item_no", "id", "target_id", "loaded_at"), "item_no", "loaded_at").select("target_id", F.col("id").alias("item_id"))
    texts = latest(table(spark, sf, "doc_sections").select("section_id", "doc_id", "label", "pos", "text", "ingested_at"), "section_id", "ingested_at")
    plain = E.plain_sources(texts.withColumn("target_id", F.concat_ws("/", "doc_id", "label")), "target_id", ["pos", "section_id"])
    return E.ground_quotes(quotes.select("rec_id", "item_id", "quote"), claims.join(plain.hint("merge"), "target_id").select("item_id", "plain"), "rec_id", "item_id")


def term_counts(spark, sf):
    # counted within each document first, so a document has one row for a term
    words = table(spark, sf, "documents").select("doc_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def chunk_rows(spark, sf):
    c = I.chunks(sections(spark, sf), studies(spark, sf))
    return c.select("section_id", "chunk_no", "doc_id", "label", F.md5("text").alias("text_md5"), F.length("context").alias("context_chars"))


def keyword_search(spark, sf):
    """Best chunks for the claims whose number is divisible by 50, against all chunks."""
    queries = items(spark, sf).where("item_no % 50 = 0").select("item_no", "claim")
    return I.search(queries, "item_no", "claim", I.chunks(sections(spark, sf), studies(spark, sf)))


def page_counts(spark, sf):
    """Pages of 800 characters of each section, with the size of the first and last one."""
    pages = sections(spark, sf).select("section_id", X.paginate(F.col("text"), 800).alias("p"))
    return pages.select("section_id", F.size("p").alias("pages"), F.length(F.col("p")[0]).alias("first_chars"), F.length(F.element_at("p", -1)).alias("last_chars"))


def sentence_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    return docs.select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"), F.length("sentence").alias("chars"))


def label_keys(spark, sf):
    return sections(spark, sf).select("section_id", X.label_key(F.col("label")).alias("label_key"), X.label_key(F.col("heading")).alias("heading_key"))


def alias_keys(spark, sf):
    return R.alias_keys(studies(spark, sf))


def cited_locations(spark, sf):
    """Document, table and other part that each citation names."""
    t = X.table_in(F.col("citation"))
    return items(spark, sf).select("item_no", X.document_in(F.col("citation")).alias("doc"), t.alias("table_no"), F.when(t.isNull(), F.nullif(X.section_in(F.col("citation")), F.lit(""))).alias("part"))


def cited_tables(spark, sf):
    return items(spark, sf).select("item_no", F.posexplode(X.tables_in(F.col("citation"))).alias("pos", "table_no"))


def true_locations(spark, sf):
    """Where a claim's data really stand: the table a mutation moved it from, or the cited one."""
    moved = X.extract(F.col("mutation"), r"^Table (\S+) ->", 1)
    return items(spark, sf).where("source_paper is not null").select("item_no", F.col("source_paper").alias("doc"), F.coalesce(moved, X.table_in(F.col("citation"))).alias("table_no"))


def resolve_citations(spark, sf):
    r = R.resolve(items(spark, sf).select("item_no", "citation"), "item_no", "citation", studies(spark, sf), sections(spark, sf))
    return r.select("item_no", "kind", "doc_id", F.array_join("labels", " + ").alias("labels"), "body_chars", "problem")


_NUMS = f"unnest({N.raw_sql('text')}) WITH ORDINALITY AS u(raw, ord)"
_TARGETS = f"""{T["items"]}, {T["sections"]},
places AS (SELECT concat_ws('/', doc_id, label) AS target_id, arg_min({{'heading': heading, 'text': text}}, (pos, section_id)) AS s FROM sections GROUP BY 1),
targets AS (SELECT item_no, id, claim, s.heading AS heading, s.text AS text, concat_ws(chr(10), s.heading, s.text) AS number_text FROM items JOIN places USING (target_id))"""
_TERMS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+(?:[.,]\p{{N}}+)*'), lambda x: CASE WHEN regexp_matches(lower(x), '^\d[\d,]*(\.\d+)?$') THEN CASE WHEN contains(x, '.') THEN regexp_replace(replace(lower(x), ',', ''), '\.?0+$', '') ELSE replace(lower(x), ',', '') END ELSE lower(x) END)"
_CHUNKS = f"""{T["sections"]},
cut AS (SELECT section_id, doc_id, label, heading, kind, list_filter(list_transform(CASE WHEN kind = 'table' THEN string_split(text, chr(10)) ELSE regexp_split_to_array(text, '\\n\\s*\\n') END, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) > 0) AS parts FROM sections),
chunks AS (SELECT section_id, CAST(u.i - 1 AS INT) AS chunk_no, doc_id, label, u.t AS text, concat_ws(' ', doc_id, title, label, heading, CASE WHEN cut.kind = 'table' AND len(parts) > 0 THEN nullif(parts[1], '') END) AS context
           FROM cut LEFT JOIN study_docs ON study_docs.id = cut.doc_id, unnest(parts) WITH ORDINALITY AS u(t, i))"""
_LABEL = r"replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '[^a-z0-9>\x01]+', '', 'g'), chr(1), '.')"


def _field_sql(column: str, weight: float) -> str:
    return f"""
      p_{column} AS (SELECT section_id, chunk_no, term, count(*) AS tf, any_value(length) AS length FROM (SELECT section_id, chunk_no, unnest(w) AS term, len(list_distinct(w)) AS length FROM (SELECT *, {_TERMS.format(column)} AS w FROM chunks)) GROUP BY ALL),
      a_{column} AS (SELECT sum(length) / (SELECT count(*) FROM chunks) AS average FROM (SELECT DISTINCT section_id, chunk_no, length FROM p_{column})),
      f_{column} AS (SELECT term, count(*) AS df FROM p_{column} GROUP BY term),
      m_{column} AS (SELECT query, section_id, chunk_no, term, {weight} * ln(1 + ((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5)) * ({I.FLOOR} + tf * ({I.K1} + 1) / (tf + {I.K1} * (1 - {I.B} + {I.B} * length / average))) AS gain FROM asked JOIN f_{column} USING (term) JOIN p_{column} USING (term), a_{column})"""


QUERIES = {
    f.__name__: f
    for f in (
        number_extract, informative_numbers, number_index, suggest_sources, missing_numbers, code_decided, quote_grounding, term_counts, chunk_rows, keyword_search, page_counts,
        sentence_split, label_keys, alias_keys, cited_locations, cited_tables, true_locations, resolve_citations,
    )
}
_CLAIM_NUMS = f"(SELECT item_no, claim, source_paper, u.raw, u.ord FROM items, unnest({N.raw_sql(N.without_confidence_sql('claim'))}) WITH ORDINALITY AS u(raw, ord) WHERE {N.informative_sql('u.raw')})"
_INDEX = f"(SELECT DISTINCT regexp_replace({N.fixed_sql('u.raw')}, '^-', '') AS norm, doc_id, label FROM (SELECT doc_id, label, concat_ws(chr(10), heading, text) AS text FROM sections), {_NUMS})"
_GROUNDED = r'''trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[‘’“”"''`]', '', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '\.', ' ', 'g'), '\x01', '.', 'g'), '[^\p{{L}}\p{{N}}%.<>=±-]+', ' ', 'g'))'''
SQL = {
    "number_extract": f"SELECT doc_id, CAST(u.ord - 1 AS INT) AS pos, u.raw, {N.fixed_sql('u.raw')} AS norm, CAST({N.decimals_sql('u.raw')} AS INT) AS decimals FROM documents, {_NUMS}",
    "informative_numbers": f"WITH {T['items']} SELECT DISTINCT item_no, {N.fixed_sql('raw')} AS norm FROM {_CLAIM_NUMS}",
    "number_index": f"WITH {T['sections']} SELECT norm, count(*) AS sections FROM {_INDEX} GROUP BY norm",
    "suggest_sources": f"""
        WITH {T["items"]}, {T["sections"]},
        asked AS (SELECT DISTINCT item_no, source_paper AS own, regexp_replace({N.fixed_sql("raw")}, '^-', '') AS norm FROM {_CLAIM_NUMS}),
        sized AS (SELECT *, count(*) OVER (PARTITION BY item_no) AS n FROM asked), place AS (SELECT * FROM {_INDEX}),
        met AS (SELECT item_no, own, n, doc_id, label FROM sized JOIN place USING (norm) GROUP BY ALL HAVING count(*) = n),
        named AS (SELECT item_no, n, concat_ws(', ', doc_id, label) AS p, coalesce(doc_id = own, false) AS mine FROM met),
        lists AS (SELECT item_no, n, list_sort(list(DISTINCT p) FILTER (mine)) AS own_list, list_sort(list(DISTINCT p)) AS all_list FROM named GROUP BY ALL),
        pick AS (SELECT item_no, CASE WHEN len(own_list) > 0 THEN own_list WHEN n >= 2 THEN all_list ELSE [] END AS p FROM lists)
        SELECT item_no, array_to_string(p, '; ') AS suggestions FROM pick WHERE len(p) BETWEEN 1 AND 3""",
    "quote_grounding": f"""
        WITH {_TARGETS}, {T["records"]},
        q AS (SELECT rec_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(result.quote, '(?i)^\\s*Title:\\s*', ''), '\\.\\.\\.|…|\\n'), lambda f: {_GROUNDED.format("f")}), lambda f: length(f) > 0) AS fs, {_GROUNDED.format("text")} AS src
              FROM records JOIN targets ON targets.id = item_id WHERE result.quote IS NOT NULL)
        SELECT rec_id, len(fs) > 0 AND len(list_filter(fs, lambda f: NOT contains(src, f))) = 0 AS grounded FROM q""",
    "term_counts": f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term",
    "chunk_rows": f"WITH {_CHUNKS} SELECT section_id, chunk_no, doc_id, label, md5(text) AS text_md5, CAST(length(context) AS INT) AS context_chars FROM chunks",
    "keyword_search": f"""
        WITH {_CHUNKS}, {T["items"]}, asked AS (SELECT DISTINCT item_no AS query, unnest({_TERMS.format("claim")}) AS term FROM items WHERE item_no % 50 = 0),{_field_sql("text", 2.0)},{_field_sql("context", 1.0)},
        s AS (SELECT query, section_id, chunk_no, round(sum(gain) * count(DISTINCT term), 6) AS score FROM (SELECT * FROM m_text UNION ALL SELECT * FROM m_context) GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, section_id, chunk_no) AS INT) AS place FROM s QUALIFY place <= {I.HITS}""",
    "label_keys": f"WITH {T['sections']} SELECT section_id, {_LABEL.format('label')} AS label_key, {_LABEL.format('heading')} AS heading_key FROM sections",
    "alias_keys": """
        WITH n AS (SELECT id, unnest(list_prepend(id, coalesce(aliases, []))) AS name FROM study_docs WHERE id IS NOT NULL),
        k AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(id), '[^a-z0-9]', '', 'g') AS is_alias FROM n)
        SELECT key, arg_min(id, (is_alias, id)) AS doc_id FROM k WHERE length(key) > 0 GROUP BY key""",
    "cited_locations": rf"""
        WITH {T["items"]}, c AS (SELECT item_no, upper(regexp_replace(coalesce(nullif(regexp_extract(citation, '(?i)\bPMC\d+\b'), ''), nullif(regexp_extract(citation, '\b(?:CSR|RPT)[-\s]?[A-Z]*-?\d[\w-]*|\b[A-Z]{{2,}}-\d[\w-]*'), '')), '\s+', '-', 'g')) AS doc,
          nullif(regexp_extract(citation, '(?i)\b(?:Supplementa(?:ry|l)\s+)?Tables?\s*(S?\d+(?:\.\d+)*[a-z]?)\b', 1), '') AS table_no,
          regexp_extract(citation, '(?i)\b(Figure|Fig\.|Listing|Section|Appendix|Module|Annex)\s*([A-Z]?\d+(?:\.\d+)*[a-z]?|[A-Z]\b)', 1) AS k, regexp_extract(citation, '(?i)\b(Figure|Fig\.|Listing|Section|Appendix|Module|Annex)\s*([A-Z]?\d+(?:\.\d+)*[a-z]?|[A-Z]\b)', 2) AS num FROM items)
        SELECT item_no, doc, table_no, CASE WHEN table_no IS NULL AND k <> '' THEN (CASE WHEN starts_with(lower(k), 'fig') THEN 'Figure' ELSE upper(k[1]) || lower(k[2:]) END) || ' ' || num END AS part FROM c""",
    "true_locations": rf"""
        WITH {T["items"]} SELECT item_no, source_paper AS doc, coalesce(nullif(regexp_extract(mutation, '^Table (\S+) ->', 1), ''), nullif(regexp_extract(citation, '(?i)\b(?:Supplementa(?:ry|l)\s+)?Tables?\s*(S?\d+(?:\.\d+)*[a-z]?)\b', 1), '')) AS table_no FROM items WHERE source_paper IS NOT NULL""",
    "resolve_citations": f"""
        WITH {T["items"]}, {T["sections"]},
        names AS (SELECT regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS key, min(id) AS doc_id FROM (SELECT id, unnest(list_prepend(id, coalesce(aliases, []))) AS x FROM study_docs) GROUP BY 1),
        c AS (SELECT item_no, citation, split_part(citation, ',', 1) AS d, regexp_replace(lower(split_part(citation, ',', 1)), '[^a-z0-9]', '', 'g') AS key, nullif(regexp_extract(citation, '(?i)\\bTable (\\S+)$', 1), '') AS t FROM items),
        r AS (SELECT c.*, names.doc_id FROM c LEFT JOIN names USING (key)),
        s AS (SELECT doc_id, {_LABEL.format("label")} AS k, arg_min({{'label': label, 'n': length(text)}}, (pos, section_id)) AS s FROM sections GROUP BY ALL),
        w AS (SELECT doc_id, sum(length(text)) AS n FROM sections GROUP BY doc_id)
        SELECT item_no, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN t IS NULL THEN 'document' WHEN s.s IS NULL THEN 'missing' ELSE 'section' END AS kind, r.doc_id, s.s.label AS labels,
          CAST(CASE WHEN r.doc_id IS NULL THEN 0 WHEN t IS NULL THEN coalesce(w.n, 0) WHEN s.s IS NULL THEN 0 ELSE s.s.n END AS BIGINT) AS body_chars,
          CASE WHEN r.doc_id IS NULL AND NOT regexp_matches(coalesce(citation, ''), 'PMC\\d|CSR') THEN 'names no document' WHEN r.doc_id IS NULL THEN 'unknown document' WHEN t IS NOT NULL AND s.s IS NULL THEN 'no such table' END AS problem
        FROM r LEFT JOIN s ON s.doc_id = r.doc_id AND s.k = {_LABEL.format("'Table ' || t")} LEFT JOIN w ON w.doc_id = r.doc_id""",
    "page_counts": f"""
        WITH {T["sections"]}, l AS (SELECT section_id, flatten(list_transform(string_split(text, chr(10)), lambda l: list_transform(range(0, greatest((length(l) - 1) // 800, 0) + 1), lambda i: l[i * 800 + 1:i * 800 + 800]))) AS ps FROM sections),
        p AS (SELECT section_id, string_split(list_reduce(list_prepend('', ps), lambda acc, x: CASE WHEN length(split_part(acc, chr(12), -1)) > 0 AND length(split_part(acc, chr(12), -1)) + 1 + length(x) > 800 THEN acc || chr(12) || x
              WHEN length(split_part(acc, chr(12), -1)) > 0 THEN acc || chr(10) || x ELSE acc || x END), chr(12)) AS pages FROM l)
        SELECT section_id, CAST(len(pages) AS INT) AS pages, CAST(length(pages[1]) AS INT) AS first_chars, CAST(length(pages[-1]) AS INT) AS last_chars FROM p""",
    "sentence_split": rf"""
        WITH m AS (SELECT doc_id, regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])({"|".join(a.replace(".", chr(92) + ".") for a in X.ABBREVIATIONS)})\.(\s+)((?-i)[A-Z(\[])', '\1\2' || chr(1) || '\3\4', 'g') AS t FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])(\s+[A-Z(\[])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: trim(regexp_replace(replace(x, chr(1), '.'), '^\s+|\s+$', '', 'g'))), lambda x: length(x) > 0) AS ss FROM m)
        SELECT doc_id, CAST(u.i - 1 AS INT) AS pos, md5(u.x) AS sentence_md5, CAST(length(u.x) AS INT) AS chars FROM s, unnest(ss) WITH ORDINALITY AS u(x, i)""",
    "cited_tables": rf"""
        WITH {T["items"]}, c AS (SELECT item_no, regexp_split_to_array(nullif(regexp_extract(citation, '(?i)\bTables?\s*((?:S?\d+(?:\.\d+)*[a-z]?)(?:\s*(?:,|and|&|-|–|to)\s*S?\d+(?:\.\d+)*[a-z]?)*)', 1), ''), '\s*(?:,|and|&)\s*') AS ps FROM items),
        e AS (SELECT item_no, flatten(list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '^\d+\s*(?:-|–|to)\s*\d+$') AND CAST(regexp_extract(p, '(\d+)$', 1) AS INT) - CAST(regexp_extract(p, '^(\d+)', 1) AS INT) < {X.WIDEST_RANGE}
              THEN list_transform(range(CAST(regexp_extract(p, '^(\d+)', 1) AS INT), CAST(regexp_extract(p, '(\d+)$', 1) AS INT) + 1), lambda i: CAST(i AS VARCHAR)) ELSE list_filter(regexp_split_to_array(p, '\s*(?:-|–|to)\s*'), lambda x: length(x) > 0) END)) AS ts FROM c),
        f AS (SELECT item_no, u.t AS table_no, min(u.i) AS i FROM e, unnest(ts) WITH ORDINALITY AS u(t, i) GROUP BY ALL)
        SELECT item_no, CAST(row_number() OVER (PARTITION BY item_no ORDER BY i) - 1 AS INT) AS pos, table_no FROM f""",
}
