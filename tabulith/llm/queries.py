"""Queries of the problems on training data, and SQL for those that SQL can express."""

from __future__ import annotations

from tabulith.llm import leaks, lookalikes, mixing, pairs, percentiles, residue, sampling, spans

QUERIES = {
    "p1_found": pairs.p1_found,
    "p1_labels": pairs.p1_labels,
    "p2_found": spans.p2_found,
    "p2_shared": spans.p2_shared,
    "p3_found": lookalikes.p3_found,
    "p3_classes": lookalikes.p3_classes,
    "p3_normalised": lookalikes.p3_normalised,
    "p4_percentiles": percentiles.p4_percentiles,
    "p4_sketch": percentiles.p4_sketch,
    "p5_found": sampling.p5_found,
    "p5_report": sampling.p5_report,
    "p5_sample": sampling.p5_sample,
    "p6_found": leaks.p6_found,
    "p6_leaks": leaks.p6_leaks,
    "p7_found": mixing.p7_found,
    "p7_shares": mixing.p7_shares,
    "p7_mixture": mixing.p7_mixture,
    "p8_found": residue.p8_found,
    "p8_residue": residue.p8_residue,
}

SQL = {
    "p2_found": """
        WITH r AS (
          SELECT DISTINCT 'section' AS record_kind, section_id AS record_id, text FROM doc_sections WHERE length(text) >= 200
          UNION SELECT 'run', rec_id, result.quote FROM run_records WHERE length(result.quote) >= 200),
        w AS (SELECT record_kind, record_id, substring(text, i + 1, 200) AS span FROM r, unnest(range(length(text) - 199)) AS u(i)),
        d AS (SELECT span FROM w GROUP BY span HAVING count(DISTINCT (record_kind, record_id)) > 1)
        SELECT DISTINCT record_kind, record_id FROM w SEMI JOIN d USING (span)""",
    "p4_percentiles": percentiles.P4_SQL,
    "p4_sketch": percentiles.P4_SKETCH_SQL,
    "p5_found": sampling.P5_FOUND_SQL,
    "p6_found": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM documents),
        pw AS (SELECT passage_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM eval_passages),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM dw, unnest(range(1, len(w) - 11)) AS u(i)),
        pg AS (SELECT DISTINCT passage_id, array_to_string(w[i:i + 12], ' ') AS g FROM pw, unnest(range(1, len(w) - 11)) AS u(i))
        SELECT DISTINCT doc_id, passage_id FROM dg JOIN pg USING (g)""",
}
