"""Checks by a judge that reads the store with tools, in rounds over all checks at once.

In each round the judge answers every open check, and the tool calls of all answers are carried
out together as queries on the store, however large it is; nothing of the store travels to
the judge but what its tools return. A check ends with a verdict or when its calls are used up;
`check_with_retries` starts failed ones over with a fresh context and a note.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions import numbers as N
from tabulith.functions import text as X
from tabulith.operators import resolving as R
from tabulith.operators import retrieval as I
from tabulith.operators.checking import _REPLY_COLUMNS, objective_failures, parse_reply
from tabulith.operators.reporting import location, same_location
from tabulith.session import cut

# Sizes of what tools return, calls of a check, retries of a check.
DOCUMENTS_PER_PAGE = 25
PAGE_CHARS = 8000
MOST_HITS, HITS, SNIPPET_CHARS = 15, 8, 300
BUDGET, RETRIES = 12, 2
# End of fixed values.
TOOLS = ("list_documents", "get_outline", "read_section", "search")
#: A judge's turn: messages in, {"content", "tool_calls": [{"name", "arguments"}], "prompt_tokens", ...} out.
Turn = Callable[[list[dict]], dict]
_UNVERIFIED = {"verdict": "not_supported", "quote": "", "location": "", "reason": "Could not verify within the tool budget.", "suggestedLocation": None, "confidence": None}
_CALL = "struct<no: int, tool: string, args: map<string,string>, bad: string>"
_STEP = "struct<tool: string, args: map<string,string>, outputChars: bigint, error: string, attempt: int>"
_MESSAGE = "struct<role: string, content: string>"
_REPLY = ", ".join(f"{c} string" for c in _REPLY_COLUMNS)


def arguments(raw: str | None) -> dict | None:
    """A call's arguments: a JSON object, or None for anything else; no text means none."""
    try:
        value = json.loads(raw or "{}")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def whole_number(value) -> int | None:
    """An argument as a whole number: numbers and numeric text, cut off; None for anything else."""
    try:
        number = float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else math.nan
    except ValueError:
        number = math.nan
    return math.trunc(number) if math.isfinite(number) else None


def within(value: Column, low, high) -> Column:
    """A number kept between two bounds."""
    return F.greatest(F.least(value, high if isinstance(high, Column) else F.lit(high)), low if isinstance(low, Column) else F.lit(low))


def capped(text: Column) -> Column:
    return F.when(F.length(text) > PAGE_CHARS, F.concat(F.substring(text, 1, PAGE_CHARS), F.lit("\n[truncated]"))).otherwise(text)


def _texts(args: dict) -> dict[str, str]:
    """Arguments as text; numbers of pages and limits only where they are numbers."""
    out = {k: v if isinstance(v, str) else json.dumps(v) for k, v in args.items() if v is not None and k not in ("page", "limit")}
    return out | {k: str(n) for k in ("page", "limit") if (n := whole_number(args.get(k))) is not None}


def run_tools(calls: DataFrame, studies: DataFrame, sections: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(call, text, error, evidence) of each call: (call, tool, args). evidence lists the texts that were shown.

    Wrong calls give a message with error true. studies: (id, title, kind, aliases); sections as everywhere.
    """
    arg = lambda name: F.col("args")[name]
    text_of = lambda name: F.coalesce(arg(name), F.lit(""))
    page = F.coalesce(arg("page").try_cast("int"), F.lit(1))
    none = F.array().cast("array<string>")
    counts = sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    docs = studies.where("id is not null").select("id", F.coalesce("title", F.lit("")).alias("title"), F.col("kind").alias("doc_kind")).join(counts, F.col("id") == F.col("doc_id"), "left").drop("doc_id")
    keys = R.alias_keys(studies)

    # documents whose id or title holds the filter: each distinct filter once, counted and paged by rank
    listing = calls.where("tool = 'list_documents'").select("call", F.lower(F.trim(text_of("filter"))).alias("f"), page.alias("page"), arg("filter").alias("shown"))
    hits = docs.join(F.broadcast(listing.select("f").distinct()), F.contains(F.lower("id"), F.col("f")) | F.contains(F.lower("title"), F.col("f")))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("f").orderBy("id")))
    pages = listing.join(hits.groupBy("f").agg(F.count("*").alias("n")), "f", "left").withColumn("pages", F.ceil(F.col("n") / DOCUMENTS_PER_PAGE)).withColumn("page", within(F.col("page"), 1, F.col("pages")))
    line = F.concat(F.lit("- "), "id", F.coalesce(F.concat(F.lit(" ["), "doc_kind", F.lit("]")), F.lit("")), F.lit(": "), "title", F.lit(" ("), F.coalesce("n_sections", F.lit(0)).cast("string"), F.lit(" sections)"))
    lines = pages.join(ranked.select("f", "rank", line.alias("line")), "f").where(F.ceil(F.col("rank") / DOCUMENTS_PER_PAGE) == F.col("page")).groupBy("call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.format_string("%s documents (page %s of %s):\n", "n", "page", "pages")
    listed = pages.join(lines, "call", "left").select("call", F.when(F.col("n").isNull(), F.format_string('No documents match "%s".', F.coalesce("shown", F.lit("")))).otherwise(F.concat(head, "lines")).alias("text"), F.col("n").isNull().alias("error"), none.alias("evidence"))

    # the document that a call names
    named = calls.where("tool in ('get_outline', 'read_section', 'search')").withColumn("key", X.id_key(text_of("doc_id"))).join(keys, "key", "left").join(docs.select(F.col("id").alias("doc_id"), "title"), "doc_id", "left")
    unknown = F.format_string('No document with id "%s". Use list_documents or search to find documents.', text_of("doc_id"))

    outline = named.where("tool = 'get_outline'")
    n_pages = F.ceil(F.length(F.coalesce("text", F.lit(""))) / PAGE_CHARS)
    size = F.concat(F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit(" chars"), F.when(n_pages > 1, F.concat(F.lit(", "), n_pages.cast("string"), F.lit(" pages"))).otherwise(F.lit("")))
    caption = F.when((F.col("kind") == "table") & (F.coalesce("heading", F.lit("")) != ""), F.concat(F.lit(" (caption: "), "heading", F.lit(")"))).otherwise(F.lit(""))
    own = sections.select("doc_id", "pos", "section_id", F.coalesce("label", F.lit("")).alias("label"), F.concat(F.lit('- "'), F.coalesce("label", F.lit("")), F.lit('"'), caption, F.lit(" ["), size, F.lit("]")).alias("line"), F.concat_ws(": ", "label", F.coalesce("heading", F.lit(""))).alias("name"))
    grouped = own.join(outline.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section_id", "label", "line", "name"))).alias("s"))
    o = outline.join(grouped, "doc_id", "left").withColumn("s", F.coalesce("s", F.array().cast(grouped.schema["s"].dataType)))
    body = F.concat("doc_id", F.lit(": "), "title", F.lit("\nSections ("), F.size("s").cast("string"), F.lit("; pass the quoted label to read_section):\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"))
    outlined = o.select("call", F.when(F.col("doc_id").isNull(), unknown).otherwise(capped(body)).alias("text"), F.col("doc_id").isNull().alias("error"), F.when(F.col("doc_id").isNull(), none).otherwise(F.concat(F.array("title"), F.transform("s", lambda x: x["name"]))).alias("evidence"))

    read = named.where("tool = 'read_section'").select("call", "doc_id", text_of("section").alias("label"), page.alias("page"), text_of("doc_id").alias("asked"))
    found = R.find_sections(read.where("doc_id is not null"), sections).select("call", "section_id")
    labels = sections.join(read.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", F.lit("")).alias("l")))), lambda x: x["l"]), ", ").alias("labels"))
    r = read.withColumnRenamed("label", "wanted").join(found, "call", "left").join(sections.select("section_id", "label", "heading", "text"), "section_id", "left").join(labels, "doc_id", "left")
    r = r.withColumn("pages", X.paginate(F.coalesce("text", F.lit("")), PAGE_CHARS)).withColumn("page", within(F.col("page"), 1, F.size("pages")))
    more = F.when(F.col("page") < F.size("pages"), F.format_string("; call again with page=%s for more", F.col("page") + 1)).otherwise(F.lit(""))
    note = F.when(F.size("pages") > 1, F.concat(F.lit("\n[page "), F.col("page").cast("string"), F.lit(" of "), F.size("pages").cast("string"), more, F.lit("]"))).otherwise(F.lit(""))
    shown = F.concat(F.col("doc_id"), F.lit(", "), F.coalesce("label", F.lit("")), F.lit(": "), F.coalesce("heading", F.lit("")), note, F.lit("\n\n"), F.get("pages", F.col("page") - 1))
    lost = F.when(F.col("doc_id").isNull(), F.format_string('No document with id "%s". Use list_documents or search to find documents.', "asked")).when(F.col("section_id").isNull(), F.format_string('%s has no section "%s". Available: %s.', "doc_id", "wanted", F.coalesce("labels", F.lit(""))))
    reads = r.select("call", F.coalesce(lost, shown).alias("text"), lost.isNotNull().alias("error"), F.when(lost.isNotNull(), none).otherwise(F.array(shown)).alias("evidence"))

    query = named.where("tool = 'search'").select("call", F.trim(text_of("query")).alias("query_"), F.nullif(F.trim(text_of("doc_id")), F.lit("")).alias("asked"), "doc_id", within(F.coalesce(arg("limit").try_cast("int"), F.lit(HITS)), 1, MOST_HITS).alias("most"))
    usable = query.where((F.col("query_") != "") & (F.col("asked").isNull() | F.col("doc_id").isNotNull())).withColumn("only", F.when(F.col("asked").isNotNull(), F.col("doc_id")))
    chunks = I.chunks(sections, studies.select("id", "title")) if chunks is None else chunks
    got = I.search(usable, "call", "query_", chunks, MOST_HITS, document="only").withColumnRenamed("query", "call").join(usable.select("call", "most"), "call").where("place <= most")
    got = got.join(chunks.select("section_id", "chunk_no", "doc_id", F.coalesce("label", F.lit("")).alias("label"), "text"), ["section_id", "chunk_no"])
    snippet = F.substring("text", 1, SNIPPET_CHARS)
    row = F.concat(F.col("place").cast("string"), F.lit(". "), "doc_id", F.lit(", "), "label", F.lit(": "), snippet, F.when(F.length("text") > SNIPPET_CHARS, F.lit("…")).otherwise(F.lit("")))
    per = got.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("place", row.alias("row"), snippet.alias("snippet")))).alias("h"))
    q = query.join(per, "call", "left")
    where = F.concat(F.lit(' for "'), "query_", F.lit('"'), F.coalesce(F.concat(F.lit(" in "), "asked"), F.lit("")))
    wrong = F.when(F.col("query_") == "", F.lit("Empty query.")).when(F.col("asked").isNotNull() & F.col("doc_id").isNull(), F.format_string('No document with id "%s".', "asked"))
    answer = F.when(F.col("h").isNull(), F.concat(F.lit("No results"), where, F.lit("."))).otherwise(capped(F.concat(F.size("h").cast("string"), F.lit(" results"), where, F.lit(":\n"), F.array_join(F.transform("h", lambda x: x["row"]), "\n"))))
    searched = q.select("call", F.coalesce(wrong, answer).alias("text"), wrong.isNotNull().alias("error"), F.when(wrong.isNotNull() | F.col("h").isNull(), none).otherwise(F.transform("h", lambda x: x["snippet"])).alias("evidence"))
    other = calls.where(~F.col("tool").isin(*TOOLS)).select("call", F.format_string('Unknown tool "%s".', "tool").alias("text"), F.lit(True).alias("error"), none.alias("evidence"))
    return listed.unionByName(outlined).unionByName(reads).unionByName(searched).unionByName(other)


def _turn(ask: Turn, budget: int):
    """One answer of the judge for each open check: what it said, its verdict, its calls, and what they cost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, messages, used in zip(b["key"], b["messages"], b["tool_calls"], strict=True):
                verdict, calls, said, error, tokens, failed = None, [], [], None, 0, 0
                try:
                    reply = ask(json.loads(messages))
                    tokens = int(reply.get("prompt_tokens") or 0)
                    said.append(("assistant", json.dumps({k: reply.get(k) for k in ("content", "tool_calls")}, ensure_ascii=False)))
                    asked = reply.get("tool_calls") or []
                    if not asked:
                        try:
                            verdict = parse_reply(reply.get("content"))
                        except ValueError:
                            used += 1
                            said.append(("user", "Use the tools to check the citation, then call submit_verdict."))
                    for call in asked:
                        args = arguments(call.get("arguments"))
                        if call.get("name") == "submit_verdict":
                            try:
                                verdict = parse_reply(json.dumps(args))
                            except ValueError as e:
                                used, failed = used + 1, failed + 1
                                said.append(("tool", f"Invalid verdict: {e}"))
                        elif used >= budget:
                            said.append(("tool", "Tool budget exhausted."))
                        else:
                            used += 1
                            bad = None if args is not None else f"Could not parse arguments as JSON: {(call.get('arguments') or '')[:200]}"
                            calls.append((len(calls), str(call.get("name")), _texts(args or {}), bad))
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[:500]
                # nested values travel as JSON
                talk = json.dumps([{"role": r, "content": c} for r, c in said])
                asked_for = json.dumps([{"no": n, "tool": t, "args": a, "bad": b} for n, t, a, b in calls])
                out.append((key, talk, *(verdict or dict.fromkeys(_REPLY_COLUMNS)).values(), verdict is not None, asked_for, used, failed, tokens, error))
            yield pd.DataFrame(out, columns=["key", "said", *_REPLY_COLUMNS, "ended", "calls", "tool_calls", "failed", "tokens", "turn_error"])

    return run


def check_with_tools(checks: DataFrame, studies: DataFrame, sections: DataFrame, ask: Turn, key: str = "item_no", budget: int = BUDGET, attempt: int = 0) -> DataFrame:
    """(key, result fields, evidence, steps, tool_calls, turns, peak_tokens, exhausted, error): every check to its end.

    checks: (key, claim, citation) and optionally note, why an earlier attempt was rejected. A check whose calls are used up is
    'not_supported'. A judge that fails ends its check with an error and null fields.
    """
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n\nA previous attempt at this check was rejected because "), "note", F.lit("."))).otherwise(F.lit("")) if "note" in checks.columns else F.lit("")
    task = F.concat(F.lit("Claim: "), F.coalesce("claim", F.lit("")), F.lit("\nCitation: "), F.coalesce("citation", F.lit("")), note)
    system = f"Check whether the cited source supports the claim. Tools: {', '.join(TOOLS)}, submit_verdict. You have {budget} calls."
    kind = checks.schema[key].dataType.simpleString()
    state = cut(checks.select(
        F.col(key).alias("key"), F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), task.alias("content"))).alias("messages"),
        F.lit(0).alias("tool_calls"), F.array().cast(f"array<{_STEP}>").alias("steps"), F.array().cast("array<string>").alias("evidence"), F.lit(0).alias("turns"), F.lit(0).cast("bigint").alias("peak_tokens"),
    ))
    chunks = cut(I.chunks(sections, studies.select("id", "title")))
    done = []
    ended_columns = ["key", *_REPLY_COLUMNS, "evidence", "steps", "tool_calls", "turns", "peak_tokens", "exhausted", "error"]
    fields = f"key {kind}, said string, {_REPLY}, ended boolean, calls string, tool_calls int, failed int, tokens bigint, turn_error string"
    while not state.isEmpty():
        spent = state.where(F.col("tool_calls") >= budget)
        done.append(spent.select("key", *(F.lit(_UNVERIFIED[c]).cast("string").alias(c) for c in _REPLY_COLUMNS), "evidence", "steps", "tool_calls", "turns", "peak_tokens", F.lit(True).alias("exhausted"), F.lit(None).cast("string").alias("error")))
        open_ = state.where(F.col("tool_calls") < budget)
        said = open_.select("key", F.to_json("messages").alias("messages"), "tool_calls").mapInPandas(_turn(ask, budget), fields)
        said = cut(said.withColumn("said", F.from_json("said", f"array<{_MESSAGE}>")).withColumn("calls", F.from_json("calls", f"array<{_CALL}>")))
        calls = said.select("key", F.explode("calls").alias("c")).select(F.struct("key", "c.no").alias("call"), "c.tool", "c.args", "c.bad")
        bad = calls.where("bad is not null").select("call", F.col("bad").alias("text"), F.lit(True).alias("error"), F.array().cast("array<string>").alias("evidence"))
        good = calls.where("bad is null")
        ran = run_tools(good, studies, sections, chunks).unionByName(bad) if not good.isEmpty() else bad
        ran = ran.join(calls.select("call", "tool", "args"), "call")
        step = F.struct("tool", "args", F.length("text").cast("bigint").alias("outputChars"), F.when(F.col("error"), F.lit("true")).alias("error"), F.lit(attempt).alias("attempt"))
        results = ran.groupBy(F.col("call.key").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("call.no").alias("no"), "text", "evidence"))).alias("r"), F.transform(F.array_sort(F.collect_list(F.struct(F.col("call.no").alias("no"), F.to_json(step).alias("s")))), lambda x: F.from_json(x["s"], _STEP)).alias("new_steps"))
        both = cut(open_.drop("tool_calls").join(said, "key").join(results, "key", "left"))
        none = F.array().cast("array<string>")
        invalid = F.transform(F.when(F.col("failed") > 0, F.sequence(F.lit(1), F.col("failed"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit("submit_verdict").alias("tool"), F.create_map().cast("map<string,string>").alias("args"), F.lit(0).cast("bigint").alias("outputChars"), F.lit("true").alias("error"), F.lit(attempt).alias("attempt")))
        grown = both.select(
            "key", F.concat("messages", "said", F.coalesce(F.transform("r", lambda x: F.struct(F.lit("tool").alias("role"), x["text"].alias("content"))), F.array().cast(f"array<{_MESSAGE}>"))).alias("messages"), "tool_calls",
            F.concat("steps", F.coalesce("new_steps", F.array().cast(f"array<{_STEP}>")), invalid).alias("steps"), F.concat("evidence", F.coalesce(F.flatten(F.transform("r", lambda x: x["evidence"])), none)).alias("evidence"),
            (F.col("turns") + 1).alias("turns"), F.greatest("peak_tokens", "tokens").alias("peak_tokens"), *_REPLY_COLUMNS, "ended", F.col("turn_error").alias("error"),
        )
        done.append(grown.where("ended or error is not null").withColumn("exhausted", F.lit(False)).select(*ended_columns))
        state = cut(grown.where("not ended and error is null").select("key", "messages", "tool_calls", "steps", "evidence", "turns", "peak_tokens"))
    if not done:
        return checks.sparkSession.createDataFrame([], f"{key} {kind}, {_REPLY}, evidence array<string>, steps array<{_STEP}>, tool_calls int, turns int, peak_tokens bigint, exhausted boolean, error string")
    return cut(reduce(DataFrame.unionByName, done).withColumnRenamed("key", key))


def failures_of(results: DataFrame, checks: DataFrame, studies: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(key, codes): what is objectively wrong with results (key, result fields, evidence, exhausted) of checks (key, claim, citation, number_checked)."""
    cited_docs = R.match_documents(checks.select(key, "citation"), key, "citation", studies).withColumnRenamed("doc_id", "cited_doc")
    said_docs = R.match_documents(results.select(key, "location"), key, "location", studies).withColumnRenamed("doc_id", "said_doc")
    both = results.join(checks.select(key, "claim", "citation", "number_checked"), key).join(cited_docs, key, "left").join(said_docs, key, "left")
    cited = location(F.col("citation"), F.lit(None).cast("string")).withField("doc", F.coalesce("cited_doc", X.document_in(F.col("citation"))))
    own = location(F.coalesce("location", F.lit("")), F.lit(None).cast("string")).withField("doc", F.coalesce("said_doc", X.document_in(F.coalesce("location", F.lit(""))), cited["doc"]))
    both = both.withColumns({"cited": cited, "loc": own}).withColumn("has_loc", (F.coalesce(F.trim("location"), F.lit("")) != "") & F.col("loc.doc").isNotNull())
    label = F.coalesce(F.concat(F.lit("Table "), "loc.table"), "loc.section")
    placed = R.find_sections(both.where(F.col("has_loc") & label.isNotNull()).select(key, F.col("loc.doc").alias("doc_id"), label.alias("label")), sections).select(key, F.col("section_id").isNotNull().alias("placed"))
    known = studies.select(F.col("id").alias("known_doc")).distinct()
    target = F.coalesce(F.concat(F.lit("Table "), "cited.table"), "cited.section")
    source = R.find_sections(both.where(target.isNotNull()).select(key, F.col("cited.doc").alias("doc_id"), target.alias("label")), sections).where("section_id is not null").select(key, "section_id")
    source = source.join(sections.select("section_id", F.concat_ws("\n", "heading", "text").alias("source_text")), "section_id").drop("section_id")
    both = both.join(placed, key, "left").join(known, F.col("loc.doc") == F.col("known_doc"), "left").join(source, key, "left")
    same = same_location(F.col("loc"), F.col("cited"))
    exists = ~F.col("has_loc") | (same & same_location(F.col("cited"), F.col("loc"))) | F.coalesce("placed", F.col("known_doc").isNotNull())
    on_target = ~F.col("has_loc") | F.col("cited.doc").isNull() | same
    missing = F.when(F.col("number_checked") | F.col("source_text").isNull(), F.array().cast("array<string>")).otherwise(F.transform(N.missing(F.col("claim"), F.col("source_text")), lambda m: m["number"]))
    return both.select(key, objective_failures(F.col("quote"), F.col("verdict"), F.array_join("evidence", "\n"), exists, on_target, missing, F.col("exhausted")).alias("codes"))


def check_with_retries(checks: DataFrame, studies: DataFrame, sections: DataFrame, ask: Turn, key: str = "item_no", retries: int = RETRIES) -> DataFrame:
    """check_with_tools with attempts: adds attempts (verdict and codes of each) and codes of the last one.

    A check with an objective failure starts over with a fresh context and a note on what was
    wrong, at most `retries` times; numbers are held against it once. The last attempt
    stands, but a 'supported' that still fails becomes 'not_supported'.
    """
    open_ = checks.select(key, "claim", "citation", F.lit("").alias("note"), F.lit(False).alias("number_checked"), F.lit("").alias("number_note"), F.array().cast("array<struct<verdict: string, codes: array<string>>>").alias("attempts"), F.array().cast(f"array<{_STEP}>").alias("earlier"))
    done = []
    for attempt in range(retries + 1):
        open_ = cut(open_)
        if attempt and open_.isEmpty():
            break
        got = check_with_tools(open_.select(key, "claim", "citation", "note"), studies, sections, ask, key, attempt=attempt)
        codes = failures_of(got.where("error is null"), open_, studies, sections, key)
        both = cut(got.join(open_, key).join(codes, key, "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))))
        both = both.withColumn("attempts", F.concat("attempts", F.array(F.struct("verdict", "codes")))).withColumn("steps", F.concat("earlier", "steps"))
        last = attempt == retries
        failed = (F.size("codes") > 0) & F.col("error").isNull()
        ended = both if last else both.where(~failed)
        unsure = failed & (F.col("verdict") == "supported")
        ended = ended.withColumn("reason", F.when(unsure, F.concat(F.lit("Could not verify: "), F.array_join("codes", "; "), F.lit("."))).otherwise(F.col("reason"))).withColumn("verdict", F.when(unsure, F.lit("not_supported")).otherwise(F.col("verdict")))
        done.append(ended.select(*got.columns, "attempts", "codes"))
        why = F.array_join("codes", "; ")
        now = F.array_contains("codes", "number_missing")
        open_ = both.where(failed).select(
            key, "claim", "citation", F.when((F.col("number_note") != "") & ~now, F.concat_ws("; ", why, "number_note")).otherwise(why).alias("note"), (F.col("number_checked") | now).alias("number_checked"),
            F.when(now, F.lit("number_missing")).otherwise(F.col("number_note")).alias("number_note"), "attempts", F.col("steps").alias("earlier"),
        )
    return cut(reduce(DataFrame.unionByName, done))
