"""Checking citations with a pluggable judge.

A judge is a function of a prompt that gives a reply text (and usage). Everything around it
is deterministic: citations are resolved first, what code can decide is decided without a
call, replies are parsed and repaired, and results are cut from their lineage after each
round, so no call is ever made twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith import schemas
from tabulith.functions import numbers as N
from tabulith.functions import text as X
from tabulith.operators import reviewing as V
from tabulith.operators import scoring as S
from tabulith.operators.resolving import resolve
from tabulith.session import cut

Ask = Callable[[str], str]

# Fixed values.
VERDICTS = frozenset(S.VERDICTS)
CONFIDENCES = frozenset({"high", "low"})
SECTION_CHARS = 8000
ATTEMPTS = 2
# End of fixed values.


def _repair(body: str) -> str:
    """Closes what a reply left open and drops what JSON does not know: raw control characters, trailing commas."""
    out: list[str] = []
    stack: list[str] = []
    quoted = escaped = False
    for ch in body:
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
            elif ch in "\n\r\t":
                ch = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[ch]
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            while out and out[-1] in ", \n\t\r":
                out.pop()
            if stack:
                stack.pop()
        out.append(ch)
    text = "".join(out)
    if quoted:
        text += '"'
    text = re.sub(r"[,\s]+$", "", text)
    if re.search(r":\s*$", text):
        text += " null"
    return text + "".join(reversed(stack))


def parse_reply(text: str | None) -> dict:
    """The result in a reply: its first JSON object, repaired if need be; ValueError without a valid one."""
    start = (text or "").find("{")
    if start < 0:
        raise ValueError(f"no JSON object in the reply: {(text or '')[:200]}")
    end = text.rfind("}")
    body = text[start : end + 1] if end > start else text[start:]
    try:
        raw = json.loads(body)
    except json.JSONDecodeError:
        raw = json.loads(_repair(text[start:] if body != text[start:] and body.count('"') % 2 else body))
    if not isinstance(raw, dict) or raw.get("verdict") not in VERDICTS or any(not isinstance(raw.get(k), str) for k in ("quote", "location", "reason")):
        raise ValueError("the reply is no check result")
    suggested = raw.get("suggestedLocation")
    confidence = raw.get("confidence")
    return {"verdict": raw["verdict"], "quote": raw["quote"], "location": raw["location"], "reason": raw["reason"], "suggestedLocation": suggested if isinstance(suggested, str) else None, "confidence": confidence if confidence in CONFIDENCES else None}


_REPLY_COLUMNS = ["verdict", "quote", "location", "reason", "suggestedLocation", "confidence"]


def parse_replies(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, result fields, error): every reply parsed; a bad one has null fields and its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"], strict=True):
                try:
                    out.append((k, *parse_reply(t).values(), None))
                except ValueError as e:
                    out.append((k, *[None] * 6, str(e)[:500]))
            yield pd.DataFrame(out, columns=["k", *_REPLY_COLUMNS, "error"])

    kind = replies.schema[key].dataType.simpleString()
    return replies.select(F.col(key).alias("k"), F.col(reply).alias("t")).mapInPandas(parse, f"k {kind}, {schemas.REPLY}, error string").withColumnRenamed("k", key)


def ask_all(prompts: DataFrame, key: str, prompt: str, ask: Ask, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, result fields, error): each prompt asked until its reply parses, at most `attempts` times.

    A failed check is a row with an error, never a failed job. The result is cut from its lineage.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b["k"], b["p"], strict=True):
                row, error = [None] * 6, None
                for _ in range(attempts):
                    try:
                        row, error = list(parse_reply(ask(p)).values()), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"[:500]
                out.append((k, *row, error))
            yield pd.DataFrame(out, columns=["k", *_REPLY_COLUMNS, "error"])

    kind = prompts.schema[key].dataType.simpleString()
    asked = prompts.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"k {kind}, {schemas.REPLY}, error string")
    return cut(asked.withColumnRenamed("k", key))


def section_prompt(claim: Column, citation: Column, source: Column, note: Column | None = None) -> Column:
    """What a judge is asked on a section."""
    ask = F.lit("Does the source support the claim? Answer with one JSON object: verdict (supported, not_supported, wrong_target), quote, location, reason, suggestedLocation, confidence.")
    parts = [ask, F.concat(F.lit("Claim: "), claim), F.concat(F.lit("Cited: "), citation), F.concat(F.lit("Source:\n"), source)]
    if note is not None:
        parts.append(F.when(note != "", F.concat(F.lit("Before you answer: "), note)))
    return F.concat_ws("\n\n", *parts)


def supported_note(claim: Column, number_text: Column, label: Column) -> Column:
    """What a verdict of 'supported' must face: numbers that the source lacks and cues of overstatement; '' if nothing."""
    missing = N.missing(claim, number_text)
    numbers = F.when(F.size(missing) > 0, F.concat(F.lit("these numbers are not in "), label, F.lit(": "), F.array_join(F.transform(missing, lambda m: F.concat(m["number"], F.when(F.size(m["nearest"]) > 0, F.concat(F.lit(" (closest: "), F.array_join(m["nearest"], ", "), F.lit(")"))).otherwise(F.lit("")))), ", ")))
    cues = V.cues(claim, number_text)
    said = F.when(F.size(cues) > 0, F.array_join(V.cue_messages(cues), "; "))
    return F.concat_ws(". Also, ", numbers, said)


def check(items: DataFrame, studies: DataFrame, sections: DataFrame, ask: Ask, whole: Ask | None = None, key: str = "item_no") -> DataFrame:
    """(key, path, result fields, note, error): every citation checked.

    Missing targets are 'wrong_target' without a call. Sections of at most SECTION_CHARS
    are asked once, and again with a note where 'supported' leaves something open; what
    remains goes to `whole` (a judge of whole documents), or has an error without one.
    """
    cited = items.select(key, "claim", "citation")
    r = resolve(cited.select(key, "citation"), key, "citation", studies, sections)
    texts = sections.select(F.col("section_id").alias("sid"), "doc_id", "label", "heading", "text")
    page = F.concat(F.concat_ws(", ", "doc_id", "label"), F.lit(": "), F.coalesce("heading", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    pasted = (
        r.where("kind = 'section'").select(key, "body_chars", F.posexplode("section_ids").alias("no", "sid")).join(texts, "sid")
        .groupBy(key, "body_chars").agg(F.array_sort(F.collect_list(F.struct("no", page.alias("page"), F.concat_ws("\n", "heading", "text").alias("numbers"), F.concat_ws(", ", "doc_id", "label").alias("label")))).alias("p"))
        .select(key, "body_chars", F.array_join(F.transform("p", lambda x: x["page"]), "\n\n").alias("source"), F.array_join(F.transform("p", lambda x: x["numbers"]), "\n").alias("number_text"), F.array_join(F.transform("p", lambda x: x["label"]), " + ").alias("label"))
    )
    fields = [F.lit(None).cast("string").alias(c) for c in _REPLY_COLUMNS]
    missing = r.where("kind = 'missing'").join(cited, key).select(key, F.lit("code").alias("path"), F.lit("wrong_target").alias("verdict"), F.lit("").alias("quote"), F.col("citation").alias("location"), F.col("problem").alias("reason"), *fields[4:], F.lit("").alias("note"), F.lit(None).cast("string").alias("error"))
    fast = pasted.where(F.col("body_chars") <= SECTION_CHARS).join(cited, key)
    first = ask_all(fast.select(key, section_prompt(F.col("claim"), F.col("citation"), F.col("source")).alias("prompt")), key, "prompt", ask)
    noted = first.where("verdict = 'supported'").select(key).join(fast, key).withColumn("note", supported_note(F.col("claim"), F.col("number_text"), F.col("label"))).where("note <> ''")
    noted = cut(noted)
    second = ask_all(noted.select(key, section_prompt(F.col("claim"), F.col("citation"), F.col("source"), F.col("note")).alias("prompt")), key, "prompt", ask)
    kept = first.join(noted.select(key), key, "left_anti").withColumn("note", F.lit(""))
    redone = second.join(noted.select(key, "note"), key)
    columns = [key, F.lit("section").alias("path"), *_REPLY_COLUMNS, "note", "error"]
    out = missing.unionByName(kept.select(*columns)).unionByName(redone.select(*columns))
    rest = r.where("kind = 'document'").select(key).unionByName(pasted.where(F.col("body_chars") > SECTION_CHARS).select(key)).join(cited, key)
    if whole is None:
        left = rest.select(key, F.lit("whole").alias("path"), *fields, F.lit("").alias("note"), F.lit("needs a judge of whole documents").alias("error"))
    else:
        prompt = F.concat(F.lit("Claim: "), F.col("claim"), F.lit("\n\nCited: "), F.col("citation"))
        left = ask_all(rest.select(key, prompt.alias("prompt")), key, "prompt", whole).select(key, F.lit("whole").alias("path"), *_REPLY_COLUMNS, F.lit("").alias("note"), "error")
    return out.unionByName(left)


def hybrid(fast: DataFrame, items: DataFrame, strong: Ask, prompts: DataFrame, options: set[str], key: str = "item_no") -> DataFrame:
    """Fast results, those with a reason to escalate replaced by the strong judge's: adds decided_by and escalation_reason.

    prompts: (key, prompt) for the strong judge. A strong check that fails keeps the fast result.
    """
    rows = fast.join(items.select(key, "claim"), key)
    reason = S.escalation_reason(F.col("verdict"), F.col("note"), F.col("claim").rlike(V.ascii_words(X.JUDGMENT)), F.col("confidence"), options)
    rows = cut(rows.withColumn("escalation_reason", F.when(F.col("verdict").isNotNull() & (F.col("path") != "code"), reason)))
    asked = ask_all(rows.where("escalation_reason is not null").select(key).join(prompts, key), key, "prompt", strong)
    strong_rows = asked.where("error is null").select(key, *(F.col(c).alias(f"s_{c}") for c in _REPLY_COLUMNS))
    both = rows.join(strong_rows, key, "left")
    replaced = F.col("s_verdict").isNotNull()
    return both.select(key, "path", *(F.when(replaced, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in _REPLY_COLUMNS), F.when(F.col("path") == "code", F.lit("code")).when(replaced, F.lit("strong")).otherwise(F.lit("fast")).alias("decided_by"), "escalation_reason", "error")


def replay(records: DataFrame) -> Ask:
    """A judge that answers from a bounded set of saved (prompt, reply) rows; unknown prompts fail."""
    rows = records.select("prompt", "reply").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("replay is for at most 100,000 saved replies")
    saved = {r["prompt"]: r["reply"] for r in rows}

    def ask(prompt: str) -> str:
        return saved[prompt]

    return ask


def objective_failures(quote: Column, verdict: Column, source: Column, location_known: Column, on_target: Column, missing: Column, exhausted: Column) -> Column:
    """Codes of what is objectively wrong with a result, in fixed order; an exhausted budget is the only one where it holds."""
    said = F.trim(F.coalesce(quote, F.lit(""))) != ""
    supported = verdict == "supported"
    codes = F.array_compact(
        F.array(
            F.when(said & ~X.grounded(quote, source), F.lit("ungrounded_quote")), F.when(~said & supported, F.lit("missing_quote")), F.when(~location_known, F.lit("bad_location")),
            F.when(supported & ~on_target, F.lit("off_target")), F.when(supported & (F.size(missing) > 0), F.lit("number_missing")),
        )
    )
    return F.when(exhausted, F.array(F.lit("budget_exhausted"))).otherwise(codes)
