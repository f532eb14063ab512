"""JSON lines, plain text and run directories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a given schema; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a row, null fields left out; mode 'append' adds to an earlier run."""
    df.write.mode(mode).json(path)


def paper_documents(papers: DataFrame) -> DataFrame:
    """Papers as documents: each table a section of its rows, with a notes block where it has a foot."""
    foot = lambda t: F.coalesce(t["foot"], F.lit(""))
    section = lambda t: F.struct(
        t["label"].alias("label"), t["caption"].alias("heading"), F.lit("table").alias("kind"),
        F.concat(F.array_join(t["rows"], "\n"), F.when(foot(t) != "", F.concat(F.lit("\n\nNotes: "), foot(t))).otherwise(F.lit(""))).alias("text"),
    )
    return papers.select("id", "title", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("array<string>").alias("aliases"), F.transform("tables", section).alias("sections"))


def document_sections(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, label, heading, kind, text): the sections of documents in order."""
    return documents.select(F.col("id").alias("doc_id"), F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.label", "s.heading", "s.kind", "s.text")


def document_text(documents: DataFrame) -> DataFrame:
    """(id, title, text): whole documents, title and sections one below the other."""
    parts = F.transform(F.coalesce("sections", F.array().cast(documents.schema["sections"].dataType)), lambda s: F.concat(F.coalesce(s["heading"], F.lit("")), F.lit("\n"), F.coalesce(s["text"], F.lit(""))))
    return documents.select("id", "title", F.array_join(F.concat(F.array("title"), parts), "\n").alias("text"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(file, paragraph_no, text) of plain-text files: paragraphs between blank lines, trimmed, none empty."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    clean = F.filter(F.transform(F.split("value", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)
    return files.select("file", F.posexplode(clean).alias("paragraph_no", "text"))


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records of all files that match, with run_name from the file."""
    df = spark.read.schema(schemas.RECORD).option("mode", "FAILFAST").json(pattern)
    return df.withColumn("run_name", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl?$", ""))


def flat_runs(runs: DataFrame) -> DataFrame:
    """Run records in the column layout that the scoring operators take."""
    usage = F.struct(F.col("usage.promptTokens").alias("prompt_tokens"), F.col("usage.completionTokens").alias("completion_tokens"), F.col("usage.costUsd").alias("cost_usd"))
    return runs.select(
        F.xxhash64("run_name", "item.id").alias("rec_id"), "run_name", F.col("item.id").alias("item_id"), F.col("item.label").alias("label"), F.col("item.errorType").alias("error_type"), F.col("item.claim").alias("claim"),
        F.col("item.citation").alias("citation"), F.col("item.reviewed").alias("reviewed"), "model", "agent", F.col("result.verdict").alias("verdict"), F.col("quoteGrounded").alias("quote_grounded"), usage.alias("usage"),
        F.col("latencyMs").alias("latency_ms"), "resolution", "cues", "hybrid", F.col("trace.attempts").alias("raw_attempts"), "trace",
    ).withColumn("attempts", F.transform("raw_attempts", lambda a: F.struct(a["result"]["verdict"].alias("verdict"), F.size(a["failures"]).alias("failures")))).drop("raw_attempts")


def agent_stats(runs: DataFrame) -> DataFrame:
    """Per run: tool calls, peaks, retries and flips of checks that used tools."""
    t = runs.where("trace is not null")
    flag = lambda v: v != "supported"
    first, last = flag(F.col("attempts")[0]["verdict"]), flag(F.col("verdict"))
    again = (F.size("attempts") > 1) & F.col("verdict").isNotNull()
    return t.groupBy("run_name").agg(
        F.count("*").alias("checks"), F.avg("trace.toolCalls").alias("avg_tool_calls"), F.max("trace.toolCalls").alias("max_tool_calls"), F.count_if("trace.budgetExhausted").alias("exhausted"),
        F.avg("trace.peakPromptTokens").alias("avg_peak"), F.max("trace.peakPromptTokens").alias("max_peak"), F.count_if(F.size("attempts") > 1).alias("retried"),
        F.count_if(F.element_at("attempts", -1)["failures"] > 0).alias("unresolved"), F.count_if(again & first & ~last).alias("flag_to_pass"), F.count_if(again & ~first & last).alias("pass_to_flag"),
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """One summary as a JSON file; its row is one by construction."""
    row = json.loads(summary.toJSON().first())
    with open(path, "w", encoding="utf-8") as out:
        json.dump(row, out, indent=2, ensure_ascii=False)


def expand_items(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims whose table exists as items; claims of unknown tables fail."""
    known = document_sections(documents).select("doc_id", "label").distinct()
    unknown = claims.join(known, ["doc_id", "label"], "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no such table: {unknown[0]['doc_id']}, {unknown[0]['label']}")
    return claims.withColumn("citation", F.concat_ws(", ", "doc_id", "label")).withColumn("target_id", F.concat_ws("/", "doc_id", "label"))
