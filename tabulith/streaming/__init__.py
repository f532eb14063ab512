"""Structured Streaming: lines checked as they come, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulith.functions import numbers as N
from tabulith.operators.extracting import marked_sentences


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder as a stream of lines; nothing is carried from one line to the next."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")).where("trim(text) <> '' and lower(trim(text)) not in ('exit', 'quit')")


def claims_of(lines: DataFrame) -> DataFrame:
    """(paragraph, sentence, claim, marker, doc, part, numbers) of each line, without state; paragraph is the line's hash."""
    keyed = lines.select(F.xxhash64("file", "text").alias("paragraph"), "text")
    return marked_sentences(keyed).select("paragraph", "sentence", "claim", "marker", "doc", "part", F.transform(N.informative(F.col("claim")), lambda n: n["raw"]).alias("numbers"))


def two_phases(stream: DataFrame, fast, strong, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes provisional results of each micro-batch at once, then final ones where `strong` has any.

    fast and strong map a batch to results; rows of both carry the batch and a phase.
    """

    def run(batch: DataFrame, number: int) -> None:
        first = fast(batch).withColumn("phase", F.lit("provisional")).withColumn("batch", F.lit(number))
        first.write.mode("append").parquet(sink)
        strong(batch).withColumn("phase", F.lit("final")).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(kind, begin, n, total) per tumbling window, or per sliding one with `slide`; rows later than the watermark are dropped by a stream."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    w = events.withWatermark(at, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(kind, F.col("w.start").alias("begin"), "n", "total")


def session_counts(events: DataFrame, by: str, at: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(by, begin, last, n) per session: rows of one key with less than `gap` between neighbours. Null times have no session."""
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return s.select(by, F.col("w.start").alias("begin"), "last", "n")
