"""Long exact spans shared between records (problem 2).

Method: level-wise doubling. Windows repeated at one length alone are extended to twice
that length, until no candidates survive.

Equal texts are first made one, with the number of records that hold them. On the first
level, each stretch of `min_chars` characters of a text is represented by the window of
min_chars / 4 characters with the least hash in it, so two equal stretches have the same
representative and only a small part of all windows is compared. On the second level the
surviving windows are extended to min_chars / 2, to the side on which the stretch lies. On
the third level the surviving candidates bring the text around them and all their windows
of min_chars characters are compared. Whatever survives is a shared span; overlapping
windows are merged, and windows that many texts hold are compared by counting windows, not
texts, on all tasks. Each text is hashed once for these levels; the later ones slice it.

Then the length doubles on, among the texts whose shared stretches are long enough, until
no window of two different texts agrees. The last length at which one does is a span that
one other record holds whole; touching spans shared with different records do not count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.codes import Rolling, chunks, code_points, sliding_min
from tabulith.session import cut, table

MIN_CHARS = 200
#: A window held by more texts than this is compared by counting on all tasks.
HOT = 5000
_POS_BITS = 24


def _anchors(texts: list[str], span: int) -> tuple:
    """Stretches' representatives: (text, position, first and last start of their stretches) and the rolling hashes."""
    codes, starts = code_points(texts)
    rolling = Rolling(codes)
    width = span // 4
    hashes = rolling.every(width)
    empty = np.zeros(0, dtype=np.int64)
    if len(codes) < span:
        return empty, empty, empty, empty, rolling, starts
    order = ((hashes >> np.uint64(_POS_BITS)) << np.uint64(_POS_BITS)) | (np.arange(len(hashes), dtype=np.uint64) & np.uint64((1 << _POS_BITS) - 1))
    best = sliding_min(order, span - width + 1)
    at = np.arange(len(best))
    text = np.searchsorted(starts, at, side="right") - 1
    whole = at + span <= starts[np.minimum(text + 1, len(starts) - 1)]
    at, text = at[whole], text[whole]
    low = (best[whole] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    anchor = (at & ~np.int64((1 << _POS_BITS) - 1)) | low
    anchor = np.where(anchor < at, anchor + (1 << _POS_BITS), anchor)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(at)) - 1
    return text[new], anchor[new], at[new], at[last], rolling, starts


def _parts(anchor: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> tuple:
    """Splits the starts of each anchor's stretches by the side to which its window of half the length extends.

    A stretch that begins less than half its length before the anchor holds the half-length
    window that begins with the anchor; any other one holds that which ends with it.
    Gives (index, start of the half window, first start, last start).
    """
    half, quarter = span // 2, span // 4
    edge = anchor - half
    index = np.arange(len(anchor))
    right = last >= edge
    left = first < edge
    return (
        np.concatenate([index[right], index[left]]),
        np.concatenate([anchor[right], anchor[left] + quarter - half]),
        np.concatenate([np.maximum(first, edge)[right], first[left]]),
        np.concatenate([last[right], np.minimum(last, edge - 1)[left]]),
    )


def _windows(texts: DataFrame, span: int) -> DataFrame:
    """Candidates: (tid, quarter, half, start, stop), hashes of a quarter and of half the length, and the text's part that holds all their stretches."""

    def scan(batches):
        for batch in batches:
            tids = batch.column(0)
            for lo, _hi, part in chunks(batch, "text"):
                text, anchor, first, last, rolling, starts = _anchors(part, span)
                if not len(text):
                    continue
                index, begin, first, last = _parts(anchor, first, last, span)
                quarter = rolling.windows(anchor, span // 4)[index].view(np.int64)
                half = rolling.windows(begin, span // 2).view(np.int64)
                base = starts[text[index]]
                yield pa.RecordBatch.from_arrays([tids.take(pa.array(lo + text[index])), pa.array(quarter), pa.array(half), pa.array((first - base).astype(np.int32)), pa.array((last + span - base).astype(np.int32))], names=["tid", "quarter", "half", "start", "stop"])

    return texts.mapInArrow(scan, "tid bigint, quarter bigint, half bigint, start int, stop int")


def _pieces(texts: DataFrame) -> DataFrame:
    """The parts of texts with a list `parts` of (half, is_hot, start, stop): (tid, half, is_hot, start, piece)."""

    def scan(batches):
        for batch in batches:
            for tid, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(parts), 5000):
                    some = parts[at : at + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tid] * len(some)), pa.array([p["half"] for p in some]), pa.array([p["is_hot"] for p in some]), pa.array([p["start"] for p in some], pa.int32()), pa.array([text[p["start"] : p["stop"]] for p in some])],
                        names=["tid", "half", "is_hot", "start", "piece"],
                    )

    return texts.mapInArrow(scan, "tid bigint, half bigint, is_hot boolean, start int, piece string")


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive positions of one owner."""
    head = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(owner, prepend=-9) != 0))
    return head, np.append(head[1:], len(at)) - 1


def _compare(span: int):
    """Compares all windows of the pieces of each group of equal half windows; groups follow one another."""

    def compare(batches):
        held: list[tuple] = []
        group = None
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for tid, half, start, piece in rows:
                if half != group:
                    if len(held) > 1:
                        yield from _shared(held, span)
                    held, group = [], half
                held.append((tid, start, piece))
        if len(held) > 1:
            yield from _shared(held, span)

    def batched(batches):
        buffer: list[tuple] = []
        for row in compare(batches):
            buffer.append(row)
            if len(buffer) >= 20_000:
                yield _rows(buffer)
                buffer = []
        if buffer:
            yield _rows(buffer)

    return batched


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], names=["tid", "start", "stop"])


def _shared(held: list[tuple], span: int):
    """(tid, start, stop) of what is shared between the pieces of different texts of a group."""
    pieces = {p for _, _, p in held}
    if len(pieces) == 1:
        if len({t for t, _, _ in held}) > 1:
            for tid, start, piece in held:
                yield tid, start, start + len(piece)
        return
    codes, starts = code_points([p for _, _, p in held])
    hashes = Rolling(codes).every(span)
    at = np.arange(len(hashes))
    row = np.searchsorted(starts, at, side="right") - 1
    whole = at + span <= starts[row + 1]
    at, row = at[whole], row[whole]
    tids = np.array([t for t, _, _ in held], dtype=np.int64)[row]
    _, same = np.unique(hashes[at], return_inverse=True)
    low = np.full(same.max() + 1, np.iinfo(np.int64).max)
    high = np.full(same.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, same, tids)
    np.maximum.at(high, same, tids)
    hit = np.flatnonzero((low < high)[same])
    if not len(hit):
        return
    head, tail = _runs(row[hit], at[hit])
    for h, t in zip(hit[head], hit[tail], strict=True):
        tid, start, _ = held[row[h]]
        offset = start - starts[row[h]]
        yield tid, int(at[h] + offset), int(at[t] + offset + span)


def _all_windows(pieces: DataFrame, span: int) -> DataFrame:
    """Every window of the pieces: (tid, start, window), its hash."""

    def scan(batches):
        for batch in batches:
            tids, begins = batch.column(0), np.asarray(batch.column(2))
            for lo, _hi, part in chunks(batch, "piece"):
                codes, starts = code_points(part)
                hashes = Rolling(codes).every(span)
                at = np.arange(len(hashes))
                row = np.searchsorted(starts, at, side="right") - 1
                whole = at + span <= starts[row + 1]
                at, row = at[whole], row[whole]
                yield pa.RecordBatch.from_arrays([tids.take(pa.array(lo + row)), pa.array((at - starts[row] + begins[lo + row]).astype(np.int32)), pa.array(hashes[at].view(np.int64))], names=["tid", "start", "window"])

    return pieces.mapInArrow(scan, "tid bigint, start int, window bigint")


def _twice(rows: DataFrame, key: str) -> DataFrame:
    """Values of key that more than one text holds, with the number of their rows."""
    return rows.groupBy(key).agg(F.min("tid").alias("low"), F.max("tid").alias("high"), F.count("*").alias("held")).where("low < high").select(key, "held")


def _level(texts: DataFrame, span: int, hot: int) -> DataFrame:
    """Windows of `span` characters that two of the texts hold: (tid, start, stop), which may overlap."""
    candidates = cut(_windows(texts.select("tid", "text").where(F.length("text") >= span), span))
    mine = candidates.join(_twice(candidates, "quarter").select("quarter"), "quarter", "left_semi").drop("quarter")
    halves = _twice(mine, "half")
    parts = mine.join(halves, "half").groupBy("tid").agg(F.collect_list(F.struct("half", (F.col("held") > hot).alias("is_hot"), "start", "stop")).alias("parts"))
    # only texts with surviving windows, and of these only the pieces around them
    pieces = cut(_pieces(texts.select("tid", "text").join(parts, "tid")))
    cold = pieces.where("not is_hot").select("tid", "half", "start", "piece").repartition("half").sortWithinPartitions("half")
    found = cold.mapInArrow(_compare(span), "tid bigint, start int, stop int")
    windows = _all_windows(pieces.where("is_hot").select("tid", "half", "start", "piece"), span)
    hot_found = windows.join(_twice(windows, "window"), "window", "left_semi").select("tid", "start", (F.col("start") + span).cast("int").alias("stop"))
    return found.unionByName(hot_found)


def shared_spans(records: DataFrame, kind: str = "record_kind", key: str = "record_id", text: str = "text", min_chars: int = MIN_CHARS, hot: int = HOT, lengths: bool = True) -> DataFrame:
    """Per record that shares a span of at least min_chars characters: (kind, key, n_chars, shared_chars, shared_share, longest).

    shared_chars counts the characters in spans that another record holds too. longest is
    the greatest of the lengths min_chars, twice, four times ... min_chars at which a span of
    the record stands whole in one other record, or all of a text that another record equals;
    null where `lengths` is not asked for. Records without such a span, and null or shorter
    texts, give no row. A span repeated only inside one record does not count; a record that
    comes several times under one (kind, key) is one record if its text is the same.
    Characters are code points, compared exactly. Other columns of records are not read.
    """
    if min_chars < 4 or min_chars % 4:
        raise ValueError("min_chars must be a multiple of 4")
    rows = records.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") >= min_chars)
    rows = rows.select("kind", "key", F.unhex(F.md5("text")).alias("digest"), "text")
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"), (F.min(F.struct("kind", "key")) != F.max(F.struct("kind", "key"))).alias("copied"))
    texts = cut(texts.withColumn("tid", F.monotonically_increasing_id()))
    merged = cut(_merge(_level(texts, min_chars, hot)))
    result = texts.select("tid", "digest", "copied", F.length("text").cast("bigint").alias("n_chars")).join(merged, "tid", "left")
    result = result.where("copied or shared > 0").withColumn("shared_chars", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("shared")))
    if lengths:
        steps, length, found = [merged.select("tid", F.lit(min_chars).cast("bigint").alias("length"))], min_chars, merged
        while True:
            length *= 2
            left = found.where(F.col("most") >= length).select("tid")
            if left.isEmpty():
                break
            found = cut(_merge(_level(texts.join(left, "tid", "left_semi"), length, hot)))
            steps.append(found.select("tid", F.lit(length).cast("bigint").alias("length")))
        every = steps[0]
        for step in steps[1:]:
            every = every.unionByName(step)
        result = result.join(every.groupBy("tid").agg(F.max("length").alias("length")), "tid", "left").withColumn("longest", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("length")))
    else:
        result = result.withColumn("longest", F.lit(None).cast("bigint"))
    # of several texts under one record the one with most shared characters counts
    out = rows.select("kind", "key", "digest").join(result, "digest").groupBy("kind", "key").agg(F.max(F.struct("shared_chars", "longest", "n_chars")).alias("r"))
    return out.select(F.col("kind").alias(kind), F.col("key").alias(key), "r.n_chars", "r.shared_chars", (F.col("r.shared_chars") / F.col("r.n_chars")).alias("shared_share"), "r.longest")


def _merge(spans: DataFrame) -> DataFrame:
    """Per text: characters covered by the spans, and the longest covered stretch."""
    step = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))),
        F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("most"), F.lit(-1).cast("bigint").alias("begin"), F.lit(-1).cast("bigint").alias("end")),
        lambda a, s: F.struct(
            (a.total + F.greatest(s.stop - F.greatest(s.start.cast("bigint"), a.end), F.lit(0))).alias("total"),
            F.greatest(a.most, s.stop - F.when(s.start <= a.end, a.begin).otherwise(s.start.cast("bigint"))).alias("most"),
            F.when(s.start <= a.end, a.begin).otherwise(s.start.cast("bigint")).alias("begin"),
            F.greatest(a.end, s.stop.cast("bigint")).alias("end"),
        ),
    )
    return spans.groupBy("tid").agg(step.alias("m")).select("tid", F.col("m.total").alias("shared"), F.col("m.most").alias("most"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and quotes as records, redelivered rows once."""
    sections = table(spark, sf_dir, "doc_sections").select(F.lit("section").alias("record_kind"), F.col("section_id").alias("record_id"), "text")
    runs = table(spark, sf_dir, "run_records").select(F.lit("run").alias("record_kind"), F.col("rec_id").alias("record_id"), F.col("result.quote").alias("text"))
    return sections.unionByName(runs)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(records(spark, sf_dir), lengths=False).select("record_kind", "record_id").distinct()


def p2_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is shared elsewhere."""
    return shared_spans(records(spark, sf_dir))
