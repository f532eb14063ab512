"""Evaluation passages inside a training corpus (problem 6).

Method: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item leaks where a document holds at least `run` consecutive words of it, which is
`run - shingle + 1` shingles. Items are cut into pieces of at most `PIECE` words that
overlap by `run - 1`, so a leak lies within a piece; pieces stand in partitions of equal
numbers by size. Documents are cut into windows of two blocks of `run` shingles, so a leak
lies within a window. In a partition with pieces of at most U shingles a leak is a
containment of at least (run - shingle + 1) / U, which against windows of a known size is a
least Jaccard similarity s; the partition's signatures have as many permutations as make
it as unlikely as `MISS` that none of them agrees, ln(MISS) / ln(1 - s). One agreeing
minimum makes a window and a piece candidates, and candidates are verified by exact
containment of stretches of `run` words, compared as text.

With items of more words than `broadcast_words` the items' signatures do not travel to
every task: pieces and windows then have `run` words both, so that equal stretches have
equal sets, s is 1 and one permutation is enough; minima meet in a shuffled join. Both ways
find the same leaks, which the tests compare.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.codes import Rolling, Words, chunks, composed, mix, sliding_min
from tabulith.session import cut, table

#: Consecutive words that make a leak; words in a shingle.
RUN = 13
SHINGLE = 5
#: Words of a piece of a test item, at most; partitions of pieces by size.
PIECE = 40
PARTITIONS = 4
#: Probability that a leak of the least length goes unseen.
MISS = 1e-6
#: Words of all test items whose signatures are broadcast, at most (about 20 MB with their texts).
BROADCAST_WORDS = 200_000
#: Parts into which the documents of one minimum are split when minima are joined.
SALTS = 16


def permutations(upper: int, window: int, run: int = RUN, shingle: int = SHINGLE) -> int:
    """Number of permutations for pieces of at most `upper` shingles against windows of `window` shingles."""
    common = run - shingle + 1
    least = common / max(common, window + upper - common)
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


@lru_cache(maxsize=4)
def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each permutation what shingles are xored with and multiplied by; the first ones are the same for any count."""
    at = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return at[::2], at[1::2] | np.uint64(1)


def _blocks(owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First places of blocks of `size` consecutive places of one owner, and the owner of each block."""
    heads = np.flatnonzero(np.diff(owner, prepend=-1) != 0)
    within = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
    first = np.flatnonzero(within % size == 0)
    return first, owner[first]


def _shingles(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of the texts, and their texts."""
    words = Words(texts)
    hashes = Rolling(words.hashes).every(shingle)
    at = np.arange(len(hashes))
    text = np.searchsorted(words.starts, at, side="right") - 1
    whole = at + shingle <= words.starts[np.minimum(text + 1, len(words.starts) - 1)]
    return hashes[whole], text[whole]


def signature(texts: list[str], run: int = RUN, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, minimum) of every stretch of `run` words of the texts."""
    words = Words(texts)
    shingles = Rolling(words.hashes).every(shingle)
    minima = sliding_min(shingles, run - shingle + 1)
    at = np.arange(len(minima))
    text = np.searchsorted(words.starts, at, side="right") - 1
    whole = at + run <= words.starts[np.minimum(text + 1, len(words.starts) - 1)]
    at, text = at[whole], text[whole]
    return text, at - words.starts[text], minima[at]


def spelled(text: str) -> list[str]:
    """The words of a text as text, split and folded like Words does."""
    kind, fold = _tables()
    out = "".join(fold.get(c, c) if k == 1 else "" if k == 2 else " " for c in text for k in (kind(c),))
    return out.split()


@lru_cache(maxsize=1)
def _tables():
    from tabulith.llm.codes import word_tables

    kinds, folds = word_tables()
    plain = {chr(i): chr(int(f)) for i, f in enumerate(folds[:65536]) if f != i}
    return (lambda c: int(kinds[min(ord(c), 65536)])), plain


def _longest(words: list[str], index: dict[str, list[tuple[int, int]]], run: int) -> dict[int, tuple[int, int]]:
    """By test item: the longest common run of words, and how many of its stretches the text holds."""
    before: dict[tuple[int, int], int] = {}
    best: dict[int, int] = {}
    held: dict[int, set[int]] = {}
    for j in range(len(words) - run + 1):
        now = {}
        for item, i in index.get(" ".join(words[j : j + run]), ()):
            now[item, i] = length = before.get((item, i - 1), run - 1) + 1
            best[item] = max(best.get(item, 0), length)
            held.setdefault(item, set()).add(i)
        before = now
    return {item: (length, len(held[item])) for item, length in best.items()}


def _index(items: list[tuple[int, str]], run: int) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(items):
        words = spelled(text)
        for i in range(len(words) - run + 1):
            out.setdefault(" ".join(words[i : i + run]), []).append((k, i))
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "passage_id",
    text: str = "text",
    run: int = RUN,
    shingle: int = SHINGLE,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Leaks as (doc_key, item_key, run_words, containment, estimate).

    run_words is the longest run of the item's words in the document, containment the
    share of the item's stretches that it holds, estimate the greatest share of a
    signature in common. Null and empty texts, and items of fewer than `run` words, have no
    leak. Equal rows give equal leaks; rows with a null key are kept with that key. Other
    columns of either table are not read, so their names do not matter.
    """
    items = items.select(F.col(item_key).alias("item"), F.col(text).cast("string").alias("text")).where(F.length("text") >= 2 * run - 1)
    docs = docs.select(F.col(doc_key).alias("doc"), F.col(text).cast("string").alias("text")).where(F.length("text") >= 2 * run - 1)
    # a text has at most half as many words as characters
    bound = items.agg(F.sum(F.floor((F.length("text") + 1) / 2))).first()[0] or 0
    if bound <= broadcast_words:
        leaks = _by_broadcast(docs, items, run, shingle)
    else:
        leaks = _by_join(docs, items, run, shingle)
    return leaks.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "run_words", "containment", "estimate")


def _schema(docs: DataFrame, items: DataFrame) -> str:
    kinds = docs.schema["doc"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    return f"doc {kinds[0]}, item {kinds[1]}, run_words int, containment double, estimate double"


class Ensemble:
    """Signatures of the pieces of test items, in partitions by size; answers which items windows may hold."""

    def __init__(self, texts: list[str], run: int, shingle: int):
        self.run, self.shingle, self.window = run, shingle, 2 * run
        hashes, owner = _shingles(texts, shingle)
        sizes = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        most, common = PIECE - shingle + 1, run - shingle + 1
        pieces = []
        for k, size in enumerate(sizes):
            if size >= common:
                # pieces overlap by all shingles of a leak but one
                for a in range(0, max(1, size - common + 1), most - common + 1):
                    pieces.append((min(most, size - a), starts[k] + a, k))
        pieces.sort()
        #: Upper size and number of permutations of each partition.
        self.partitions: list[tuple[int, int]] = []
        self.item = np.array([k for _, _, k in pieces], dtype=np.int64)
        self.size = np.zeros(len(pieces), dtype=np.int64)
        minima, at, which = [], [], []
        for part in np.array_split(np.arange(len(pieces)), PARTITIONS):
            if len(part):
                upper = pieces[part[-1]][0]
                count = permutations(upper, self.window, run, shingle)
                self.partitions.append((upper, count))
                self.size[part] = count
                xor, times = _seeds(count)
                for p in part:
                    size, a, _ = pieces[p]
                    minima.append(((hashes[a : a + size, None] ^ xor) * times).min(axis=0))
                    at.append(np.full(count, p))
                    which.append(np.arange(count))
        self.count = max((c for _, c in self.partitions), default=0)
        keys = np.concatenate(minima) if minima else np.zeros(0, np.uint64)
        which = np.concatenate(which) if which else np.zeros(0, np.int64)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        #: For each permutation its minima in order and their pieces.
        self.tables = []
        for j in range(self.count):
            own = np.flatnonzero(which == j)
            own = own[np.argsort(keys[own], kind="stable")]
            self.tables.append((keys[own], at[own]))

    def candidates(self, texts: list[str]) -> dict[int, dict[int, float]]:
        """By text the items that a window may hold, with the greatest share of a signature in common."""
        hashes, owner = _shingles(texts, self.shingle)
        if not len(hashes) or not self.count:
            return {}
        first, text = _blocks(owner, self.run)
        joined = np.append(text[1:] == text[:-1], False)
        xor, times = _seeds(self.count)
        windows, pieces = [], []
        for j, (keys, at) in enumerate(self.tables):
            low = np.minimum.reduceat((hashes ^ xor[j]) * times[j], first)
            low[:-1] = np.where(joined[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
            left = np.searchsorted(keys, low)
            hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == low)
            if len(hit):
                n = np.searchsorted(keys, low[hit], side="right") - left[hit]
                windows.append(np.repeat(hit, n))
                pieces.append(at[np.repeat(left[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        if not windows:
            return {}
        both, common = np.unique(np.stack([np.concatenate(windows), np.concatenate(pieces)]), axis=1, return_counts=True)
        out: dict[int, dict[int, float]] = {}
        for t, item, share in zip(text[both[0]].tolist(), self.item[both[1]].tolist(), (common / self.size[both[1]]).tolist(), strict=True):
            own = out.setdefault(t, {})
            own[item] = max(own.get(item, 0.0), share)
        return out


def _by_broadcast(docs: DataFrame, items: DataFrame, run: int, shingle: int) -> DataFrame:
    rows = [(r["item"], composed(r["text"])) for r in items.collect()]
    schema = _schema(docs, items)
    arrow_item = items.select("item").limit(0).toArrow().schema.field(0).type
    shared = docs.sparkSession.sparkContext.broadcast((rows, Ensemble([t for _, t in rows], run, shingle)))

    def scan(batches):
        rows, ensemble = shared.value
        index = None
        for batch in batches:
            keys = batch.column(0)
            out: list[tuple] = []
            for lo, _hi, texts in chunks(batch, "text"):
                texts = [composed(t) for t in texts]
                for t, items in ensemble.candidates(texts).items():
                    if index is None:
                        index = _index(rows, run)
                        stretches = np.bincount([k for held in index.values() for k, _ in held], minlength=len(rows))
                    for item, (length, held) in _longest(spelled(texts[t]), index, run).items():
                        if item in items:
                            out.append((lo + t, rows[item][0], length, held / stretches[item], items[item]))
            picked = keys.take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked, pa.array([o[1] for o in out], arrow_item), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.float64()), pa.array([o[4] for o in out], pa.float64())],
                names=["doc", "item", "run_words", "containment", "estimate"],
            )

    return docs.mapInArrow(scan, schema)


def _minima(table: DataFrame, key: str, run: int, shingle: int) -> DataFrame:
    """Distinct (row, minimum) of a table's texts, with the row's number of minima."""

    def scan(batches):
        for batch in batches:
            for lo, _hi, texts in chunks(batch, "text"):
                text, _, minima = signature([composed(t) for t in texts], run, shingle)
                if not len(text):
                    continue
                pairs = np.unique(np.stack([text.astype(np.uint64), minima]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=["row", "minimum"])

    return table.mapInArrow(scan, "row bigint, minimum bigint")


def _by_join(docs: DataFrame, items: DataFrame, run: int, shingle: int) -> DataFrame:
    """As _by_broadcast for any number of test items; each document's text moves once, to all its candidates."""
    schema = _schema(docs, items)
    arrow_item = items.select("item").limit(0).toArrow().schema.field(0).type
    # row numbers must not change between uses, so they are cut from their lineage
    docs = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc", "text"))
    items = cut(items.select(F.monotonically_increasing_id().alias("row"), "item", "text"))
    own = _minima(items.select("row", "text"), "row", run, shingle)
    sizes = own.groupBy("row").agg(F.count("*").alias("size")).withColumnRenamed("row", "item_row")
    # documents of one minimum are split, as wording that many of them hold may be an item's too
    theirs = _minima(docs.select("row", "text"), "row", run, shingle).select(F.col("row").alias("doc_row"), "minimum", F.pmod(F.hash("row"), F.lit(SALTS)).alias("salt"))
    spread = own.select(F.col("row").alias("item_row"), "minimum", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = theirs.join(spread, ["minimum", "salt"]).groupBy("doc_row", "item_row").agg(F.count("*").alias("common"))
    told = pairs.join(sizes, "item_row").join(items.withColumnRenamed("row", "item_row"), "item_row")
    held = told.groupBy("doc_row").agg(F.collect_list(F.struct("item", "text", (F.col("common") / F.col("size")).alias("estimate"))).alias("held"))
    both = docs.join(held, F.col("row") == F.col("doc_row")).select("doc", "text", "held")

    def verify(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, (d, held) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                index = _index([(k, composed(h["text"])) for k, h in enumerate(held)], run)
                stretches = np.bincount([k for own in index.values() for k, _ in own], minlength=len(held))
                for k, (best, count) in _longest(spelled(composed(d)), index, run).items():
                    out.append((i, held[k]["item"], best, count / stretches[k], held[k]["estimate"]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), arrow_item, pa.int32(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=["doc", "item", "run_words", "containment", "estimate"])

    return both.mapInArrow(verify, schema)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).select("doc_id", "passage_id").distinct()


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with its longest run, containment and MinHash estimate."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))
