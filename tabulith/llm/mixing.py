"""Mixing sources to target weights (problem 7).

Method: Pfair scheduling. The mixture is a sequence of blocks of about `block` size units.
The k-th block of a source with weight w is released at floor((k - 1) / w) and due at
ceil(k / w); at each place of the sequence the released block that is due earliest is
scheduled. Each source is so less than one block away from its share in every prefix.

A source's documents are laid end to end in a random order (by hash), as often as needed,
at most `max_repeats` times, and cut at the edges of its blocks, so the promise holds for
the rows of the mixture and not only for its plan: a document that lies over an edge gives
a row for each of its parts. Cumulative sizes come from totals of hash buckets, so that a
source with any part of the rows is spread over all tasks. Only sources and blocks, both of
bounded number, are handled on the driver.

Sizes are tokens of a public tokenizer whose files are given by path and sent to the workers.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.session import cut, table

#: Folder of the public tokenizers' files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Blocks of a mixture: its size divided by this is the size of a block.
BLOCKS = 10_000
#: Hash buckets of a source for cumulative sizes.
BUCKETS = 1024
#: How the byte-level vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, text: str = "text", column: str = "n_tokens", tokenizers: str = TOKENIZERS) -> DataFrame:
    """docs with the number of tokens of the text instead of the text; null and empty texts have 0."""
    docs.sparkSession.sparkContext.addFile(os.path.join(tokenizers, VOCABULARY))
    rest = [c for c in docs.columns if c != text]
    names = [f"c{i}" for i in range(len(rest))]
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)), F.col(text).cast("string").alias("the_text"))

    def count(batches):
        encoder = _encoder(SparkFiles.get(VOCABULARY))
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            # a text at a time: the encoder's results are counted and dropped
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64())], names=[*names, "n"])

    fields = [f"{n} {source.schema[n].dataType.simpleString()}" for n in names]
    sized = source.mapInArrow(count, ", ".join([*fields, "n bigint"]))
    return sized.select(*(F.col(n).alias(c) for n, c in zip(names, rest, strict=True)), F.col("n").alias(column))


def schedule(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[tuple[str, int]]:
    """Earliest-deadline-first sequence of (source, number of its block), one for each place.

    blocks: how many blocks each source has; weights: its share of the places, adding up
    to at most 1. A place at which no block is released is left out.
    """
    waiting: list[tuple[int, str, int]] = []
    ready: list[tuple[int, str, int]] = []
    for source in sorted(blocks):
        if blocks[source] > 0 and weights[source] > 0:
            heapq.heappush(waiting, (0, source, 1))
    out: list[tuple[str, int]] = []
    place = 0
    while waiting or ready:
        if not ready and waiting[0][0] > place:
            place = waiting[0][0]
        while waiting and waiting[0][0] <= place:
            _, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil(k / weights[source]), source, k))
        _, source, k = heapq.heappop(ready)
        out.append((source, k))
        if k < blocks[source]:
            heapq.heappush(waiting, (max(place + 1, math.floor(k / weights[source])), source, k + 1))
        place += 1
    return out


def _plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], blocks: int) -> tuple[list[dict], list[tuple[str, int]]]:
    """Per source what it has and gives and its number of blocks, and the sequence of blocks.

    A source gives what it should, or all that its repeats allow. Its blocks are of equal
    size, at most the common one.
    """
    total = sum(sizes.get(s, 0) for s, _, _ in targets)
    block = max(1, math.ceil(total / blocks))
    report = []
    for source, share, repeats in targets:
        own = sizes.get(source, 0)
        wanted = Fraction(str(share or 0)) * total
        given = min(math.ceil(wanted), own * max(0, repeats or 0))
        report.append({"source": source, "own_size": own, "target_share": share, "max_repeats": repeats, "target_size": wanted, "given_size": given, "blocks": math.ceil(given / block)})
    places = sum(r["blocks"] for r in report)
    weights = {r["source"]: Fraction(r["blocks"], places) for r in report if r["blocks"]}
    return report, schedule({r["source"]: r["blocks"] for r in report if r["blocks"]}, weights)


def _targets(targets: DataFrame, source: str) -> list[tuple[str, float, int]]:
    """Targets with a source; of equal sources the largest share counts, null shares and repeats are 0."""
    rows = targets.select(source, "target_share", "max_repeats").where(F.col(source).isNotNull()).groupBy(source).agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("t"))
    return sorted((r[source], (r["t"] or (0, 0))[0] or 0.0, (r["t"] or (0, 0))[1] or 0) for r in rows.collect())


class Mixture:
    """The sources of `targets` mixed from `docs`; see the module's text.

    Documents of null or unlisted sources and those without tokens take no part. Sources
    without documents, and empty tables, have size 0. Rows that repeat a key are documents
    of their own. The same rows in any order give the same mixture. Other columns are not read.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", blocks: int = BLOCKS, tokenizers: str = TOKENIZERS):
        self.spark, self.key = docs.sparkSession, key
        wanted = _targets(targets, source)
        listed = docs.where(F.col(source).isin([s for s, _, _ in wanted])) if wanted else docs.limit(0)
        sized = with_tokens(listed.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")), "text", "n_tokens", tokenizers).where("n_tokens > 0")
        self.sized = cut(sized.withColumn("rank", F.xxhash64("key", F.lit("mixture"))).withColumn("bucket", F.shiftrightunsigned("rank", 54).cast("int")))
        # totals of hash buckets, of bounded number: where each bucket begins within its source
        totals = self.sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).collect()
        sizes: dict[str, int] = {}
        self.begins = []
        for r in sorted(totals, key=lambda r: (r["source"], r["bucket"])):
            self.begins.append((r["source"], r["bucket"], sizes.get(r["source"], 0)))
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["n"]
        self.plan, self.order = _plan(sizes, wanted, blocks)

    def rows(self) -> DataFrame:
        """The mixture: (key, source, repeat, place, first_token, n_tokens), a row for each part of a use of a document.

        Ordered by place (the block's place in the schedule) and offset within it, the rows
        are the mixture; the part holds n_tokens tokens of the document from first_token on.
        """
        begun = self.spark.createDataFrame(self.begins, "source string, bucket int, bucket_start bigint")
        gives = self.spark.createDataFrame([(r["source"], r["own_size"], r["given_size"], r["blocks"]) for r in self.plan], "source string, own_size bigint, given_size bigint, blocks bigint")
        places = self.spark.createDataFrame([(s, k - 1, i) for i, (s, k) in enumerate(self.order)], "source string, block bigint, place bigint")
        w = Window.partitionBy("source", "bucket").orderBy("rank", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
        # block k of n blocks holds the offsets from floor(k * given / n) on, so offset x lies in block ceil((x + 1) * n / given) - 1
        block_of = lambda x: F.expr(f"CAST(({x} + 1) * CAST(blocks AS DECIMAL(20,0)) - 1 AS DECIMAL(38,0)) div given_size")
        start_of = F.expr("CAST(CAST(block AS DECIMAL(20,0)) * given_size AS DECIMAL(38,0)) div blocks")
        stop_of = F.expr("CAST(CAST(block + 1 AS DECIMAL(20,0)) * given_size AS DECIMAL(38,0)) div blocks")
        laid = (
            self.sized.withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
            .join(F.broadcast(begun), ["source", "bucket"]).join(F.broadcast(gives), "source")
            .withColumn("offset", F.col("bucket_start") + F.col("before"))
            .withColumn("uses", F.ceil((F.col("given_size") - F.col("offset")) / F.col("own_size")))
            .where("uses > 0")
            .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
            .withColumn("start", F.col("offset") + (F.col("repeat") - 1) * F.col("own_size"))
            .withColumn("stop", F.least(F.col("start") + F.col("n_tokens"), F.col("given_size")))
            .withColumn("block", F.explode(F.sequence(block_of("start"), block_of("stop - 1"))))
            .withColumn("part_start", F.greatest("start", start_of))
            .withColumn("part", F.least("stop", stop_of) - F.col("part_start"))
            .where("part > 0")
        )
        placed = laid.join(F.broadcast(places), ["source", "block"])
        return placed.select(F.col("key").alias(self.key), "source", "repeat", "place", (F.col("part_start") - F.col("start")).alias("first_token"), F.col("part").alias("n_tokens"), (F.col("part_start") - start_of).alias("offset"))

    def report(self) -> DataFrame:
        """What each listed source has, should give and gives in the mixture's rows, with its actual share.

        met tells whether a source has tokens and its rows reach its target size;
        deviation is how far its actual share is from the target.
        """
        plan = [(r["source"], r["own_size"], r["target_share"], r["max_repeats"], float(r["target_size"]), math.ceil(r["target_size"])) for r in self.plan]
        wanted = self.spark.createDataFrame(plan, "source string, own_size bigint, target_share double, max_repeats int, target_size double, least bigint")
        given = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("actual_size"), F.max("repeat").alias("repeats"))
        both = wanted.join(given, "source", "left").withColumn("actual_size", F.coalesce("actual_size", F.lit(0)))
        share = F.col("actual_size") / F.sum("actual_size").over(Window.partitionBy(F.lit(0)))  # a row for each source
        return both.select(
            "source", "own_size", "target_share", "max_repeats", "target_size", "actual_size", F.coalesce("repeats", F.lit(0)).alias("repeats"),
            share.alias("actual_share"), (share - F.col("target_share")).alias("deviation"), ((F.col("own_size") > 0) & (F.col("actual_size") >= F.col("least"))).alias("met"),
        )


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().where("not met").select("source").distinct()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and actual shares of the mixed sources."""
    return _mixture(spark, sf_dir).report()


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: each part of each use of a document with its place."""
    return _mixture(spark, sf_dir).rows()
