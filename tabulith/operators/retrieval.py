"""Chunks of documents and keyword search over them."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions import text as X
from tabulith.session import cut

# Fixed values of the scoring.
K1, B, FLOOR = 1.2, 0.7, 0.5
WEIGHTS = {"text": 2.0, "context": 1.0}
HITS = 8
# End of fixed values.
#: Queries of a block, chunks scored at a time, and blocks whose results are kept in one plan.
QUERY_BLOCK, CHUNK_BLOCK, BLOCKS_PER_PLAN = 8192, 10_000, 32
#: Share of a batch's chunks from which a term's gains are added as a whole array.
DENSE = 0.05
#: Scores are rounded to 6 digits; rough ones are compared with this room.
ROOM = 2e-6


def chunks(sections: DataFrame, studies: DataFrame) -> DataFrame:
    """(section_id, chunk_no, doc_id, label, text, context): table rows, or paragraphs of text sections."""
    parts = F.when(F.col("kind") == "table", F.split("text", "\n")).otherwise(F.split("text", r"\n\s*\n"))
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)
    s = sections.withColumn("parts", clean).withColumn("header", F.when((F.col("kind") == "table") & (F.size("parts") > 0), F.col("parts")[0]).otherwise(F.lit("")))
    titled = s.join(studies.select(F.col("id").alias("doc_id"), "title"), "doc_id", "left")
    context = F.concat_ws(" ", "doc_id", "title", "label", "heading", F.nullif("header", F.lit("")))
    return titled.select("section_id", "doc_id", "label", context.alias("context"), F.posexplode("parts").alias("chunk_no", "text"))


def search(queries: DataFrame, query_key: str, query_text: str, chunk_rows: DataFrame, limit: int = HITS, block: int = QUERY_BLOCK, document: str | None = None) -> DataFrame:
    """(query, section_id, chunk_no, score, place): the best chunks by BM25 over text (twice) and context.

    A chunk needs one term of the query; scores are multiplied by the number of the query's
    terms that it holds. Frequencies come from all chunks. Of each query the best `limit`
    chunks are kept, ties in the order of section and chunk. Queries with a null key or
    without terms have no hits. document: a column of queries with the id of the document
    that a query is limited to; a null one is not limited.

    The stated queries go through all chunks in blocks: every chunk of a batch is scored
    roughly, by adding up the postings of the query's terms, and those that may be among the
    best are scored again term by term. Of the queries one block at a time is on the driver,
    whatever their number. Terms are compared by 64-bit hashes.
    """
    within = F.col(document).cast("string") if document else F.lit(None).cast("string")
    hashed = lambda text: F.transform(X.terms(text), lambda t: F.xxhash64(t))
    asked = queries.select(F.col(query_key).alias("query"), within.alias("doc"), F.array_distinct(hashed(F.col(query_text))).alias("terms")).where("query is not null and size(terms) > 0")
    # terms are made once; frequencies, lengths and scores all read them
    tokens = cut(chunk_rows.select("section_id", "chunk_no", *(hashed(F.coalesce(c, F.lit(""))).alias(c) for c in WEIGHTS), F.col("doc_id").cast("string").alias("doc")))
    sizes = tokens.agg(F.count("*"), *(F.sum(F.size(F.array_distinct(c))) for c in WEIGHTS)).first()
    fields = {c: (sizes[0], (sizes[i] or 0) / max(1, sizes[0])) for i, c in enumerate(WEIGHTS, 1)}
    each = asked.select("query", "doc", F.explode("terms").alias("term"))
    frequency = None
    for column in WEIGHTS:
        # counted on each task first, so that only its distinct terms are sent
        one = tokens.select(F.explode(F.array_distinct(column)).alias("term")).groupBy("term").agg(F.count("*").alias(column))
        one = one.join(each.select("term").distinct(), "term", "left_semi")
        frequency = one if frequency is None else frequency.join(one, "term", "full")
    known = cut(each.join(frequency, "term").groupBy("query", "doc").agg(F.collect_list(F.struct("term", *WEIGHTS)).alias("terms")).select("query", "doc", *(F.col(f"terms.{c}").alias(c) for c in ("term", *WEIGHTS))))
    kind = asked.schema["query"].dataType.simpleString()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "section_id", "chunk_no"))
    done, held = [], []
    rows = known.toLocalIterator()
    while part := list(itertools.islice(rows, block)):
        held.append(_by_block(part, kind, tokens, fields, limit))
        if len(held) == BLOCKS_PER_PLAN:
            done.append(cut(reduce(DataFrame.unionByName, held)))
            held = []
    every = [*done, *held] or [_by_block([], kind, tokens, fields, limit)]
    hits = reduce(DataFrame.unionByName, every)
    return hits.withColumn("place", place).where(F.col("place") <= limit).select("query", "section_id", "chunk_no", "score", "place")


class _Block:
    """Queries of a block by number: their terms in the order of the block's vocabulary, and what the terms weigh."""

    def __init__(self, rows: list[tuple], fields: dict[str, tuple[int, float]], limit: int):
        self.limit = limit
        self.average = {c: max(a, 1e-9) for c, (_, a) in fields.items()}
        self.within = [r["doc"] for r in rows]
        self.starts = np.cumsum([0, *(len(r["term"]) for r in rows)])
        every = np.array([t for r in rows for t in r["term"]], dtype=np.int64)
        self.vocabulary, first, at = np.unique(every, return_index=True, return_inverse=True)
        self.idf = {}
        for c, (total, _) in fields.items():
            df = np.array([n or 0 for r in rows for n in r[c]], dtype=float)[first]
            self.idf[c] = np.log(1 + (total - df + 0.5) / (df + 0.5))
        self.terms = at.astype(np.int64)
        for a, b in itertools.pairwise(self.starts):
            self.terms[a:b].sort()

    def postings(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of term and chunk in order (term * chunks + chunk), their gains, and where each term begins."""
        n, keys, gains = batch.num_rows, [], []
        for i, (c, weight) in enumerate(WEIGHTS.items(), 2):
            column = batch.column(i)
            offsets = np.asarray(column.offsets)
            values = np.asarray(column.values)[offsets[0] : offsets[-1]]
            row = np.repeat(np.arange(n), np.diff(offsets))
            # the length of a chunk is the number of its distinct terms
            order = np.lexsort((values, row))
            r, v = row[order], values[order]
            new = np.flatnonzero((np.diff(r, prepend=-1) != 0) | np.concatenate([[True], v[1:] != v[:-1]])[: len(v)])
            tf = np.diff(np.append(new, len(v)))
            r, v = r[new], v[new]
            length = np.bincount(r, minlength=n)
            at = np.minimum(np.searchsorted(self.vocabulary, v), len(self.vocabulary) - 1)
            asked = np.flatnonzero(self.vocabulary[at] == v)
            at, r, tf = at[asked], r[asked], tf[asked]
            norm = K1 * (1 - B + B * length[r] / self.average[c])
            keys.append(at * n + r)
            gains.append(weight * self.idf[c][at] * (FLOOR + tf * (K1 + 1) / (tf + norm)))
        keys, gains = np.concatenate(keys), np.concatenate(gains)
        order = np.argsort(keys, kind="stable")
        keys, gains = keys[order], gains[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
        keys, gains = keys[new], np.add.reduceat(gains, new) if len(new) else gains
        return keys, gains, np.searchsorted(keys, np.arange(len(self.vocabulary) + 1) * n)

    def hits(self, batch: pa.RecordBatch, least: np.ndarray):
        """(query, chunks of the batch, scores): the best `limit` that reach the query's least score, which rises with them."""
        n = batch.num_rows
        keys, gains, begins = self.postings(batch)
        sizes = np.diff(begins)
        counted = sizes[self.terms] > 0
        held = np.append(0, np.cumsum(counted))
        # a rough sum holds the number of matched terms in units above every sum of gains
        unit = 2.0 ** np.ceil(np.log2(1 + gains.max(initial=0) * np.diff(self.starts).max()))
        rows, packed = keys % n, gains + unit
        dense = {}
        for t in np.flatnonzero(sizes > DENSE * n):
            dense[t] = np.zeros(n)
            dense[t][rows[begins[t] : begins[t + 1]]] = packed[begins[t] : begins[t + 1]]
        docs, code = None, {}
        if any(w is not None for w in self.within):
            names = batch.column(4).to_pylist()
            code = {d: i for i, d in enumerate(dict.fromkeys(names))}
            docs = np.array([code[d] for d in names])
        sections, chunk_nos = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        spare = np.empty(n)
        for q in np.flatnonzero(np.diff(held[self.starts])):
            span = slice(self.starts[q], self.starts[q + 1])
            terms = self.terms[span][counted[span]]
            few = [slice(begins[t], begins[t + 1]) for t in terms if t not in dense]
            rough = np.bincount(np.concatenate([rows[p] for p in few]), np.concatenate([packed[p] for p in few]), n) if few else np.zeros(n)
            for t in terms:
                if t in dense:
                    rough += dense[t]
            if self.within[q] is not None:
                rough[docs != code.get(self.within[q], -1)] = 0
            matched = np.floor(np.multiply(rough, 1 / unit, out=spare), out=spare)
            if least[q] < 0:
                near = np.flatnonzero(matched)
                rough = (rough[near] - matched[near] * unit) * matched[near]
            else:
                rough -= matched * unit
                rough *= matched
                near = np.flatnonzero(rough >= least[q] - ROOM)
                rough = rough[near]
            if len(near) > self.limit:
                near = near[rough >= np.partition(rough, -self.limit)[-self.limit] - ROOM]
            if not len(near):
                continue
            wanted = terms[:, None] * n + near
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = keys[at] == wanted
            # one term after the other, so that sums don't depend on the other chunks
            score = np.round(np.cumsum(np.where(same, gains[at], 0.0), axis=0)[-1] * same.sum(axis=0), 6)
            best = np.lexsort((chunk_nos[near], sections[near], -score))[: self.limit]
            near, score = near[best], score[best]
            if len(near) == self.limit:
                least[q] = max(least[q], score[-1])
            yield q, near, score


def _by_block(rows: list[tuple], kind: str, tokens: DataFrame, fields: dict[str, tuple[int, float]], limit: int) -> DataFrame:
    """The best `limit` chunks of each batch for each of the queries."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(_Block(rows, fields, limit))

    def scan(batches):
        block = shared.value
        least = np.full(len(block.within), -1.0)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK_BLOCK):
                part = batch.slice(lo, CHUNK_BLOCK)
                found = list(block.hits(part, least)) if len(block.terms) else []
                if found:
                    pick = pa.array(np.concatenate([c for _, c, _ in found]))
                    q = np.repeat(np.array([q for q, _, _ in found], dtype=np.int32), [len(c) for _, c, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(q), part.column(0).take(pick), part.column(1).take(pick), pa.array(np.concatenate([s for _, _, s in found]))], names=["q", "section_id", "chunk_no", "score"])

    hits = tokens.mapInArrow(scan, f"q int, section_id {tokens.schema['section_id'].dataType.simpleString()}, chunk_no int, score double")
    names = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(rows)], f"q int, query {kind}")
    return hits.join(F.broadcast(names), "q").select("query", "section_id", "chunk_no", "score")
