"""Template residue, filler and error-page text in documents (problem 8).

Method: interpolated character n-gram models are fitted for filler, for notices, for slots
and shells, and for natural prose. Each character of each document gets the logarithm of
the likelihood ratio between residue and prose; windows in which the ratios add up to
enough are residue, overlapping windows make spans, and documents are excluded by the
coverage of the whole text (`MIN_COVERAGE`) or of its most covered window of `NEAR`
characters (`MIN_NEAR`, by kind), as residue stands alone or inside a real text.

The residue models start from the training texts of residue_seeds. The prose model is
fitted on all documents: their n-grams are counted by bucket on the tasks, and only tables
of a fixed size meet. Counts are taken for each `FIT_DOCS` documents, so that equal shares
give equal models, whatever the size of the table. Lines and
sentences that the table repeats teach it once each, however many rows hold them, so that
a page held by a third of the rows does not become prose, and documents that hold a whole
training text word by word do not teach it at all. As the documents themselves hold
residue, fitting repeats: documents with residue found by one round leave the prose model
of the next, and their spans join the residue models. The fitted tables have a fixed size,
are broadcast, and every document is scored as a whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.codes import CHUNK_CHARS, Rolling, chunks, code_points
from tabulith.llm.residue_seeds import FILLER, NOTICES, SHELLS, slots
from tabulith.session import table

#: Documents that counts are reduced to; smaller tables count as they are.
FIT_DOCS = 2000
ROUNDS = 4
#: Characters that are counted at a time, and that are scored at a time.
FIT_CHARS = 1_000_000
SCAN_CHARS = 200_000
ORDER = 5
BITS = 20
#: N-grams shorter than this many characters and one have buckets of their own.
EXACT = 3
#: Buckets of each order.
SIZES = [1 << min(BITS, 6 * (n + 1)) for n in range(ORDER)]
KINDS = ("filler", "notice", "slot")
#: Window widths in characters, and the sum of log ratios from which a window is residue.
WINDOWS = ((8, 20.0), (12, 24.0), (24, 30.0), (48, 38.0))
#: Mean log ratio of a sentence from which it goes on a filler before it, while models are fitted.
SPREAD = -0.6
#: Ratios of a single character are kept within this bound.
CLIP = 7.0
#: Mean ratio from which a text too short for any window is residue as a whole.
SHORT_MEAN = 2.5
#: Share of a text in spans from which it is excluded.
MIN_COVERAGE = 0.5
#: Width of the window of greatest coverage, and the share in spans from which a text is
#: excluded. Slots are short and stand out by their marks; filler and notices cover more.
NEAR = 48
MIN_NEAR = {"slot": 4 / 48, "filler": 8 / 48, "notice": 13 / 48}
#: Strength of the back-off to the next shorter context.
BACKOFF = 1.5
#: Least probability; the n-gram that stands for a bucket may be of a document that teaches no longer.
LEAST = np.float32(1e-6)
#: What less than about this share of the documents hold is unknown to the prose model.
DISCOUNT = 0.001
_MISS = np.float16(np.inf)
_MISS_BITS = _MISS.view(np.uint16)


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Small symbol (below 64) of each code point: letters without case and accent, one for all digits, single marks."""
    import unicodedata

    marks = " |.,;:()[]{}<>%$#@&_-/\\'\"=+*?!§●©\n"
    out = np.full(65537, 63, dtype=np.uint32)
    for i, ch in enumerate(marks):
        out[ord(ch)] = 28 + i
    for cp in range(65536):
        ch = chr(cp)
        if ch.isdigit():
            out[cp] = 27
        elif ch.isalpha():
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            out[cp] = ord(base) - 96 if "a" <= base <= "z" else 62
        elif ch.isspace() and ch != "\n":
            out[cp] = out[32]
    return out


def _symbols(codes: np.ndarray) -> np.ndarray:
    return _alphabet()[np.minimum(codes, 65536)]


def _packed(symbols: np.ndarray) -> list[np.ndarray]:
    """The n-gram that ends at each character as one number, for n from 1 to ORDER; the last character is lowest."""
    out, gram = [symbols], symbols
    for n in range(1, ORDER):
        back = np.zeros_like(symbols)
        back[n:] = symbols[:-n]
        gram = gram | (back << np.uint32(6 * n))
        out.append(gram)
    return out


def _bucket(packed: np.ndarray, n: int) -> np.ndarray:
    """Buckets of n-grams of n + 1 characters; those of up to three have one each."""
    return packed if n < EXACT else (packed * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol whether it is blank, and whether it ends a sentence."""
    blank, stop = np.zeros(64, dtype=bool), np.zeros(64, dtype=bool)
    blank[_alphabet()[[32, 10]]] = True
    stop[_alphabet()[[ord(c) for c in ".!?"]]] = True
    return blank, stop


def _units(symbols: np.ndarray, starts: np.ndarray, rolling: Rolling | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lines and sentences: the length of each with the blanks around it, and its hash without them (0 for blanks alone)."""
    blank, stop = (k[symbols] for k in _kinds())
    cut = symbols == _alphabet()[10]
    cut[1:] |= blank[1:] & stop[:-1]
    ends = np.union1d(np.flatnonzero(cut) + 1, starts[1:]).astype(np.int64)
    ends = ends[ends > 0]
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    inked = np.flatnonzero(~blank)
    a, b = np.searchsorted(inked, begins), np.searchsorted(inked, ends)
    hashes = np.zeros(len(ends), dtype=np.uint64)
    real = np.flatnonzero(b > a)
    if len(real):
        first = inked[a[real]]
        hashes[real] = (rolling or Rolling(symbols)).windows(first, inked[b[real] - 1] + 1 - first)
    return ends - begins, hashes


@dataclass
class Repeats:
    """Hashes of repeated lines and sentences in order, and how often each stands in the table."""

    hashes: np.ndarray
    counts: np.ndarray

    def weights(self, symbols: np.ndarray, starts: np.ndarray, rolling: Rolling) -> np.ndarray:
        """Weight of each character by which all copies of its line or sentence together count once."""
        sizes, hashes = _units(symbols, starts, rolling)
        weight = np.ones(len(sizes))
        if len(self.hashes) and len(sizes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = np.flatnonzero((self.hashes[at] == hashes) & (hashes != 0))
            weight[same] = 1 / self.counts[at[same]]
        return np.repeat(weight, sizes)


#: Symbols that a training text has at least to be looked up in documents as it stands; it has two words too.
QUOTED = 8


@lru_cache(maxsize=1)
def _quotes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training texts of two words and more: hashes of their beginnings in order, their lengths and hashes, and which leading bits the beginnings have."""
    found = set()
    for text in (*FILLER, *NOTICES, *SHELLS):
        symbols = _symbols(code_points([text.strip(" .:")])[0])
        if len(symbols) >= QUOTED and len(_words(text)) > 1:
            rolling = Rolling(symbols)
            found.add((int(rolling.every(QUOTED)[0]), len(symbols), int(rolling.every(len(symbols))[0])))
    heads, sizes, hashes = zip(*sorted(found), strict=True)
    heads = np.array(heads, dtype=np.uint64)
    leading = np.zeros(1 << BITS, dtype=bool)
    leading[heads >> np.uint64(64 - BITS)] = True
    return heads, np.array(sizes, dtype=np.int64), np.array(hashes, dtype=np.uint64), leading


@lru_cache(maxsize=1)
def _alone() -> np.ndarray:
    """Hashes of all training texts, in order; a document may be one."""
    found = set()
    for text in (*FILLER, *NOTICES, *SHELLS, *slots()):
        symbols = _symbols(code_points([text.strip()])[0])
        if len(symbols) > 2:
            found.add(int(Rolling(symbols).every(len(symbols))[0]))
    return np.array(sorted(found), dtype=np.uint64)


def _words(text: str) -> list[str]:
    return [w for w in text.split() if sum(ch.isalpha() for ch in w) > 1]


def _quoting(symbols: np.ndarray, starts: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Whether each text holds a whole training text, between other characters than letters and digits, or is one of any length."""
    out = np.zeros(len(starts) - 1, dtype=bool)
    inked = np.flatnonzero(~_kinds()[0][symbols])
    a, b = np.searchsorted(inked, starts[:-1]), np.searchsorted(inked, starts[1:])
    full = np.flatnonzero(b > a)
    if len(full):
        first = inked[a[full]]
        whole = rolling.windows(first, inked[b[full] - 1] + 1 - first)
        known = _alone()
        out[full] = known[np.minimum(np.searchsorted(known, whole), len(known) - 1)] == whole
    heads, sizes, hashes, leading = _quotes()
    every = rolling.every(QUOTED)
    at = np.flatnonzero(leading[every >> np.uint64(64 - BITS)])
    k = np.minimum(np.searchsorted(heads, every[at]), len(heads) - 1)
    same = heads[k] == every[at]
    at, k = at[same], k[same]
    inner = np.concatenate([[False], ((symbols > 0) & (symbols < 28)) | (symbols == 62), [False]])
    edge = np.zeros(len(inner), dtype=bool)
    edge[starts] = True
    while len(at):
        fits = at + sizes[k] <= len(symbols)
        a, e = at[fits], at[fits] + sizes[k[fits]]
        text = np.searchsorted(starts, a, side="right") - 1
        good = (rolling.windows(a, e - a) == hashes[k[fits]]) & (e <= starts[text + 1])
        good &= (~inner[a] | edge[a]) & (~inner[e + 1] | edge[e])
        out[text[good]] = True
        more = k + 1 < len(heads)
        more[more] = heads[k[more] + 1] == heads[k[more]]
        at, k = at[more], k[more] + 1
    return out


def _least(rows: int) -> float:
    """Copies from which a line or sentence is repeated; fewer are unknown to the prose model in any case."""
    return max(2.0, DISCOUNT * rows)


def _repeats(texts: list[str]) -> Repeats:
    codes, starts = code_points(texts)
    hashes, counts = np.unique(_units(_symbols(codes), starts)[1], return_counts=True)
    kept = (counts >= _least(len(texts))) & (hashes != 0)
    return Repeats(hashes[kept], counts[kept])


def repeats(docs: DataFrame, text: str, rows: int) -> Repeats:
    """The repeated lines and sentences of a whole table of that many rows.

    Their number is bounded by the lines a row has on average, divided by DISCOUNT.
    """

    def count(batches):
        for batch in batches:
            for _, _, texts in chunks(batch, "text", CHUNK_CHARS):
                codes, starts = code_points(texts)
                hashes, counts = np.unique(_units(_symbols(codes), starts)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["unit", "n"])

    units = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "unit bigint, n bigint").where("unit != 0")
    found = units.groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") >= _least(rows)).toArrow()
    hashes = found.column("unit").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Repeats(hashes[order], found.column("n").to_numpy()[order])


@dataclass
class Model:
    """Log ratios by n-gram bucket: of all residue against prose, and of each kind against prose."""

    ratio: list[np.ndarray]
    kinds: list[np.ndarray]

    def score(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio of residue against prose of each character, and the packed n-gram that ends at it."""
        longest = _packed(symbols)[-1]
        # half-precision numbers are compared by their bits, which is faster
        raw = self.ratio[ORDER - 1].view(np.uint16)[_bucket(longest, ORDER - 1)]
        missing = np.flatnonzero(raw == _MISS_BITS)
        for n in range(ORDER - 2, -1, -1):
            if not len(missing):
                break
            found = self.ratio[n].view(np.uint16)[_bucket(longest[missing] & np.uint32((1 << 6 * (n + 1)) - 1), n)]
            raw[missing] = found
            missing = missing[found == _MISS_BITS]
        raw[missing] = 0
        return raw.view(np.float16).astype(np.float32), longest

    def score_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, packed n-grams and symbols of texts end to end, each as if it stood alone."""
        symbols, starts = _glued(texts)
        own = np.ones(len(symbols), dtype=bool)
        own[(starts[:-1, None] + np.arange(ORDER)).ravel()] = False
        scores, longest = self.score(symbols)
        return scores[own], longest[own], symbols[own]

    def by_kind(self, longest: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log ratio of each kind for the characters at the given places."""
        longest = longest[at]
        out = self.kinds[ORDER - 1][_bucket(longest, ORDER - 1)].astype(np.float32)
        for n in range(ORDER - 2, -1, -1):
            missing = np.flatnonzero(out[:, 0] >= _MISS)
            out[missing] = self.kinds[n][_bucket(longest[missing] & np.uint32((1 << 6 * (n + 1)) - 1), n)]
        out[out >= _MISS] = 0
        return out


class _Interpolated:
    """Probabilities of the last character of n-grams given those before it, one order after the other.

    discount is taken off each count of two characters and more, so that what only a few
    documents hold stays unknown to the model.
    """

    def __init__(self, discount: float = 0.0):
        self.discount = discount
        self.counts: np.ndarray | None = None
        self.probs: np.ndarray | None = None

    def extend(self, counts: np.ndarray, known: np.ndarray, shorter: np.ndarray | None, context: np.ndarray | None) -> np.ndarray:
        """Log probabilities of the known buckets of the next order; shorter, context: the buckets of each without its first and its last character."""
        counts = counts.astype(np.float32)
        if shorter is None:
            probs = (counts + np.float32(0.1)) / np.float32(counts.sum() + 6.4)
        else:
            counts = np.maximum(counts - np.float32(self.discount), 0)
            probs = np.zeros(len(counts), dtype=np.float32)
            probs[known] = (counts[known] + np.float32(BACKOFF) * np.maximum(self.probs[shorter], LEAST)) / (self.counts[context] + np.float32(BACKOFF))
        self.counts, self.probs = counts, probs
        return np.log(probs[known])


#: Weights are counted in whole parts of this size, so that sums do not depend on their order.
PART = 1 << 20


class Tally:
    """Counts of n-grams by bucket, of fixed size.

    tables[n] holds the weight in prose, the number in found residue of each kind (None
    while there is none), and the greatest n-gram seen (plus 1; 0 for none), which stands
    for its bucket.
    """

    def __init__(self):
        self.tables: list[list[np.ndarray | None]] = [[np.zeros(size, dtype=np.int64), *[None] * len(KINDS), np.zeros(size, dtype=np.uint32)] for size in SIZES]
        #: Characters, and their weight.
        self.total = np.zeros(2, dtype=np.int64)

    def table(self, n: int, c: int) -> np.ndarray:
        if self.tables[n][c] is None:
            self.tables[n][c] = np.zeros(len(self.tables[n][0]), dtype=np.int64)
        return self.tables[n][c]

    def add(self, symbols: np.ndarray, weight: np.ndarray, prose: np.ndarray, found: list[np.ndarray]) -> None:
        """weight: of each character; prose: whether it is prose; found: places of residue by kind."""
        parts = np.maximum(1, np.rint(weight * PART))
        self.total += (len(symbols), int(parts.sum()))
        parts *= prose
        used = prose.copy()
        for at in found:
            used[at] = True
        used = slice(None) if used.all() else np.flatnonzero(used)
        for n, packed in enumerate(_packed(symbols)):
            buckets, table = _bucket(packed, n), self.table(n, 0)
            table += np.bincount(buckets, weights=parts, minlength=len(table)).astype(np.int64)
            for k, at in enumerate(found):
                if len(at):
                    np.add.at(self.table(n, 1 + k), buckets[at], 1)
            self.note(n, packed[used], buckets[used])

    def note(self, n: int, packed: np.ndarray, buckets: np.ndarray) -> None:
        if n < EXACT:
            return
        most, gram = self.tables[n][-1], packed + np.uint32(1)
        new = np.flatnonzero(most[buckets] < gram)
        np.maximum.at(most, buckets[new], gram[new])

    def slices(self):
        """(slot, places, counts) of what is not 0, packed; places is None for a slice of which much is not. Slots number the slices of all tables."""
        for n, table in enumerate(self.tables):
            for c, counts in enumerate(table):
                for i, part in enumerate(np.split(counts, 1 if n == 0 else SLICES) if counts is not None else ()):
                    at = np.flatnonzero(part)
                    slot = (n * len(table) + c) * SLICES + i
                    if 8 * len(at) < len(part):
                        if len(at):
                            yield slot, _packed_bytes(at.astype(np.uint32)), _packed_bytes(part[at])
                    else:
                        yield slot, None, _packed_bytes(part)
        yield -1, None, _packed_bytes(self.total)

    def merge(self, slot: int, at: bytes | None, data: bytes) -> None:
        if slot < 0:
            self.total += _unpacked(data, np.int64)
            return
        (n, c), i = divmod(slot // SLICES, len(KINDS) + 2), slot % SLICES
        whole = self.table(n, c)
        size = len(whole) // (1 if n == 0 else SLICES)
        _join(whole[i * size : (i + 1) * size], slot, at, data)


def _packed_bytes(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


#: Slices of a table, which are added up apart from each other.
SLICES = 16


def _join(into: np.ndarray, slot: int, at: bytes | None, data: bytes) -> None:
    """Adds a slice's counts up; of n-grams the greatest stays."""
    greatest = slot >= 0 and slot // SLICES % (len(KINDS) + 2) == len(KINDS) + 1
    values = _unpacked(data, np.uint32 if greatest else np.int64)
    place = slice(None) if at is None else _unpacked(at, np.uint32)
    # places of a slice are distinct
    into[place] = np.maximum(into[place], values) if greatest else into[place] + values


def _slice_of(slot: int) -> np.ndarray:
    """An empty slice of a slot."""
    n, c = divmod(slot // SLICES, len(KINDS) + 2)
    size = 2 if slot < 0 else SIZES[n] // (1 if n == 0 else SLICES)
    return np.zeros(size, dtype=np.uint32 if slot >= 0 and c == len(KINDS) + 1 else np.int64)


@lru_cache(maxsize=1)
def _seeds() -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each kind the symbols of its training texts, the places that count, and their weight: each kind weighs as much as 20,000 characters."""
    glue = "\n" * ORDER
    out = []
    for part in (FILLER, NOTICES, [*SHELLS, *slots()]):
        symbols = _symbols(code_points([glue + glue.join(part) + glue])[0])
        out.append((symbols, np.arange(ORDER, len(symbols)), max(1.0, 20_000 / max(1, len(symbols) - ORDER))))
    return out


def _fit(tally: Tally, rows: int, found: Tally | None = None) -> Model:
    """Models from the training texts and the counts of that many documents.

    found: of the documents in which the model before found residue what they had taught
    the prose model, which is taken back, and their residue.
    """
    docs = rows * (tally.total[1] / PART / tally.total[0] if tally.total[0] else 1.0)
    scale = min(1.0, FIT_DOCS / max(1.0, docs))
    base = _Interpolated(DISCOUNT * docs * scale)
    residue, each = _Interpolated(), [_Interpolated() for _ in KINDS]
    ratio, by_kind = [], []
    for n, table in enumerate(tally.tables):
        prose = (table[0] - found.tables[n][0] if found else table[0]) * (scale / PART)
        kinds = [np.zeros(len(prose)) if not found or t is None else t * scale for t in (found or tally).tables[n][1:-1]]
        most = np.maximum(table[-1], found.tables[n][-1]) if found else table[-1].copy()
        for k, (symbols, at, weight) in enumerate(_seeds()):
            packed = _packed(symbols)[n][at]
            buckets = _bucket(packed, n)
            kinds[k] += np.bincount(buckets, minlength=len(prose)) * weight
            np.maximum.at(most, buckets, packed + np.uint32(1))
        every = sum(kinds)
        known = np.arange(64) if n == 0 else np.flatnonzero((prose > 0) | (every > 0))
        shorter = context = None
        if n:
            gram = known.astype(np.uint32) if n < EXACT else most[known] - np.uint32(1)
            shorter, context = _bucket(gram & np.uint32((1 << 6 * n) - 1), n - 1), _bucket(gram >> np.uint32(6), n - 1)
        plain = base.extend(prose, known, shorter, context)
        r = np.full(len(prose), _MISS, dtype=np.float16)
        r[known] = np.clip(residue.extend(every, known, shorter, context) - plain, -CLIP, CLIP)
        b = np.full((len(prose), len(KINDS)), _MISS, dtype=np.float16)
        for k, model in enumerate(each):
            b[known, k] = np.clip(model.extend(kinds[k], known, shorter, context) - plain, -CLIP, CLIP)
        ratio.append(r)
        by_kind.append(b)
    return Model(ratio, by_kind)


def _marked(scores: np.ndarray, starts: np.ndarray, windows: tuple = WINDOWS) -> np.ndarray:
    """Whether each character lies in a residue window; windows stay within their text."""
    n = len(scores)
    sums = np.zeros(n + 1)
    sums[1:] = scores
    np.cumsum(sums, out=sums)
    room = np.empty(n + 1)
    cover = np.zeros(n + 1, dtype=np.int32)
    for width, least in windows:
        if n < width:
            continue
        hit = np.flatnonzero(np.subtract(sums[width:], sums[:-width], out=room[: n + 1 - width]) >= least)
        if len(hit):
            text = np.searchsorted(starts, hit, side="right")
            hit = hit[hit + width <= starts[text]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + width, -1)
    inside = np.cumsum(cover[:-1], dtype=np.int32) > 0
    # starts holds the end of each text; texts shorter than any window count as a whole
    begins = np.concatenate([[0], starts[:-1]])
    sizes = starts - begins
    short = np.flatnonzero((sizes > 0) & (sizes < min(w for w, _ in windows)))
    short = short[sums[starts[short]] - sums[begins[short]] >= SHORT_MEAN * sizes[short]] if windows is WINDOWS else short[:0]
    # of each stretch of windows, the parts with the greatest sums are residue
    least = min(x for _, x in windows)
    out = np.zeros(n, dtype=bool)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    todo = list(zip(edges[::2], edges[1::2], strict=True))
    while todo:
        a, b = todo.pop()
        part = sums[a : b + 1]
        rise = part - np.minimum.accumulate(part)
        end = int(rise.argmax())
        if rise[end] < least or end == 0:
            continue
        begin = int(part[: end + 1].argmin())
        out[a + begin : a + end] = True
        todo += [(a, a + begin), (a + end, b)]
    for t in short:
        out[begins[t] : starts[t]] = True
    return out


def _whole_words(marked: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spans widened to words of which they hold at least half."""
    blank = (symbols == _alphabet()[32]) | (symbols == _alphabet()[10])
    edge = ~blank
    edge[1:] &= blank[:-1]
    edge[starts[:-1][starts[:-1] < len(symbols)]] = True
    word = np.cumsum(edge)
    ink = np.bincount(word, weights=~blank)
    hit = np.bincount(word, weights=marked & ~blank, minlength=len(ink))
    return marked | (~blank & (2 * hit >= np.maximum(ink, 1))[word])


def _glued(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, starts = code_points(["\n" * ORDER + t for t in texts])
    return _symbols(codes), starts


def _lesson(symbols: np.ndarray, starts: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Which characters teach the prose model: those of texts that hold no training text."""
    prose = np.repeat(~_quoting(symbols, starts, rolling), np.diff(starts))
    # of the lines before a text the last alone counts, as n-grams of the others reach into the text before
    prose[(starts[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
    return prose


def _count(tally: Tally, texts: list[str], repeated: Repeats) -> None:
    """Adds the texts to the tally as prose."""
    symbols, starts = _glued(texts)
    rolling = Rolling(symbols)
    tally.add(symbols, repeated.weights(symbols, starts, rolling), _lesson(symbols, starts, rolling), [])


def _found_in(texts: list[str], model: Model, turn: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None:
    """Of the texts in which the model finds residue the symbols, where each begins, and the places of residue by kind; None if there is none."""
    symbols, starts = _glued(texts)
    scores, longest = model.score(symbols)
    # no window runs over the lines between texts, so a text's neighbours do not matter
    scores[(starts[:-1, None] + np.arange(ORDER)).ravel()] = -1000
    at = np.flatnonzero(_marked(scores, starts[1:], FIRST if turn == 1 else WINDOWS))
    if not len(at):
        return None
    # spans end with their text
    doc = np.searchsorted(starts, at, side="right") - 1
    spans = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(doc, prepend=-1) > 0))
    sums = np.add.reduceat(model.by_kind(longest, at), spans, axis=0)
    kind = np.repeat(sums.argmax(axis=1), np.diff(np.append(spans, len(at))))
    found = [at[kind == k] for k in range(len(KINDS))]
    if turn > 1:
        found[0] = np.union1d(found[0], _following(symbols, scores, found[0], starts))
    bad = np.unique(doc)
    begins = np.concatenate([[0], np.cumsum(np.diff(starts)[bad])])
    symbols = np.concatenate([symbols[starts[d] : starts[d + 1]] for d in bad])
    moved = begins[:-1] - starts[bad]
    return symbols, begins, [f + moved[np.searchsorted(bad, np.searchsorted(starts, f, side="right") - 1)] for f in found]


def _count_found(tally: Tally, held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], repeated: Repeats) -> None:
    """Adds texts with residue: what they teach as prose, and their residue."""
    offsets = np.cumsum([0, *(len(s) for s, _, _ in held)])
    symbols = np.concatenate([s for s, _, _ in held])
    starts = np.concatenate([[0], *(b[1:] + o for (_, b, _), o in zip(held, offsets, strict=False))])
    found = [np.concatenate([f[k] + o for (_, _, f), o in zip(held, offsets, strict=False)]) for k in range(len(KINDS))]
    rolling = Rolling(symbols)
    tally.add(symbols, repeated.weights(symbols, starts, rolling), _lesson(symbols, starts, rolling), found)


def _rounds(counted, rows: int) -> Model:
    """The model of the last round; counted gives the tally of all documents, or of those in which a model finds residue."""
    whole = counted(None, 0)
    model = _fit(whole, rows)
    for turn in range(1, ROUNDS):
        model = _fit(whole, rows, counted(model, turn))
    return model


def _parts(texts: list[str], limit: int):
    for _, _, part in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text", limit):
        if part := [t for t in part if t]:
            yield part


def _tallied(parts, repeated: Repeats, model: Model | None, turn: int) -> Tally:
    tally = Tally()
    held, size = [], 0
    for part in parts:
        if model is None:
            _count(tally, part, repeated)
        elif found := _found_in(part, model, turn):
            # few texts have residue, so those of many parts are counted together
            held.append(found)
            size += len(found[0])
            if size >= FIT_CHARS:
                _count_found(tally, held, repeated)
                held, size = [], 0
    if held:
        _count_found(tally, held, repeated)
    return tally


def fit(texts: list[str]) -> Model:
    """Models from the training texts and these documents; see the module's text."""
    repeated = _repeats(texts)
    return _rounds(lambda model, turn: _tallied(_parts(texts, SCAN_CHARS if model else FIT_CHARS), repeated, model, turn), len(texts))


def _record(slot: int, at: bytes | None, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([at], pa.binary()), pa.array([data], pa.binary())], names=["slot", "places", "counts"])


def fit_table(docs: DataFrame, text: str) -> Model:
    """The same from all documents of a table; each round reads it once, on at most two tasks a core."""
    context = docs.sparkSession.sparkContext
    rows = docs.where(F.length(text) > 0).count()
    source = docs.select(F.col(text).cast("string").alias("text")).where(F.length("text") > 0).coalesce(2 * context.defaultParallelism)
    repeated = context.broadcast(repeats(docs, text, rows))

    def counted(model: Model | None, turn: int) -> Tally:
        before = context.broadcast(model)

        def count(batches):
            model = before.value
            parts = (texts for batch in batches for _, _, texts in chunks(batch, "text", SCAN_CHARS if model else FIT_CHARS))
            for row in _tallied(parts, repeated.value, model, turn).slices():
                yield _record(*row)

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for slot, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _join(sums.setdefault(slot, _slice_of(slot)), slot, at, data)
            for slot, part in sums.items():
                yield _record(slot, None, _packed_bytes(part))

        form = "slot int, places binary, counts binary"
        out = Tally()
        for slot, at, data in source.mapInArrow(count, form).repartition("slot").mapInArrow(add, form).toLocalIterator():
            out.merge(slot, at and bytes(at), bytes(data))
        before.destroy()
        return out

    model = _rounds(counted, rows)
    repeated.destroy()
    return model


def _following(symbols: np.ndarray, scores: np.ndarray, filler: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of the sentences that go on after found filler and that prose does not explain better.

    Filler begins with well-known words and goes on with made-up ones, which only this way
    reach the model of filler.
    """
    if not len(filler):
        return filler
    stops = np.flatnonzero((symbols == _alphabet()[ord(".")]) | (symbols == _alphabet()[10]))
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
    out = []
    for end in filler[np.flatnonzero(np.diff(filler, append=filler[-1] + 9) > 1)] + 1:
        last = docs[np.searchsorted(docs, end - 1, side="right")]
        while end < last:
            k = np.searchsorted(stops, end)
            stop = min(last, (stops[k] + 1) if k < len(stops) else last)
            if stop - end > 3 and sums[stop] - sums[end] < SPREAD * (stop - end):
                break
            out.append(np.arange(end, stop))
            end = stop
    return np.concatenate(out) if out else filler[:0]


#: In the first round the prose model still knows residue, so ratios are near 0 where both models know a text.
FIRST = ((32, -1.0), (48, -2.0))


def find_residue(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Residue of each document: (key, n_chars, residue_chars, coverage, near_coverage, kind, first_start, first_text).

    Every row of docs gives one row, also without residue (residue_chars 0, kind null).
    Null and empty texts have n_chars 0 and coverage 0. coverage is the share of the text,
    near_coverage that of its most covered window of NEAR characters. kind is that of most residue
    characters; first_start and first_text show the first span. Rows with equal keys stay
    separate rows, null keys too; other columns of docs are not read.
    """
    spark = docs.sparkSession
    if model is None:
        model = fit_table(docs, text)
    shared = spark.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ("n_chars", "residue_chars", "coverage", "near_coverage", "kind", "first_start", "first_text")

    def scan(batches):
        m = shared.value
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, texts in chunks(batch, "text", SCAN_CHARS):
                codes, starts = code_points(texts)
                rows = hi - lo
                out = {"n_chars": np.diff(starts), "residue_chars": np.zeros(rows, dtype=np.int64)}
                kind, start, first, near = [None] * rows, [None] * rows, [None] * rows, np.zeros(rows)
                if len(codes):
                    scores, longest, symbols = m.score_each(texts)
                    marked = _marked(scores, starts[1:])
                    at = np.flatnonzero(_whole_words(marked, symbols, starts)) if marked.any() else np.zeros(0, np.int64)
                    if len(at):
                        upto = np.zeros(len(codes) + 1, dtype=np.int64)
                        upto[at + 1] = 1
                        upto = np.cumsum(upto)
                        row = np.searchsorted(starts, at, side="right") - 1
                        out["residue_chars"] = np.bincount(row, minlength=rows)
                        heads = np.flatnonzero(np.diff(row, prepend=-1) != 0)
                        kinds = np.add.reduceat(m.by_kind(longest, at), heads, axis=0).argmax(axis=1)
                        ends = np.append(heads[1:], len(at))
                        for h, e, k in zip(heads, ends, kinds, strict=True):
                            r = row[h]
                            a, b = starts[r], starts[r + 1]
                            wide = min(NEAR, b - a)
                            near[r] = (upto[a + wide : b + 1] - upto[a : b - wide + 1]).max() / wide
                            stop = h + 1
                            while stop < e and at[stop] - at[stop - 1] <= 2:
                                stop += 1
                            kind[r], start[r] = KINDS[k], int(at[h] - starts[r])
                            first[r] = texts[r][start[r] : int(at[stop - 1] - starts[r]) + 1]
                n = np.maximum(out["n_chars"], 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, rows), pa.array(out["n_chars"]), pa.array(out["residue_chars"]), pa.array(out["residue_chars"] / n), pa.array(near), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(first, pa.string())],
                    names=["key", *names],
                )

    kind_of = key_type.simpleString()
    found = source.mapInArrow(scan, f"key {kind_of}, n_chars bigint, residue_chars bigint, coverage double, near_coverage double, kind string, first_start bigint, first_text string")
    return found.withColumnRenamed("key", key)


def excluded(found: DataFrame, min_coverage: float = MIN_COVERAGE, min_near: dict[str, float] = MIN_NEAR) -> DataFrame:
    """The documents to exclude: residue covers at least this share of the text, or of its most covered window by kind."""
    least = F.lit(max(min_near.values()))
    for kind, share in min_near.items():
        least = F.when(F.col("kind") == kind, F.lit(share)).otherwise(least)
    return found.where((F.col("residue_chars") > 0) & ((F.col("coverage") >= min_coverage) | (F.col("near_coverage") >= least)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excluded(find_residue(table(spark, sf_dir, "documents"))).select("doc_id").distinct()


def p8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's residue with its coverage, kind and first span."""
    return find_residue(table(spark, sf_dir, "documents"))
