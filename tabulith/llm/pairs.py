"""Broken prompt and response pairs (problem 1).

Method: for every defect several noisy labelling functions vote on a pair (1 defect, 0
none, -1 no opinion); an expectation-maximisation label model estimates how reliable each
function is and gives the posterior of the defect for every pattern of votes. A pair gets
each defect whose posterior exceeds the defect's cutoff, so several where several hold;
cutoffs are validated on all sound pairs of the data, into which defects are planted. No
function of one defect looks at another defect, and planted defects are made by other
means than the functions use.

Votes are computed once per distinct pair of a batch, patterns are counted on all pairs,
and the model is fitted to the counts of patterns, whose number is bounded by the functions
and not by the data.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.languages import foreign_letters, language_of, other_language_run, speaks, words_of
from tabulith.llm.lookalikes import Forms, forms
from tabulith.session import cut, table

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Sound claims of a language of which one is planted as a foreign text, on average.
DONATED = 4
#: Share of a claim's words that stand in its original, from which the two can be compared in length and ending.
ON_SUBJECT = 0.35
#: Cutoffs that are tried.
CUTOFFS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))

# Wording that the labelling functions look for; common usage, not taken from any table.
NOTHING = {
    "none", "null", "nil", "nan", "na", "n a", "n.a", "n/a", "nothing", "empty", "blank", "undefined", "no answer", "no response", "no claim", "no statement", "no text", "no output", "not available",
    "not applicable", "missing", "unknown", "void", "tbd", "todo", "no data", "no content", "placeholder", "keine", "aucun", "ninguno", "nessuno", "nenhum", "brak", "нет",
}
OPEN_WORDS = set(
    "a an the of in on at by to from with without for and or but nor while whereas although because since than as vs versus against between among after before during under over near into per that which who whose was were is are be been being had has have not no"
    " der die das des dem den ein eine einer von vom mit ohne für und oder um im am an auf bei nach unter über wurden wurde la le les du un une et ou dans sur par pour avec sous el los las del y o en con por para il lo gli di della dei nel con da per e os as do na em com w z na i".split()
)
CANNOT = re.compile(
    r"\b(?:i|we|this (?:model|assistant)|the assistant)\b[^.]{0,40}?\b(?:cannot|can not|can't|can’t|won't|won’t|will not|unable|not able|declin\w*|refus\w*|must refrain|not comfortable|couldn't|could not|am not permitted|not allowed)\b"
    r"|\b(?:unable|not able|not allowed|not permitted) to (?:help|assist|comply|answer|fulfil|do|provide|produce)|\bnot possible for (?:me|us)\b|\bno \w+ (?:can|could|will) be (?:given|made|provided|produced|offered)"
    r"|\b(?:cannot|can't|can not|could not|will not|won't) be (?:changed|rewritten|rephrased|reworded|altered|provided|done)\b|\bagainst (?:my|our) (?:policy|policies|guidelines|rules)"
    r"|\bich kann [^.]{0,40}\bnicht\b|\bje ne (?:peux|suis) pas\b|\bno puedo\b|\bnon posso\b|\bnão posso\b|\bnie mogę\b|\bя не могу\b|\bik kan (?:dit|deze|niet)\b",
    re.I,
)
REGRET = re.compile(r"^\W*(?:(?:i(?:'|’)?m|i am|we(?:'|’)?re|we are)? ?(?:very |so |really )?sorry|(?:my |our )?apologies|(?:i|we) (?:must )?apologi[sz]e|unfortunately|with regret|regrettably|as an? (?:[a-z]+ ){0,3}(?:ai|model|assistant|chatbot)\b|es tut mir leid|leider|(?:je suis )?désolé|lo siento|mi dispiace|desculpe|przykro mi|przepraszam|к сожалению|het spijt me)", re.I)
TASK = re.compile(r"\b(?:re-?writ\w*|re-?phras\w*|re-?word\w*|paraphras\w*|(?:this|your|the) (?:request|sentence|statement|text|task|instruction|question|prompt)|help with|as an? (?:[a-z]+ )?(?:ai|assistant)|guidelines|policy)\b", re.I)
LEAD = re.compile(r"^\s*(?:[\w’'-]+\s+){0,4}[\w’'-]+\s*[:：]\s*(?=\S)")
BROKEN_OFF = re.compile(r"(?:…|\.\.\.+|\[\s*(?:…|\.\.\.)\s*\]|-)\s*[\"'”’»)]*\s*$")
ABBREVIATED = re.compile(r"\b(?:vs|ca|bzw|approx|e\.g|i\.e|no|n|p)\.\s*$", re.I)
WORDS = re.compile(r"[^\W_]+(?:[.,]\d+)*(?:[-'’/][^\W_]+)*")
QUOTING = re.compile(r"(?<=[.!?])\s+[\"“«„][^\"”»“]*[\"”»“]?$")
STOP = re.compile(r"[.!?。؟]\s*[\"'”’»)\]]*\s*$")
# End of fixed values.


def words(text: str) -> list[str]:
    return WORDS.findall(text)


def bare(plain: str) -> str:
    """A canonical text without enclosing quotes and final stop."""
    while True:
        out = re.sub(r"[\s.。]+$", "", plain.strip(" \"'“”‘’«»„‚`*_"))
        if out == plain:
            return out
        plain = out


class Origin:
    """What the functions need of an original claim, made once for each."""

    def __init__(self, text: str, made_by: Forms):
        self.plain = made_by.canonical(text)
        self.bare = {bare(self.plain), bare(LEAD.sub("", self.plain, count=1))}
        self.words = words(self.plain)
        self.known = frozenset(self.words)
        self.starts = {w[:i] for w in self.known for i in range(1, len(w))}
        self.written = words_of(text)
        self.spoken = language_of(self.written)
        self.letters = foreign_letters(self.written, lambda t: False)


def votes(origin: Origin, claim: str, made_by: Forms) -> dict[str, list[int]]:
    """Votes of every labelling function, by defect. No vote depends on another defect's."""
    text, seen = made_by.canonical(claim), made_by.visible(claim).rstrip()
    mine, stripped, known = words(text), bare(text), origin.known
    unled = LEAD.sub("", text, count=1)
    shared = sum(w in known for w in mine)
    overlap = shared / len(mine) if mine else 0.0
    content = re.sub(r"[^\w/ .]", "", text).strip(" ._/")
    empty = [
        int(not mine),
        int(len(mine) <= 3 and (content in NOTHING or stripped in NOTHING)),
        1 if len(mine) <= 1 and len(text) <= 12 else 0 if len(mine) >= 4 else -1,
        0 if shared >= 2 else 1 if len(mine) <= 3 else -1,
    ]
    # truncation: the final mark, signs of breaking off, the last word, brackets, length, the end of the original, its subject
    # (a quotation after a whole sentence is not the response's own text, so its end is not looked at)
    said = QUOTING.sub("", seen)
    size, own_words = len(text), mine
    if said != seen:
        seen = said
        own_text = made_by.canonical(said)
        size, own_words = len(own_text), words(own_text)
        overlap = sum(w in known for w in own_words) / max(1, len(own_words))
    end = own_words[-1] if len(own_words) > 1 else ""
    open_mark = seen.endswith((",", ";", ":", "(", "±", "=", "<", "–", "/"))
    truncated = [
        -1 if not end else 0 if STOP.search(seen) and not BROKEN_OFF.search(seen) and not ABBREVIATED.search(seen) else 1,
        -1 if not end else int(bool(BROKEN_OFF.search(seen))),
        -1 if not end else int(end in OPEN_WORDS or open_mark),
        -1 if not end else 0 if end in known else 1 if end in origin.starts else -1,
        -1 if not end else int(seen.count("(") > seen.count(")") or seen.count("[") > seen.count("]")),
        -1 if not end or overlap < ON_SUBJECT else 1 if size < 0.5 * len(origin.plain) else 0 if size > 0.85 * len(origin.plain) else -1,
        -1 if not end or overlap < ON_SUBJECT else int(end != origin.words[-1]),
        -1 if not end else int(overlap >= ON_SUBJECT),
    ]
    # refusals: wording, opening, talk about the task, distance from the original before any quotation
    head = words(re.split("[\"“«„]", unled)[0])
    near = sum(w in known for w in head) / len(head) if head else 0.0
    refusal = [
        int(bool(CANNOT.search(unled)) and not CANNOT.search(origin.plain)),
        int(bool(REGRET.search(unled)) and not REGRET.search(origin.plain)),
        1 if TASK.search(unled) and not TASK.search(origin.plain) else 0,
        -1 if len(head) < 3 else 1 if near < 0.4 else 0 if near > 0.6 else -1,
    ]
    # copies: the same text, letters, words and set of words once dressing is gone
    dressed = bare(unled)
    flat = lambda s: re.sub(r"[\W_]+", "", s)
    ending = words(dressed)
    copy = [
        int(bool(mine) and (stripped in origin.bare or dressed in origin.bare)),
        int(bool(mine) and flat(dressed if len(dressed) >= len(origin.plain) // 2 else stripped) in {flat(b) for b in origin.bare}),
        int(bool(mine) and (mine == origin.words or ending == origin.words)),
        0 if len(known) > len(set(mine)) or len(set(ending) - known) > 0 else 1,
    ]
    # other languages: of all new words, of a run of them, of the script, closed-class words of the own language; what shares nothing is no translation
    written = words_of(claim)
    heard = lambda t: (t if t.isascii() else made_by.canonical(t)) in known
    new = [t for t in written if not heard(t)]
    own = sum(speaks(t, origin.spoken) for t in new)
    told = language_of(new)
    alien = other_language_run(written, heard, origin.spoken) if origin.spoken else -1
    mixed = any(n >= 4 and script not in origin.letters for script, n in foreign_letters(written, heard).items())
    language = [
        -1 if not told or not origin.spoken else int(told != origin.spoken),
        -1 if alien < 0 else 1 if alien >= 3 else 0 if alien <= 1 else -1,
        int(mixed),
        0 if len(new) <= 2 or own >= 2 else 1 if len(new) >= 4 and own == 0 and origin.spoken else -1,
        -1 if len(mine) < 4 else int(shared > 0),
    ]
    return {"empty": empty, "truncated": truncated, "refusal": refusal, "copy": copy, "language": language}


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each pattern of votes, by expectation-maximisation.

    Functions are taken as independent given the truth. Each has a probability of voting 1
    under either truth, starting from functions that are right more often than not; no
    opinion is no evidence. A function is never taken to vote 1 more often on sound pairs
    than on broken ones, which also settles which of the two classes is the defect. Counts
    are smoothed, so patterns that never occur have posteriors too.
    """
    if not patterns:
        return {}
    seen = list(patterns)
    count = np.array([patterns[p] for p in seen], dtype=float)
    v = np.array(seen)
    width = v.shape[1]
    prior = 0.05
    sound, broken = np.full(width, 0.1), np.full(width, 0.8)
    weight = max(10.0, 0.01 * count.sum())
    for _ in range(rounds):
        post = _posterior(v, prior, sound, broken)
        prior = float(np.clip((count @ post + 0.5) / (count.sum() + 10), 1e-4, 0.5))
        for j in range(width):
            yes, said = v[:, j] == 1, v[:, j] >= 0
            sound[j] = (count[yes] @ (1 - post[yes]) + weight * 0.1) / (count[said] @ (1 - post[said]) + weight)
            broken[j] = (count[yes] @ post[yes] + weight * 0.08) / (count[said] @ post[said] + weight * 0.1)
            if broken[j] < sound[j]:
                sound[j] = broken[j] = count[yes].sum() / max(1.0, count[said].sum())
        sound, broken = np.clip(sound, 1e-4, 1 - 1e-4), np.clip(broken, 1e-4, 1 - 1e-4)
    whole = np.array(list(itertools.product((-1, 0, 1), repeat=width))) if width <= 5 else v
    return {tuple(int(x) for x in p): float(q) for p, q in zip(whole, _posterior(whole, prior, sound, broken), strict=True)}


def _posterior(v: np.ndarray, prior: float, sound: np.ndarray, broken: np.ndarray) -> np.ndarray:
    gain = (v == 1) @ (np.log(broken) - np.log(sound)) + (v == 0) @ (np.log(1 - broken) - np.log(1 - sound))
    return 1 / (1 + np.exp(np.clip(np.log(1 - prior) - np.log(prior) - gain, -500, 500)))


def plant(original: str, claim: str, i: int, foreign: str) -> list[tuple[str | None, str]]:
    """A sound pair's claim with each defect planted, and sound variants (defect None).

    Defects come from elsewhere than the functions' word lists: text cut at any character,
    marks of any kind, the original in varied dressing, a text in another language from the
    data (foreign; none if ''), and ways of declining that use other words.
    """
    at = max(8, len(claim) * (2 + i % 6) // 9)
    declined = ("That is something I would rather leave as it is.", "Changing these words is beyond what I may do.", "Sorry, I can't do that.", "I don't think I should alter this; please ask someone else.", "My instructions keep me from doing this, so I will not.", "I am afraid I can't help here.")
    marks = ("", " ", "—", "···", "( )", "//", "?", "\u200b", "_", "*")
    dressed = (original, original.swapcase(), f"“{original}”", f"Answer - final: {original}", original.rstrip("."), f"  {original}  ", original.replace(" ", "\u00a0"))
    out: list[tuple[str | None, str]] = [
        ("empty", marks[i % len(marks)]),
        ("truncated", claim[:at].rstrip() if not claim[:at].rstrip().endswith(".") else claim[: at - 3]),
        ("refusal", declined[i % len(declined)]),
        ("copy", dressed[i % len(dressed)]),
        (None, claim),
        (None, claim.rstrip(".")),
    ]
    if foreign:
        out.append(("language", foreign if i % 2 else " ".join(claim.split()[:4]) + " " + foreign))
    return out


def _planted(sound: DataFrame, made_by: Forms) -> DataFrame:
    """(defect, pattern, planted, n): how many texts planted into all sound pairs have a pattern, and whether with that defect.

    sound: (original, claim, spoken, own), distinct, with the languages of the claim and the original. Foreign texts
    are claims of another language in the data, one for each DONATED of them; where that leaves none, none is planted.
    """
    numbered = sound.withColumn("i", F.pmod(F.xxhash64("original", "claim"), F.lit(2**31)))
    languages = {r["spoken"]: max(1, r["count"] // DONATED) for r in sound.where("spoken != ''").groupBy("spoken").count().collect()}
    if languages:
        buckets = F.create_map(*(F.lit(x) for pair in sorted(languages.items()) for x in pair))
        at = lambda language, salt: F.pmod(F.xxhash64("original", "claim", F.lit(salt)), F.element_at(buckets, language))
        others = F.filter(F.array(*(F.lit(x) for x in sorted(languages))), lambda x: x != F.col("own"))
        donors = numbered.where("spoken != ''").groupBy("spoken", at(F.col("spoken"), 1).alias("bucket")).agg(F.min_by("claim", F.struct("i", "claim")).alias("foreign"))
        asked = numbered.withColumn("language", F.when((F.col("own") != "") & (F.size(others) > 0), F.get(others, F.pmod(F.col("i"), F.size(others)).cast("int"))))
        asked = asked.withColumn("bucket", at(F.col("language"), 2)).drop("spoken")
        numbered = asked.join(donors.withColumnRenamed("spoken", "language"), ["language", "bucket"], "left")
    else:
        numbered = numbered.withColumn("foreign", F.lit(None).cast("string"))

    def plant_all(batches):
        for batch in batches:
            counts: dict[tuple[str, str, bool], int] = {}
            for original, claim, i, foreign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                origin = Origin(original, made_by)
                for planted, text in plant(original, claim or "", i, foreign or ""):
                    for d, v in votes(origin, text, made_by).items():
                        at = d, ",".join(map(str, v)), planted == d
                        counts[at] = counts.get(at, 0) + 1
            defect, pattern, hit = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(defect, pa.string()), pa.array(pattern, pa.string()), pa.array(hit, pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["defect", "pattern", "planted", "n"])

    # votes take far longer than their few bytes suggest, so tasks are not merged by size
    tasks = max(2 * sound.sparkSession.sparkContext.defaultParallelism, int(sound.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = numbered.select("original", "claim", "i", "foreign").repartition(tasks).mapInArrow(plant_all, "defect string, pattern string, planted boolean, n bigint")
    return made.groupBy("defect", "pattern", "planted").agg(F.sum("n").alias("n"))


def _cutoffs(counts: list[tuple[str, str, bool, int]], models: dict[str, dict]) -> dict[str, float]:
    """Per defect the cutoff with the best F1 on planted pairs; the middle one of equals. Without planted pairs 0.5."""
    scored: dict[str, list[tuple[float, bool, int]]] = {d: [] for d in DEFECTS}
    for d, pattern, planted, n in counts:
        scored[d].append((models[d].get(tuple(map(int, pattern.split(","))), 0.0), planted, n))
    out = {}
    for d, rows in scored.items():
        best = []
        for c in CUTOFFS:
            tp = sum(n for p, t, n in rows if p > c and t)
            fp = sum(n for p, t, n in rows if p > c and not t)
            fn = sum(n for p, t, n in rows if p <= c and t)
            best.append((2 * tp / max(1, 2 * tp + fp + fn), c))
        top = max(b[0] for b in best)
        ties = [c for f, c in best if f == top]
        out[d] = ties[len(ties) // 2] if any(t for _, t, _ in rows) else 0.5
    return out


def broken_pairs(pairs: DataFrame, key: str, original: str, claim: str) -> DataFrame:
    """Defects as (key, defect, posterior, cutoff); a pair with several defects gives several rows.

    Null texts count as empty ones; a pair without an original is judged by its claim
    alone. Equal rows give equal labels, and keys may repeat or be null. Other columns
    of pairs are not read. An empty table gives no rows. Functions that need to know the
    original's language abstain where it has too few closed-class words to tell.
    """
    source = pairs.select(F.col(key).alias("key"), F.col(original).cast("string").alias("original"), F.col(claim).cast("string").alias("claim"))
    kind = source.schema["key"].dataType.simpleString()
    made_by = forms()

    def vote(batches):
        for batch in batches:
            originals, cast, seen = {}, [], {}
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (a, b) not in seen:
                    if a not in originals:
                        originals[a] = Origin(a or "", made_by)
                    v = votes(originals[a], b or "", made_by)
                    seen[a, b] = [*(",".join(map(str, v[d])) for d in DEFECTS), language_of(words_of(b or "")) or "", originals[a].spoken or ""]
                cast.append(seen[a, b])
            columns = [pa.array(c, pa.string()) for c in zip(*cast, strict=True)] if cast else [pa.array([], pa.string())] * (len(DEFECTS) + 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["key", "original", "claim", *DEFECTS, "spoken", "own"])

    voted = source.mapInArrow(vote, f"key {kind}, original string, claim string, " + ", ".join(f"{d} string" for d in (*DEFECTS, "spoken", "own")))
    voted = cut(voted)
    counts = voted.select(F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("v")).groupBy("v.defect", "v.pattern").count().collect()
    patterns: dict[str, dict] = {d: {} for d in DEFECTS}
    for r in counts:
        patterns[r["defect"]][tuple(map(int, r["pattern"].split(",")))] = r["count"]
    models = {d: label_model(p) for d, p in patterns.items()}
    # all sound pairs validate: those whose posteriors are low for every defect
    sound = voted.where(F.length("original") > 40)
    for d in DEFECTS:
        sound = sound.where(F.col(d).isin([",".join(map(str, p)) for p in patterns[d] if models[d][p] < 0.05]))
    sound = cut(sound.select("original", "claim", "spoken", "own").distinct())
    cutoffs = _cutoffs([tuple(r) for r in _planted(sound, made_by).collect()], models)
    spark = pairs.sparkSession
    found = [(d, ",".join(map(str, p)), models[d][p], cutoffs[d]) for d in DEFECTS for p in patterns[d] if models[d][p] > cutoffs[d]]
    chosen = spark.createDataFrame(found, "defect string, pattern string, posterior double, cutoff double")
    each = voted.select("key", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("v")).select("key", "v.defect", "v.pattern")
    return each.join(F.broadcast(chosen), ["defect", "pattern"]).select(F.col("key").alias(key), "defect", "posterior", "cutoff")


def rewrites(items: DataFrame) -> DataFrame:
    """Items made by rewriting a claim."""
    return items.where(F.col("mutation").endswith(" rewrite"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(rewrites(table(spark, sf_dir, "bench_items")), "item_no", "original_claim", "claim").select("item_no", "defect").distinct()


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defects with their posteriors and validated cutoffs."""
    return broken_pairs(rewrites(table(spark, sf_dir, "bench_items")), "item_no", "original_claim", "claim").distinct()
