"""Suggestions for flagged claims: word differences, gates for rewrites, new citations."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from tabulith.functions import numbers as N
from tabulith.operators import building as G

# Fixed values.
CANDIDATES = 3
SUBTLE_RATIO = 0.85
# End of fixed values.


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: the longest rising chain among the places at which words agree."""
    where: dict[str, list[int]] = {}
    for j, word in enumerate(b):
        where.setdefault(word, []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, word in enumerate(a):
        # from the right, so that no word of a is used twice
        for j in reversed(where.get(word, ())):
            k = bisect_left(ends, j)
            chain = (i, j, chains[k - 1] if k else None)
            ends[k : k + 1], chains[k : k + 1] = [j], [chain]
    out = []
    chain = chains[-1] if chains else None
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


def _diff(before: str, after: str) -> str:
    """Words of both texts in order, what only the first has in [-...-], what only the second has in {+...+}."""
    a, b = before.split(), after.split()
    out: list[str] = []
    i = j = 0
    for x, y in [*_common(a, b), (len(a), len(b))]:
        out += [f"[-{' '.join(a[i:x])}-]"] * (x > i) + [f"{{+{' '.join(b[j:y])}+}}"] * (y > j) + a[x : x + 1]
        i, j = x + 1, y + 1
    return " ".join(out)


@pandas_udf(StringType())
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Word difference of two texts; null if either is null."""
    return pd.Series([None if a is None or b is None else _diff(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


@pandas_udf(DoubleType())
def likeness(before: pd.Series, after: pd.Series) -> pd.Series:
    """Ratio of matching characters of two texts."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(before, after, strict=True)], dtype=float)


def same_numbers(before: Column, after: Column) -> Column:
    """Whether two texts hold the same numbers, each as often."""
    return F.array_sort(G.build_numbers(before)) == F.array_sort(G.build_numbers(after))


def rewrite_passes(claim: Column, rewrite: Column, source: Column) -> Column:
    """Whether a rewrite is new and all its informative numbers stand in the source."""
    return rewrite.isNotNull() & (F.trim(rewrite) != "") & (rewrite != claim) & (F.size(N.missing(rewrite, source)) == 0)


def overstatement_passes(original: Column, rewrite: Column, subtle: bool) -> Column:
    """Gate for made overstatements: changed wording, unchanged numbers, and for subtle ones a likeness of at least SUBTLE_RATIO."""
    ok = rewrite.isNotNull() & (rewrite != original) & same_numbers(original, rewrite)
    return ok & (likeness(original, rewrite) >= SUBTLE_RATIO) if subtle else ok


def citation_candidates(flagged: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, candidates): up to CANDIDATES other sections that hold every informative number of a claim.

    flagged: (key, claim, doc_id); places: (norm, doc_id, label), distinct. Sections of the
    cited document come first.
    """
    asked = flagged.select(key, "doc_id", F.array_distinct(F.transform(N.informative(F.col("claim")), lambda n: N.unsigned(n["norm"]))).alias("ns")).where(F.size("ns") > 0)
    met = asked.select(key, F.col("doc_id").alias("own"), F.size("ns").alias("n"), F.explode("ns").alias("norm")).join(places, "norm").groupBy(key, "own", "n", "doc_id", "label").agg(F.count("*").alias("held")).where("held = n")
    ranked = F.array_sort(F.collect_list(F.struct((F.col("doc_id") != F.col("own")).alias("other"), F.concat_ws(", ", "doc_id", "label").alias("place"))))
    return met.groupBy(key).agg(F.slice(ranked, 1, CANDIDATES).alias("c")).select(key, F.transform("c", lambda c: c["place"]).alias("candidates"))


def suggest_rewrites(flagged: DataFrame, key: str, ask, attempts: int = 2) -> DataFrame:
    """(key, rewrite, diff, note): a judge's rewrite of a flagged claim that passes the number gate.

    flagged: (key, claim, source). A claim without a passing rewrite has a null one and a note.
    """
    from tabulith.session import cut

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, claim, source in zip(b["k"], b["claim"], b["source"], strict=True):
                tries = []
                for _ in range(attempts):
                    try:
                        tries.append((ask(f"Rewrite the claim so that the source supports it.\nClaim: {claim}\nSource: {source}") or "").strip())
                    except Exception:  # noqa: BLE001
                        tries.append("")
                out.append((k, claim, source, tries))
            yield pd.DataFrame(out, columns=["k", "claim", "source", "tries"])

    kind = flagged.schema[key].dataType.simpleString()
    asked = cut(flagged.select(F.col(key).alias("k"), "claim", "source").mapInPandas(run, f"k {kind}, claim string, source string, tries array<string>"))
    gated = asked.withColumn("rewrite", F.get(F.filter("tries", lambda t: rewrite_passes(F.col("claim"), t, F.col("source"))), F.lit(0)))
    return gated.select(F.col("k").alias(key), "rewrite", word_diff(F.col("claim"), F.col("rewrite")).alias("diff"), F.when(F.col("rewrite").isNull(), F.lit("no rewrite passed the number gate")).otherwise(F.lit("")).alias("note"))


def cached_rewrites(claims: DataFrame, cache: DataFrame, ask, again: bool = False) -> DataFrame:
    """The cache (style, claim, rewrite) with all wanted claims: only new ones are asked for, each once; no rewrite is kept as null.

    claims: (style, claim). again: ask for claims whose kept rewrite is null, too.
    """
    from tabulith.session import cut

    kept = cache.where("rewrite is not null") if again else cache
    todo = claims.select("style", "claim").where("claim is not null").distinct().join(kept.select("style", "claim"), ["style", "claim"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for style, claim in zip(b["style"], b["claim"], strict=True):
                try:
                    out.append((style, claim, (ask(style, claim) or "").strip() or None))
                except Exception:  # noqa: BLE001
                    out.append((style, claim, None))
            yield pd.DataFrame(out, columns=["style", "claim", "rewrite"])

    return kept.select("style", "claim", "rewrite").unionByName(cut(todo.mapInPandas(run, "style string, claim string, rewrite string")))


def suggest_fixes(flagged: DataFrame, places: DataFrame, key: str, rewrite, recheck) -> DataFrame:
    """(key, text, citation, candidates, note): for each flagged claim a moved citation or new wording that a second check supports.

    flagged: (key, claim, citation, doc_id, source, verdict), source null where the citation has no section; places:
    (norm, doc_id, label). recheck(rows of (key, claim, citation)) gives (key, verdict). Citations are tried first where the target is
    wrong or a number is missing; wording where at most one number is missing. What nothing
    fixes comes with the places that hold its numbers, for a person.
    """
    from tabulith.session import cut

    rows = cut(flagged.where("verdict <> 'supported'").withColumn("lacking", F.when(F.col("source").isNotNull(), F.size(N.missing(F.col("claim"), F.col("source"))))))
    wrong = (F.col("verdict") == "wrong_target") | F.col("source").isNull()
    movable = rows.where(wrong | (F.col("lacking") > 0))
    offered = cut(citation_candidates(movable.select(key, "claim", "doc_id"), places, key))
    tries = cut(offered.select(key, F.posexplode("candidates").alias("n", "citation")).withColumn("try", F.concat_ws("/", key, "n")))
    checked = recheck(tries.join(rows.select(key, "claim"), key).select(F.col("try").alias(key), "claim", "citation")).select(F.col(key).alias("try"), "verdict")
    moved = tries.join(checked.where("verdict = 'supported'"), "try").groupBy(key).agg(F.min_by("citation", "n").alias("new_citation"))
    rest = rows.join(moved, key, "left").join(offered, key, "left")
    reword = rest.where(F.col("new_citation").isNull() & ~wrong & ((F.col("lacking") <= 1) | F.col("candidates").isNull()))
    made = suggest_rewrites(reword.select(key, "claim", "source"), key, rewrite).where("rewrite is not null").select(key, "rewrite")
    agreed = recheck(made.join(rows.select(key, "citation"), key).select(key, F.col("rewrite").alias("claim"), "citation")).where("verdict = 'supported'").select(key)
    worded = made.join(agreed, key, "left_semi")
    both = rest.join(worded, key, "left")
    note = F.when(F.col("new_citation").isNotNull(), F.lit("moved and checked again: supported")).when(F.col("rewrite").isNotNull(), F.lit("reworded and checked again: supported")).when(F.size("candidates") > 0, F.lit("the numbers stand elsewhere")).otherwise(F.lit("no fix passed"))
    return both.select(key, F.when(F.col("new_citation").isNull(), F.col("rewrite")).alias("text"), F.col("new_citation").alias("citation"), "candidates", note.alias("note"))
