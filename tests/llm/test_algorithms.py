"""Shared spans, leaks, percentiles, samples and mixtures against brute force."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabulith.llm import leaks, mixing, percentiles, sampling, spans


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _span_truth(records, span):
    own = {}
    for rec, text in records:
        for s in range(len(text or "") - span + 1):
            own.setdefault(text[s : s + span], set()).add(rec)
    out = {}
    for rec, text in records:
        cover = [0] * len(text or "")
        for s in range(len(text or "") - span + 1):
            if len(own[text[s : s + span]]) > 1:
                cover[s : s + span] = [1] * span
        if sum(cover):
            out[rec] = max(out.get(rec, 0), sum(cover))
    return out


@pytest.mark.parametrize("hot", [1, 5000])
def test_shared_spans_against_brute_force(spark, hot):
    rng = random.Random(5)
    letters = "ab cdé"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [make(90) for _ in range(6)]
    records = []
    for i in range(60):
        kind = "section" if i % 2 else "run"
        b = rng.choice(base)
        s, n = rng.randint(0, 40), rng.randint(30, 50)
        records.append(((kind, i), make(rng.randint(0, 30)) + b[s : s + n] + make(rng.randint(0, 30))))
    records += [(("run", 100), "x" * 200), (("section", 101), "x" * 120), (("run", 102), "y" * 300), (("run", 103), None), (("run", 104), ""), (("run", 105), base[0]), (("section", 105), base[0]), (("run", 105), base[0]), (("run", 106), "\U0001f600" * 41), (("run", 107), "\U0001f600" * 45)]
    df = spark.createDataFrame([(k, i, t) for (k, i), t in records], "record_kind string, record_id bigint, text string").withColumn("tid", F.lit(0)).withColumn("half", F.lit("h"))
    got = {(r["record_kind"], r["record_id"]): r["shared_chars"] for r in spans.shared_spans(df, min_chars=40, hot=hot).collect()}
    assert got == _span_truth(records, 40)
    assert spans.shared_spans(df.limit(0), min_chars=40).count() == 0


def test_longest_span_is_held_by_one_other_record(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = make(40), make(40), make(170)
    data = [("run", 0, a + b), ("run", 1, a + make(9)), ("run", 2, make(7) + b), ("run", 3, make(5) + c), ("run", 4, c[:165] + make(30)), ("run", 5, make(50)), ("run", 6, c[3:90])]
    df = spark.createDataFrame(data, "record_kind string, record_id bigint, text string")
    got = {r["record_id"]: (r["longest"], r["shared_chars"]) for r in spans.shared_spans(df, min_chars=40).collect()}
    assert got[0] == (40, 80) and got[1][0] == got[2][0] == 40 and got[3][0] == got[4][0] == 160 and got[6] == (80, 87) and 5 not in got


def test_span_inside_one_record_only_is_no_case(spark):
    piece = "".join(random.Random(1).choice("abcdef ") for _ in range(50))
    df = spark.createDataFrame([("run", 1, piece + "|" + piece), ("run", 2, piece[:39] + "#")], "record_kind string, record_id bigint, text string")
    assert spans.shared_spans(df, min_chars=40).count() == 0


ITEM = "Severe cough under drug one tracked the second score closely, 12.5 versus 8, in 300 people rated at the first site of the study."


@pytest.mark.parametrize("limit", [leaks.BROADCAST_WORDS, 0])
def test_leaks(spark, limit):
    words = ITEM.split()
    docs = [
        (1, "Before. " + ITEM + " After."), (2, ITEM.upper().replace(" ", "\n ").replace(",", " ;")), (3, "Filler text. " + " ".join(words[3:14]) + " more."), (4, " ".join(words[3:16]) + " and so on"),
        (5, None), (6, ""), (7, "word " * 20000 + ITEM), (None, ITEM), (1, "Before. " + ITEM + " After."), (8, " ".join(reversed(words))), (9, ITEM.replace("cough", "co­ugh")),
    ]
    items = [(10, ITEM), (11, "too short to leak"), (12, None), (13, " ".join(words[2:])), (14, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(1)).withColumn("estimate", F.lit(1))
    p = spark.createDataFrame(items, "passage_id bigint, text string").withColumn("doc", F.lit(1))
    got = {(r["doc_id"], r["passage_id"]) for r in leaks.find_leaks(d, p, broadcast_words=limit).collect()}
    truth = set()
    for k, t in docs:
        w = leaks.spelled(t or "")
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for n, x in items:
            v = leaks.spelled(x or "")
            if any(tuple(v[i : i + 13]) in grams for i in range(len(v) - 12)):
                truth.add((k, n))
    assert got == truth and (7, 10) in got and (9, 10) in got and (3, 10) not in got
    assert leaks.find_leaks(d.limit(0), p, broadcast_words=limit).count() == 0
    assert leaks.find_leaks(d, p.limit(0), broadcast_words=limit).count() == 0


def test_ensemble_partitions_bound_what_is_missed():
    """Items of any size are found by a run of the least length; larger partitions have more permutations."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([13, 20, 40, 80, 200]))) for _ in range(300)]
    ensemble = leaks.Ensemble(items, leaks.RUN, leaks.SHINGLE)
    uppers = [u for u, _ in ensemble.partitions]
    assert uppers == sorted(uppers) and ensemble.partitions[0][1] < ensemble.partitions[-1][1]
    docs = []
    for item in items:
        own = item.split()
        at = rng.randint(0, len(own) - 13)
        docs.append(" ".join([*(rng.choice(words) for _ in range(rng.randint(0, 90))), *own[at : at + 13], *(rng.choice(words) for _ in range(60))]))
    got = ensemble.candidates(docs)
    assert all(i in got.get(i, {}) for i in range(len(items)))
    assert sum(map(len, got.values())) < 2 * len(items)


def test_percentile_error_and_merging(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, rng.lognormvariate(5, 2), -rng.lognormvariate(1, 3), 7.0]) for _ in range(5000)] + [1e300, -1e-300, 5e-324]
    data = [("a" if i % 3 else None, i % 4, v) for i, v in enumerate(values)] + [("a", 1, None), ("a", 2, float("nan"))]
    df = spark.createDataFrame(data, "grp string, day int, value double").withColumn("bucket", F.lit(1))
    whole = percentiles.sketch(df, ["grp"], "value")
    parts = [percentiles.sketch(df.where(f"day = {d}"), ["grp", "day"], "value") for d in range(4)]
    assert rows(percentiles.combine(*parts, groups=["grp"])) == rows(whole)
    for r in percentiles.percentiles(whole, ["grp"]).collect():
        own = sorted(v for g, _, v in data if g == r["grp"] and v is not None and not math.isnan(v))
        exact = own[min(len(own) - 1, math.floor(r["quantile"] * len(own)))]
        assert abs(r["value"] - exact) <= 0.0100001 * abs(exact)
    assert percentiles.percentiles(percentiles.sketch(df.limit(0), ["grp"], "value"), ["grp"]).count() == 0


def test_infinite_values_are_kept(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "v double")
    got = percentiles.percentiles(percentiles.sketch(df, [], "v"), [], (0.0, 0.5, 1.0)).orderBy("quantile").collect()
    assert [r["value"] for r in got][::2] == [float("-inf"), float("inf")]


def test_repair_leaves_no_better_exchange():
    rng = random.Random(7)
    for _ in range(200):
        k = rng.randint(1, 6)
        available = {(f"s{i}",): rng.randint(0, 30) for i in range(k)}
        shares = [rng.random() for _ in range(k)]
        plan = sampling.Plan(rng.randint(0, sum(available.values())), {(f"s{i}",): [(i, shares[i] / sum(shares), rng.randint(0, 3))] for i in range(k) if rng.random() < 0.8})
        have = {s: n for s, n in available.items() if n}
        sampling.repair(plan, have, rng)
        counts, floors = plan.counts, sampling._floors(plan, have)
        want = {s: sum(t[1] for t in v) * plan.size for s, v in plan.targets.items()}
        far = lambda c: sum((c.get(s, 0) - want.get(s, 0)) ** 2 for s in available)  # noqa: B023, E731
        assert sum(counts.values()) == max(plan.size, sum(floors.values()))
        assert all(counts.get(s, 0) >= f for s, f in floors.items()) and all(n <= available[s] for s, n in counts.items())
        for a in available:
            for b in counts:
                if a != b and counts.get(a, 0) < available[a] and counts[b] > floors.get(b, 0):
                    other = dict(counts)
                    other[a] = other.get(a, 0) + 1
                    other[b] -= 1
                    assert far(other) >= far(counts) - 1e-6


def test_sample_and_report(spark):
    items = [(i, "good" if i % 3 else "bad", "x" if i % 2 else None) for i in range(300)] + [(5, "good", "x"), (None, "good", "x")]
    df = spark.createDataFrame(items, "item_no bigint, label string, error_type string").withColumn("key", F.lit(1)).withColumn("take", F.lit(1))
    targets = spark.createDataFrame([(1, "p", 0.5, "good", "x", 0.5, 2), (2, "p", 0.5, "bad", None, 0.3, 60), (3, "p", 0.5, "none", "x", 0.2, 1)], "target_no bigint, plan_name string, sample_share double, label string, error_type string, target_share double, min_rows int")
    s = sampling.Sample(df, targets)
    report = {r["target_no"]: r for r in s.report().collect()}
    assert report[1]["met"] and not report[2]["met"] and not report[3]["met"]
    assert report[2]["sampled"] == 50 and report[3]["available"] == 0
    drawn = s.draw().collect()
    assert len(drawn) == len({r["item_no"] for r in drawn}) == 150
    assert sum(r["label"] == "good" and r["error_type"] == "x" for r in drawn) == report[1]["sampled"]
    empty = sampling.Sample(df.limit(0), targets)
    assert [r["met"] for r in empty.report().collect()] == [False, False, False] and empty.draw().count() == 0


def test_schedule_stays_within_one_block():
    for seed in range(20):
        rng = random.Random(seed)
        blocks = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 7))}
        total = sum(blocks.values())
        weights = {s: Fraction(n, total) for s, n in blocks.items()}
        order = mixing.schedule(blocks, weights)
        assert len(order) == total and {s: sum(x == s for x, _ in order) for s in blocks} == blocks
        seen = dict.fromkeys(blocks, 0)
        for place, (s, k) in enumerate(order, 1):
            seen[s] += 1
            assert seen[s] == k
            assert all(abs(seen[x] - weights[x] * place) < 1 for x in blocks)


def test_mixture(spark):
    docs = [(i, "big" if i % 3 else "small", "one two three four five six " * (i % 5 + 1)) for i in range(60)] + [(100, None, "x"), (101, "other", "x"), (102, "big", None), (103, "big", ""), (104, "big", "one two three " * 70)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("bucket", F.lit(1)).withColumn("n_tokens", F.lit(1)).withColumn("place", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.Mixture(df, targets, blocks=50)
    report = {r["source"]: r for r in mixed.report().collect()}
    assert report["big"]["met"] and report["small"]["met"] and not report["gone"]["met"]
    used = sorted(mixed.rows().collect(), key=lambda r: (r["place"], r["offset"]))
    # parts of a use of a document are its tokens in order, each once, but for the last use that a source gives
    parts: dict = {}
    for r in used:
        at = parts.setdefault((r["source"], r["doc_id"], r["repeat"]), [])
        assert r["first_token"] == sum(at)
        at.append(r["n_tokens"])
    sizes = {r["key"]: r["n_tokens"] for r in mixed.sized.collect()}
    assert sum(sum(p) != sizes[k[1]] for k, p in parts.items()) <= 2
    for source, most in (("big", 1), ("small", 2)):
        given = sum(r["n_tokens"] for r in used if r["source"] == source)
        assert given == report[source]["actual_size"] == math.ceil(report[source]["target_size"])
        assert max(r["repeat"] for r in used if r["source"] == source) <= most
    # every prefix of the rows is less than one block away from the shares
    whole = sum(r["n_tokens"] for r in used)
    block = math.ceil(sum(sizes.values()) / 50)
    share = {s: report[s]["actual_size"] / whole for s in ("big", "small")}
    sofar, seen = 0, dict.fromkeys(share, 0)
    for r in used:
        sofar += r["n_tokens"]
        seen[r["source"]] += r["n_tokens"]
        assert all(abs(seen[s] - share[s] * sofar) < block for s in share)
    assert max(sizes.values()) > 5 * block
    assert mixing.Mixture(df.limit(0), targets).report().where("met").count() == 0
    assert mixing.Mixture(df.limit(0), targets).rows().count() == 0
    assert mixing.Mixture(df, targets.limit(0)).report().count() == 0
