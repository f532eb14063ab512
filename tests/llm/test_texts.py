"""Look-alikes, residue, pairs: normal and awkward input."""

import pytest
from pyspark.sql import functions as F

from tabulith.llm import lookalikes, pairs, residue

LONG = "The trial enrolled 120 patients and the mean change was 4.5 points. " * 3000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def made_by(spark):
    return lookalikes.forms()


def test_canonical_is_consistent_and_idempotent(made_by):
    same = ["Café at WEEK 12", "café at week 12", "café\u200b at week １２", "cаfé at week 12", "cafe\u0301 at week 12"]
    assert len({made_by.canonical(s) for s in same}) == 1
    for s in [*same, "", "\u200b", "ßẞ", "İstanbul", "10⁹/L", "a\tb\nc"]:
        once = made_by.canonical(s)
        assert made_by.canonical(once) == once


def test_capitals_of_other_scripts(made_by):
    """Capitals that look alike although their small letters do not."""
    for odd, plain in (("Week В", "Week B"), ("Тable", "Table"), ("Меаn", "Mean"), ("Ηigh", "High"), ("Α", "A"), ("Νo", "No"), ("Ϲost", "Cost"), ("Ёlan", "Ëlan"), ("ΚΕΥ", "KEY")):
        assert made_by.visible(odd) == made_by.visible(plain) and made_by.canonical(odd) == made_by.canonical(plain), odd


def test_visible_keeps_what_a_reader_sees(made_by):
    v = made_by.visible
    assert v("diﬀerence") == v("difference") and v("pоlo") == v("polo")
    assert v("Week") != v("week") and v("m²") != v("m2") and v("cafe") != v("café")
    assert v("TNF-α") != v("TNF-a") and v("p1") != v("pl") and v("В") != v("в")


def test_equal_visible_forms_have_equal_canonical_forms(made_by):
    texts = ["Ａbc", "Аbc", "abc", "ABC", "ﬁt", "fit", "x²", "x2", "ΝΟ", "NO", "е\u0308", "ë", "a\u00a0b", "a b", "ſ", "ϐ", "β"]
    for a in texts:
        for b in texts:
            if made_by.visible(a) == made_by.visible(b):
                assert made_by.canonical(a) == made_by.canonical(b)


@pytest.mark.parametrize("block", [1, 4096])
def test_same_looking_pairs(spark, block):
    data = [(1, "alpha beta"), (2, "аlpha beta"), (2, "аlpha beta"), (3, "alpha beta"), (4, "Alpha beta"), (5, None), (None, "alpha beta"), (6, "—"), (7, "-"), (8, ""), (9, "alpha\u00adbeta"), (10, LONG), (11, LONG.replace("e", "е", 1)), (12, "Week В"), (13, "Week B")]
    df = spark.createDataFrame(data, "key_a bigint, visible string").withColumn("form", F.lit(1)).withColumn("class_id", F.lit(1))
    assert rows(lookalikes.same_looking(df, "key_a", "visible", block)) == [(1, 2), (2, 3), (10, 11), (12, 13)]
    classes = {r["key_a"]: (r["class_rows"], r["links"]) for r in lookalikes.look_classes(df, "key_a", "visible").collect()}
    assert classes == {1: (3, 1), 2: (3, 2), 3: (3, 1), 10: (2, 1), 11: (2, 1), 12: (2, 1), 13: (2, 1)}
    assert rows(lookalikes.same_looking(df.limit(0), "key_a", "visible")) == []


def test_residue_of_awkward_rows(spark):
    prose = [(i, f"At site {i} the mean change from baseline was {i}.4 points in {i * 3} patients who completed week {i}.") for i in range(60)]
    data = [*prose, (100, None), (101, ""), (102, "Error 404\nThe page you asked for could not be found."), (102, "Error 404\nThe page you asked for could not be found."), (None, "Please enable JavaScript to view this page."), (103, prose[3][1] + " See {{study_title}}. " + prose[5][1]), (104, LONG)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("n_chars", F.lit(7)).withColumn("kind", F.lit("x"))
    assert residue.find_residue(df).count() == len(data)
    found = residue.find_residue(df, model=residue.fit([*(t for _, t in prose), LONG[:2000]]))
    assert found.count() == len(data)
    out = residue.excluded(found).collect()
    assert sorted((r["doc_id"] or -1) for r in out) == [-1, 102, 102, 103]
    slot = next(r for r in out if r["doc_id"] == 103)
    assert slot["kind"] == "slot" and "study_title" in slot["first_text"]
    assert residue.find_residue(df.limit(0)).count() == 0


#: Residue whose wording is in no training text.
UNSEEN = [
    "HTTP 499 - the upstream node closed your connection early.", "This archive wants JavaScript switched on before it can show the record.", "We could not prove you are a person; tick the box to go on.",
    "Prepared for {{cohort_lead}} on request.", "Dear [INSERT chairperson], as agreed.", "The mean was <%= wound.area %> at the end.", "Value: undefined; grade: null; ward: NaN", "Lorem ipsum vestra quidem nostrum elitam dolorem suntque.",
    "Click or tap here to enter the ward.", "Overwrite this box with two lines about harms, then remove this note.", "Grade: TBD. Ward: TBD. Nurse: TBD.", "Nurse: ________ Ward: ________", "#VALUE! | #N/A | #REF!",
]
SOUND = ["Not found in the second list; ask the site.", "Scripts for the interview were tested in 12 people.", "An error of 4 points was accepted at week 3.", "The undefined group was small (n = 12).", "Cookies were given as a reward at each visit."]


def test_residue_held_out_accuracy():
    """Models fitted on made-up prose alone find residue of unseen wording inside prose and leave sound texts alone."""
    from tabulith.llm.codes import code_points

    assert not any(u in seed or seed in (u,) for u in UNSEEN for seed in (*residue.NOTICES, *residue.FILLER, *residue.SHELLS, *residue.slots()))
    prose = prose_texts(500, seed=8)
    model = residue.fit([*prose[:400], *(f"{t} {s}" for t, s in zip(prose[:100], SOUND * 20, strict=True))])

    def found(text):
        codes, starts = code_points([text])
        symbols = residue._symbols(codes)
        return bool(residue._marked(model.score(symbols)[0], starts[1:]).sum() >= 4)

    hits = [found(f"{prose[400 + i]} {u} {prose[401 + i]}") for i, u in enumerate(UNSEEN)]
    false = [found(f"{prose[450 + i]} {s} {prose[451 + i]}") for i, s in enumerate(SOUND)] + [found(t) for t in prose[460:]]
    assert sum(hits) >= 0.9 * len(hits) and sum(false) == 0, ([u for u, h in zip(UNSEEN, hits, strict=True) if not h], false)


def test_short_residue_is_excluded_by_coverage(spark):
    data = [*enumerate(prose_texts(200)), (1000, "TBD"), (1001, "[●]"), (1002, "NaN"), (1003, "#REF!"), (1004, "410 Gone"), (1005, "Error 404"), (1006, "Yes."), (1007, "12.5")]
    found = residue.find_residue(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in residue.excluded(found).collect()} == {1000, 1001, 1002, 1003, 1004, 1005}


PAGES = ["JavaScript is turned off. Please enable JavaScript in your browser to view this page.", "Error 404: the page you asked for was not found on this server.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."]


def prose_texts(n, seed=3):
    import random

    rng = random.Random(seed)
    words = "patients received treatment during weeks with placebo response rate score baseline analysis group mean outcome safety site".split()
    return [" ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("page", PAGES)
def test_residue_of_one_wording_in_many_rows(spark, page):
    """Copies that a third of the rows hold, alone and inside real texts, are no prose."""
    data = [(i, page if i % 3 == 0 else f"{t} {page}" if i % 30 == 1 else t) for i, t in enumerate(prose_texts(600))]
    found = residue.excluded(residue.find_residue(spark.createDataFrame(data, "doc_id bigint, text string")))
    assert {r["doc_id"] for r in found.collect()} == {i for i, _ in data if i % 3 == 0 or i % 30 == 1}


def test_residue_models_count_every_document(spark):
    """The models of a table in parts are those of all its documents, also beyond FIT_DOCS; rare residue reaches them."""
    texts = [t + " Zwrqk vbnxz: enable JavaScript to view this page." if i == 2900 else t for i, t in enumerate(prose_texts(3000))]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id bigint, text string").repartition(5)
    model, whole, without = residue.fit_table(docs, "text"), residue.fit(texts), residue.fit(texts[:2900])
    assert all((a == b).all() for a, b in zip(model.ratio + model.kinds, whole.ratio + whole.kinds, strict=True))
    assert any((a != b).any() for a, b in zip(model.ratio, without.ratio, strict=True))


ORIGINAL = "In knee pain, drug A may have improved the mean score by 12.5 points compared with 3.1 points on placebo (p = 0.041)."
CASES = [
    ("In knee pain, drug A improved the mean score by 12.5 points compared with 3.1 points on placebo (p = 0.041).", None),
    ("In knee pain, drug A improved the mean score by 12.5 points compared with 3.1 points on placebo (p = 0.041)", None),
    ("In knee pain, drug A improved the mean score by 12.5 points.", None),
    ("", "empty"), (None, "empty"), ("N/A", "empty"), ("​", "empty"), ("—", "empty"),
    ("In knee pain, drug A improved the", "truncated"), ("In knee pain, drug A impro", "truncated"), ("In knee pain, drug A improved the mean score by 12.5 points compared…", "truncated"),
    ("I'm sorry, but I cannot rewrite this statement.", "refusal"), ("Unfortunately, no rewrite can be given without more context.", "refusal"),
    (ORIGINAL, "copy"), (ORIGINAL.upper(), "copy"), ('"' + ORIGINAL[:-1] + '"', "copy"), ("Rewritten claim: " + ORIGINAL, "copy"), (ORIGINAL.replace("a", "а"), "copy"),
    ("Die Auswertung der Daten zeigte nach der Behandlung einen Unterschied von 12.5 Punkten zwischen den Gruppen.", "language"),
    ("In knee pain, el análisis de los pacientes mostró una diferencia de 12.5 puntos tras el tratamiento.", "language"),
]


@pytest.fixture(scope="module")
def labels(spark):
    sound = [(1000 + i, ORIGINAL.replace("12.5", f"{i}.5").replace("knee", f"area{i}"), CASES[0][0].replace("12.5", f"{i}.5").replace("knee", f"area{i}")) for i in range(13, 200)]
    data = [(i, ORIGINAL, claim) for i, (claim, _) in enumerate(CASES)] + sound + [(1, ORIGINAL, CASES[1][0]), (5000, None, "Drug A improved the mean score by 12.5 points."), (None, ORIGINAL, "")]
    df = spark.createDataFrame(data, "empty bigint, original string, claim string").withColumn("defect", F.lit(0))
    return [tuple(r) for r in pairs.broken_pairs(df, "empty", "original", "claim").select("empty", "defect").collect()]


def test_defects(labels):
    want = {(i, d) for i, (_, d) in enumerate(CASES) if d}
    assert {x for x in labels if x[0] is not None} == want


def test_null_key_keeps_its_label(labels):
    assert (None, "empty") in labels


def test_no_pairs(spark):
    df = spark.createDataFrame([], "item_no bigint, original_claim string, claim string")
    assert pairs.broken_pairs(df, "item_no", "original_claim", "claim").count() == 0


def test_label_model_orders_patterns():
    model = pairs.label_model({(1, 1, 1): 30, (0, 0, 0): 900, (1, 0, 1): 3, (0, -1, 0): 50})
    assert model[(1, 1, 1)] > 0.95 > 0.1 > model[(0, 0, 0)]
    assert pairs.label_model({}) == {}


def test_several_labels_stand_together(labels_of):
    """No defect hides another: a refusal in another language than the original, and a broken-off text in one."""
    got = labels_of([(1, "Es tut mir leid, ich kann diese Aussage leider nicht umformulieren, weil sie so nicht stimmt und nicht belegt ist."), (2, "In knee pain, drug A, el análisis de los datos mostró una diferencia de 12.5 puntos entre los grupos y con")])
    assert {(1, "refusal"), (1, "language")} <= got and {(2, "truncated"), (2, "language")} <= got


@pytest.fixture(scope="module")
def labels_of(spark):
    def run(extra):
        sound = [(1000 + i, ORIGINAL.replace("12.5", f"{i}.5").replace("knee", f"area{i}"), CASES[0][0].replace("12.5", f"{i}.5").replace("knee", f"area{i}")) for i in range(13, 200)]
        data = [(100 + i, ORIGINAL, claim) for i, (claim, _) in enumerate(CASES)] + sound + [(i, ORIGINAL, c) for i, c in extra]
        df = spark.createDataFrame(data, "item_no bigint, original string, claim string")
        return {tuple(r) for r in pairs.broken_pairs(df, "item_no", "original", "claim").select("item_no", "defect").collect()}

    return run


def test_every_sound_pair_validates(spark):
    """Defects are planted into all sound pairs of a table, foreign texts wherever another language is there."""
    english = [(f"The rate of group {i} was {i} percent in the study and the trial.", f"In the study and the trial the rate of group {i} was {i} percent.", "en", "en") for i in range(900)]
    german = [(f"Die Rate der Gruppe {i} war in der Studie und dem Versuch {i} Prozent.", f"In der Studie und dem Versuch war die Rate der Gruppe {i} {i} Prozent.", "de", "de") for i in range(4)]
    sound = spark.createDataFrame(english + german, "original string, claim string, spoken string, own string")
    got = pairs._planted(sound, lookalikes.forms()).where("planted").groupBy("defect").agg(F.sum("n").alias("n")).collect()
    counts = {r["defect"]: r["n"] for r in got}
    assert {d: counts[d] for d in ("empty", "truncated", "refusal", "copy")} == dict.fromkeys(("empty", "truncated", "refusal", "copy"), 904)
    assert counts["language"] >= 900
    few = pairs._planted(sound.where("own = 'en'").repartition(5), lookalikes.forms()).where("planted")
    assert few.where("defect = 'language'").count() == 0 and few.agg(F.sum("n")).first()[0] == 4 * 900


def test_parts_of_any_size_teach_the_same(monkeypatch):
    """Texts are scored in small parts, and those with residue are counted together: few additions, the same model."""
    import numpy as np

    texts = [f"Patients of group {i} had {i * 7 % 50} visits in {i % 12} months; the mean was {i * 3}.{i % 9} points." for i in range(600)] + [f"404 Not Found. The requested page {i} was not found on this server." for i in range(40)]
    whole = residue.fit(texts)
    added = []
    counted = residue._count_found
    monkeypatch.setattr(residue, "_count_found", lambda tally, held, repeated: (added.append(len(held)), counted(tally, held, repeated)))
    monkeypatch.setattr(residue, "SCAN_CHARS", 700)
    split = residue.fit(texts)
    assert all(np.array_equal(a, b) for a, b in zip((*whole.ratio, *whole.kinds), (*split.ratio, *split.kinds), strict=True))
    assert len(added) == residue.ROUNDS - 1 and max(added) > 1
