"""Visually identical text with different characters (problem 3).

Method: compatibility normalisation in composed form, full case folding, mapped white
space and removal of default-ignorable characters, computed once per distinct value of a
batch. Look-alike letters of other scripts are mapped to the Latin letters they show,
before and after folding, as a capital may look alike where its small letter does not.
The letters come from the public confusables data that Spark ships with its Unicode
library: a letter is a look-alike if its skeleton and case are those of a Latin letter.

`canonical` is the consistent form in which texts are compared. As it also folds what a
reader does see (letter case, raised digits), texts look the same if their `visible`
forms, made by the same steps without these two foldings, are equal; equal visible forms
have equal canonical forms.
"""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import cut, table

# Letters that the confusables data reduce to a Latin letter although readers tell
# them apart in running text, marks that show the same, and compatibility forms a reader can tell.
OWN_SHAPE = "αγισυɑɣɩɪɯʋʏгѡƽƍƦƖϺϜ"
SAME_MARKS = {"‐": "-", "‑": "-", "ӏ": "l"}
SEEN = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")
# End of fixed values.
#: Rows of one spelling that meet the rows of another in one task, at most.
PAIR_BLOCK = 4096


@lru_cache(maxsize=1)
def _confusables() -> dict[str, str]:
    """Look-alike letters by rule: same skeleton and same case as a Latin letter. Asked once, on the driver."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = string.ascii_letters
    # every letter outside the big ideograph and syllable blocks
    letters = [c for c in map(chr, (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000))) if c.isalpha()]
    skeletons = checker.getSkeleton("\n".join([*latin, *letters])).split("\n")
    shown: dict[str, list[str]] = {}
    for letter, skeleton in zip(latin, skeletons, strict=False):
        shown.setdefault(skeleton, []).append(letter)
    out = {}
    for letter, skeleton in zip(letters, skeletons[len(latin) :], strict=True):
        alike = [c for c in shown.get(skeleton, ()) if c.isupper() == letter.isupper()]
        if alike and letter not in OWN_SHAPE and not unicodedata.normalize("NFKC", letter).isascii() and not unicodedata.decomposition(letter).startswith(SEEN):
            out[letter] = alike[0]
    return out | SAME_MARKS


def _ignorable(cp: int) -> bool:
    """Default-ignorable code points: shown as nothing."""
    return (
        cp in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0)
        or 0x180B <= cp <= 0x180F or 0x200B <= cp <= 0x200F or 0x202A <= cp <= 0x202E or 0x2060 <= cp <= 0x206F
        or 0xFE00 <= cp <= 0xFE0F or 0xFFF0 <= cp <= 0xFFF8 or 0x1BCA0 <= cp <= 0x1BCA3 or 0x1D173 <= cp <= 0x1D17A or 0xE0000 <= cp <= 0xE0FFF
    )


class _Table(dict):
    """Replacement of each character, found by rule when it is first met."""

    def __init__(self, letters: dict[str, str], visible: bool):
        super().__init__()
        self.letters, self.visible = letters, visible

    def __missing__(self, cp: int):
        ch = chr(cp)
        if _ignorable(cp):
            out = ""
        elif ch in "\n\r\x0b\x0c\x85\u2028\u2029":
            out = "\n"
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            out = " "
        elif ch in self.letters:
            out = self.letters[ch]
        elif self.visible and unicodedata.decomposition(ch).startswith(SEEN):
            out = ch
        else:
            plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
            out = unicodedata.normalize("NFC", "".join(self.letters.get(c, c) for c in plain))
        self[cp] = out
        return out


class Forms:
    """The two forms of texts. Small enough to travel with a task; made on the driver by `forms()`."""

    def __init__(self, letters: dict[str, str]):
        self.letters = letters
        self._tables: tuple[_Table, _Table] | None = None

    def __getstate__(self):
        return {"letters": self.letters, "_tables": None}

    def _table(self, visible: bool) -> _Table:
        if self._tables is None:
            self._tables = _Table(self.letters, False), _Table(self.letters, True)
        return self._tables[visible]

    def visible(self, text: str) -> str:
        """What a reader sees of a text."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(self._table(True)))
        # runs of blanks as one, none at the ends of lines, line breaks as one
        return "\n".join(filter(None, (" ".join(line.split()) for line in text.replace("\r", "\n").split("\n"))))

    def canonical(self, text: str) -> str:
        """The consistent form: also without letter case and compatibility differences; idempotent."""
        if text.isascii():
            return " ".join(text.lower().split())
        table = self._table(False)
        for _ in range(4):
            # capitals may look alike where their small letters do not, so letters are mapped on both sides of folding
            shown = unicodedata.normalize("NFKC", unicodedata.normalize("NFC", text).translate(table))
            folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", shown.casefold()).translate(table))
            folded = " ".join(folded.split())
            if folded == text:
                break
            text = folded
        return text


@lru_cache(maxsize=1)
def forms() -> Forms:
    """The forms by the confusables data; needs a session's driver. Workers get the object with their task."""
    return Forms(_confusables())


def has_content(text: str) -> bool:
    return any(c.isalnum() for c in text)


def normalised(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of df with canonical, visible and has_content of the text.

    Null texts have null forms; empty ones and those of invisible characters only have ''.
    """
    names = [f"c{i}" for i in range(len(keep))]
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).cast("string").alias("the_text"))
    made_by = forms()

    def make(batches):
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(len(names)))
            values = coded.dictionary.to_pylist()
            seen = [made_by.visible(v) for v in values]
            plain = [made_by.canonical(v) for v in values]
            made = [pa.array(plain, pa.string()), pa.array(seen, pa.string()), pa.array([has_content(v) for v in plain], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(m.take(coded.indices) for m in made)], names=[*names, "canonical", "visible", "has_content"])

    fields = [f"{n} {source.schema[n].dataType.simpleString()}" for n in names]
    out = source.mapInArrow(make, ", ".join([*fields, "canonical string", "visible string", "has_content boolean"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "canonical", "visible", "has_content")


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Membership of texts that look the same: (key, class_id, spelling_id, spelling_rows, class_rows, links).

    One row for each row of df in a class with at least two spellings; class_id stands for
    the canonical and visible form, spelling_id for the exact text. links is the number of
    rows that look the same and are written differently. A row that comes several times
    counts once. Null keys and texts, and texts without any letter or digit, are in no
    class. An empty table gives no rows. Texts are read and normalised once; classes are
    counted by spelling before anything is joined, so copies of one text never meet.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null")
    rows = normalised(rows, "text", ["key", "text"]).where("has_content")
    look = F.unhex(F.md5(F.concat(F.col("canonical"), F.lit("\x00"), F.col("visible"))))
    rows = cut(rows.select("key", look.alias("class_id"), F.unhex(F.md5("text")).alias("spelling_id")).distinct())
    spellings = rows.groupBy("class_id", "spelling_id").agg(F.count("*").alias("spelling_rows"))
    classes = spellings.groupBy("class_id").agg(F.sum("spelling_rows").alias("class_rows"), F.count("*").alias("spellings")).where("spellings > 1")
    counted = spellings.join(classes.select("class_id", "class_rows"), "class_id")
    members = rows.join(counted, ["class_id", "spelling_id"])
    return members.select(F.col("key").alias(key), "class_id", "spelling_id", "spelling_rows", "class_rows", (F.col("class_rows") - F.col("spelling_rows")).alias("links"))


def same_looking(df: DataFrame, key: str, text: str, block: int = PAIR_BLOCK) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, whose texts look the same and differ as characters.

    The classes of `look_classes` written out. Rows of a large class are split into blocks
    of about `block` rows by the hash of their key, and each pair of blocks is a join key of
    its own, so no task holds a whole class.
    """
    members = cut(look_classes(df, key, text).withColumnRenamed(key, "key"))
    blocks = F.ceil(F.col("class_rows") / F.lit(block)).cast("int")
    placed = members.select("key", "class_id", "spelling_id", blocks.alias("blocks"), F.pmod(F.hash("key"), blocks).alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = placed.select("class_id", F.col("own").alias("i"), every.alias("j"), F.col("key").alias("key_a"), F.col("spelling_id").alias("spelling_a"))
    b = placed.select("class_id", every.alias("i"), F.col("own").alias("j"), F.col("key").alias("key_b"), F.col("spelling_id").alias("spelling_b"))
    return a.join(b, ["class_id", "i", "j"]).where("key_a < key_b and spelling_a != spelling_b").select("key_a", "key_b").distinct()


def _both(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("bench_items", table(spark, sf_dir, "bench_items"), "item_no", "claim"), ("doc_sections", table(spark, sf_dir, "doc_sections"), "section_id", "text")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [same_looking(df, key, text).select(F.lit(name).alias("table_name"), "key_a", "key_b") for name, df, key, text in _both(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim and section with texts that look the same: its class, spelling and number of links."""
    parts = [look_classes(df, key, text).select(F.lit(name).alias("table_name"), F.col(key).alias("key"), F.hex("class_id").alias("class_id"), F.hex("spelling_id").alias("spelling_id"), "class_rows", "links") for name, df, key, text in _both(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p3_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims and section texts in the consistent form, redelivered rows once."""
    parts = []
    for name, df, key, text in _both(spark, sf_dir):
        parts.append(normalised(df, text, [key]).select(F.lit(name).alias("table_name"), F.col(key).alias("key"), "canonical").distinct())
    return parts[0].unionByName(parts[1])
