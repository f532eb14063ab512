"""Where data sets, stores, runs and settings lie, and downloads that are kept as tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import schemas
from tabulith.sources.files import paper_documents, read_jsonl

# Which set cites another one's tables, the files of each form of a store, the options
# that send a check on to a stronger judge, and how many pages a download follows.
CITES_TABLES_OF = {"pmchard": "pmc"}
STORE_FILES = {"tables": "papers.jsonl", "pdf": "papers_pdf.jsonl", "full": "docs_full.jsonl"}
WHOLE_PAPERS_ONLY = ("pmcrefs",)
STORED = ("pmc", "pmcrefs")
ESCALATIONS = ("flags", "passes", "cues", "judgment", "lowconf")
PAGES = 40
# End of fixed values.


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load_dataset(spark: SparkSession, root: str, name: str, split: str = "sample") -> tuple[DataFrame, DataFrame]:
    """(items, corpus) of a data set; fixtures win over data. Of equal ids in the corpus the last line counts."""
    if split not in ("sample", "full"):
        raise ValueError("split is 'sample' or 'full'")
    fixture = os.path.join(root, "fixtures", name)
    folder = fixture if _exists(spark, fixture) else os.path.join(root, "data", name)
    items = read_jsonl(spark, os.path.join(folder, "items_sample.jsonl" if split == "sample" else "items.jsonl"), schemas.ITEM)
    lines = read_jsonl(spark, os.path.join(folder, "corpus.jsonl"), schemas.SOURCE).withColumn("line", F.monotonically_increasing_id())
    corpus = lines.groupBy("id").agg(F.max_by(F.struct("title", "text"), "line").alias("r")).select("id", "r.title", "r.text")
    return items, corpus


def load_store(spark: SparkSession, root: str, name: str, variant: str = "tables") -> DataFrame:
    """A data set's documents (schemas.DOCUMENT): its fixture's, whole documents, or the tables of its papers."""
    if variant not in STORE_FILES:
        raise ValueError(f"variant is one of {', '.join(STORE_FILES)}")
    fixture = os.path.join(root, "fixtures", name, "docs.jsonl")
    if _exists(spark, fixture):
        return read_jsonl(spark, fixture, schemas.DOCUMENT)
    name = CITES_TABLES_OF.get(name, name)
    if name not in STORED:
        raise ValueError(f"no documents for {name}")
    path = os.path.join(root, "data", STORED[0], STORE_FILES[variant])
    if variant == "full":
        if not _exists(spark, path):
            raise FileNotFoundError(path)
        return read_jsonl(spark, path, schemas.DOCUMENT)
    if name in WHOLE_PAPERS_ONLY:
        raise ValueError(f"{name} cites whole papers: use the variant 'full'")
    return paper_documents(read_jsonl(spark, path, schemas.PAPER))


def load_overrides(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Reviewed labels, the last line of each id; none without a file."""
    path = os.path.join(root, "labels", f"{name}_overrides.jsonl")
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.OVERRIDE)
    rows = read_jsonl(spark, path, schemas.OVERRIDE).withColumn("line", F.monotonically_increasing_id())
    rest = [f.name for f in schemas.OVERRIDE if f.name != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "line").alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in rest))


def latest_run(spark: SparkSession, pattern: str) -> str | None:
    """The last by name of the files that match; names begin with their time."""
    found = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    status = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return max((s.getPath().toString() for s in status or []), default=None)


def run_stamp(now: datetime) -> str:
    """The time in the name of a run's file."""
    return now.strftime("%Y-%m-%dT%H-%M-%S")


def variant_name(agent: str, corpus: str = "tables", prompt: str = "v1", reasoning: str = "", cues: bool = False, retries: int = 2, escalate: str = "flags", strong: str = "") -> str:
    """The name of a set-up in the name of its runs."""
    version = "" if prompt == "v1" else f"-{prompt}"
    tags = (f"-{reasoning}" if reasoning else "") + ("-cues" if cues else "")
    named = {"tool": f"tool-{corpus}-r{retries}", "resolve": f"resolve-{corpus}{version}{tags}", "hybrid": f"hybrid{version or '-v1'}{tags}-{escalate.replace(',', '+')}-{strong.rpartition('/')[2]}"}
    return named.get(agent, agent)


def escalation_options(listed: str) -> set[str]:
    """The options of a comma list; unknown ones fail."""
    asked = {p.strip() for p in listed.split(",")} - {""}
    if unknown := sorted(asked - set(ESCALATIONS)):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    return asked


def read_settings(path: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """Settings 'key=value' of a file added to those given, which win; comments and lines without '=' are passed over."""
    out = dict(into or {})
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                key, sign, value = line.partition("=")
                if sign and not line.lstrip().startswith("#"):
                    out.setdefault(key.strip(), value.strip())
    return out


def limited(rows: DataFrame, order: str, limit: int | None = None, holds: str | None = None, column: str = "run_name") -> DataFrame:
    """The first rows by an order, of those whose column holds a text."""
    out = rows if holds is None else rows.where(F.contains(F.col(column), F.lit(holds)))
    return out if limit is None else out.orderBy(order).limit(limit)


def complete_enough(records: DataFrame, items: DataFrame, least: int | None = None) -> DataFrame:
    """Runs with at least `least` records (nine tenths of the items unless given), all of known items."""
    wanted = least if least is not None else -(-9 * items.select("id").distinct().count() // 10)
    known = items.select(F.col("id").alias("item_id"), F.lit(True).alias("known")).distinct()
    runs = records.join(known, "item_id", "left").groupBy("run_name").agg(F.count("*").alias("records"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))
    return runs.where(F.col("known") & (F.col("records") >= wanted)).select("run_name", "records")


def paged(spark: SparkSession, path: str, fetch: Callable[[str | None], tuple[list[str], str | None]], enough: int | None = None, known: set[str] = frozenset(), pages: int = PAGES) -> DataFrame:
    """(place, id): ids of a cursor-paged listing, kept at path; a kept listing is not fetched again.

    fetch(cursor) gives ids and the next cursor (None at the end). Each id counts once, by
    its first place; known ids are passed over; paging ends after `enough` new ids or `pages` pages.
    """
    if not _exists(spark, path):
        found: dict[str, None] = {}
        cursor: str | None = None
        for _ in range(pages):
            ids, cursor = fetch(cursor)
            found |= dict.fromkeys(i for i in ids if i not in known)
            if cursor is None or (enough is not None and len(found) >= enough):
                break
        spark.createDataFrame(list(enumerate(found)), "place bigint, id string").write.parquet(path)
    return spark.read.parquet(path).orderBy("place")


def land(ids: DataFrame, path: str, fetch: Callable[[str, int], bytes | None], versions: int = 3, magic: bytes = b"") -> DataFrame:
    """(id, version, content) of objects kept at path: those that are missing are fetched in parallel, first version that exists.

    ids: (id). What does not begin with `magic` is no object. Objects that no version has are asked for again next time.
    """
    spark = ids.sparkSession

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for i in b["id"]:
                for version in range(1, versions + 1):
                    try:
                        content = fetch(i, version)
                    except Exception:  # noqa: BLE001
                        continue
                    if content is not None and content.startswith(magic):
                        out.append((i, version, content))
                        break
            yield pd.DataFrame(out, columns=["id", "version", "content"])

    todo = ids.select("id").where("id is not null").distinct()
    if _exists(spark, path):
        todo = todo.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    todo.mapInPandas(run, "id string, version int, content binary").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def as_xml(landed: DataFrame) -> DataFrame:
    """Landed articles as (id, xml)."""
    return landed.select("id", F.decode("content", "UTF-8").alias("xml"))


def as_json_rows(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(json): each checked citation as one object, with the findings at its place as sourceIssues.

    rows: (claim, citation, verdict, ...); found: (citation, issue struct).
    """
    if found is not None:
        issues = found.groupBy("citation").agg(F.collect_list("issue").alias("sourceIssues"))
        rows = rows.join(issues, "citation", "left").withColumn("sourceIssues", F.coalesce("sourceIssues", F.array().cast(issues.schema["sourceIssues"].dataType)))
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
