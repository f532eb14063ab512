"""Tables from positioned text: spans to lines, lines to tables.

Input rows are text spans of pages: (doc, page, x0, x1, y, text). Lines and tables need the
order of a page or a document, so they are made per page and per document, whose sizes are
those of single files.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
BASELINE, CELL_GAP = 2.0, 8.0
PROSE_WIDTH, PROSE_WORDS, NUMERIC_SHARE, PROSE_RUN, CAPTION_LINES = 0.8, 9, 0.3, 2, 4
CAPTION = re.compile(r"^\s*(?:Table|TABLE)\s+(\d+)\s*[.:|]?\s*(.*)$")
# End of fixed values.


def upright(spans: DataFrame) -> DataFrame:
    """Spans (doc, page, x0, y0, x1, y1, dx, dy, text) in the frame of their reading direction: (doc, page, frame, x0, x1, y, text).

    frame is 0 for text across the page, 1 for text that reads upwards, 2 for downwards;
    dx and dy are the direction of the line (null: across).
    """
    across = F.coalesce(F.abs("dx") >= F.abs("dy"), F.lit(True))
    frame = F.when(across, F.lit(0)).when(F.col("dy") < 0, F.lit(1)).otherwise(F.lit(2))
    a = F.when(across, F.col("x0")).when(F.col("dy") < 0, -F.col("y1")).otherwise(F.col("y0"))
    b = F.when(across, F.col("x1")).when(F.col("dy") < 0, -F.col("y0")).otherwise(F.col("y1"))
    base = F.when(across, F.col("y1")).when(F.col("dy") < 0, F.col("x1")).otherwise(-F.col("x0"))
    return spans.select("doc", "page", frame.alias("frame"), a.alias("x0"), b.alias("x1"), F.floor(base + 0.5).cast("double").alias("y"), "text")


def page_lines(spans: DataFrame) -> DataFrame:
    """(doc, page, line_no, x0, x1, rotated, text) with cells parted by ' | '.

    A span joins the line of its frame whose first span's baseline is at most BASELINE away;
    a gap wider than CELL_GAP begins a cell. Lines of turned frames follow the page's
    others. Spans without text are left out.
    """
    spans = spans if "frame" in spans.columns else spans.withColumn("frame", F.lit(0))

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for s in pdf.sort_values(["frame", "y", "x0"], kind="stable").itertuples():
            if not (s.text or "").strip():
                continue
            if rows and rows[-1][0].frame == s.frame and abs(rows[-1][0].y - s.y) <= BASELINE:
                rows[-1].append(s)
            else:
                rows.append([s])
        out = []
        for no, row in enumerate(rows):
            row.sort(key=lambda s: s.x0)
            cells, right = [], None
            for s in row:
                if right is not None and s.x0 - right <= CELL_GAP:
                    cells[-1] += (" " if s.x0 - right > 0.5 else "") + s.text.strip()
                else:
                    cells.append(s.text.strip())
                right = s.x1 if right is None else max(right, s.x1)
            out.append((row[0].doc, row[0].page, no, float(row[0].x0), float(right), row[0].frame != 0, " | ".join(cells)))
        return pd.DataFrame(out, columns=["doc", "page", "line_no", "x0", "x1", "rotated", "text"])

    return spans.groupBy("doc", "page").applyInPandas(lines, "doc string, page int, line_no int, x0 double, x1 double, rotated boolean, text string")


def is_prose(text: str, width: float, column: float) -> bool:
    """Whether a line is running text: one wide cell of many words, few of them numeric."""
    words = text.split()
    numeric = sum(any(c.isdigit() for c in w) for w in words)
    return " | " not in text and width > PROSE_WIDTH * column and len(words) >= PROSE_WORDS and numeric <= NUMERIC_SHARE * len(words)


def layout_tables(lines: DataFrame) -> DataFrame:
    """(doc, number, caption, rows): tables that follow a caption until running text begins again.

    A caption may go on for some lines; rows of a number on later pages are added to it.
    """

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, dict] = {}
        # columns are as wide as the widest line of their page
        widest = (pdf["x1"] - pdf["x0"]).groupby(pdf["page"]).max()
        now, prose, caption_left = None, 0, 0
        for line in pdf.sort_values(["page", "line_no"]).itertuples():
            m = CAPTION.match(line.text)
            if m and not re.match(r"^(?:shows|presents|lists|and|in|of)\b", m[2]):
                now = found.setdefault(int(m[1]), {"caption": m[2].strip(), "rows": []})
                prose, caption_left = 0, CAPTION_LINES
                continue
            if now is None:
                continue
            running = is_prose(line.text, line.x1 - line.x0, float(widest[line.page]))
            if caption_left and " | " not in line.text and not now["rows"]:
                now["caption"] = f"{now['caption']} {line.text}".strip()
                caption_left -= 1
                continue
            caption_left = 0
            prose = prose + 1 if running else 0
            if prose >= PROSE_RUN:
                now["rows"] = now["rows"][: -(PROSE_RUN - 1)]
                now = None
            else:
                now["rows"].append(line.text)
        doc = pdf["doc"].iloc[0] if len(pdf) else None
        return pd.DataFrame([(doc, n, t["caption"], t["rows"]) for n, t in sorted(found.items())], columns=["doc", "number", "caption", "rows"])

    return lines.groupBy("doc").applyInPandas(tables, "doc string, number int, caption string, rows array<string>")
