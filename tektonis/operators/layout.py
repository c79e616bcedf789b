"""Pages of words and lines: line assembly, rows by height, carry-forward of keys, contents with gaps.

Groups are pages or documents, bounded by what a sheet holds; nothing wider than that is gathered."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def lines_from_words(words: DataFrame, keys: list[str], x: str = "x", text: str = "text") -> DataFrame:
    """The words of each line in reading order, in one string."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t"))))
    return words.where(F.col(text).isNotNull() & (F.trim(text) != "")).groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda w: w["t"]), " ").alias("line"), F.min(x).alias("left"), F.count("*").alias("n_words"))


def anchored_rows(ys: list[int], threshold: int) -> list[int]:
    """Row numbers of ordered heights; a word starts a new row where it is further than the threshold below the row's first word."""
    out, row, anchor = [], 0, None
    for y in ys:
        if anchor is None or abs(y - anchor) > threshold:
            row, anchor = row + 1, y
        out.append(row)
    return out


def group_rows(words: DataFrame, threshold: int = 10, page: str = "page_id") -> DataFrame:
    """(page, row_no, line): words in rows by distance to the row's first word, which no window frame expresses; a page is one group."""
    kind = words.schema[page].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x", "text"], kind="stable")
        pdf["row_no"] = anchored_rows(pdf["y"].tolist(), threshold)
        rows = [(p, r, " ".join(g.sort_values(["x", "text"])["text"])) for (p, r), g in pdf.groupby([page, "row_no"])]
        return pd.DataFrame(rows, columns=[page, "row_no", "line"])

    return words.select(page, "x", "y", "text").where("text IS NOT NULL AND y IS NOT NULL").groupBy(page).applyInPandas(one, f"`{page}` {kind}, row_no bigint, line string")


def carry_forward(lines: DataFrame, doc: str, order: str, key: str, value: str) -> DataFrame:
    """(doc, key, value): lines without a key continue the value of the last key above them."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_k", F.last(key, ignorenulls=True).over(before)).withColumn("_n", F.count(key).over(before)).where(F.col("_k").isNotNull())
    parts = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull() & (F.col(value) != ""), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return marked.groupBy(doc, "_n", "_k").agg(F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias("value")).select(doc, F.col("_n").alias("no"), F.col("_k").alias("key"), "value")


def section_starts(boxes: DataFrame, doc: str, page: str, order: list[str], marks: list[str]) -> DataFrame:
    """(doc, page, last): pages on which a section begins, and the document's last page of all.

    A section begins with the document's first box and wherever a mark differs from its last known value; a box without a mark goes on with it."""
    w = Window.partitionBy(doc).orderBy(page, *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    known = boxes.where(F.col(page).isNotNull()).select(doc, page, *order, *[F.last(m, ignorenulls=True).over(so_far).alias(f"_{i}") for i, m in enumerate(marks)])
    begins = F.row_number().over(w) == 1
    for i in range(len(marks)):
        begins = begins | ~F.col(f"_{i}").eqNullSafe(F.lag(f"_{i}").over(w))
    marked = known.select(doc, page, begins.alias("_begins"), F.max(page).over(Window.partitionBy(doc)).alias("last"))
    return marked.where("_begins").select(doc, page, "last").distinct()


def section_ranges(entries: DataFrame, doc: str, page: str, last_page: str) -> DataFrame:
    """Entries with the page on which they end: the one before the next entry, or the document's last."""
    w = Window.partitionBy(doc).orderBy(page)
    return entries.withColumn("end_page", F.coalesce(F.lead(page).over(w) - 1, F.col(last_page)))


def fill_missing_pages(entries: DataFrame, doc: str, number: str, page: str) -> DataFrame:
    """A missing page becomes the last known one plus the distance, as long as section numbers are consecutive."""
    w = Window.partitionBy(doc).orderBy(number)
    run = Window.partitionBy(doc, "_run").orderBy(number)
    gap = F.when(F.col(number) - F.lag(number).over(w) == 1, 0).otherwise(1)
    marked = entries.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w))
    known = F.last(F.when(F.col(page).isNotNull(), F.struct(F.col(page).alias("p"), F.col(number).alias("n"))), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_known", known)
    return marked.withColumn("filled", F.coalesce(F.col(page), F.col("_known.p") + F.col(number) - F.col("_known.n"))).drop("_gap", "_run", "_known")


def repair_numbers(entries: DataFrame, doc: str, order: str, number: str) -> DataFrame:
    """Section numbers that step back or jump by more than one become the predecessor's successor, in order, per document."""
    kind = entries.schema[doc].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, last = [], None
        for n in pdf[number]:
            n = None if n is None or n != n else int(n)
            if last is not None and (n is None or not last < n <= last + 1):
                n = last + 1
            out.append(n)
            last = n if n is not None else last
        return pd.DataFrame({doc: pdf[doc], "place": pdf[order], "repaired": pd.array(out, dtype="Int64")})

    return entries.select(doc, order, number).groupBy(doc).applyInPandas(one, f"`{doc}` {kind}, place bigint, repaired bigint")


def patch(entries: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Entries with the corrected values where a correction has the same keys."""
    fix = corrections.select(*keys, *[F.col(c).alias("_" + c) for c in columns])
    out = entries.join(fix, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce("_" + c, c)).drop("_" + c)
    return out


def reading_order(boxes: DataFrame, least_area: int = 2500, least_height: int = 20) -> DataFrame:
    """Boxes that are large enough, from top to bottom and left to right."""
    return boxes.where((F.col("w") * F.col("h") >= least_area) & (F.col("h") >= least_height)).orderBy("y", "x")


