"""Uploaded files: sessions, copies, and groups of pages by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Seconds without an upload that end a session.
GAP = 1800
#: How a file name tells its page, and how sure a group is by name or of a single file.
PAGE_MARK, PART_MARK = r"(?i)(?:page|p|页)[\s_-]*(\d+)(?:[\s_-]*(?:of|-|/)[\s_-]*(\d+))?", r"(?i)(\d+)\s*(?:of|/)\s*(\d+)"
BY_NAME, ALONE = 0.55, 0.2


def page_of(name: Column) -> tuple[Column, Column, Column]:
    """Page, pages (0 if unknown) and the group of a file name: what is left of it without the mark; empty where it has none."""
    base = F.regexp_replace(name, r"\.[^.]+$", "")
    marked = base.rlike(PAGE_MARK)
    found = lambda k: F.when(marked, F.regexp_extract(base, PAGE_MARK, k)).otherwise(F.regexp_extract(base, PART_MARK, k))
    mark = found(0)
    at = F.position(mark, base)
    rest = F.concat(F.substr(base, F.lit(1), at - 1), F.substr(base, at + F.length(mark)))
    key = F.coalesce(F.nullif(F.trim(F.regexp_replace(rest, r"[_\-\s]+$", "")), F.lit("")), base)
    number = lambda k: F.coalesce(F.nullif(found(k), F.lit("")).try_cast("int"), F.lit(0))
    return number(1), number(2), F.when(mark == "", "").otherwise(key)


def pages(uploads: DataFrame, gap: int = GAP) -> DataFrame:
    """The uploads (company_id, user_id, file_id, at, name, hash) with session, page_index, page_number, page_count, status and group.

    A user's session ends when nothing comes for ``gap`` seconds; it is named by its first file. A file whose hash the company had before is a copy. The group is
    that of the name within the session, or the file itself.
    """
    order = Window.partitionBy("company_id", "user_id").orderBy("at", "file_id")
    fresh = F.coalesce(F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)) > gap * 1_000_000, F.lit(True))
    d = uploads.withColumn("fresh", fresh).withColumn("session", F.last(F.when(c("fresh"), c("file_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")
    d = d.withColumn("page_index", F.row_number().over(Window.partitionBy("company_id", "user_id", "session").orderBy("at", "file_id")))
    seen = F.row_number().over(Window.partitionBy("company_id", "hash").orderBy("at", "file_id"))
    known = uploads.where(F.length("hash") > 0).select("company_id", "file_id", (seen > 1).alias("copy"))
    number, count, key = page_of(c("name"))
    d = d.join(known, ["company_id", "file_id"], "left").withColumn("page_number", number).withColumn("page_count", count).withColumn("key", key)
    d = d.withColumn("status", F.when(F.coalesce("copy", F.lit(False)), "skipped_duplicate").otherwise("waiting"))
    return d.withColumn("group", F.when(c("key") != "", c("key")).otherwise(F.concat(F.lit("file:"), c("file_id").cast("string")))).drop("copy", "key")


def groups(pages: DataFrame) -> DataFrame:
    """(company_id, user_id, session, group, n_pages, files, copies, confidence): the groups of each session with their files in order."""
    d = pages.groupBy("company_id", "user_id", "session", "group").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.struct("page_index", "file_id"))).alias("p"), F.count_if(c("status") == "skipped_duplicate").alias("copies"))
    files = F.array_join(F.transform("p", lambda x: x["file_id"].cast("string")), ",")
    return d.select("company_id", "user_id", "session", "group", "n_pages", files.alias("files"), "copies", F.when(c("group").startswith("file:"), ALONE).otherwise(BY_NAME).alias("confidence"))
