"""Version-control output as tables. The text is an input; nothing here starts a process."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_ranges(diff: DataFrame, line_no: str = "line_no", line: str = "line", by: tuple[str, ...] = ()) -> DataFrame:
    """(path, start, end) of the new-side hunks of unified diffs, given as numbered lines.

    ``by`` names columns that tell diffs apart (a repository, a change), and with them the work is
    dealt out; one diff alone is read in order by one task. A hunk without a count, or with a count
    of 0, gives no range.
    """
    order = Window.partitionBy(*by).orderBy(line_no)
    path = F.last(F.when(F.col(line).startswith("+++ "), F.regexp_replace(F.substring(line, 5, 4096), "^b/", "")), ignorenulls=True).over(order)
    head = r"^@@ \S+ \+(\d+),(\d+)"
    rows = diff.withColumn("path", path).where(F.col(line).rlike(head))
    start, count = F.regexp_extract(line, head, 1).cast("int"), F.regexp_extract(line, head, 2).cast("int")
    return rows.where(count > 0).select("path", start.alias("start"), (start + count - 1).alias("end"))


def commits(log: DataFrame, line_no: str = "line_no", line: str = "line", by: tuple[str, ...] = ()) -> DataFrame:
    """(commit_hash, author, path) of numstat logs whose commit lines are a hash and a name.

    ``by`` names columns that tell logs apart, and with them the work is dealt out. The whole rest of a commit line is the author, also where it holds spaces.
    """
    order = Window.partitionBy(*by).orderBy(line_no)
    head = r"^([0-9a-f]{7,40}) (.+)$"
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    at = lambda k: F.last(F.when(F.col(line).rlike(head), F.regexp_extract(line, head, k)), ignorenulls=True).over(order)
    rows = log.select(at(1).alias("commit_hash"), at(2).alias("author"), F.col(line).alias("line"))
    return rows.where(F.col("line").rlike(stat)).select("commit_hash", "author", F.regexp_extract("line", stat, 3).alias("path"))
