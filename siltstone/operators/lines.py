"""Lines of files, and what most detectors need to know about a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_comment, occurrences, trimmed
from ..sources.config import BY_LANGUAGE, thresholds


def lines(files: DataFrame) -> DataFrame:
    """(path, lang, line_no, line, text, blank, comment, opens, closes): ``text`` is the trimmed line.

    A line feed at the end opens no line; an empty file has none. The thresholds of the file's
    language come along, from a table of a fixed few rows.
    """
    parts = F.when(F.col("source") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("source", r"\n\z", ""), "\n"))
    made = files.select("path", "lang", F.posexplode(parts).alias("at", "line")).select("path", "lang", (F.col("at") + 1).alias("line_no"), "line", trimmed(F.col("line")).alias("text"))
    return made.withColumns({"blank": F.col("text") == "", "comment": is_comment(F.col("text")), "opens": occurrences(F.col("text"), "{"), "closes": occurrences(F.col("text"), "}")})


def with_thresholds(rows: DataFrame, overrides: dict | None = None) -> DataFrame:
    """``rows`` (lang, ...) with the thresholds of their language; the table has seven rows."""
    table = thresholds(rows.sparkSession, overrides)
    return rows.withColumn("lang_key", F.when(F.col("lang").isin(*BY_LANGUAGE), F.col("lang")).otherwise("*")).join(F.broadcast(table), "lang_key").drop("lang_key")
