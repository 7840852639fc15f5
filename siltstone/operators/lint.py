"""Findings of outside linters, and misspelled words.

Linters that need a type checker don't run here; what they report comes in as rows and gets its tool
and category. Misspelled words are found by a join of words with a dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories of analyzers, by name and by prefix.
CATEGORIES = {
    "ineffassign": "unused", "assign": "unused", "unusedresult": "unused", "printf": "correctness", "slog": "correctness", "stdmethods": "correctness", "copylock": "bug", "bools": "bug", "nilfunc": "bug",
    "nilness": "bug", "atomic": "bug", "loopclosure": "bug", "lostcancel": "bug", "composite": "style", "structtag": "style",
}
PREFIXES = (("SA", "correctness"), ("S", "style"), ("U", "unused"))
# End of fixed values.

#: A small dictionary of common misspellings; any table of (wrong, right) takes its place.
MISSPELLINGS = {
    "accross": "across", "acheive": "achieve", "adress": "address", "alot": "a lot", "arguement": "argument", "begining": "beginning", "beleive": "believe", "calender": "calendar", "collegue": "colleague",
    "comming": "coming", "definately": "definitely", "dependancy": "dependency", "existance": "existence", "foward": "forward", "goverment": "government", "immediatly": "immediately", "independant": "independent",
    "lenght": "length", "neccessary": "necessary", "occured": "occurred", "occurence": "occurrence", "paramter": "parameter", "prefered": "preferred", "recieve": "receive", "refered": "referred", "seperate": "separate",
    "succesful": "successful", "teh": "the", "threshhold": "threshold", "tommorow": "tomorrow", "truely": "truly", "untill": "until", "wich": "which", "writting": "writing",
}


def tool(code: Column) -> Column:
    return F.when(code == "ineffassign", "ineffassign").when(code.rlike("^[SU]"), "staticcheck").otherwise("govet")


def category(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    by_prefix = F.lit("correctness")
    for prefix, name in reversed(PREFIXES):
        by_prefix = F.when(code.startswith(prefix), name).otherwise(by_prefix)
    return F.coalesce(F.try_element_at(names, code), by_prefix)


def lint_findings(rows: DataFrame) -> DataFrame:
    """Outside findings (code, severity, path, line, column, message) with their tool and category."""
    return rows.withColumns({"tool": tool(F.col("code")), "category": category(F.col("code"))})


def in_order(needs: dict[str, tuple[str, ...]]) -> list[str]:
    """Analyzers so that each stands behind those it needs, else by name; a circle is an error."""
    from graphlib import CycleError, TopologicalSorter

    sorter, out = TopologicalSorter(needs), []
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"analyzers need each other: {e.args[1]}") from e
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MISSPELLINGS.items()), "wrong string, right string")


def misspell(lines: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(path, line_no, wrong, right, n): misspelled words of each line and how often they stand there.

    The built-in dictionary is small and fixed, so it is broadcast; Spark chooses for one that is given.
    """
    table = F.broadcast(dictionary(lines.sparkSession)) if words is None else words
    each = lines.select("path", "line_no", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("([a-z]+)"))).alias("wrong"))
    return each.join(table, "wrong").groupBy("path", "line_no", "wrong", "right").agg(F.count("*").alias("n"))
