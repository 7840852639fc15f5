"""What to do about findings: assessments of files, and what cleaner files would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import strategies, tokens

# Texts of an assessment, prices of a million tokens, and what a month is made of.
STEPS_HEAD = "\n\nREFACTORING STEPS: Call get_refactoring_strategy() for each detected smell:"
STEP = '\n  - get_refactoring_strategy("%s")'
STEPS_END = "\n  Then refactor in 3-5 small steps, re-running analyze_code after each to verify improvement."
STOP = "RECOMMENDATION: STOP — refactor before any AI modification. "
STOP_FOUND = "Call get_refactoring_strategy() for the specific smell names above. Do NOT modify this file until the score is above 80."
STOP_NONE = "The file is in a risky state and cannot be safely edited as-is."
WORK = "RECOMMENDATION: Needs Work — significant complexity issues. "
WORK_FOUND = "Use get_refactoring_strategy() for the smells above. Refactor incrementally in 3-5 small steps, re-running analyze_code after each."
WORK_NONE = "Refactor incrementally in 3-5 small steps before adding features."
CARE = "RECOMMENDATION: Proceed with Care — use guard clauses and small isolated changes. Re-check after each edit with analyze_code."
PRICES = (15.0, 10.0, 3.0)
READS_A_MONTH = 20 * 50 * 22 * 6
FEWER_ITERATIONS = 1.4
REDUCTIONS = ((50, 0.50), (65, 0.45), (80, 0.40))
CLEAN_REDUCTION = 0.10
# End of fixed values.


def recommendation(label: Column, n_smells: Column) -> Column:
    """The closing advice for a label; null where there is none."""
    some = n_smells > 0
    return (
        F.when(label == "Stop & Refactor", F.concat(F.lit(STOP), F.when(some, STOP_FOUND).otherwise(STOP_NONE)))
        .when(label == "Needs Work", F.concat(F.lit(WORK), F.when(some, WORK_FOUND).otherwise(WORK_NONE)))
        .when(label == "Proceed with Care", CARE)
    )


def assessments(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(path, assessment): score and label of each file, its findings by line and name, the strategies that answer them, and advice.

    Files without findings have no list. A finding is told by name, severity and value.
    """
    known = found.join(F.broadcast(strategies(found.sparkSession)), "smell", "left")  # a row for each strategy
    told = F.format_string("\n  - %s (%s): %s", "smell", "severity", F.col("value").cast("decimal(38,2)").cast("string"))
    per = known.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_start", "smell", "severity", "value", told.alias("text")))).alias("issues"), F.array_sort(F.collect_set("strategy")).alias("names"))
    issues = F.concat(F.format_string("\nDetected %d issues:", "n"), F.array_join(F.transform("issues", lambda x: x["text"]), ""))
    steps = F.when(F.size("names") > 0, F.concat(F.lit(STEPS_HEAD), F.array_join(F.transform("names", lambda x: F.format_string(STEP, x)), ""), F.lit(STEPS_END))).otherwise("")
    joined = scores.select("path", "score", "label").join(per, "path", "left")
    advice = recommendation(F.col("label"), F.coalesce("n", F.lit(0)))
    head = F.format_string("%s — Score: %d/100", "label", "score")
    return joined.select("path", F.concat(head, F.coalesce(F.concat(issues, steps), F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), advice), F.lit(""))).alias("assessment"))


def reduction(score: Column) -> Column:
    """The share of tokens that a file of a score of 80 and more would save."""
    out = F.lit(CLEAN_REDUCTION)
    for bound, share in reversed(REDUCTIONS):
        out = F.when(score < bound, share).otherwise(out)
    return out


def half_up(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def token_savings(files: DataFrame, scores: DataFrame) -> DataFrame:
    """(path, tokens, after, saved, price, per_read, monthly, with_iterations): three rows a file, one for each price of a million tokens."""
    n = tokens(F.col("n_bytes"))
    base = files.join(scores.select("path", "score"), "path").select("path", n.alias("tokens"), half_up(n * (1 - reduction(F.col("score")))).cast("long").alias("after"))
    priced = base.withColumn("saved", F.col("tokens") - F.col("after")).withColumn("price", F.explode(F.array(*[F.lit(p) for p in PRICES])))
    priced = priced.withColumn("per_read", half_up(F.col("saved") / 1_000_000 * F.col("price"), 3))
    priced = priced.withColumn("monthly", half_up(F.col("per_read") * READS_A_MONTH, 2))
    return priced.withColumn("with_iterations", half_up(F.col("monthly") * FEWER_ITERATIONS, 2))


def directory_savings(files: DataFrame, scores: DataFrame) -> DataFrame:
    """(price, files, tokens, after, saved, monthly): sums over all files; the month is reckoned from the total, unrounded."""
    each = token_savings(files, scores)
    total = each.groupBy("price").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("after").alias("after"), F.sum("saved").alias("saved"))
    return total.withColumn("monthly", F.col("saved") / 1_000_000 * F.col("price") * READS_A_MONTH)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(strategy, content) of a folder of markdown pages named by strategy."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("strategy"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def guidance(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(smell, strategy, content) for the smells among the findings; content is null without a page."""
    names = found.select("smell").distinct().join(F.broadcast(strategies(found.sparkSession)), "smell")
    return names.join(pages, "strategy", "left").select("smell", "strategy", "content")
