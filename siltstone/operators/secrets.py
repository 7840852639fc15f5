"""Secret scan over files: keyword gate, patterns, entropy, filters, companions and redaction.

One Arrow pass: an automaton finds all keywords of all rules in one walk over a text, and only rules
whose keywords occur are matched, with a pattern engine that has RE2's classes and boundaries. What
follows (severity, redaction, allow comments, companions) is DataFrame code.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redacted
from .declared import no_secret, predicate, skipped
from .secret_rules import Rule, built_in

# Literals that are never secrets, and marks that allow a finding.
PLACEHOLDERS = ("your-api-key-here", "your-token-here", "your-secret-here", "default_value", "placeholder", "example", "super_secret_jwt_value", "hardcoded_password_123")
PLACEHOLDER_PREFIX = "this_is_just_a_"
ALLOW = "gitleaks:allow"
SEVERE, SERIOUS = 4.5, 3.5
# End of fixed values.

SCHEMA = "path string, rule string, line int, column int, secret string, entropy double, reported boolean, allowed boolean"
ARROW = pa.schema([("path", pa.string()), ("rule", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("secret", pa.string()), ("entropy", pa.float64()), ("reported", pa.bool_()), ("allowed", pa.bool_())])


def shannon(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


class Matcher:
    """Compiled rules behind one keyword automaton; compiled on first use in a worker."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = [r for r in rules if r.pattern]
        self.compiled: dict[int, object] = {}
        self.always = [i for i, r in enumerate(self.rules) if not r.keywords]
        self.automaton = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                of.setdefault(k, []).append(i)
        for k, which in of.items():
            self.automaton.add_word(k, which)
        if of:
            self.automaton.make_automaton()

    def pattern(self, i: int):
        if i not in self.compiled:
            import regex

            text = self.rules[i].pattern.replace("[[:alnum:]]", "[0-9A-Za-z]").replace("(?-i:atlasv1)", "atlasv1")
            self.compiled[i] = regex.compile(re.sub(r"\$(?=$|\)|\|)", r"\\Z", text), regex.VERSION1 | regex.ASCII)
        return self.compiled[i]

    def find(self, path: str, text: str):
        """(rule, start, end, secret) of all matches of the rules whose keywords occur."""
        low = text.lower()
        due = set(self.always)
        if len(self.automaton):
            for _, which in self.automaton.iter(low):
                due.update(which)
        for i in sorted(due):
            rule = self.rules[i]
            if rule.path and not re.search(rule.path.replace("(?i)", ""), path or "", re.IGNORECASE if "(?i)" in rule.path else 0):
                continue
            for m in self.pattern(i).finditer(text):
                secret = m[rule.group] if rule.group else next((g for g in m.groups() if g), m[0])
                yield rule, m.start(), m.end(), secret


@cache
def matcher(rules: tuple[Rule, ...]) -> Matcher:
    return Matcher(list(rules))


def candidates(files: DataFrame, rules: list[Rule] | None = None, filter_mode: str = "as_loaded") -> DataFrame:
    """All matches, also those that aren't reported.

    ``filter_mode`` "declared" leaves out the paths that aren't searched and applies the filters of all
    rules (placeholders, variables) and of each rule (entropy bounds, expressions).
    """
    if filter_mode not in ("as_loaded", "declared"):
        raise ValueError(filter_mode)
    chosen = tuple(built_in() if rules is None else rules)

    def run(batches):
        found, declared = matcher(chosen), filter_mode == "declared"
        tests = {r.id: predicate(r.filter, shannon) for r in chosen if declared and r.filter}
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if declared and skipped(path):
                    continue
                lines = None
                for rule, start, end, secret in found.find(path, text):
                    bits = shannon(secret)
                    if declared and (no_secret(secret) or rule.entropy is not None and bits <= rule.entropy):
                        continue
                    lines = lines or text.split("\n")
                    at = text.count("\n", 0, start)
                    if rule.id in tests and tests[rule.id]({"secret": secret, "match": text[start:end], "line": lines[at], "path": path}):
                        continue
                    column = len(text[text.rfind("\n", 0, start) + 1 : start].encode()) + 1
                    rows.append((path, rule.id, at + 1, column, secret, bits, rule.report, any(ALLOW in x for x in lines[max(0, at - 1) : at + 2])))
            columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW.types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

    return files.select("path", F.coalesce("source", F.lit("")).alias("source")).mapInArrow(run, SCHEMA)


def severity(bits: Column) -> Column:
    return F.when(bits >= SEVERE, "critical").when(bits >= SERIOUS, "alert").otherwise("warning")


def false_positive(secret: Column) -> Column:
    """Placeholders, and a bare token header without a payload."""
    low = F.lower(secret)
    return low.isin(*PLACEHOLDERS) | low.startswith(PLACEHOLDER_PREFIX) | (secret.startswith("eyJ") & ~secret.contains(".") & (F.octet_length(secret) <= 50))


def with_companions(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Without matches of rules that need another rule's match in the file, near enough, and have none."""
    needs = [(r.id, need, within) for r in rules for need, within in r.required]
    if not needs:
        return found
    wanted = found.sparkSession.createDataFrame(needs, "rule string, need string, within int")
    others = found.select("path", F.col("rule").alias("need"), F.col("line").alias("line2")).distinct()
    asked = found.select("path", "rule", "line").distinct().join(F.broadcast(wanted), "rule")  # a row for each need of a rule
    near = F.col("within").isNull() | (F.abs(F.col("line") - F.col("line2")) <= F.col("within"))
    missing = asked.join(others.withColumnRenamed("path", "path2"), (F.col("path") == F.col("path2")) & (asked["need"] == others["need"]) & near, "left_anti").select("path", "rule", "line").distinct()
    return found.join(missing, ["path", "rule", "line"], "left_anti")


def scan(files: DataFrame, rules: list[Rule] | None = None, filter_mode: str = "as_loaded") -> DataFrame:
    """(path, rule, line, column, secret, entropy, severity) of reported findings; secrets are redacted."""
    chosen = built_in() if rules is None else rules
    found = with_companions(candidates(files, chosen, filter_mode), chosen)
    kept = found.where(F.col("reported") & ~F.col("allowed") & ~false_positive(F.col("secret")))
    return kept.select("path", "rule", "line", "column", redacted(F.col("secret")).alias("secret"), F.round("entropy", 6).alias("entropy"), severity(F.col("entropy")).alias("severity"))


# What a finding says.
MESSAGE = 'CRITICAL: %s detected on line %d. %s. You MUST rewrite this to use environment variables (e.g., os.Getenv("VAR_NAME")). Never hardcode secrets in source code.'
# End of fixed values.


def explained(found: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``found`` with the ``description`` of its rule and a ``message`` that says what to do; a rule without a description is described by its id."""
    known = [(r.id, r.description or r.id) for r in (built_in() if rules is None else rules)]
    told = found.join(F.broadcast(found.sparkSession.createDataFrame(known, "rule string, description string")), "rule", "left")  # a row for each rule
    return told.withColumn("message", F.format_string(MESSAGE, "rule", "line", "description"))


def has_findings(files: DataFrame, rules: list[Rule] | None = None) -> bool:
    """Whether anything is found at all; placeholders count, allowed lines don't."""
    chosen = built_in() if rules is None else rules
    return not with_companions(candidates(files, chosen), chosen).where(F.col("reported") & ~F.col("allowed")).isEmpty()
