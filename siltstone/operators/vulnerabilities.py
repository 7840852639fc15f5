"""Vulnerability scan: one pass over files without a shuffle, at most one finding per rule and file.

A file that holds none of the literals of any rule, and renames no import, is done after one search for
these literals. The others go through four steps, which Spark evaluates once each and doesn't fold into
one another: comment lines, multi-line strings, import aliases, rules. All rules are built-in expressions,
in groups so that no generated method grows too long; gates on the extension come first. Patterns are
rewritten so that Java reads them as RE2 does.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import portable
from .vulnerability_rules import HASH_COMMENTS, PY, RULES, SLASH_COMMENTS, WORKFLOW, WORKFLOW_PATH, Rule

TRIPLE = r"'''[^']*'''|\"\"\"[^\"]*\"\"\""
ALIAS = r"(?m)^(?:import\s+(\S+)\s+as\s+(\S+)|from\s+\S+\s+import\s+(\S+)\s+as\s+(\S+))"
SCHEMA = "array<struct<rule: string, category: string, severity: string, at: int>>"
GROUP = 8


def blank(c: Column) -> Column:
    """As many spaces as the string has bytes."""
    return F.repeat(F.lit(" "), F.octet_length(c).cast("int"))


def without_comment_lines(source: Column, ext: Column) -> Column:
    """Comment lines as spaces; their indentation goes."""

    def lines(mark: str) -> Column:
        one = lambda x: F.when(F.ltrim(x, F.lit(" \t")).startswith(mark), blank(F.ltrim(x, F.lit(" \t")))).otherwise(x)
        return F.array_join(F.transform(F.split(source, "\n"), one), "\n")

    return F.when(ext.isin(*PY, *HASH_COMMENTS), lines("#")).when(ext.isin(*SLASH_COMMENTS), lines("//")).otherwise(source)


def without_long_strings(text: Column, ext: Column) -> Column:
    """For Python, triple-quoted strings as spaces."""
    pieces = F.arrays_zip(F.split(text, TRIPLE).alias("a"), F.concat(F.regexp_extract_all(text, F.lit(f"({TRIPLE})")), F.array(F.lit(""))).alias("b"))
    python = F.array_join(F.transform(pieces, lambda p: F.concat(p["a"], blank(F.coalesce(p["b"], F.lit(""))))), "")
    return F.when(ext.isin(*PY) & text.rlike(TRIPLE), python).otherwise(text)


def without_aliases(text: Column) -> Column:
    """``alias.`` as ``module.`` for every ``import module as alias``, in the order of the imports."""
    found = lambda k: F.regexp_extract_all(text, F.lit(ALIAS), F.lit(k))
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x != "", x).otherwise(y))
    both = F.arrays_zip(pair(found(1), found(3)).alias("module"), pair(found(2), found(4)).alias("alias"))
    quoted = lambda p: F.concat(F.lit(r"(?<![0-9A-Za-z_])\Q"), p["alias"], F.lit(r"\E\."))
    return F.when(text.rlike(ALIAS), F.aggregate(both, text, lambda t, p: F.regexp_replace(t, quoted(p), F.concat(F.replace(F.replace(p["module"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit("."))))).otherwise(text)


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside all groups."""
    out, depth, inside, k, start = [], 0, False, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


def needles(pattern: str, least: int = 3) -> tuple[str, ...] | None:
    """Literals of which every match holds one, the longest of each alternative; None where one has none."""
    if "(?i)" in pattern:
        return None
    found = []
    for branch in branches(pattern):
        runs, run, depth, inside, k = [], "", 0, False, 0
        while k < len(branch):
            c, step, literal = branch[k], 1, ""
            if c == "\\":
                step, literal = 2, branch[k + 1] if not branch[k + 1].isalnum() else ""
            elif inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            elif c in "()":
                depth += 1 if c == "(" else -1
            elif c not in ".^$*+?{}":
                literal = c
            optional = branch[k + step : k + step + 1] in ("?", "*", "{")
            if literal and not depth and not inside and not optional:
                run += literal
            else:
                runs.append(run)
                run = ""
            k += step
        best = max([*runs, run], key=len)
        if len(best) < least:
            return None
        found.append(best)
    return tuple(dict.fromkeys(found))


#: Literals, as ``needles`` would give them, of the patterns in which it finds none; "sha" ones stand in lower case.
SHORT_NEEDLES = {
    "pickle_variants_load": ("Pickle.", "pickle.", "dill."),
    "torch_unsafe_load": ("torch.load", "torch_load"),
    "yaml_unsafe_load_variants": ("unsafe_load",),
    "xml_unsafe_parse": ("ElementTree.", "ET.", "minidom.parse", "xml.sax."),
    "javascript_sql_injection": (".query", ".execute", ".prepare"),
    "python_ssrf_urllib": ("request.urlopen", "urllib2.urlopen", "httpx.get", "ClientSession"),
}
SMALL_NEEDLES = {"weak_hash_sha1": ("sha1", "sha-1")}


def any_of(text: Column, literals) -> Column:
    return reduce(lambda x, y: x | y, [text.contains(n) for n in literals], F.lit(False))


def due(rule: Rule, text: Column) -> Column | None:
    """Whether a text holds a literal that every match of the rule's pattern holds; None for patterns without one."""
    if rule.name in SMALL_NEEDLES:
        return any_of(F.lower(text), SMALL_NEEDLES[rule.name])
    found = SHORT_NEEDLES.get(rule.name) or needles(rule.pattern)
    return any_of(text, found) if found else None


def gate_pattern(rules: tuple[Rule, ...]) -> str | None:
    """One pattern that every file with a match of a rule matches, or whose renamed imports may spell one; None if a rule has no literal."""
    if any(r.pattern and r.name not in SMALL_NEEDLES and r.name not in SHORT_NEEDLES and not needles(r.pattern) for r in rules):
        return None
    plain = {n for r in rules for n in (*r.literals, *(SHORT_NEEDLES.get(r.name) or (needles(r.pattern) if r.pattern else None) or ()))}
    held = sorted(n for n in plain if not any(m != n and m in n for m in plain))  # what holds a shorter one is found by that
    quoted = lambda n: re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", n)
    small = [f"(?i:{quoted(n)})" for r in rules for n in SMALL_NEEDLES.get(r.name, ())]
    return "|".join([*map(quoted, held), *small, ALIAS])


def worth_reading(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(path, ext, source) of the files in which any rule can match: by a literal, by a path, or because of renamed imports.

    One automaton for all literals, over Arrow columns; Spark's own search for a literal takes longer for
    each of them than this does for all.
    """
    pattern, rows = gate_pattern(rules), files.select("path", "ext", "source")
    if pattern is None:
        return rows

    def run(batches):
        for batch in batches:
            held = pc.match_substring_regex(batch.column(2), pattern)
            yield batch.filter(pc.or_kleene(held, pc.match_substring_regex(batch.column(0), WORKFLOW_PATH)))

    return rows.mapInArrow(run, "path string, ext string, source string")


def position(rule: Rule, text: Column, ext: Column) -> Column:
    """1-based character of the first match; null without one."""
    tries = [F.nullif(F.regexp_instr(text, F.lit(portable(rule.pattern))), F.lit(0))] if rule.pattern else []
    if rule.pattern and (gate := due(rule, text)) is not None:  # a search for literals is far cheaper than a pattern
        tries = [F.when(gate, tries[0])]
    tries += [F.nullif(F.locate(x, text), F.lit(0)) for x in rule.literals]
    at = F.coalesce(*tries)
    gate = F.lit(True)
    if rule.only:
        gate = ext.isin(*rule.only)
    if rule.never:
        gate = ~ext.isin(*rule.never)
    if rule.unless:
        at = F.when(at.isNotNull() & ~text.rlike(portable(rule.unless)), at)
    return F.when(gate, at)


def scan(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, rule, category, severity, line, column) of the first match of each rule in each file; columns in bytes."""
    cleaned = worth_reading(files.where("source <> ''"), rules).withColumnRenamed("source", "text")
    for step in (lambda t: without_comment_lines(t, F.col("ext")), lambda t: without_long_strings(t, F.col("ext")), without_aliases):
        # a generator is a border: what stands behind it refers to the text and doesn't repeat the step
        cleaned = cleaned.select("path", "ext", F.explode(F.array(step(F.col("text")))).alias("text"))

    def hit(rule: Rule, at: Column) -> Column:
        return F.when(at.isNotNull(), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"), at.cast("int").alias("at")))

    groups = [F.array(*[hit(r, position(r, F.col("text"), F.col("ext"))) for r in rules[k : k + GROUP]]) for k in range(0, len(rules), GROUP)]
    workflow = hit(WORKFLOW, F.when(F.col("path").rlike(WORKFLOW_PATH), F.lit(1)))
    found = cleaned.select("path", "text", F.explode(F.filter(F.concat(F.array(workflow), *groups), lambda x: x.isNotNull())).alias("f"))
    before = F.left(F.col("text"), F.col("f.at") - 1)
    return found.select(
        "path", "f.rule", "f.category", "f.severity", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"), (F.octet_length(F.substring_index(before, "\n", -1)) + 1).cast("int").alias("column")
    )
