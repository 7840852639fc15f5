"""Detectors that follow a file or function line by line: long switches and long-lived variables.

Both are sequential by nature; they run as Arrow passes over files or functions, without a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.config import BY_LANGUAGE, DEFAULT
from .functions import split_lines

SMELL_SCHEMA = "path string, smell string, severity string, line_start int, line_end int, value double"
ARROW = pa.schema([("path", pa.string()), ("smell", pa.string()), ("severity", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("value", pa.float64())])

# How switches and their branches begin.
SWITCH = re.compile(r"(?:.*[ \t])?(?:switch|match)[ (]|case .*(?:when |of )|when (?!.*=)")
BRANCH = re.compile(r"(?:.*[ \t])?(?:case[ \t]|default[: ])|when (?:.*then|[^=(]*$)")
INDENTED = re.compile(r"case[ \t]|when [^=]*$")
# End of fixed values.


def is_comment(text: str) -> bool:
    return text.startswith(("//", "#", "/*", "*"))


def indent(line: str) -> int:
    return sum(4 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip(" \t"))])


def switches(lines: list[str]) -> list[tuple[int, int, int]]:
    """(first line, last line, branches) of the outermost switches; inner ones count with the outer."""
    texts, found, at = [x.strip() for x in lines], [], 0
    while at < len(lines):
        if not texts[at] or is_comment(texts[at]) or not SWITCH.match(texts[at]):
            at += 1
            continue
        depth, inside, branches, end = 0, False, 0, at + 1
        for k in range(at, len(lines)):
            text = texts[k]
            if not text or is_comment(text):
                continue
            depth += text.count("{")
            inside = inside or "{" in text
            branches += inside and bool(BRANCH.match(text))
            depth = max(0, depth - text.count("}"))
            end = k + 1
            if inside and depth == 0:
                break
        if not branches:  # no braces: what is indented deeper belongs to it
            end, base = at + 1, indent(lines[at])
            for k in range(at + 1, len(lines)):
                if not texts[k] or is_comment(texts[k]):
                    continue
                if indent(lines[k]) <= base:
                    end = k
                    break
                branches += bool(INDENTED.match(texts[k]))
                end = k + 1
        found.append((at + 1, end, branches))
        at = max(end, at + 1)
    return found


def _smells(source: DataFrame, columns: list[str], of) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [row for x in zip(*(batch.column(k).to_pylist() for k in range(len(columns))), strict=True) for row in of(*x)]
            data = zip(*rows, strict=True) if rows else [[]] * len(ARROW.types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, ARROW.types, strict=True)], schema=ARROW)

    return source.select(*columns).mapInArrow(run, SMELL_SCHEMA)


def long_switch(files: DataFrame) -> DataFrame:
    def of(path, lang, source):
        t = BY_LANGUAGE.get(lang, DEFAULT)
        for start, end, n in switches(split_lines(source or "")):
            if n >= t.switch_w:
                yield path, "long_switch", "alert" if n >= t.switch_a else "warning", start, end, float(n)

    return _smells(files, ["path", "lang", "source"], of)


def declared(text: str) -> str:
    """The name that a line declares; empty if none."""
    low = text.lower()
    if low.startswith("var ") and len(text.split()) >= 2:
        return text.split()[1]
    if ":=" in text and text.partition(":=")[0].strip():
        return text.partition(":=")[0].strip()
    if low.startswith(("let ", "const ")):
        return next((p.rstrip("=;") for p in text.split()[1:] if p != "=" and not p.startswith("//")), "")
    return ""


def lifetimes(body: list[str], start: int, gap: int) -> list[tuple[str, int, int]]:
    """(name, since, used) of variables whose uses lie ``gap`` lines or more apart, declared near the start.

    Names are tried in the order of their declaration and one name is served per line; a nearer use
    moves the place that later uses are measured from.
    """
    found, since = [], {}
    for number, line in enumerate(body, start):
        text = line.strip()
        if not text or is_comment(text):
            continue
        name = declared(text)
        if name:
            since.setdefault(name, number)
        for known, at in since.items():
            if known in text and number > at:
                if number - at < gap:
                    since[known] = number
                else:
                    if at <= start + 10:
                        found.append((known, at, number))
                    del since[known]
                break
    return found


def long_scope_variable(functions: DataFrame) -> DataFrame:
    def of(path, lang, name, start, count, body):
        gap = BY_LANGUAGE.get(lang, DEFAULT).long_scope
        if count >= gap and name not in ("unknown", "anonymous"):
            for _, since, used in lifetimes(body, start, gap):
                yield path, "long_scope_variable", "warning", since, used, float(used - since)

    return _smells(functions, ["path", "lang", "name", "line_start", "line_count", "body"], of).where(F.col("path").isNotNull())
