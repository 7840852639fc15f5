"""Registered queries of the code-analytics engine over the driver's tables and a few code fixtures, with their SQL."""

from __future__ import annotations

import dataclasses

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, redacted
from ..operators import advice, blocks, changes, function_smells, lint, report, score, secrets, smells, vulnerabilities
from ..operators.functions import functions
from ..operators.lines import lines
from ..operators.secret_rules import built_in
from ..operators.vulnerability_rules import HASH_COMMENTS, PY, RULES, SLASH_COMMENTS
from ..sources.config import BY_LANGUAGE, DEFAULT, Thresholds
from ..sources.corpus import files
from ..streaming.ingest import event_counts
from . import fixtures


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer partitions than there are cores, as files of one row group do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, whole, as files, and the code fixtures."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("documents/%d.go", "doc_id").alias("path"), F.lit("go").alias("lang"), F.col("text").alias("source"))
    pages = table(spark, sf_dir, "pages").select(F.format_string("pages/%d.html", "page_id").alias("path"), F.lit("html").alias("lang"), F.col("html").alias("source"))
    code = spark.createDataFrame(fixtures.FILES, "path string, lang string, source string")
    return files(code.unionByName(spread(docs)).unionByName(spread(pages)), lang="lang")


def _on_lines(f):
    return lambda spark, sf_dir: f(lines(corpus(spark, sf_dir)))


def _on_functions(f):
    return lambda spark, sf_dir: f(functions(corpus(spark, sf_dir)))


def file_lines(spark, sf_dir):
    rows = lines(corpus(spark, sf_dir))
    return rows.groupBy("path", "lang").agg(F.count("*").alias("n"), F.sum(F.col("blank").cast("int")).alias("blanks"), F.sum(F.col("comment").cast("int")).alias("comments"), F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))


def function_extents(spark, sf_dir):
    return functions(corpus(spark, sf_dir)).select("path", "lang", "name", "line_start", "line_count")


def brain_class(spark, sf_dir):
    table_ = corpus(spark, sf_dir)
    return function_smells.brain_class(functions(table_), lines(table_))


def cohesion(spark, sf_dir):
    return function_smells.cohesion(functions(corpus(spark, sf_dir)))


def quality_scores(spark, sf_dir):
    table_ = corpus(spark, sf_dir)
    made = score.prepared(table_)
    return score.quality(table_, score.all_smells(table_, made), made)


def quality_overall(spark, sf_dir):
    return score.overall(quality_scores(spark, sf_dir))


def quality_labels(spark, sf_dir):
    return score.distribution(quality_scores(spark, sf_dir))


def smell_severities(spark, sf_dir):
    table_ = corpus(spark, sf_dir)
    return score.severities(score.all_smells(table_, score.prepared(table_)))


def vulnerability_findings(spark, sf_dir):
    return vulnerabilities.scan(corpus(spark, sf_dir))


def vulnerability_tiers(spark, sf_dir):
    return score.risk_tier(vulnerability_findings(spark, sf_dir))


def secret_findings(spark, sf_dir):
    found = secrets.scan(corpus(spark, sf_dir))
    return found.groupBy("path", "rule").agg(F.count("*").alias("n"), F.min("secret").alias("secret"))


def secret_text_functions(spark, sf_dir):
    """Redaction of every event's properties, as a check of byte-wise text functions on a whole table."""
    return table(spark, sf_dir, "events").select("event_id", redacted(F.col("props")).alias("shown"), F.octet_length("props").cast("long").alias("n_bytes"))


def commit_log(spark, sf_dir):
    """Events as commits: the user is the file, the event type the author."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("commit_hash"), F.col("event_type").alias("author"), F.format_string("documents/%d.go", "user_id").alias("path"))


def churn(spark, sf_dir):
    return changes.churn(commit_log(spark, sf_dir))


def scored(spark, sf_dir):
    """(files, findings, scores) of the corpus; lines and functions are kept."""
    table_ = corpus(spark, sf_dir)
    made = score.prepared(table_)
    found = score.all_smells(table_, made)
    return table_, found, score.quality(table_, found, made)


def hotspots(spark, sf_dir):
    return changes.hotspots(commit_log(spark, sf_dir), quality_scores(spark, sf_dir))


def hotspots_top(spark, sf_dir):
    return changes.top_hotspots(hotspots(spark, sf_dir)).select("rank", "path", "commits", "authors", "score", "priority")


def hotspot_smells(spark, sf_dir):
    return changes.hotspot_smell(hotspots(spark, sf_dir))


def middle_ranges(spark, sf_dir):
    """The middle half of the lines of every file, as if it were changed."""
    n = F.count("*")
    return lines(corpus(spark, sf_dir)).groupBy("path").agg((F.floor(n / 4) + 1).cast("int").alias("start"), F.ceil(n * 3 / 4).cast("int").alias("end"))


def changed_findings(spark, sf_dir):
    """Findings of all detectors that touch the middle half of the lines of any file."""
    return changes.changed_findings(scored(spark, sf_dir)[1], middle_ranges(spark, sf_dir))


def findings_of_change(spark, sf_dir):
    """Findings of the files that the log names, in the middle half of their lines; pages come without ranges and keep all."""
    ranges = middle_ranges(spark, sf_dir).where("path not like 'pages/%'")
    changed = commit_log(spark, sf_dir).select("path").unionByName(corpus(spark, sf_dir).where("path like 'pages/%'").select("path"))
    return changes.findings_of_change(scored(spark, sf_dir)[1], ranges, changed)


def token_costs(spark, sf_dir):
    table_, _, scores = scored(spark, sf_dir)
    return changes.token_costs(table_, scores)


def token_savings(spark, sf_dir):
    table_, _, scores = scored(spark, sf_dir)
    return advice.token_savings(table_, scores)


def directory_savings(spark, sf_dir):
    table_, _, scores = scored(spark, sf_dir)
    return advice.directory_savings(table_, scores)


def assessments(spark, sf_dir):
    _, found, scores = scored(spark, sf_dir)
    return advice.assessments(scores, found)


def score_histogram(spark, sf_dir):
    return score.histogram(quality_scores(spark, sf_dir), "score")


def findings_by_severity(spark, sf_dir):
    return score.by_severity(scored(spark, sf_dir)[1])


def refactoring_strategies(spark, sf_dir):
    return changes.suggested(scored(spark, sf_dir)[1], changes.strategies(spark)).select("path", F.array_join("strategies", ",").alias("strategies"))


def misspelled_words(spark, sf_dir):
    return lint.misspell(lines(corpus(spark, sf_dir)))


def language_counts(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("n_bytes"))


def all_findings(spark, sf_dir):
    """Entries of all scans, kept, as reports read them more than once."""
    table_, found, _ = scored(spark, sf_dir)
    return report.entries(found, secrets.scan(table_), vulnerabilities.scan(table_)).persist(StorageLevel.MEMORY_AND_DISK)


def problem_lines(spark, sf_dir):
    return report.problems(all_findings(spark, sf_dir))


def sarif_rules(spark, sf_dir):
    return report.sarif_rules(all_findings(spark, sf_dir))


def sarif_results(spark, sf_dir):
    return report.sarif_results(all_findings(spark, sf_dir))


def sarif_log(spark, sf_dir):
    return report.sarif_log(all_findings(spark, sf_dir), "siltstone", "1.0")


def json_report(spark, sf_dir):
    table_, found, scores = scored(spark, sf_dir)
    return report.json_report(scores, found, secrets.scan(table_), vulnerabilities.scan(table_))


def secret_severities(spark, sf_dir):
    """Every reported secret, redacted, with its entropy and severity."""
    return secrets.scan(corpus(spark, sf_dir)).select("path", "rule", "secret", "entropy", "severity")


def scan_events(spark, sf_dir):
    return event_counts(table(spark, sf_dir, "events"))


QUERIES = {
    "file_lines": file_lines,
    "function_extents": function_extents,
    **{f"smell_{f.__name__}": _on_lines(f) for f in smells.LINE_DETECTORS},
    **{f"smell_{f.__name__}": _on_functions(f) for f in (function_smells.brain_method, function_smells.complex_method, function_smells.bumpy_road, function_smells.function_count, function_smells.lazy_element, function_smells.code_duplication, function_smells.low_cohesion, blocks.long_scope_variable)},
    "smell_brain_class": brain_class,
    "smell_long_switch": lambda spark, sf_dir: blocks.long_switch(corpus(spark, sf_dir)),
    "cohesion": cohesion,
    "quality_scores": quality_scores,
    "quality_overall": quality_overall,
    "quality_labels": quality_labels,
    "smell_severities": smell_severities,
    "vulnerability_findings": vulnerability_findings,
    "vulnerability_tiers": vulnerability_tiers,
    "secret_findings": secret_findings,
    "secret_text_functions": secret_text_functions,
    "churn": churn,
    "hotspots": hotspots,
    "changed_findings": changed_findings,
    "changed_smells": changed_findings,
    "findings_of_change": findings_of_change,
    "hotspots_top": hotspots_top,
    "hotspot_smells": hotspot_smells,
    "token_costs": token_costs,
    "token_savings": token_savings,
    "directory_savings": directory_savings,
    "assessments": assessments,
    "score_histogram": score_histogram,
    "findings_by_severity": findings_by_severity,
    "secret_severities": secret_severities,
    "sarif_log": sarif_log,
    "refactoring_strategies": refactoring_strategies,
    "misspelled_words": misspelled_words,
    "language_counts": language_counts,
    "problem_lines": problem_lines,
    "sarif_rules": sarif_rules,
    "sarif_results": sarif_results,
    "json_report": json_report,
    "scan_events": scan_events,
}

# --- SQL -----------------------------------------------------------------------------------------


def occ(c: str, literal: str) -> str:
    return f"((length({c}) - length(replace({c}, {fixtures.text(literal)}, ''))) // {len(literal)})"


_THRESHOLDS = fixtures.values([(lang, *dataclasses.astuple(t)) for lang, t in {"*": DEFAULT, **BY_LANGUAGE}.items()])
_NAMES = ", ".join(f.name for f in dataclasses.fields(Thresholds))
_KNOWN = ", ".join(f"'{x}'" for x in BY_LANGUAGE)
FILES = f"""
files AS (SELECT path, lang, source FROM (VALUES {fixtures.values(fixtures.FILES)}) v(path, lang, source)
          UNION ALL SELECT 'documents/' || doc_id || '.go', 'go', coalesce(text, '') FROM documents
          UNION ALL SELECT 'pages/' || page_id || '.html', 'html', coalesce(html, '') FROM pages),
th AS (SELECT * FROM (VALUES {_THRESHOLDS}) v(lang_key, {_NAMES}))"""
LINES = f"""{FILES},
sp AS (SELECT path, lang, CASE WHEN source = '' THEN []::VARCHAR[]
              ELSE string_split(CASE WHEN right(source, 1) = chr(10) THEN left(source, length(source) - 1) ELSE source END, chr(10)) END AS ls FROM files),
ln AS (SELECT path, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM sp),
lines AS (SELECT path, lang, line_no, text, lower(text) AS low, text = '' AS blank, regexp_matches(text, '^(//|#|/\\*|\\*)') AS comment,
                 {occ("text", "{")} AS opens, {occ("text", "}")} AS closes
          FROM (SELECT *, regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM ln))"""
TH = f"JOIN th ON lang_key = CASE WHEN lang IN ({_KNOWN}) THEN lang ELSE '*' END"
SOLID = "NOT blank AND NOT comment"
SIG = "(contains(low, 'func ') OR starts_with(low, 'def ') OR starts_with(low, 'async def '))"


def graded(v: str, w: str, a: str) -> str:
    return f"CASE WHEN {v} >= {a} THEN 'alert' WHEN {v} >= {w} THEN 'warning' END"


def row(name: str, severity: str, start: str, end: str, value: str) -> str:
    return f"path, '{name}' AS smell, {severity} AS severity, ({start})::INT AS line_start, ({end})::INT AS line_end, ({value})::DOUBLE AS value"


_PRIMS = " + ".join([occ("low", p + e) for p in smells.PRIMITIVES for e in (",", ")", " ")] + [f"ends_with(low, '{p}')::INT" for p in smells.PRIMITIVES])
_BRANCHES = " + ".join(occ("low", b) for b in smells.BRANCHES)
_CHAIN = smells.CHAIN.replace("'", "''")

#: The functions of the fixtures, worked out by hand: path, language, order, name, first line, lines.
FUNCTION_ROWS = [
    ("fix/deep.go", "go", 0, "Deep", 3, 12),
    ("fix/bumps.go", "go", 0, "Bumps", 3, 15),
    ("fix/bumps.go", "go", 1, "tiny", 19, 2),
    ("fix/bumps.go", "go", 2, "Wide", 22, 4),
    ("fix/condition.py", "python", 0, "pick", 1, 7),
    ("fix/condition.py", "python", 1, "many", 8, 3),
    ("fix/globals.go", "go", 0, "f", 6, 3),
    ("fix/switch.go", "go", 0, "pick", 1, 30),
    ("fix/long.go", "go", 0, "Long", 1, 94),
    ("fix/twins.go", "go", 0, "First", 1, 12),
    ("fix/twins.go", "go", 1, "Second", 14, 12),
    *[("fix/loose.go", "go", k, f"F{k}", 1 + 5 * k, 4) for k in range(6)],
    *[("fix/big.go", "go", k, f"B{k}", 1 + 40 * k, 40) for k in range(26)],
    ("fix/risks.py", "python", 0, "run", 6, 9),
    ("fix/risks.py", "python", 1, "hash", 15, 2),
    ("fix/risks.js", "javascript", 0, "const run =", 1, 6),
    ("fix/risks.go", "go", 0, "get", 1, 5),
]
FN = f"""fn AS (SELECT * FROM (VALUES {fixtures.values(FUNCTION_ROWS)}) v(path, lang, ord, name, line_start, line_count)),
body AS (SELECT fn.*, l.line_no - line_start + 1 AS k, l.text, l.low, l.blank, l.comment, l.opens, l.closes
         FROM fn JOIN lines l ON l.path = fn.path AND l.line_no BETWEEN line_start AND line_start + line_count - 1)"""
REAL = "name NOT IN ('unknown', 'anonymous') AND line_count >= 3"


def _java_free(pattern: str) -> str:
    return pattern.replace("'", "''")


def _vulnerability_sql() -> str:
    def gate(r):
        parts = []
        if r.only:
            parts.append(f"ext IN ({', '.join(fixtures.text(x) for x in r.only)})")
        if r.never:
            parts.append(f"ext NOT IN ({', '.join(fixtures.text(x) for x in r.never)})")
        if r.unless:
            parts.append(f"NOT regexp_matches(text, '{_java_free(r.unless)}')")
        return " AND ".join(parts) or "true"

    def at(r):
        tries = [f"CASE WHEN regexp_matches(text, '{_java_free(r.pattern)}') THEN length(regexp_replace(text, '(?:{_java_free(r.pattern)})(?s:.*)', '')) + 1 END"] if r.pattern else []
        tries += [f"nullif(strpos(text, {fixtures.text(x)}), 0)" for x in r.literals]
        return f"coalesce({', '.join(tries)})" if len(tries) > 1 else tries[0]

    union = "\n UNION ALL ".join(f"SELECT path, text, '{r.name}' AS rule, '{r.category}' AS category, '{r.severity}' AS severity, {at(r)} AS pos FROM clean WHERE {gate(r)}" for r in RULES)
    names = lambda xs: ", ".join(fixtures.text(x) for x in xs)
    blanked = lambda mark: f"array_to_string(list_transform(string_split(source, chr(10)), lambda x: CASE WHEN starts_with(ltrim(x, ' ' || chr(9)), '{mark}') THEN repeat(' ', strlen(ltrim(x, ' ' || chr(9)))) ELSE x END), chr(10))"
    alias = r"(?m)^(?:import\s+(\S+)\s+as\s+(\S+)|from\s+\S+\s+import\s+(\S+)\s+as\s+(\S+))"
    return f"""WITH {FILES},
    e AS (SELECT path, source, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM files WHERE source <> ''),
    c AS (SELECT path, ext, CASE WHEN ext IN ({names([*PY, *HASH_COMMENTS])}) THEN {blanked("#")} WHEN ext IN ({names(SLASH_COMMENTS)}) THEN {blanked("//")} ELSE source END AS text FROM e),
    a AS (SELECT *, list_transform(range(1, len(regexp_extract_all(text, '{alias}')) + 1), lambda i:
                   coalesce(nullif(regexp_extract_all(text, '{alias}', 1)[i], ''), regexp_extract_all(text, '{alias}', 3)[i]) || chr(9) ||
                   coalesce(nullif(regexp_extract_all(text, '{alias}', 2)[i], ''), regexp_extract_all(text, '{alias}', 4)[i])) AS names FROM c),
    clean AS (SELECT path, ext, list_reduce(list_prepend(text, names), lambda t, p: regexp_replace(t, '\\b' || regexp_escape(split_part(p, chr(9), 2)) || '\\.', split_part(p, chr(9), 1) || '.', 'g')) AS text FROM a),
    hits AS ({union}
      UNION ALL SELECT path, text, 'github_actions_workflow', 'workflow', 'warning', 1 FROM clean WHERE regexp_matches(path, '\\.github/workflows/.*\\.ya?ml$')),
    found AS (SELECT path, rule, category, severity, left(text, (pos - 1)::INT) AS before FROM hits WHERE pos IS NOT NULL)
    SELECT path, rule, category, severity, ({occ("before", chr(10))} + 1)::INT AS line, (strlen(string_split(before, chr(10))[-1]) + 1)::INT AS "column" FROM found"""


GENERIC = next(r for r in built_in() if r.id == "generic-api-key")  # the only built-in rule that the driver's tables trip
_VULN = _vulnerability_sql()
_PARA = f"""SELECT {row("paragraph_of_code", "'warning'", "min(line_no)", "max(line_no)", "count(*)")}
  FROM (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM lines WHERE {SOLID}) {TH}
  GROUP BY path, island, paragraph HAVING count(*) > paragraph"""

_NAMED = "name NOT IN ('unknown', 'anonymous')"
_WORDS = "list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce(string_agg(CASE WHEN NOT blank AND NOT comment THEN text END, chr(10) ORDER BY k), ''), '[0-9]', '0', 'g')), '[^a-z0-9_]+'), lambda x: length(x) > 2))"
_DUPLICATION = f"""WITH {LINES}, {FN},
    w AS (SELECT path, lang, ord, line_start, {_WORDS} AS words FROM body {TH} WHERE {_NAMED} AND line_count >= dup_lines GROUP BY path, lang, ord, line_start),
    p AS (SELECT a.path, a.lang, a.line_start AS x, b.line_start AS y, len(list_intersect(a.words, b.words)) / len(list_distinct(a.words || b.words)) AS alike FROM w a JOIN w b ON a.path = b.path AND a.ord < b.ord)
    SELECT {row("code_duplication", "'warning'", "x", "y", "round(alike, 2)")} FROM p {TH} WHERE alike >= dup_similarity"""
_STRIP = "[()\\[\\]{}*&,.;:\"'']+"
_TYPES = f"list_distinct(list_filter(list_transform(string_split_regex(string_agg(text, ' ' ORDER BY k), '\\s+'), lambda w: regexp_replace(w, '^{_STRIP}|{_STRIP}$', '', 'g')), lambda w: strlen(w) >= 3 AND NOT list_contains([{', '.join(fixtures.text(x) for x in function_smells.NOT_TYPES)}], lower(w)) AND regexp_matches(w, '^[A-Z]')))"
_COHESION = f"""WITH {LINES}, {FN},
    f AS (SELECT * FROM fn WHERE {_NAMED} AND line_count >= 2),
    c AS (SELECT path, count(*) AS n, count(DISTINCT name) AS names FROM f GROUP BY path),
    t AS (SELECT b.path, b.name, unnest({_TYPES}) AS type FROM body b JOIN (SELECT path, name, max(ord) AS ord FROM f GROUP BY ALL) l USING (path, name, ord) WHERE k <= 10 GROUP BY b.path, b.name),
    s AS (SELECT a.path, count(DISTINCT a.name) AS shared FROM t a JOIN t b ON a.path = b.path AND a.type = b.type AND a.name <> b.name GROUP BY a.path)
    SELECT path, n, names - coalesce(shared, 0) AS isolated, CASE WHEN n <= 3 THEN 1.0::DOUBLE ELSE (n - (names - coalesce(shared, 0))) / n END AS cohesion FROM c LEFT JOIN s USING (path)"""

#: Findings of the two sequential detectors in the fixtures, worked out by hand.
SEQUENTIAL_ROWS = [("fix/switch.go", "long_switch", "warning", 2, 29, 13.0), ("fix/long.go", "long_scope_variable", "warning", 2, 93, 91.0)]

ORACLE_SQL = {
    "smell_code_duplication": _DUPLICATION,
    "cohesion": _COHESION,
    "smell_low_cohesion": f"WITH c AS ({_COHESION}) SELECT {row('low_cohesion', 'CASE WHEN cohesion < 0.3 THEN ' + chr(39) + 'alert' + chr(39) + ' ELSE ' + chr(39) + 'warning' + chr(39) + ' END', '0', '0', 'cohesion')} FROM c WHERE n >= 5 AND cohesion < 0.5",
    **{f"smell_{x[1]}": f"SELECT path, smell, severity, line_start, line_end, value::DOUBLE AS value FROM (VALUES {fixtures.values([x])}) v(path, smell, severity, line_start, line_end, value)" for x in SEQUENTIAL_ROWS},
    "file_lines": f"""WITH {LINES} SELECT path, lang, count(*) AS n, sum(blank::INT)::BIGINT AS blanks, sum(comment::INT)::BIGINT AS comments,
        sum(opens)::BIGINT AS opens, sum(closes)::BIGINT AS closes FROM lines GROUP BY path, lang""",
    "function_extents": f"WITH {LINES}, {FN} SELECT path, lang, name, line_start, line_count FROM fn",
    "smell_deep_nesting": f"""WITH {LINES},
        s AS (SELECT path, lang, line_no, opens, sum(opens - closes) OVER w AS s FROM lines WHERE {SOLID} WINDOW w AS (PARTITION BY path ORDER BY line_no)),
        d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line_no)) AS depth FROM s),
        r AS (SELECT path, lang, line_no, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line_no), 0) + opens AS reach FROM d),
        m AS (SELECT path, lang, max(reach) AS most, arg_max(line_no, (reach, -line_no)) AS first_line FROM r GROUP BY path, lang)
        SELECT {row("deep_nesting", graded("most", "nesting_w", "nesting_a"), "first_line", "first_line", "most")} FROM m {TH} WHERE most >= nesting_w""",
    "smell_file_bloat": f"""WITH {LINES}, c AS (SELECT path, lang, count(*) AS loc FROM lines GROUP BY path, lang)
        SELECT {row("file_bloat", "CASE WHEN loc >= file_loc_c THEN 'critical' ELSE " + graded("loc", "file_loc_w", "file_loc_a") + " END", "0", "0", "loc")} FROM c {TH} WHERE loc >= file_loc_w""",
    "smell_complex_conditional": f"""WITH {LINES}, c AS (SELECT *, {occ("text", "&&")} + {occ("text", "||")} AS n FROM lines WHERE {SOLID} AND (starts_with(low, 'if ') OR starts_with(low, 'while ')))
        SELECT {row("complex_conditional", graded("n", "conditional_w", "conditional_a"), "line_no", "line_no", "n")} FROM c {TH} WHERE n >= conditional_w""",
    "smell_long_parameter_list": f"""WITH {LINES}, p AS (SELECT *, regexp_extract(text, '^[^(]*\\(([^)]*)\\)', 1) AS inside FROM lines WHERE {SOLID} AND {SIG}),
        c AS (SELECT *, CASE WHEN trim(inside) = '' THEN 0 ELSE {occ("inside", ",")} + 1 END AS n FROM p)
        SELECT {row("long_parameter_list", graded("n", "args_w", "args_a"), "line_no", "line_no", "n")} FROM c {TH} WHERE n >= args_w""",
    "smell_message_chains": f"""WITH {LINES}, c AS (SELECT *, len(regexp_extract_all(text, '{_CHAIN}')) AS n FROM lines WHERE NOT comment)
        SELECT {row("message_chains", "'warning'", "line_no", "line_no", "n")} FROM c WHERE n >= 2""",
    "smell_primitive_obsession": f"""WITH {LINES}, c AS (SELECT *, {_PRIMS} AS n FROM lines WHERE {SIG})
        SELECT {row("primitive_obsession", "'warning'", "line_no", "line_no", "n")} FROM c WHERE n >= 4""",
    "smell_paragraph_of_code": f"WITH {LINES} {_PARA}",
    "smell_excessive_comments": f"""WITH {LINES}, c AS (SELECT path, lang, count(*) AS a, sum((NOT blank)::INT) AS solid, sum(regexp_matches(text, '^(//|#|/\\*|\\*/)')::INT) AS notes FROM lines GROUP BY path, lang)
        SELECT {row("excessive_comments", "CASE WHEN notes / solid >= comments * 2 THEN 'alert' ELSE 'warning' END", "0", "0", "notes / solid")} FROM c {TH} WHERE a >= 10 AND solid > 0 AND notes / solid >= comments""",
    "smell_global_data": f"""WITH {LINES}, m AS (SELECT *, CASE WHEN contains(text, 'func ') OR starts_with(text, 'def ') OR starts_with(text, 'class ') THEN 1 WHEN text = '}}' THEN 0 END AS marker FROM lines WHERE {SOLID}),
        i AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS inside FROM m),
        c AS (SELECT path, lang, count(*) AS n FROM i WHERE marker IS NULL AND inside = 0 AND (starts_with(low, 'var ') OR starts_with(low, 'const ')
              OR (contains(low, ' = ') AND NOT contains(low, 'func') AND NOT contains(low, 'import') AND NOT contains(low, 'package'))) GROUP BY path, lang)
        SELECT {row("global_data", "'warning'", "0", "0", "n")} FROM c {TH} WHERE n >= globals_""",
    "smell_brain_method": f"WITH {LINES}, {FN} SELECT {row('brain_method', graded('line_count', 'func_loc_w', 'func_loc_a'), 'line_start', 'line_start + line_count', 'line_count')} FROM fn {TH} WHERE line_count >= func_loc_w",
    "smell_complex_method": f"""WITH {LINES}, {FN}, c AS (SELECT path, lang, ord, line_start, 1 + sum(CASE WHEN {SOLID} THEN {_BRANCHES} ELSE 0 END) AS n FROM body GROUP BY ALL)
        SELECT {row("complex_method", graded("n", "func_cc_w", "func_cc_a"), "line_start", "0", "n")} FROM c {TH} WHERE n >= func_cc_w""",
    "smell_function_count": f"WITH {LINES}, {FN}, c AS (SELECT path, lang, count(*) AS n FROM fn WHERE {REAL} GROUP BY ALL) SELECT {row('function_count', chr(39) + 'warning' + chr(39), '0', '0', 'n')} FROM c {TH} WHERE n >= func_count_w",
    "smell_lazy_element": f"WITH {LINES}, {FN} SELECT {row('lazy_element', chr(39) + 'warning' + chr(39), 'line_start', '0', 'line_count')} FROM fn {TH} WHERE line_count < lazy AND name NOT IN ('unknown', 'anonymous')",
    "smell_brain_class": f"""WITH {LINES}, {FN}, c AS (SELECT path, lang, count(*) AS n FROM fn WHERE {REAL} GROUP BY ALL), z AS (SELECT path, count(*) AS loc FROM lines GROUP BY path)
        SELECT {row("brain_class", "'alert'", "0", "0", "n")} FROM c JOIN z USING (path) {TH} WHERE n >= brain_class AND loc >= file_loc_w""",
    "smell_bumpy_road": f"""WITH {LINES}, {FN},
        s AS (SELECT *, sum(opens - closes) OVER (PARTITION BY path, ord ORDER BY k) AS s FROM body WHERE line_count >= 10 AND {SOLID} AND NOT (opens > 0 AND opens = closes)),
        d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path, ord ORDER BY k)) AS depth FROM s),
        p AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path, ord ORDER BY k), 0) AS prior FROM d),
        b AS (SELECT *, sum((depth >= 2 AND prior < 2)::INT) OVER (PARTITION BY path, ord ORDER BY k) AS bump FROM p),
        g AS (SELECT path, lang, ord, line_start, line_count, bump, max(depth) AS most FROM b WHERE depth >= 2 OR prior >= 2 GROUP BY ALL HAVING count(*) > 3),
        f AS (SELECT path, lang, ord, line_start, line_count, count(*) AS n, max(most) AS most FROM g GROUP BY ALL)
        SELECT {row("bumpy_road", "CASE WHEN n >= 4 OR most >= 4 THEN 'critical' WHEN n >= 3 OR most >= 3 THEN 'alert' ELSE 'warning' END", "line_start", "line_start + line_count - 1", "n")} FROM f {TH} WHERE n >= bumps""",
    "vulnerability_findings": _VULN,
    "vulnerability_tiers": f"""WITH v AS ({_VULN}) SELECT path, CASE WHEN bool_or(severity IN ('critical', 'alert')) THEN 'Remediate' WHEN bool_or(severity = 'warning') THEN 'Monitor' ELSE 'Clean' END AS tier FROM v GROUP BY path""",
    "secret_findings": f"""WITH {FILES}, m AS (SELECT path, unnest(regexp_extract_all(source, '{_java_free(GENERIC.pattern)}', 1)) AS s FROM files
            WHERE {" OR ".join(f"contains(lower(source), '{k}')" for k in GENERIC.keywords)})
        SELECT path, '{GENERIC.id}' AS rule, count(*) AS n, min(CASE WHEN strlen(s) <= 8 THEN '***' ELSE left(s, 4) || '...' || right(s, 4) END) AS secret
        FROM m WHERE NOT (lower(s) IN ({", ".join(fixtures.text(x) for x in secrets.PLACEHOLDERS)}) OR starts_with(lower(s), '{secrets.PLACEHOLDER_PREFIX}') OR (starts_with(s, 'eyJ') AND NOT contains(s, '.') AND strlen(s) <= 50)) GROUP BY path""",
    "secret_text_functions": "SELECT event_id, CASE WHEN strlen(props) <= 8 THEN '***' ELSE left(props, 4) || '...' || right(props, 4) END AS shown, strlen(props) AS n_bytes FROM events",
    "churn": "SELECT 'documents/' || user_id || '.go' AS path, count(*) AS commits, count(DISTINCT event_type) AS authors FROM events GROUP BY user_id",
    "misspelled_words": f"""WITH {LINES}, d AS (SELECT * FROM (VALUES {fixtures.values(sorted(lint.MISSPELLINGS.items()))}) v(wrong, "right")),
        w AS (SELECT path, line_no, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS wrong FROM ln)
        SELECT path, line_no, wrong, "right", count(*) AS n FROM w JOIN d USING (wrong) GROUP BY ALL""",
    "language_counts": f"WITH {FILES} SELECT lang, count(*) AS files, sum(strlen(source))::BIGINT AS n_bytes FROM files GROUP BY lang",
    "scan_events": "SELECT time_bucket(INTERVAL 15 SECONDS, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}


_ALL_SMELLS = " UNION ALL ".join(f"SELECT path, smell, severity, line_start, line_end, value FROM ({sql})" for name, sql in ORACLE_SQL.items() if name.startswith("smell_"))


def _excess(v: str, bound: str, factor: float, cap: float) -> str:
    return f"CASE WHEN {v} <= {bound} THEN 0.0::DOUBLE ELSE least({cap}::DOUBLE, {factor}::DOUBLE * log2({v} / {bound})) END"


_SCORES = f"""WITH {LINES}, {FN}, found AS ({_ALL_SMELLS}), coh AS ({_COHESION}),
    per AS (SELECT path, sum(CASE severity WHEN 'critical' THEN 0.5 WHEN 'alert' THEN 0.25 ELSE 0.1 END)::DOUBLE AS smell, count(*) FILTER (smell = 'code_duplication') AS pairs, count(*) AS n_smells FROM found GROUP BY path),
    r AS (SELECT path, count(*) AS n_real FROM fn WHERE {REAL} GROUP BY path),
    j AS (SELECT sp.path, sp.lang, len(ls) AS loc, coalesce(n_smells, 0) AS n_smells, coalesce(smell, 0) AS smell, coalesce(pairs, 0) AS pairs, coalesce(n_real, 0) AS n_real, coalesce(n, 0) AS n, coalesce(cohesion, 1.0) AS cohesion
          FROM sp LEFT JOIN per USING (path) LEFT JOIN r USING (path) LEFT JOIN coh USING (path)),
    s AS (SELECT path, lang, loc, n_smells, 10 - {_excess("loc", "file_loc_w", 1.5, 3.0)} - {_excess("n_real", "func_count_w", 0.8, 1.5)} - least(smell, 3.0) - least(pairs * 0.15, 2.0)
                 - CASE WHEN n >= 5 AND cohesion < 0.5 THEN least((1 - cohesion) * 2, 1.5) ELSE 0 END AS left_ FROM j {TH}),
    scored AS (SELECT path, lang, loc, n_smells, least(100, greatest(0, floor(round(greatest(left_, 1.0) * 10, 9) + 0.5)))::INT AS score FROM s)"""
_LABEL = "CASE WHEN score >= 80 THEN 'Go Ahead' WHEN score >= 60 THEN 'Proceed with Care' WHEN score >= 40 THEN 'Needs Work' ELSE 'Stop & Refactor' END"
ORACLE_SQL |= {
    "quality_scores": f"{_SCORES} SELECT *, {_LABEL} AS label FROM scored",
    "quality_overall": f"{_SCORES}, o AS (SELECT count(*) AS files, floor(sum(score) / count(*))::INT AS score FROM scored) SELECT files, score, {_LABEL} AS label FROM o",
    "quality_labels": f"{_SCORES}, l AS (SELECT score, {_LABEL} AS label FROM scored) SELECT label, count(*) AS files, min(score) AS least, max(score) AS most FROM l GROUP BY label",
    "smell_severities": f"WITH found AS ({_ALL_SMELLS}) SELECT smell, severity, count(*) AS n, count(DISTINCT path) AS files FROM found GROUP BY ALL",
}

_BITS = """SELECT path, i, s, -sum(c / l * log2(c / l)) AS bits FROM (SELECT path, i, s, length(s) AS l, ch, count(*) AS c FROM (SELECT path, i, s, unnest(string_split(s, '')) AS ch FROM m) GROUP BY ALL) GROUP BY path, i, s"""
_SECRETS = f"""WITH {FILES}, g AS (SELECT path, regexp_extract_all(source, '{_java_free(GENERIC.pattern)}', 1) AS l FROM files WHERE {" OR ".join(f"contains(lower(source), '{k}')" for k in GENERIC.keywords)}),
    m AS (SELECT path, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM g), e AS ({_BITS})
    SELECT path, i, '{GENERIC.id}' AS rule, CASE WHEN strlen(s) <= 8 THEN '***' ELSE left(s, 4) || '...' || right(s, 4) END AS secret, round(bits, 6) AS entropy,
           CASE WHEN round(bits, 6) >= 4.5 THEN 'critical' WHEN round(bits, 6) >= 3.5 THEN 'alert' ELSE 'warning' END AS severity
    FROM e WHERE NOT (lower(s) IN ({", ".join(fixtures.text(x) for x in secrets.PLACEHOLDERS)}) OR starts_with(lower(s), '{secrets.PLACEHOLDER_PREFIX}') OR (starts_with(s, 'eyJ') AND NOT contains(s, '.') AND strlen(s) <= 50))"""
_RANGES = f"r AS (SELECT path, count(*) // 4 + 1 AS start, ceil(count(*) * 3 / 4)::INT AS stop FROM lines GROUP BY path)"
_TOUCHES = "(line_start BETWEEN start AND stop OR (line_end >= start AND line_start <= stop))"
_CHURN = "c AS (SELECT 'documents/' || user_id || '.go' AS path, count(*) AS commits, count(DISTINCT event_type) AS authors FROM events GROUP BY user_id)"
_HOT = f"""{_SCORES}, {_CHURN},
    t AS (SELECT path FROM c ORDER BY commits DESC, path LIMIT {changes.TOP}), b AS (SELECT path, score FROM t JOIN scored USING (path)),
    hot AS (SELECT path, commits, authors, score, CASE WHEN score IS NOT NULL THEN commits * (101 - score) ELSE commits * 11 END AS priority FROM c LEFT JOIN b USING (path))"""
_CASE_RULES = " ".join(f"WHEN {fixtures.text(k)} THEN {fixtures.text(v)}" for k, v in report.NAMES.items())
_SAVINGS = f"""{_SCORES}, n AS (SELECT path, ceil(strlen(source) / 4)::BIGINT AS tokens, CASE WHEN score < 50 THEN 0.5::DOUBLE WHEN score < 65 THEN 0.45::DOUBLE WHEN score < 80 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS cut FROM files JOIN scored USING (path)),
    a AS (SELECT path, tokens, floor(tokens * (1 - cut) + 0.5::DOUBLE)::BIGINT AS after_ FROM n),
    p AS (SELECT path, tokens, after_ AS after, tokens - after_ AS saved, price, floor((tokens - after_) / 1000000 * price * 1000 + 0.5::DOUBLE) / 1000 AS per_read FROM a, (VALUES (15.0::DOUBLE), (10.0::DOUBLE), (3.0::DOUBLE)) v(price)),
    q AS (SELECT *, floor(per_read * 132000 * 100 + 0.5::DOUBLE) / 100 AS monthly FROM p),
    savings AS (SELECT *, floor(monthly * 1.4::DOUBLE * 100 + 0.5::DOUBLE) / 100 AS with_iterations FROM q)"""
_STRATEGY = f"strategies AS (SELECT * FROM (VALUES {fixtures.values(sorted(changes.STRATEGIES.items()))}) v(smell, strategy))"
_REST = "'RECOMMENDATION: STOP — refactor before any AI modification. ' || CASE WHEN n > 0 THEN 'Call get_refactoring_strategy() for the specific smell names above. Do NOT modify this file until the score is above 80.' ELSE 'The file is in a risky state and cannot be safely edited as-is.' END"
_WORK = "'RECOMMENDATION: Needs Work — significant complexity issues. ' || CASE WHEN n > 0 THEN 'Use get_refactoring_strategy() for the smells above. Refactor incrementally in 3-5 small steps, re-running analyze_code after each.' ELSE 'Refactor incrementally in 3-5 small steps before adding features.' END"
_CARE = "'RECOMMENDATION: Proceed with Care — use guard clauses and small isolated changes. Re-check after each edit with analyze_code.'"
_ENTRIES = f"""en AS (SELECT 0 AS k, 'smell' AS kind, smell AS rule, severity, path, line_start AS line, 1 AS col FROM ({_ALL_SMELLS}) WHERE line_start > 0
    UNION ALL SELECT 1, 'secret', rule, severity, path, i, 1 FROM ({_SECRETS}) UNION ALL SELECT 2, 'vulnerability', rule, severity, path, line, "column" FROM ({_VULN}))"""
ORACLE_SQL |= {
    "hotspots": f"{_HOT} SELECT * FROM hot",
    "hotspots_top": f"{_HOT} SELECT (row_number() OVER (ORDER BY priority DESC, path))::INT AS rank, * FROM (SELECT * FROM hot ORDER BY priority DESC, path LIMIT 20)",
    "hotspot_smells": f"{_HOT} SELECT path, 'hotspot' AS smell, CASE WHEN commits >= 50 AND score / 10 < 4 THEN 'critical' WHEN commits >= 20 THEN 'alert' ELSE 'warning' END AS severity, commits, score FROM hot WHERE commits >= 5 AND score / 10 <= 7",
    **dict.fromkeys(("changed_findings", "changed_smells"), f"WITH {LINES}, f AS ({_ALL_SMELLS}), {_RANGES} SELECT f.* FROM f JOIN r USING (path) WHERE {_TOUCHES}"),
    "findings_of_change": f"""WITH {LINES}, f AS ({_ALL_SMELLS}), {_RANGES}, g AS (SELECT DISTINCT 'documents/' || user_id || '.go' AS path FROM events)
        SELECT f.* FROM f JOIN r USING (path) JOIN g USING (path) WHERE {_TOUCHES} UNION ALL SELECT * FROM f WHERE path LIKE 'pages/%'""",
    "token_costs": f"""{_SCORES}, n AS (SELECT path, ceil(strlen(source) / 4)::BIGINT AS tokens, score FROM files JOIN scored USING (path))
        SELECT path, tokens, floor(tokens * CASE WHEN score < 50 THEN 0.5::DOUBLE WHEN score < 65 THEN 0.45::DOUBLE WHEN score < 80 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END)::BIGINT AS saved, round(tokens * 3.0::DOUBLE / 1000000, 3) AS cost FROM n""",
    "token_savings": f"{_SAVINGS} SELECT * FROM savings",
    "directory_savings": f"{_SAVINGS} SELECT price, count(*) AS files, sum(tokens)::BIGINT AS tokens, sum(after)::BIGINT AS after, sum(saved)::BIGINT AS saved, sum(saved) / 1000000 * price * 132000 AS monthly FROM savings GROUP BY price",
    "assessments": f"""{_SCORES}, {_STRATEGY}, al AS (SELECT path, score, {_LABEL} AS label FROM scored),
        ai AS (SELECT path, count(*) AS n, string_agg(chr(10) || '  - ' || smell || ' (' || severity || '): ' || value::DECIMAL(38, 2), '' ORDER BY line_start, smell, severity, value) AS issues FROM found GROUP BY path),
        ast AS (SELECT path, string_agg(DISTINCT chr(10) || '  - get_refactoring_strategy("' || strategy || '")', '' ORDER BY chr(10) || '  - get_refactoring_strategy("' || strategy || '")') AS steps FROM found JOIN strategies USING (smell) GROUP BY path),
        aj AS (SELECT path, label, score, coalesce(n, 0) AS n, issues, steps FROM al LEFT JOIN ai USING (path) LEFT JOIN ast USING (path))
        SELECT path, label || ' — Score: ' || score || '/100' || coalesce(chr(10) || 'Detected ' || n || ' issues:' || issues, '')
            || coalesce(chr(10) || chr(10) || 'REFACTORING STEPS: Call get_refactoring_strategy() for each detected smell:' || steps || chr(10) || '  Then refactor in 3-5 small steps, re-running analyze_code after each to verify improvement.', '')
            || CASE label WHEN 'Stop & Refactor' THEN chr(10) || chr(10) || {_REST} WHEN 'Needs Work' THEN chr(10) || chr(10) || {_WORK} WHEN 'Proceed with Care' THEN chr(10) || chr(10) || {_CARE} ELSE '' END AS assessment FROM aj""",
    "score_histogram": f"{_SCORES}, b AS (SELECT (SELECT min(x) FROM (VALUES (0), (10), (20), (30), (40), (50), (60), (70), (74), (75), (80), (85), (90), (94), (95), (100)) v(x) WHERE score <= x)::DOUBLE AS upto FROM scored) SELECT upto, count(*) AS n FROM b GROUP BY upto",
    "findings_by_severity": f"""WITH f AS ({_ALL_SMELLS}) SELECT path, severity, CASE severity WHEN 'critical' THEN 1 WHEN 'alert' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END AS rank, count(*) AS n,
        string_agg(smell || ':' || line_start, ',' ORDER BY line_start, smell) AS findings FROM f GROUP BY path, severity""",
    "refactoring_strategies": f"WITH {_STRATEGY}, f AS ({_ALL_SMELLS}) SELECT path, coalesce(string_agg(DISTINCT strategy, ',' ORDER BY strategy), '') AS strategies FROM f LEFT JOIN strategies USING (smell) GROUP BY path",
    "secret_severities": f"SELECT path, rule, secret, entropy, severity FROM ({_SECRETS})",
    "sarif_rules": f"""WITH {_ENTRIES}, o AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY k, path, line, col, severity) AS nth,
            CASE severity WHEN 'critical' THEN 9.5 WHEN 'error' THEN 8.0 WHEN 'alert' THEN 8.0 WHEN 'warning' THEN 5.0 WHEN 'info' THEN 4.0 ELSE 1.0 END::DOUBLE AS sc FROM en),
        t AS (SELECT *, max(sc) OVER (PARTITION BY rule) AS top FROM o)
        SELECT rule, kind, CASE rule {_CASE_RULES} ELSE array_to_string(list_transform(string_split(rule, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS name,
            (row_number() OVER (ORDER BY k, path, line, col, severity) - 1)::INT AS index, CASE WHEN severity IN ('critical', 'error') THEN 'error' WHEN severity = 'warning' THEN 'warning' ELSE 'note' END AS level,
            CASE WHEN kind <> 'vulnerability' THEN top WHEN severity = 'critical' THEN 9.5 WHEN severity = 'error' THEN 7.5 WHEN severity = 'warning' THEN 5.0 ELSE 3.0 END::DOUBLE AS score,
            CASE kind WHEN 'secret' THEN 'high' ELSE 'very-high' END AS precision,
            CASE kind WHEN 'smell' THEN 'maintainability,code-quality' WHEN 'secret' THEN 'security,secret-detection' ELSE 'security,vulnerability' END AS tags
        FROM t WHERE nth = 1""",
}
