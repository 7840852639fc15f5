"""Reports from findings: SARIF, JSON, problem lines and markdown. Rows stay distributed; texts are built by row or group."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels and severity scores.
LEVELS = {"critical": "error", "error": "error", "alert": "warning", "warning": "warning"}
SCORES = {"critical": 9.5, "error": 8.0, "alert": 8.0, "warning": 5.0, "info": 4.0}
VULNERABILITY_SCORES = {"critical": 9.5, "error": 7.5, "warning": 5.0}
RULE_LEVELS = {"critical": "error", "error": "error", "warning": "warning"}
PRECISION = {"smell": "very-high", "secret": "high", "vulnerability": "very-high", "lint": "very-high"}
TAGS = {"smell": "maintainability,code-quality", "secret": "security,secret-detection", "vulnerability": "security,vulnerability", "lint": "maintainability,static-analysis"}
NAMES = {
    "deep_nesting": "Deeply nested control flow",
    "brain_method": "Overly large method / function",
    "bumpy_road": "Code with bumpy readability — many short blocks",
    "complex_conditional": "Complex boolean condition with many branches",
    "complex_method": "Method with high cyclomatic complexity",
    "long_parameter_list": "Function with too many parameters",
    "primitive_obsession": "Excessive use of primitive types",
    "duplicated_code": "Duplicated code block",
    "god_class": "Class with too many responsibilities",
    "file_bloat": "File exceeds size thresholds",
    "paragraph_of_code": "Long block of consecutive non-blank lines",
    "lazy_element": "Unnecessary intermediate variable or function",
    "message_chains": "Long method call chain",
    "long_scope_variable": "Variable used far from declaration",
    "long_switch": "Long switch statement",
    "global_data": "Excessive global state",
    "excessive_comments": "Too many comments relative to code",
    "low_cohesion": "Low cohesion in class/module",
    "brain_class": "Overly large class",
    "code_duplication": "Duplicate code pattern",
    "generic-api-key": "Generic API key detected",
    "gcp-api-key": "Google Cloud Platform API key",
    "aws-access-key": "AWS access key",
    "stripe-access-token": "Stripe access token",
    "go_path_traversal": "Path traversal via filepath.Join with user input",
    "go_sql_injection": "SQL query built with string formatting",
    "go_exec_shell_injection": "Command injection via exec.Command with shell",
    "go_template_html_xss": "XSS via template.HTML() bypassing auto-escaping",
    "go_ssrf_http": "SSRF via http.Get() with user-controlled URL",
    "eval_injection": "eval() with untrusted input",
    "innerHTML_xss": "innerHTML assignment with untrusted content",
    "aes_ecb_mode": "AES in ECB mode (leaks plaintext structure)",
    "weak_hash_md5": "MD5 hash (collision vulnerability)",
    "weak_hash_sha1": "SHA-1 hash (collision vulnerability)",
    "weak_crypto_des": "DES/3DES encryption (deprecated)",
    "tls_verification_disabled": "TLS certificate verification disabled",
    "xml_unsafe_parse": "XML parsing vulnerable to XXE",
    "unsafe_yaml_load": "Unsafe YAML deserialization",
    "pickle_wrapper_load": "Unsafe pickle deserialization",
    "python_subprocess_shell": "subprocess with shell=True",
    "react_dangerously_set_html": "dangerouslySetInnerHTML with untrusted content",
    "document_write_xss": "document.write() with untrusted input",
    "new_function_injection": "new Function() with dynamic string",
    "spelling": "Spelling error detected",
    "gofmt": "Code formatting issue",
    "go_vet": "Go vet issue",
    "staticcheck": "Static analysis issue",
}
FORMATS = {
    "json": "json", "md": "markdown", "markdown": "markdown", "text": "human", "human": "human", "problems": "problems", "gcc": "problems", "vscode": "problems", "sarif": "sarif", "auto": "auto",
}
# End of fixed values.


def resolved_format(name: str, env: dict[str, str], terminal: bool, strict: bool = False) -> str:
    """The output format that a name asks for; without one, what the environment and the terminal suggest.

    Unknown names give JSON, or an error if ``strict``.
    """
    auto = "human" if terminal else "json"
    asked = FORMATS.get(name.lower())
    if strict:
        if name and not asked:
            raise ValueError(f"unknown format: {name} (valid: auto, human, json, markdown, problems, sarif)")
        return asked if asked and asked != "auto" else auto
    if asked is None and env.get("NO_COLOR"):
        return "json"
    if asked is None and not name:
        asked = FORMATS.get(env.get("CLI_FORMAT", "").lower(), "auto")
    return auto if asked == "auto" else asked or "json"


def rule_name(rule: Column) -> Column:
    """A readable name of a rule: a fixed one, or its words with capitals."""
    words = F.transform(F.split(rule, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), rule), F.array_join(words, " "))


def _case(c: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def entries(smells: DataFrame | None = None, secrets: DataFrame | None = None, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """(kind, rule, severity, path, line, column) of all findings with a line; lines and columns are 1 at least."""
    parts = []
    if smells is not None:
        parts.append(smells.where("line_start > 0").select(F.lit("smell").alias("kind"), F.col("smell").alias("rule"), "severity", "path", F.col("line_start").alias("line"), F.lit(1).alias("column")))
    if secrets is not None:
        parts.append(secrets.select(F.lit("secret").alias("kind"), "rule", "severity", "path", "line", "column"))
    if vulnerabilities is not None:
        parts.append(vulnerabilities.select(F.lit("vulnerability").alias("kind"), "rule", "severity", "path", "line", "column"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"line": F.greatest("line", F.lit(1)), "column": F.greatest("column", F.lit(1))})


def sarif_rules(found: DataFrame) -> DataFrame:
    """(rule, kind, name, index, level, score, precision, tags): one row per rule, numbered by the first sight of it.

    First is by kind (smells, secrets, vulnerabilities, others), path, line, column. Kind and level are
    those of the first finding; the score is the highest of the rule's findings, but for vulnerabilities
    that of the first.
    """
    order = F.struct(_case(F.col("kind"), {"smell": 0, "secret": 1, "vulnerability": 2}, 3).alias("k"), "path", "line", "column", "severity", "kind")
    ranked = found.groupBy("rule").agg(F.min(order).alias("first"), F.max(_case(F.col("severity"), SCORES, 1.0)).alias("top"))
    w = Window.orderBy("first")  # over rules, of which there are a few hundred
    kind, severity = F.col("first.kind"), F.col("first.severity")
    score = F.when(kind == "vulnerability", _case(severity, VULNERABILITY_SCORES, 3.0)).otherwise(F.col("top"))
    return ranked.select(
        "rule", kind.alias("kind"), rule_name(F.col("rule")).alias("name"), (F.row_number().over(w) - 1).alias("index"), _case(severity, RULE_LEVELS, "note").alias("level"), score.alias("score"), _case(kind, PRECISION, "very-high").alias("precision"), _case(kind, TAGS, "").alias("tags")
    )


def sarif_results(found: DataFrame, root: str = "") -> DataFrame:
    """(path, line, rule, result): each finding as a SARIF result in JSON, its path relative to ``root``. ``found`` is read twice; persist what is dear."""
    path = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)).otherwise(F.col("path")) if root else F.col("path")
    joined = found.join(F.broadcast(sarif_rules(found).select("rule", "index", "name")), "rule")  # rules only
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.array(F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("index").alias("ruleIndex"), _case(F.col("severity"), LEVELS, "note").alias("level"), F.struct(F.col("name").alias("text")).alias("message"), place.alias("locations")))
    return joined.select("path", "line", "rule", result.alias("result"))


def sarif_log(found: DataFrame, tool: str, version: str, root: str = "") -> DataFrame:
    """(part, path, line, rule, value): the lines of one SARIF log, to be written in this order.

    Part 0 is the head with the rules, part 1 a result in each line, part 2 the end; results stay
    distributed. Without findings the log has no results.
    """
    rules, results = sarif_rules(found), sarif_results(found, root)
    shown = F.struct(
        F.col("rule").alias("id"), "name", F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct(F.col("score").cast("string").alias("security-severity"), "precision", F.split("tags", ",").alias("tags"), F.col("level").alias("problem.severity")).alias("properties"),
    )
    listed = rules.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("index", shown.alias("r")))), lambda x: x["r"])).alias("rules"))  # a few hundred rules
    driver = F.concat(F.lit(f'{{"name":{json.dumps(tool)},"version":{json.dumps(version)},"rules":'), F.col("rules"), F.lit("}"))
    head = listed.select(F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), driver, F.lit('},"results":[')).alias("value"))
    place = lambda df, part: df.select(F.lit(part).alias("part"), F.lit("").alias("path"), F.lit(0).alias("line"), F.lit("").alias("rule"), "value")
    first = results.agg(F.min(F.struct("path", "line", "rule", "result")).alias("f"))
    body = results.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "path", "line", "rule", F.concat(F.when(F.struct("path", "line", "rule", "result") == F.col("f"), "").otherwise(","), F.col("result")).alias("value"))
    end = listed.select(F.lit("]}]}").alias("value"))
    return place(head, 0).unionByName(body).unionByName(place(end, 2))


def human(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(path, value): a card in plain text for each file: score and label, then its findings, critical ones first."""
    rank = _case(F.col("severity"), {"critical": 0, "alert": 1, "warning": 2}, 3)
    line = F.format_string("  [%s] %s at line %d", "severity", "smell", "line_start")
    cards = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "line_start", line.alias("text")))).alias("cards"))
    head = F.format_string("%s\n%s — %d/100 [%s]", F.col("path"), F.col("label"), F.col("score"), F.concat(F.repeat(F.lit("#"), F.floor(F.col("score") / 10).cast("int")), F.repeat(F.lit("."), (10 - F.floor(F.col("score") / 10)).cast("int"))))
    return scores.join(cards, "path", "left").select("path", F.concat_ws("\n", head, F.transform("cards", lambda c: c["text"])).alias("value"))


def problems(found: DataFrame) -> DataFrame:
    """``path:line:column: error|warning: rule`` lines."""
    return found.select(F.format_string("%s:%d:%d: %s: %s", "path", "line", "column", F.when(F.col("severity") == "critical", "error").otherwise("warning"), "rule").alias("value"))


def json_report(scores: DataFrame, smells: DataFrame, secrets: DataFrame | None = None, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """(path, report): one JSON object per file; kinds without findings are left out."""
    nested = lambda df, name: df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "path"]))).alias(name))
    out = scores.join(nested(smells, "smells"), "path", "left")
    names = ["smells"]
    for df, name in ((secrets, "secret_scan"), (vulnerabilities, "vulnerability_scan")):
        if df is not None:
            out, names = out.join(nested(df, name), "path", "left"), [*names, name]
    quality = F.struct("score", "label", "lang", "loc", "smells")
    return out.select("path", F.to_json(F.struct(quality.alias("code_quality"), *names[1:])).alias("report"))


def markdown(overall: DataFrame, distribution: DataFrame) -> str:
    """A summary page from two small aggregates (one row, and one per label)."""
    top = overall.first()
    rows = "".join(f"| {r['label']} | {r['files']} | {r['least']} | {r['most']} |\n" for r in distribution.orderBy("label").collect())
    return f"# Quality report\n\nFiles: {top['files']}  \nScore: {top['score']} ({top['label']})\n\n| label | files | least | most |\n| --- | --- | --- | --- |\n{rows}"
