"""Reports, advice, settings and declared filters."""

import json
import os

import pytest

from siltstone.operators import advice, changes, declared, lint, report, score, secrets
from siltstone.operators.secret_rules import Rule, load_rules
from siltstone.sources import corpus, settings
from siltstone.sources.config import thresholds

FOUND = "path string, smell string, severity string, line_start int, line_end int, value double"


@pytest.fixture(scope="module")
def found(spark):
    rows = [("a.go", "deep_nesting", "alert", 3, 3, 6.0), ("a.go", "long_switch", "critical", 9, 30, 22.0), ("a.go", "file_bloat", "warning", 0, 0, 1200.0), ("b.go", "function_count", "warning", 0, 0, 30.0), ("b.go", "lazy_element", "warning", 4, 0, 1.0)]
    return spark.createDataFrame(rows, FOUND)


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("a.go", 35, "Stop & Refactor"), ("b.go", 70, "Proceed with Care"), ("c.go", 100, "Go Ahead"), ("d.go", 45, "Needs Work")], "path string, score int, label string")


@pytest.mark.parametrize(
    ("name", "env", "terminal", "want"),
    [("md", {}, True, "markdown"), ("GCC", {}, True, "problems"), ("", {}, True, "human"), ("", {}, False, "json"), ("auto", {}, True, "human"), ("odd", {}, True, "json"), ("", {"NO_COLOR": "1"}, True, "json"), ("", {"CLI_FORMAT": "sarif"}, True, "sarif"), ("", {"CLI_FORMAT": "odd"}, True, "human")],
)
def test_formats(name, env, terminal, want):
    assert report.resolved_format(name, env, terminal) == want


def test_strict_formats():
    assert report.resolved_format("", {"CLI_FORMAT": "md"}, False, strict=True) == "json"
    with pytest.raises(ValueError, match="unknown format"):
        report.resolved_format("odd", {}, True, strict=True)


def test_rules_go_by_first_sight(spark):
    rows = [("smell", "b_rule", "warning", "z.go", 5, 1), ("smell", "a_rule", "alert", "z.go", 6, 1), ("smell", "b_rule", "critical", "z.go", 7, 1), ("vulnerability", "weak_hash_md5", "warning", "a.go", 1, 1), ("vulnerability", "weak_hash_md5", "critical", "b.go", 1, 1), ("secret", "x-y", "critical", "a.go", 1, 1)]
    made = report.sarif_rules(spark.createDataFrame(rows, "kind string, rule string, severity string, path string, line int, column int")).orderBy("index").collect()
    assert [(r.rule, r["index"], r.level, r.score) for r in made] == [("b_rule", 0, "warning", 9.5), ("a_rule", 1, "note", 8.0), ("x-y", 2, "error", 9.5), ("weak_hash_md5", 3, "warning", 5.0)]
    assert [r.name for r in made] == ["B Rule", "A Rule", "X-y", "MD5 hash (collision vulnerability)"]


@pytest.mark.parametrize("none", [False, True])
def test_log_is_one_json_document(found, none):
    entries = report.entries(smells=found.where("false") if none else found)
    lines = report.sarif_log(entries, 'a "tool"', "1.0").orderBy("part", "path", "line", "rule").collect()
    log = json.loads("\n".join(r.value for r in lines))
    run = log["runs"][0]
    assert run["tool"]["driver"]["name"] == 'a "tool"' and len(run["results"]) == (0 if none else 3)
    for r in run["results"]:
        assert run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"]


def test_assessments_and_cards(found, scores):
    told = {r.path: r.assessment for r in advice.assessments(scores, found).collect()}
    assert told["c.go"] == "Go Ahead — Score: 100/100"
    assert told["d.go"].endswith(advice.WORK + advice.WORK_NONE)
    a = told["a.go"]
    assert a.index("file_bloat") < a.index("deep_nesting (alert): 6.00") and 'strategy("long_switch")' in a and a.endswith(advice.STOP_FOUND)
    assert "function_count" in told["b.go"] and 'strategy("function_count")' not in told["b.go"]
    cards = {r.path: r.value.split("\n") for r in report.human(scores, found).collect()}
    assert cards["a.go"][2].startswith("  [critical] long_switch") and cards["c.go"] == ["c.go", "Go Ahead — 100/100 [##########]"]


def test_savings(spark, scores):
    files = spark.createDataFrame([("a.go", 4001), ("b.go", 40), ("c.go", 0)], "path string, n_bytes long")
    rows = advice.token_savings(files, scores).where("price = 15.0").orderBy("path").collect()
    assert [(r.tokens, r.after, r.saved) for r in rows] == [(1001, 501, 500), (10, 6, 4), (0, 0, 0)]
    assert (rows[0].per_read, rows[0].monthly, rows[0].with_iterations) == (0.008, 1056.0, 1478.4)
    total = {r.price: r for r in advice.directory_savings(files, scores).collect()}
    assert total[3.0].saved == 504 and total[3.0].monthly == pytest.approx(504 / 1e6 * 3 * 132000)


def test_guidance(spark, found, tmp_path):
    (tmp_path / "long_switch.md").write_text("# Long switch\n")
    got = {r.smell: r.content for r in advice.guidance(found, advice.pages(spark, str(tmp_path))).collect()}
    assert got == {"deep_nesting": None, "file_bloat": None, "lazy_element": None, "long_switch": "# Long switch\n"}


def test_changes_without_ranges(spark, found):
    ranges = spark.createDataFrame([("a.go", 1, 5)], "path string, start int, end int")
    changed = spark.createDataFrame([("a.go",), ("b.go",)], "path string")
    names = lambda **o: sorted(r.smell for r in changes.findings_of_change(found, ranges, changed, **o).collect())
    assert names() == ["deep_nesting", "function_count", "lazy_element"] and names(whole_folder=False) == ["deep_nesting"]


def test_top_hotspots(spark):
    ranked = spark.createDataFrame([(f"f{k:02}", k % 7) for k in range(40)], "path string, priority int")
    top = changes.top_hotspots(ranked).orderBy("rank").collect()
    assert len(top) == 20 and [(r.path, r.rank) for r in top[:2]] == [("f06", 1), ("f13", 2)]


def test_histograms_and_groups(spark, found, scores):
    got = {r.upto: r.n for r in score.histogram(scores, "score").collect()}
    assert got == {40.0: 1, 50.0: 1, 70.0: 1, 100.0: 1}
    assert score.histogram(spark.createDataFrame([(None,), (20000.0,)], "ms double"), "ms", score.DURATION_BOUNDS).collect()[0].upto is None
    groups = [(r.path, r.severity, r.findings) for r in score.by_severity(found).orderBy("path", "rank").collect()]
    assert groups[0] == ("a.go", "critical", "long_switch:9") and groups[-1] == ("b.go", "warning", "function_count:0,lazy_element:4")


def test_project_settings(spark):
    given = {"rules": {"deep_nesting": {"warning": 2, "alert": 0}, "duplicated_code": {"min_similarity": 0.9}, "file_bloat": "odd", "bumpy_road": {"bumps_warning": True}}, "exclude": {"files": ["a/", 3]}}
    assert settings.overrides(given) == {"nesting_w": 2, "dup_similarity": 0.9} and settings.exclusions(given) == ["a/"] and settings.overrides({}) == {}
    row = thresholds(spark, settings.overrides(given)).where("lang_key = 'python'").first()
    assert (row.nesting_w, row.nesting_a, row.dup_similarity, row.file_loc_w) == (2, 5, 0.9, 600)


def test_user_settings(tmp_path):
    path = str(tmp_path / "x" / "config.json")
    assert settings.read_user(path) == {}
    settings.set_user(path, "access_token", "abc")
    settings.set_user(path, "enabled_tools", "a, b,")
    assert settings.set_user(path, "read_only", "1") == {"access_token": "***", "enabled_tools": ["a", "b"], "read_only": True}
    assert settings.read_user(path)["access_token"] == "abc"
    with pytest.raises(ValueError, match="unknown config key"):
        settings.set_user(path, "odd", "1")


def test_repository_and_guard(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert settings.repository(str(tmp_path / "a" / "b")) == str(tmp_path)
    assert settings.guarded("b", str(tmp_path / "a")) == os.path.realpath(tmp_path / "a" / "b")
    with pytest.raises(PermissionError):
        settings.guarded("../.git", str(tmp_path / "a"))


def test_report_walk_and_single_files(spark, tmp_path):
    for name, text in (("testdata/a.go", b"x"), ("vendor/b.go", b"x"), ("c.env", b"A=1"), ("d.go", b"y\n"), ("bin.go", b"\0")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    assert sorted(r.path for r in corpus.read_report_files(spark, str(tmp_path)).collect()) == ["d.go", "testdata/a.go"]
    assert corpus.read_file(spark, f"{tmp_path}/d.go", str(tmp_path)).first().path == "d.go"
    assert corpus.read_file(spark, f"{tmp_path}/bin.go").count() == 0


def test_filters():
    test = declared.predicate('entropy(finding["secret"]) <= 2.0 || (matchesAny(finding["line"], [r"""(?i)^x""", "q$"]) && !containsAny(attributes[?"path"].orValue(""), ["Keep"])) || failsTokenEfficiency(finding["secret"])', secrets.shannon, lambda s: s == "word")
    assert test({"secret": "aaa"}) and test({"secret": "word"}) and not test({"secret": "abcdefgh"})
    assert test({"secret": "abcdefgh", "line": "X = 1", "path": "a"}) and not test({"secret": "abcdefgh", "line": "X = 1", "path": "a/keep"})
    for bad in ("entropy(", "matchesAny(finding[\"secret\"], [1", "entropy(finding[\"secret\"]) <= 1 entropy", "odd(x)", "#"):
        with pytest.raises((ValueError, IndexError)):
            declared.predicate(bad, secrets.shannon)


def test_declared_scan_leaves_paths_and_placeholders_out(spark, tmp_path):
    (tmp_path / "r.toml").write_text("[[rules]]\nid='key'\nregex='''K-([^ ]+)'''\nkeywords=['k-']\nfilter='''containsAny(finding[\"match\"], [\"TEST\"])'''\n")
    rules = load_rules(str(tmp_path / "r.toml"))
    table = corpus.files(spark.createDataFrame([("a.go", "K-9f8e7d"), ("node_modules/x.js", "K-9f8e7d"), ("b.go", "K-${HOME}"), ("c.go", "K-testing1")], "path string, source string"))
    paths = lambda mode: sorted(r.path for r in secrets.scan(table, rules, mode).collect())
    assert paths("declared") == ["a.go"] and len(paths("as_loaded")) == 4


def test_explained_findings(spark):
    rules = [Rule("key", r"K-([0-9]+)", ("k-",), description="A key")]
    table = corpus.files(spark.createDataFrame([("a.go", "\nK-123456789")], "path string, source string"))
    row = secrets.explained(secrets.scan(table, rules), rules).first()
    assert row.message.startswith("CRITICAL: key detected on line 2. A key. You MUST") and secrets.has_findings(table, rules)
    assert not secrets.has_findings(table.where("false"), rules)


def test_order_of_analyzers():
    assert lint.in_order({"b": ("a",), "c": ("a",), "a": (), "d": ("c", "b")}) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="need each other"):
        lint.in_order({"a": ("b",), "b": ("a",)})
