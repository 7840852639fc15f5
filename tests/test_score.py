import json

import duckdb
import pytest

from siltstone.operators import report, score
from siltstone.plans import fixtures, queries
from siltstone.sources.corpus import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    table = files(spark.createDataFrame(fixtures.FILES, "path string, lang string, source string"), lang="lang")
    found = score.all_smells(table).cache()
    return found, score.quality(table, found).cache()


def test_scores_of_the_fixtures(scored):
    found, quality = scored
    got = {r.path: r for r in quality.collect()}
    assert len(got) == len(fixtures.FILES)
    assert (got["fix/empty.go"].loc, got["fix/empty.go"].score, got["fix/empty.go"].label) == (0, 100, "Go Ahead")
    assert got["fix/newline.go"].loc == 1
    names = {(r.path, r.smell) for r in found.collect()}
    for want in [("fix/deep.go", "deep_nesting"), ("fix/bumps.go", "bumpy_road"), ("fix/twins.go", "code_duplication"), ("fix/loose.go", "low_cohesion"), ("fix/switch.go", "long_switch"), ("fix/long.go", "long_scope_variable"), ("fix/big.go", "brain_class"), ("fix/big.go", "function_count"), ("fix/big.go", "file_bloat")]:
        assert want in names
    assert 10 <= min(r.score for r in got.values()) < 100


def test_overall_rounds_down(spark):
    rows = spark.createDataFrame([("a", 99), ("b", 100)], "path string, score int")
    assert tuple(score.overall(rows).first()) == (2, 99, "Go Ahead")
    assert tuple(score.overall(rows.where("false")).first()) == (0, 0, "Stop & Refactor")


@pytest.mark.parametrize(("value", "want"), [(100, "Go Ahead"), (80, "Go Ahead"), (79, "Proceed with Care"), (40, "Needs Work"), (39, "Stop & Refactor")])
def test_labels(spark, value, want):
    assert spark.createDataFrame([(value,)], "s int").select(score.label(__import__("pyspark").sql.functions.col("s"))).first()[0] == want


def test_reports(spark, scored):
    found, quality = scored
    entries = report.entries(smells=found)
    rules = report.sarif_rules(entries).orderBy("index").collect()
    assert [r["index"] for r in rules] == list(range(len(rules))) and {r.level for r in rules} <= {"error", "warning", "note"}
    result = json.loads(report.sarif_results(entries, root="fix").orderBy("path", "line", "rule").first().result)
    assert result["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1
    assert not result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"].startswith("fix/")
    whole = {r.path: json.loads(r.report) for r in report.json_report(quality, found).collect()}
    assert whole["fix/deep.go"]["code_quality"]["smells"][0]["smell"] == "deep_nesting" and "smells" not in whole["fix/empty.go"]["code_quality"]
    assert all(r.value.count(":") >= 4 for r in report.problems(entries).collect())
    assert "| Go Ahead |" in report.markdown(score.overall(quality), score.distribution(quality))


def test_stream_equals_batch(spark, tmp_path, scored):
    from siltstone.streaming.ingest import arriving, score_batches

    data, got = str(tmp_path / "in"), []
    spark.createDataFrame([(p, s) for p, _, s in fixtures.FILES[:4]], "path string, source string").write.parquet(data)
    score_batches(arriving(spark, data), str(tmp_path / "cp"), lambda df, n: got.extend(df.collect())).awaitTermination(120)
    want = {r.path: r.score for r in scored[1].collect()}
    assert {r.path: r.score for r in got} == {p: want[p] for p, _, _ in fixtures.FILES[:4]}


@pytest.mark.parametrize("name", ["file_lines", "smell_paragraph_of_code", "smell_deep_nesting", "smell_bumpy_road", "smell_complex_method", "vulnerability_findings", "token_costs", "changed_findings", "hotspots"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = con.sql(queries.ORACLE_SQL[name])
    at = [list(want.columns).index(c) for c in columns]
    assert got == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_changed_smells_cover_all_documents_and_detectors(spark):
    got = queries.QUERIES["changed_smells"](spark, SF).select("path", "smell").distinct().collect()
    documents = {int(r.path[10:-3]) for r in got if r.path.startswith("documents/")}
    assert {d % 2 for d in documents} == {0, 1} and len({r.smell for r in got}) > 5
