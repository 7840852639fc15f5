from siltstone.operators import lint


def test_tools_and_categories(spark):
    rows = spark.createDataFrame([(c,) for c in ("SA1000", "ST1000", "S1000", "U1000", "printf", "nilness", "ineffassign", "other")], "code string")
    got = {r.code: (r.tool, r.category) for r in lint.lint_findings(rows).collect()}
    assert got == {
        "SA1000": ("staticcheck", "correctness"), "ST1000": ("staticcheck", "style"), "S1000": ("staticcheck", "style"), "U1000": ("staticcheck", "unused"), "printf": ("govet", "correctness"), "nilness": ("govet", "bug"),
        "ineffassign": ("ineffassign", "unused"), "other": ("govet", "correctness"),
    }


def test_misspell(spark):
    rows = spark.createDataFrame([("a", 1, "Teh teh the"), ("a", 2, "fine")], "path string, line_no int, line string")
    assert [tuple(r) for r in lint.misspell(rows).collect()] == [("a", 1, "teh", "the", 2)]
    own = spark.createDataFrame([("fine", "good")], "wrong string, right string")
    assert [tuple(r) for r in lint.misspell(rows, own).collect()] == [("a", 2, "fine", "good", 1)]
