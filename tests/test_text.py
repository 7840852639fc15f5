import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.corpus import excluded, files, ignore_pattern, in_skipped_folder, is_source


def one(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize(("value", "want"), [("\t a b \u00a0", "a b"), ("", ""), ("\u2003x", "x")])
def test_trimmed(spark, value, want):
    assert one(spark, c=value).select(T.trimmed(F.col("c"))).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [("12345678", "***"), ("123456789", "1234...6789"), ("éééé", "***"), ("", "***")])
def test_redacted_counts_bytes(spark, value, want):
    assert one(spark, c=value).select(T.redacted(F.col("c"))).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [("", 0.0), ("aaaa", 0.0), ("abab", 1.0), ("abcd", 2.0)])
def test_entropy(spark, value, want):
    assert one(spark, c=value).select(T.entropy(F.col("c"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(
    ("pattern", "value", "hit"),
    [(r"\bfoo", "\u00e9foo", True), (r"\bfoo", "xfoo", False), (r"a$", "a\n", False), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False), (r"[$]x", "$x", True)],
)
def test_portable_patterns(spark, pattern, value, hit):
    assert one(spark, c=value).select(F.col("c").rlike(T.portable(pattern))).first()[0] is hit


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.go",), ("a/.git/b.go",), ("vendor/x.py",), ("a/Dockerfile",), ("a/x.bin",), ("x/.env.local",)], "p string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("p", is_source(F.col("p")), in_skipped_folder(F.col("p"))).collect()}
    assert got == {"a/b.go": (True, False), "a/.git/b.go": (True, True), "vendor/x.py": (True, True), "a/Dockerfile": (True, False), "a/x.bin": (False, False), "x/.env.local": (True, False)}
    assert [r[0] for r in rows.where(excluded(F.col("p"), ["a/", "vendor/x.py"])).collect()] == ["a/b.go", "a/.git/b.go", "vendor/x.py", "a/Dockerfile", "a/x.bin"]


@pytest.mark.parametrize(("line", "path", "hit"), [("*.log", "a/b.log", True), ("build/", "build/x", True), ("build/", "a/build/x", False), ("/a/*.go", "a/b.go", True)])
def test_ignore_patterns(line, path, hit):
    assert bool(re.search(ignore_pattern(line), path)) is hit


def test_ignore_pattern_skips_blanks_and_negations():
    assert [ignore_pattern(x) for x in ("", "# x", "!keep")] == [None, None, None]


def test_files_take_null_texts_and_unknown_languages(spark):
    got = files(spark.createDataFrame([("a.zig", None), ("b.PY", "\u00e9")], "path string, source string")).collect()
    assert [(r.lang, r.ext, r.source, r.n_bytes) for r in got] == [("go", ".zig", "", 0), ("python", ".py", "\u00e9", 2)]


def test_read_files(spark, tmp_path):
    from siltstone.sources.corpus import read_files

    for name, data in {"a.go": b"x\xff", "b.bin": b"x", "c.py": b"a\0b", "node_modules/d.js": b"x", "skip/e.go": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = read_files(spark, str(tmp_path), ignore=["skip/"]).collect()
    assert [(r.path, r.source) for r in got] == [("a.go", "x\ufffd")]
