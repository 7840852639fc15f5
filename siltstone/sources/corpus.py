"""Source files as a table: (path, lang, ext, source, n_bytes)."""

from __future__ import annotations

import fnmatch
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, language

# What counts as a source file, and folders that a walk leaves out.
EXTENSIONS = (
    ".go .py .js .jsx .ts .tsx .mjs .cjs .java .rs .rb .swift .kt .kts .cs .c .h .cpp .cc .cxx .hpp .php .scala .sh .bash .sql .yaml .yml .toml .json .xml .html .htm .env .properties .tf .ini .cfg .conf"
).split()
BASENAMES = "Dockerfile Makefile Jenkinsfile Vagrantfile Gemfile Rakefile Procfile .env".split()
SKIPPED_FOLDERS = ("node_modules", "vendor", "testdata")
REPORT_SKIPPED_FOLDERS = ("node_modules", "vendor")
REPORT_LEFT_OUT = (".env",)
# End of fixed values.

BINARY_PREFIX = 8000


def is_source(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return extension(path).isin(EXTENSIONS) | name.isin(BASENAMES) | name.startswith(".env.") | name.startswith("Dockerfile.")


def in_skipped_folder(path: Column, folders: tuple[str, ...] = SKIPPED_FOLDERS) -> Column:
    """Whether a folder of the path is one of ``folders`` or begins with a dot."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(parts, lambda p: p.isin(*folders) | (p.startswith(".") & ~p.isin(".", "..")))


def ignore_pattern(line: str) -> str | None:
    """A gitignore line as a regular expression over relative paths; None for blanks, comments and negations."""
    line = line.strip()
    if not line or line[0] in "#!":
        return None
    if line.endswith("/"):
        return "^" + fnmatch.translate(line.strip("/")).replace(r"\Z", "").replace(r"\z", "").replace("(?s:", "(?:") + "/"
    body = fnmatch.translate(line.lstrip("/")).replace(r"\Z", "").replace(r"\z", "").replace("(?s:", "(?:")
    return f"(^|/){body}$" if "/" not in line else f"^{body}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Exact paths, or prefixes where a pattern ends in a slash."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (path.startswith(p) if p.endswith("/") else path == p)
    return hit


def files(rows: DataFrame, path: str = "path", source: str = "source", lang: str | None = None) -> DataFrame:
    """The file table from any rows of paths and texts; a null text is an empty file."""
    text = F.coalesce(F.col(source), F.lit(""))
    return rows.select(
        F.col(path).alias("path"), (F.col(lang) if lang else language(F.col(path))).alias("lang"), extension(F.col(path)).alias("ext"), text.alias("source"), F.octet_length(text).cast("long").alias("n_bytes")
    )


def read_files(spark: SparkSession, root: str, ignore: list[str] = (), exclude: list[str] = (), folders: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """All text source files below ``root``; content is read only for paths that pass the filters.

    Bytes that aren't UTF-8 are replaced; files with a NUL in their first bytes are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = posixpath.join(root.rstrip("/"), "")
    relative = F.regexp_replace("path", f"^([a-z0-9]+:/*)?{base.lstrip('/')}".replace(".", r"\."), "")
    named = raw.select(relative.alias("path"), "content").where(is_source(F.col("path")) & ~in_skipped_folder(F.col("path"), folders) & ~excluded(F.col("path"), list(exclude)))
    for pattern in filter(None, map(ignore_pattern, ignore)):
        named = named.where(~F.col("path").rlike(pattern))
    text = named.where(F.locate("\x00", F.make_valid_utf8(F.substring("content", 1, BINARY_PREFIX).cast("string"))) == 0)
    return files(text.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source")))


def read_report_files(spark: SparkSession, root: str, ignore: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The files of a report: as ``read_files``, but with test data and without environment files by extension."""
    return read_files(spark, root, ignore, exclude, REPORT_SKIPPED_FOLDERS).where(~F.col("ext").isin(*REPORT_LEFT_OUT))


def read_file(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """One file, whatever its name, with its path relative to ``root`` if it lies below; a binary file gives no row."""
    raw = spark.read.format("binaryFile").load(path)
    here = path[len(root.rstrip("/")) + 1 :] if root and path.startswith(root.rstrip("/") + "/") else path
    text = raw.where(F.locate("\x00", F.make_valid_utf8(F.substring("content", 1, BINARY_PREFIX).cast("string"))) == 0)
    return files(text.select(F.lit(here).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("source")))
