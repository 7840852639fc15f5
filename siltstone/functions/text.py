"""Column functions over source text. Positions and sizes are in bytes of UTF-8 where the name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, in a form that Java and RE2 patterns share.
SPACE = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# File extensions and their languages.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".c": "c", ".h": "cpp", ".hpp": "cpp",
    ".java": "java", ".rs": "rust", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".yaml": "yaml", ".yml": "yaml", ".html": "html", ".htm": "html",
}
# End of fixed values.


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def occurrences(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def extension(path: Column) -> Column:
    """From the last dot of the path, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """The language of a path by its extension; go where it is unknown, as scans assume."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("go"))


def is_comment(c: Column) -> Column:
    """Whether a trimmed line is a comment for most detectors."""
    return c.rlike(r"^(//|#|/\*|\*)")


def redacted(c: Column) -> Column:
    """At most eight bytes become ***; longer secrets keep four at each end."""
    return F.when(F.octet_length(c) <= 8, "***").otherwise(F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4))))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters of a string; 0 for the empty one."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, x: s + share(x) * F.log2(share(x))))


def portable(pattern: str) -> str:
    """A pattern for Java that matches what RE2 matches: ASCII word boundaries, ends of text, dots and classes."""
    boundary = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    out, k = [], 0
    inside = False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if pattern[k] == "\\":
            out.append(boundary if two == r"\b" and not inside else two)
            k += 2
            continue
        inside = pattern[k] == "[" or inside and pattern[k] != "]"
        out.append(r"\z" if pattern[k] == "$" and not inside else pattern[k])
        k += 1
    return "(?d)" + "".join(out).replace("(?P<", "(?<").replace("[[:alnum:]]", r"\p{Alnum}")
