"""Function extents of source files.

Files go through one Arrow pass; each file is read once from top to bottom by a small state machine
whose definition test, naming and ending rule are chosen by language. No shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extent = tuple[str, int, int]  # name, first line, number of lines

# Words that begin or can't begin a definition.
CPP_NOT = re.compile(r"(if |else |for |while |switch |return |break|continue|case |default:|goto |try |catch |throw |enum |struct |class |namespace |template|using |typedef |public:|private:|protected:|#|//|/\*)", re.I)
JAVA_HEAD = re.compile(r"(public |private |protected |static |synchronized |final |abstract |native |default |void |int |long |double |float |boolean |byte |short |char |string )", re.I)
RUST_HEAD = re.compile(r"(pub )?(async )?fn |pub\(crate\) fn ", re.I)
SWIFT_HEAD = re.compile(r"((private|public|internal|override|mutating|static|class) )?func .*\(", re.I)
KOTLIN_HEAD = re.compile(r"((private|public|protected|internal|override|open|final|suspend|inline|operator|infix|tailrec|external|abstract|expect|actual|@\S*)\s+)*fun ", re.I)
RUBY_OPENERS = ("do", "if", "unless", "while", "until", "for", "case", "begin", "module", "class")
JS_MODIFIERS = frozenset("async static public private protected export default abstract get set".split())
# End of fixed values.


def code(line: str) -> str:
    """The trimmed line; empty if it is a line comment."""
    text = line.strip()
    return "" if text.startswith(("//", "#")) else text


def before_paren(text: str) -> str:
    return text.partition("(")[0].strip()


def last_word(text: str, none: str = "unknown") -> str:
    words = before_paren(text).split() if "(" in text else []
    return words[-1] if words else none


def go_defines(text: str) -> bool:
    low = text.lower()
    return "func " in low or low.startswith("func(") or "function " in low or "= function(" in low or "=>" in low and "{" in low


def go_name(text: str) -> str:
    if "function " in text:
        m = re.match(r"\s*([^ (]*)[ (]", text.partition("function ")[2].strip())
        return m[1] if m else "anonymous"
    if "=>" in text:
        words = text.partition("=")[0].split()
        return words[-1] if len(words) >= 2 else "arrow"
    if "func " not in text:
        return "unknown"
    rest = text.partition("func ")[2].strip()
    if rest.startswith("("):
        depth = 0
        for k, c in enumerate(rest):
            depth += (c == "(") - (c == ")")
            if not depth:
                rest = rest[k + 1 :].strip()
                break
        else:
            rest = ""
    return before_paren(rest)


def cpp_defines(text: str) -> bool:
    if "(" not in text or CPP_NOT.match(text):
        return False
    if "~" in before_paren(text) or "operator" in text.lower():
        return True
    return bool(before_paren(text)) and (text.endswith(("{", ")")) or ") {" in text or ") :" in text)


def java_defines(text: str) -> bool:
    return "(" in text and not text.startswith(("/*", "*")) and (text.startswith("@") or bool(JAVA_HEAD.match(text)))


def rust_name(text: str) -> str:
    return before_paren(RUST_HEAD.sub("", text, count=1)) if "(" in text else "unknown"


def swift_name(text: str) -> str:
    return before_paren(re.sub(r"^((private|public|internal|override|mutating|static|class) )*func ", "", text, flags=re.I))


def kotlin_defines(text: str) -> bool:
    return bool(KOTLIN_HEAD.match(text)) and "(" in text and (text.endswith(("{", ")")) or ") =" in text or "):" in text)


def kotlin_name(text: str) -> str:
    rest = re.sub(r"^<[^>]*>\s*", "", re.split(r"fun ", text, maxsplit=1, flags=re.I)[-1].strip())
    return re.split(r"[(: ]", rest, maxsplit=1)[0]


@dataclass(frozen=True)
class Braces:
    """Functions that end where their braces are closed. While a body is awaited, a later definition takes over.

    Functions don't nest, and one that is open at the end of the file has no extent.
    """

    defines: Callable[[str], bool]
    name: Callable[[str], str]

    def extents(self, lines: list[str]) -> list[Extent]:
        found, state, depth, name, start = [], "idle", 0, "", 0
        for number, line in enumerate(lines, 1):
            text = code(line)
            delta = text.count("{") - text.count("}")
            depth += delta
            if state == "inside":
                if depth <= 0:
                    found.append((name, start, number - start + 1))
                    state = "idle"
                continue
            if state == "awaiting" and depth > 0:
                state = "inside"
            if text and self.defines(text):
                name, start, depth = self.name(text), number, delta
                state = "inside" if delta > 0 else "awaiting" if state != "inside" else state
            elif state == "idle":
                depth = 0
        return found


def word_count(text: str, word: str) -> int:
    return len(re.findall(rf"(?<![A-Za-z0-9_]){re.escape(word)}" + ("" if word.endswith(" ") else r"(?![A-Za-z0-9_])"), text))


class Ruby:
    """Functions that end where the depth of their keywords falls back to where they began; they may nest."""

    def extents(self, lines: list[str]) -> list[Extent]:
        found, depth, active = [], 0, []
        for number, line in enumerate(lines, 1):
            text = code(line)
            if text.startswith("def "):
                name = re.split(r"[ (]", text[4:].strip().removeprefix("self."), maxsplit=1)[0]
                active.append((name, number, depth))
            depth += word_count(text, "def ") + sum(word_count(text, w) for w in RUBY_OPENERS) + text.count("{")
            depth = max(0, depth - word_count(text, "end") - text.count("}"))
            for name, start, base in [x for x in reversed(active) if depth <= x[2]]:
                found.append((name, start, number - start + 1))
            active = [x for x in active if depth > x[2]]
        return found + [(name, start, len(lines) - start + 1) for name, start, _ in active]


class Python:
    """Functions that end before the first line indented no deeper than they are; they may nest."""

    def extents(self, lines: list[str]) -> list[Extent]:
        indented = [x for x in lines if x[:1] in (" ", "\t") and code(x)]
        tabs = bool(indented) and indented[0][0] == "\t"
        found, stack = [], []
        for number, line in enumerate(lines, 1):
            text = line.strip()
            if not text or text[0] in "#@":
                continue
            lead = line[: len(line) - len(line.lstrip(" \t"))]
            indent = lead.count("\t") if tabs else (lead.count(" ") + 4 * lead.count("\t")) // 4
            while stack and stack[-1][2] >= indent:
                name, start, _ = stack.pop()
                found.append((name, start, number - start))
            if re.match(r"(async )?def ", text):
                head = re.sub(r"^(async )?def ", "", text)
                stack.append((before_paren(head) if "(" in head else "unknown", number, indent))
        return found + [(name, start, len(lines) - start + 1) for name, start, _ in stack]


class Script:
    """JavaScript and TypeScript: braces inside parentheses don't count; a function may end with the file."""

    @staticmethod
    def defines(text: str) -> bool:
        low = text.lower()
        if not low or low.startswith(("//", "#", "/*", "*")):
            return False
        if "=>" in low and "{" in low:
            head = low.rpartition("=>")[0]
            if "//" not in head and '"' not in head:
                return True
        if "function " in low:
            return True
        close, brace, arrow = low.rfind(")"), low.rfind("{"), low.find("=>")
        if "(" not in low or close < 0 or not close < brace < (arrow if arrow >= 0 else len(low)):
            return False
        return 1 <= sum(w not in JS_MODIFIERS for w in before_paren(low).split()) <= 2

    @staticmethod
    def name(text: str) -> str:
        text = re.sub(r"^(export )?(default )?(async )?(static )?(public )?(private )?(protected )?(abstract )?", "", text).strip()
        if text.startswith("function "):
            m = re.match(r"\s*([^(<]*)[(<]", text[9:])
            return m[1].strip() if m else "anonymous"
        if text.startswith("constructor"):
            return "constructor"
        if text.find("(") > 0:
            return before_paren(text)
        if "=>" in text:
            words = text.partition("=")[0].split()
            return words[-1] if text.find("=") < text.find("=>") and len(words) >= 2 else "arrow"
        return "unknown"

    def extents(self, lines: list[str]) -> list[Extent]:
        found, name, start = [], None, 0
        for number, line in enumerate(lines, 1):
            text = code(line)
            begins = name is None and self.defines(text)
            if begins:
                name, start, braces, parens, opened = self.name(text), number, 0, 0, False
            if name is None:
                continue
            for c in text:
                if c == "(":
                    parens += 1
                elif c == ")":
                    parens -= 1
                elif parens == 0 and c == "{":
                    braces, opened = (1 if begins else braces + 1), True
                elif parens == 0 and c == "}":
                    braces -= 1
            parens = max(parens, 0)
            if not begins and opened and braces <= 0 and parens == 0:
                found.append((name, start, number - start + 1))
                name = None
        return found + ([(name, start, len(lines) - start + 1)] if name is not None else [])


GO = Braces(go_defines, go_name)
CPP = Braces(cpp_defines, lambda t: last_word(t).rpartition("::")[2])
JAVA = Braces(java_defines, last_word)
BY_LANGUAGE = {
    "python": Python(), "ruby": Ruby(), "javascript": Script(), "typescript": Script(), "c": CPP, "cpp": CPP, "java": JAVA, "csharp": JAVA,
    "rust": Braces(lambda t: bool(RUST_HEAD.match(t)), rust_name), "swift": Braces(lambda t: bool(SWIFT_HEAD.match(t)), swift_name), "kotlin": Braces(kotlin_defines, kotlin_name),
}


def split_lines(source: str) -> list[str]:
    return source.removesuffix("\n").split("\n") if source else []


def extents(source: str, lang: str) -> list[Extent]:
    """(name, first line, lines) of the functions of one file, in the order in which they end."""
    return BY_LANGUAGE.get(lang, GO).extents(split_lines(source))


SCHEMA = "path string, lang string, ord int, name string, line_start int, line_count int, body array<string>"
ARROW = pa.schema([("path", pa.string()), ("lang", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("line_start", pa.int32()), ("line_count", pa.int32()), ("body", pa.list_(pa.string()))])


def functions(files: DataFrame) -> DataFrame:
    """(path, lang, ord, name, line_start, line_count, body) of every function; ``body`` holds its lines in the file."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, lang, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = split_lines(source or "")
                for k, (name, start, count) in enumerate(BY_LANGUAGE.get(lang, GO).extents(lines)):
                    rows.append((path, lang, k, name, start, count, lines[start - 1 : start - 1 + count]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW.types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

    return files.select("path", "lang", F.coalesce("source", F.lit("")).alias("source")).mapInArrow(run, SCHEMA)
