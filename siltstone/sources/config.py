"""Thresholds by language, and project settings that change them."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the detectors; w, a and c stand for warning, alert and critical."""

    # The defaults that findings are compared with.
    nesting_w: int = 4
    nesting_a: int = 5
    file_loc_w: int = 1000
    file_loc_a: int = 2000
    file_loc_c: int = 4000
    func_loc_w: int = 80
    func_loc_a: int = 300
    func_cc_w: int = 9
    func_cc_a: int = 20
    func_count_w: int = 25
    func_count_a: int = 50
    bumps: int = 2
    conditional_w: int = 2
    conditional_a: int = 10
    args_w: int = 4
    args_a: int = 7
    brain_class: int = 20
    paragraph: int = 20
    lazy: int = 3
    dup_lines: int = 10
    dup_similarity: float = 0.75
    comments: float = 0.3
    globals_: int = 5
    long_scope: int = 50
    switch_w: int = 10
    switch_a: int = 20


DEFAULT = Thresholds()
BY_LANGUAGE = {
    "python": dataclasses.replace(DEFAULT, file_loc_w=600, func_loc_w=70),
    "javascript": dataclasses.replace(DEFAULT, nesting_w=3, file_loc_w=700, func_loc_w=60, func_loc_a=200),
    "typescript": dataclasses.replace(DEFAULT, nesting_w=3, file_loc_w=700, func_loc_w=60, func_loc_a=200),
    "ruby": dataclasses.replace(DEFAULT, nesting_w=3, file_loc_w=600, file_loc_a=1500, file_loc_c=3000, func_loc_w=60, func_loc_a=200, func_cc_w=7, func_cc_a=15, func_count_w=20, func_count_a=40, brain_class=15, dup_lines=8),
    "swift": dataclasses.replace(DEFAULT, file_loc_w=800),
    "kotlin": dataclasses.replace(DEFAULT, file_loc_w=800, func_loc_w=70),
}
# End of fixed values.


def thresholds(spark: SparkSession, overrides: dict[str, float] | None = None) -> DataFrame:
    """One row per language, and one with the language '*' for all others; positive overrides apply to each."""
    changed = {k: v for k, v in (overrides or {}).items() if v and v > 0}
    rows = {lang: dataclasses.replace(t, **changed) for lang, t in {"*": DEFAULT, **BY_LANGUAGE}.items()}
    cells = ", ".join("('" + lang + "', " + ", ".join(f"{v}D" if isinstance(v, float) else str(int(v)) + "L" for v in dataclasses.astuple(t)) + ")" for lang, t in rows.items())
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t(lang_key, {', '.join(f.name for f in dataclasses.fields(Thresholds))})")


def find_settings(start: str, name: str) -> dict:
    """The nearest settings file from ``start`` upwards, parsed; {} without one or if it is no TOML."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            try:
                with open(path, "rb") as f:
                    return tomllib.load(f)
            except tomllib.TOMLDecodeError:
                return {}
        if os.path.dirname(folder) == folder:
            return {}
        folder = os.path.dirname(folder)
