"""Ordered ignore rules in gitignore syntax.

Rules are compiled once, on the driver, to regular expressions (a rule list is a configuration file). Each
path and each directory above it is tested as a file name and as a directory name; the last rule that
matches decides, and a path with an ignored directory above it can't be taken back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semindex.functions import columns as C


@dataclass(frozen=True)
class Rule:
    pattern: str  # for a path without a trailing slash
    negated: bool
    dirs_only: bool


def compile_rule(line: str) -> Rule | None:
    """One line of an ignore file; null for blank lines and comments."""
    text = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r"))
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    dirs_only = text.endswith("/")
    text = text.rstrip("/") if dirs_only else text
    anchored = "/" in text
    text = text.lstrip("/")
    parts = text.split("/")
    out = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
            continue
        out += glob(part) + ("" if last else "/")
    return Rule(f"(?is)^{out}\\z", negated, dirs_only)


def glob(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            inside = part[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inside[1:] if inside[:1] == "!" else inside) + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_ignore(lines: list[str] | tuple[str, ...]) -> list[Rule]:
    return [r for r in map(compile_rule, lines) if r]


def verdict(path: Column, is_dir: bool, rules: list[Rule]) -> Column:
    """The last matching rule's word on one path: true ignored, false taken back or not matched."""
    out = F.lit(False)
    for rule in rules:
        if is_dir or not rule.dirs_only:
            out = F.when(path.rlike(rule.pattern), F.lit(not rule.negated)).otherwise(out)
    return out


def is_ignored(path: Column | str, rules: list[Rule]) -> Column:
    """For a column of relative paths: directories above decide first, then the name as file or as directory."""
    whole = C.slashed(path)
    parts = C.path_segments(whole)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    return F.exists(above, lambda p: verdict(p, True, rules)) | verdict(whole, False, rules) | verdict(whole, True, rules)


def apply_ignore(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Files that no rule ignores. Directories are tested once each and joined back, as files share them.

    Rules hold for all collections here; the directory table is broadcast by Spark if it is small.
    """
    parts = C.path_segments(C.slashed("file_path"))
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    held = files.withColumn("_folder", folder)
    # A folder is out if it or one above it is ignored as a directory.
    out = F.when(F.col("_folder") == "", F.lit(False)).otherwise(ignored_folder("_folder", rules))
    folders = held.select("_folder").distinct().withColumn("_out", out)
    kept = held.join(folders.where(~F.col("_out")).select("_folder"), "_folder")
    whole = C.slashed("file_path")
    return kept.where(~(verdict(whole, False, rules) | verdict(whole, True, rules))).drop("_folder")


def ignored_folder(path: str, rules: list[Rule]) -> Column:
    parts = C.path_segments(path)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(each, lambda p: verdict(p, True, rules))
