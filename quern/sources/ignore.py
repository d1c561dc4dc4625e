"""Ignore patterns in git's syntax as one Spark predicate."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that apply where a project sets none.
DEFAULT_PATTERNS = ("node_modules/", "target/", ".git/")


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression, negated) of one pattern line; None for blanks and comments.

    The expression matches a path when the pattern matches it or one of its
    parent folders. A slash at the start or inside ties the pattern to the
    root; one at the end limits it to folders. `*` and `?` stop at slashes,
    `**` doesn't. A backslash takes the next sign literally.
    """
    line = pattern.rstrip("\r\n")
    line = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    tied = "/" in line
    line = line.lstrip("/")
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out.append("/.+")
            i += 3
        elif c == "*":
            while i + 1 < len(line) and line[i + 1] == "*":
                i += 1
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(line):
                i += 1
                c = line[i]
            out.append(re.escape(c))
            i += 1
    start = "^" if tied else "(?:^|/)"
    return f"{start}{''.join(out)}{'/' if only_folders else '(?:/|$)'}", negated


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path (or a folder above it) ignores it.

    A null path gives null. The patterns, a list of the project's settings,
    become regular expressions once; nothing is looked up per row.
    """
    rules = [r for r in map(pattern_regex, patterns) if r]
    # The later line wins: it is asked first.
    verdict = reduce(
        lambda rest, rule: F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(rest), rules, F.lit(False)
    )
    return F.when(path.isNotNull(), verdict)
