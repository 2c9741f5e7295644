"""Glob patterns as predicates: equality or a prefix where the pattern allows, else a regular expression.

`*` any run, `?` one character, `[a-z]` and `[^x]` classes (if classes), backslash
takes the next character as it is. A class without an end matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("\\^$.|?*+()[]{}-&~#")


def _quoted(c: str) -> str:
    return "\\" + c if c in _META else c


def to_regex(glob: str, classes: bool = True) -> str | None:
    """Java and Python regular expression for whole strings; None if nothing can match."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(glob):
            out.append(_quoted(glob[i]))
            i += 1
        elif c == "[" and classes:
            end = glob.find("]", i + (glob[i : i + 1] == "^") + 1)
            if end < 0:
                return None
            body, negated = (glob[i + 1 : end], "^") if glob[i] == "^" else (glob[i:end], "")
            parts = re.findall(r"(.)-(.)|(.)", body, re.S)
            out.append(f"[{negated}" + "".join(f"{_quoted(min(a, b))}-{_quoted(max(a, b))}" if a else _quoted(x) for a, b, x in parts) + "]")
            i = end + 1
        else:
            out.append(_quoted(c))
    return "(?s)^" + "".join(out) + "$"


def matches(column: Column, glob: str, classes: bool = True) -> Column:
    """Literal patterns and `prefix*` are pushed down to the scan."""
    special = set("*?\\[") if classes else set("*?\\")
    if not special & set(glob):
        return column == F.lit(glob)
    if glob.endswith("*") and not special & set(glob[:-1]):
        return column.startswith(glob[:-1])
    regex = to_regex(glob, classes)
    return F.lit(False) if regex is None else column.rlike(regex.replace("$", r"\z") if regex.endswith("$") and "\\$" not in regex else regex)


def regex_column(glob: Column) -> Column:
    """The same for a column of patterns without classes, as subscriptions have them."""
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)(\\.|.)"), 1)
    own = lambda x: F.when(F.length(x) > 1, F.substring(x, 2, 1)).otherwise(x)  # noqa: E731  an escaped character without its backslash
    literal = lambda x: F.regexp_replace(own(x), r"([.^$|*?+(){}\[\]\\])", r"\\$1")
    parts = F.transform(tokens, lambda x: F.when(x == "*", ".*").when(x == "?", ".").otherwise(literal(x)))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(parts, ""), F.lit(r"\z"))
