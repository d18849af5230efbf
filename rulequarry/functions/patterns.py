"""Globs as regular expressions, and small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the trim of source lines takes away: Unicode white space.
BLANK = r"^[\s\u0085   -     　]*"


def path_glob(glob: str, recursive: bool = False) -> str:
    """An anchored pattern. Plain: each star stays within a path segment, so ``**`` needs a segment of its own. Recursive: ``**`` spans segments, also
    none. Dots are literal; other characters keep the meaning that they have in a pattern."""
    out, i = [], 0
    while i < len(glob):
        if recursive and glob.startswith("**/", i):
            out.append("(.*/)?")
            i += 3
        elif recursive and glob.startswith("/**", i) and not glob.startswith("/**/", i):
            out.append("(/.*)?")
            i += 3
        elif recursive and glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({".": r"\.", "*": "[^/]*"}.get(glob[i], glob[i]))
            i += 1
    return f"^{''.join(out)}$"


def module_glob(glob: str) -> str:
    """An anchored pattern for module names; a star crosses dots."""
    return f"^{glob.replace('.', chr(92) + '.').replace('*', '.*')}$"


def is_code_line(text: Column) -> Column:
    """Neither blank nor, after blanks, a comment."""
    bare = F.regexp_replace(text, BLANK, "")
    return (bare != "") & ~bare.startswith("#")


def line_of_offset(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset.cast("int")), "\n", -1))
