"""Text helpers shared by rules, checks and profiling. All are plain Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import WHITESPACE


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (Spark's own ``trim`` removes only spaces).

    Matching a character against the whole set costs far more than comparing it, and most values neither
    start nor end with a space, so those that start and end in printable ASCII are passed through.
    """
    plain = (c >= "!") & (c < "\x7f") & F.substring(c, -1, 1).between("!", "~")
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


#: White space that is not the blank.
_OTHER_SPACES = WHITESPACE.replace(" ", "")


def blanks(c: Column) -> Column:
    """Every white space as a blank: one pass, without a pattern."""
    return F.translate(c, _OTHER_SPACES, " " * len(_OTHER_SPACES))


def one_blank(c: Column) -> Column:
    """Runs of blanks as one; most texts have none, and are passed through."""
    return F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c)


def _strip_sql(name: str) -> str:
    c = "`" + name.replace("`", "``") + "`"
    plain = f"{c} >= '!' AND {c} < '\x7f' AND substring({c}, -1, 1) BETWEEN '!' AND '~'"
    return f"CASE WHEN {plain} THEN {c} ELSE btrim({c}, '{WHITESPACE}') END"


def strip_column(name: str) -> Column:
    """``strip`` of a named text column: one call to the JVM instead of a dozen."""
    return F.expr(_strip_sql(name))


def blank_column(name: str) -> Column:
    return F.expr(f"`{name}` IS NULL OR ({_strip_sql(name)}) = ''")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == F.lit(""))


def fill(template: str, **parts: Column | str) -> Column:
    """Fill ``{name}`` slots of a text with columns; plain strings are merged in at compile time."""
    pieces: list[Column] = []
    literal = ""
    for chunk in re.split(r"(\{[a-z]+\})", template):
        name = chunk[1:-1] if chunk.startswith("{") else None
        if name is not None and name in parts:
            part = parts[name]
            if isinstance(part, str):
                literal += part
                continue
            if literal:
                pieces.append(F.lit(literal))
                literal = ""
            pieces.append(F.coalesce(part.cast("string"), F.lit("None")))
        else:
            literal += chunk
    if literal:
        pieces.append(F.lit(literal))
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def java_regex(pattern: str) -> str | None:
    """Express a Python search pattern for ``rlike``; None when the pattern does not compile.

    ``\\d \\w \\s \\b`` are Unicode-aware in Python, and only a newline ends a line there, hence the flags.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None
    flags = "dU" if re.search(r"\\[dDwWsSbB]", pattern) else "d"
    translated = re.sub(r"\(\?P<", "(?<", pattern)
    translated = re.sub(r"\(\?P=([A-Za-z_]\w*)\)", r"\\k<\1>", translated)
    return f"(?{flags}){translated}"
