"""Column expressions with Python's text rules, where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters at which Python ends a line ("\r\n" counts as one).
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
STRIP_ENDS = f"^{_SPACE}|{_SPACE}$"


def strip(c: Column) -> Column:
    """All white space off both ends, not blanks alone."""
    return F.regexp_replace(c, STRIP_ENDS, "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    parts = F.split(c, LINE_ENDS, -1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts))


def addressable_lines(c: Column) -> Column:
    """Lines an editor can go to: one more than there are newlines, none in an empty text."""
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, "\n", -1))).cast("bigint")


def literal(text: Column, old: str, new: str) -> Column:
    """Replace a literal text, unless it is empty."""
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def integer(c: Column) -> Column:
    """What Python's int() makes of a text: surrounding white space is fine, fractions are not (null)."""
    c = strip(c)
    return F.when(c.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(c, "_", "").try_cast("bigint"))
