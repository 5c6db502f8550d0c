"""Statement texts as Spark expressions: without comments and literals, at one depth of brackets, cut at their commas.

No parser: the patterns know what hides text (comments, literals, quoted names) and which brackets belong together. All loops in them
are possessive, so a match takes time in proportion to the text and no stack, however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 24  # brackets within brackets, and comments within comments, that one pass matches
PASSES = 3  # passes that close brackets, each of them DEPTH levels

_LINE = r"(--)(?:\\\n|[^\r\n])*+"
_RAW = r"""(?<!\w)[rR](?:(')[^']*+'|(")[^"]*+")"""
_SINGLE = r"""(')[^'\\]*+(?:\\.[^'\\]*+)*+'"""
_DOUBLE = r"""(")[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_QUOTED_NAME = r"(`(?:[^`]++|``)*+`)"


def _nested(opens: str, closes: str, other: str, depth: int) -> str:
    pattern = f"{opens}(?:{other})*+{closes}"
    for _ in range(depth - 1):
        pattern = f"{opens}(?:{other}|{pattern})*+{closes}"
    return pattern


_COMMENT = _nested(r"/\*", r"\*/", r"[^*/]++|\*(?!/)|/(?!\*)", DEPTH).replace(r"\*/", r"(?:\*/)")
#: A pair of brackets with all that is in it.
BRACKETS = _nested(r"\(", r"\)", r"[^()]++", DEPTH)
_FILLED = r"\((?!\))"
#: A table name, in one or several parts.
NAME = r"(?:[\w$]++|`[^`]++`)(?:\s*+\.\s*+(?:[\w$]++|`[^`]++`))*+"

# What the groups of a match keep: the mark of a line comment, both marks of an empty literal, a quoted name whole; of a bracketed comment nothing.
_HIDDEN = f"(?s){_LINE}|{_COMMENT}|{_RAW}|{_SINGLE}|{_DOUBLE}|{_QUOTED_NAME}"
_KEPT = "$1 $2$2$3$3$4$4$5$5$6"


def bare(sql: Column) -> Column:
    """The text without comments, every literal empty; quoted names stay. What is never closed stays as it is."""
    hidden = F.regexp_replace(sql, _HIDDEN, "\u0001" + _KEPT.replace(" ", "\u0001"))
    # Only names are glued to what stands beside them; the places of all else become blanks.
    names = F.regexp_replace(hidden, "\u0001\u0001(`)", "$1")
    return F.regexp_replace(names, "\u0001(?:--)?+\u0001", " ")


def outline(text: Column) -> Column:
    """A bare text at depth 0: all brackets empty."""
    flat = F.regexp_replace(text, BRACKETS, "()")
    for _ in range(PASSES - 1):
        flat = F.when(flat.rlike(_FILLED), F.regexp_replace(flat, BRACKETS, "()")).otherwise(flat)
    return flat


def unclosed(text: Column, flat: Column) -> Column:
    """Whether a bare text, or its outline, holds the start of a comment, literal, name or bracket that nothing ends."""
    return flat.rlike(rf"{_FILLED}|(?<!\()\)") | F.regexp_replace(text, "''|\"\"|`(?:[^`]++|``)*+`", "").rlike(r"""['"`]|/\*""")


def until(words: str) -> str:
    """A pattern for a stretch of bare text at one depth, up to the first of some words (a pattern of alternatives)."""
    return rf"(?:{BRACKETS}|[^()\w]++|(?!(?:{words})\b)\w++)*+"


def parts(text: Column) -> Column:
    """The parts of a bare text between its commas at depth 0, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?:{BRACKETS}|[^(),])++"), F.lit(0)), lambda x: F.trim(x))


def plain_name(c: Column) -> Column:
    """A table name without quotes and without blanks around its dots."""
    return F.regexp_replace(F.regexp_replace(c, r"[`\"]", ""), r"\s*\.\s*", ".")


_LIST_ITEM = r"(?:[\w$]++|`[^`]++`)\s*+(?:\(\)\s*+)?+(?:MAX\s++RECURSION\s++LEVEL\s++\d++\s*+)?+AS\s*+(?:NOT\s++)?+(?:MATERIALIZED\s*+)?+\(\)"
_WITH = rf"(?:WITH\s++(?:RECURSIVE\s++)?+{_LIST_ITEM}(?:\s*+,\s*+{_LIST_ITEM})*+\s*+)?+"


def without_names(text: Column) -> Column:
    """A bare text whose quoted names are all the same word, so that none reads like a verb."""
    return F.regexp_replace(text, "`(?:[^`]++|``)*+`", "`q`")


def reads_only(text: Column, flat: Column) -> Column:
    """Whether a bare text without names, whose outline is ``flat``, opens with SELECT or WITH and its main verb reads.

    After a WITH list only SELECT, VALUES, TABLE or a bracket may follow; SELECT ... INTO, writes within brackets
    (which some databases allow in a WITH list) and text that nothing closes do not count as reading. Null text is null.
    """
    verb = flat.rlike(rf"(?is)^{_WITH}(?:SELECT\b|VALUES\b|TABLE\b|\(\))") & flat.rlike(r"(?is)^(?:SELECT|WITH)\b")
    writes = flat.rlike(r"(?i)\b(?:INTO|INSERT\s+OVERWRITE)\b") | text.rlike(r"(?i)\(\s*(?:INSERT|UPDATE|DELETE|MERGE)\b(?!\s*[,)(])")
    return verb & ~writes & ~unclosed(text, flat)


def several(text: Column) -> Column:
    """Whether a bare text holds more than one statement."""
    return F.regexp_replace(text, r"[;\s]+$", "").contains(";")
