"""Names, keywords and glob patterns as Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes of identifiers by case style.
CASE_PATTERNS = {
    "snake_case": "^[a-z][a-z0-9]*(_[a-z0-9]+)*$",
    "UPPER_SNAKE": "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$",
    "camelCase": "^[a-z][a-zA-Z0-9]*$",
}

# Keyword -> business domain, checked in this order; the first hit wins.
DOMAIN_KEYWORDS = {
    "order": "trade",
    "trade": "trade",
    "pay": "trade",
    "payment": "trade",
    "user": "user",
    "login": "user",
    "member": "user",
    "product": "product",
    "item": "product",
    "sku": "product",
    "log": "log",
    "event": "log",
    "click": "log",
}

# Layer name prefixes.
LAYER_PREFIXES = {
    "ODS": "ods_",
    "DWD": "dwd_",
    "DWS": "dws_",
    "ADS": "ads_",
    "DIM": "dim_",
    "TMP": "tmp_",
}

_WORD_BREAK = "([a-z0-9])([A-Z])"
_NOT_ALNUM = "[^a-zA-Z0-9]+"


def snake_name(name: str) -> str:
    """snake_case form of one Python string; used to rename columns on the driver."""
    broken = re.sub(_WORD_BREAK, r"\1_\2", name.strip())
    return re.sub(_NOT_ALNUM, "_", broken).strip("_").lower()


def snake_case(c: Column) -> Column:
    """snake_case form of a string column."""
    broken = F.regexp_replace(F.trim(c), _WORD_BREAK, "$1_$2")
    joined = F.regexp_replace(broken, _NOT_ALNUM, "_")
    return F.lower(F.regexp_replace(joined, "^_|_$", ""))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression for a shell-style pattern with ``*`` and ``?``."""
    wild = {"*": ".*", "?": "."}
    return "^" + "".join(wild.get(ch, re.escape(ch)) for ch in pattern.lower()) + "$"


def matches_any_glob(c: Column, patterns: Iterable[str]) -> Column:
    """True where the lower-cased value fits at least one pattern."""
    union = "|".join(glob_regex(p) for p in patterns)
    return F.lower(c).rlike(union) if union else F.lit(False)


def first_keyword(c: Column, mapping: Mapping[str, str], default: str) -> Column:
    """Label of the first keyword, in mapping order, that the lower-cased text contains."""
    # Every test is evaluated, so the text is lower-cased once and not once per keyword.
    text = F.lower(c)
    first = F.array_position(F.array(*[text.contains(k) for k in mapping]), True)
    labels = F.array(F.lit(default), *[F.lit(v) for v in mapping.values()])
    return F.element_at(labels, (F.coalesce(first, F.lit(0)) + 1).cast("int"))


def present(values: Column) -> Column:
    """An array of distinct strings without its NULLs.

    Unlike ``array_compact`` this is compiled, and so is everything the array is made of.
    """
    return F.array_except(values, F.array(F.lit(None).cast("string")))


def domain_of(c: Column) -> Column:
    """Business domain of a table name, ``common`` when no keyword fits."""
    return first_keyword(c, DOMAIN_KEYWORDS, "common")


def layer_of(c: Column, prefixes: Mapping[str, str] = LAYER_PREFIXES) -> Column:
    """Warehouse layer by name prefix, NULL when no prefix fits."""
    return F.coalesce(*[F.when(c.startswith(p), F.lit(layer)) for layer, p in prefixes.items()])


def count_pattern(c: Column, pattern: str) -> Column:
    """Number of regular-expression matches, as a long."""
    return F.regexp_count(c, F.lit(pattern)).cast("long")
