"""Synthetic rows for a schema: seeded random values, or values that follow the row number.

A column's maker is found in a table by its type; texts have a second table, of name hints. Makers get
their randomness from ``Draws``, whose numbers are hashes of (row number, seed, column, use), so a table is
the same however many partitions make it, and a retried task makes the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "id"  # the row number, from 0
KEY = re.compile(r"(^id|_id|key)$")

STATES = ("draft", "open", "held", "done", "void")
WORDS = ("amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "harbor", "inlet", "jetty", "knoll", "lagoon")
FIRST_DAY, DAYS = "2015-01-01", 4_000
#: Decimal digits of a whole number, by its type.
DIGITS = {T.ByteType: 2, T.ShortType: 4, T.IntegerType: 8, T.LongType: 15}


class Draws:
    """Random numbers of one column; ``use`` tells apart the draws of one value."""

    def __init__(self, column: str, seed: int):
        self.column, self.seed = column, seed

    def hashed(self, use: int = 0) -> Column:
        return F.xxhash64(F.col(ROW), F.lit(self.seed), F.lit(self.column), F.lit(use))

    def below(self, size: int, use: int = 0) -> Column:
        """A whole number from 0 to ``size`` - 1."""
        return F.pmod(self.hashed(use), F.lit(size).cast("long"))

    def one_of(self, pool: tuple[str, ...], use: int = 0) -> Column:
        return F.get(F.array(*map(F.lit, pool)), self.below(len(pool), use).cast("int"))

    def digits(self, count: int, use: int = 0) -> Column:
        """A text of ``count`` digits, nine a draw."""
        widths = [min(9, count - at) for at in range(0, count, 9)]
        return F.concat(*(F.lpad(self.below(10**w, use + k).cast("string"), w, "0") for k, w in enumerate(widths)))


def _whole(draws: Draws, field: T.StructField) -> Column:
    """Keys count up from 1, so they are unique."""
    if KEY.search(field.name.lower()):
        return F.col(ROW) + 1
    return draws.below(10 ** DIGITS[type(field.dataType)])


def _decimal(draws: Draws, field: T.StructField) -> Column:
    """All digits that the type holds."""
    kind = field.dataType
    digits, whole = draws.digits(kind.precision), kind.precision - kind.scale
    return F.concat(F.lit("0"), F.substring(digits, 1, whole), F.lit("."), F.substring(digits, whole + 1, kind.scale), F.lit("0"))


def _moment(draws: Draws, field: T.StructField) -> Column:
    after = F.make_dt_interval(days=draws.below(DAYS).cast("int"), secs=draws.below(86_400, 1).cast("decimal(18,6)"))
    return F.lit(FIRST_DAY).cast("timestamp_ntz") + after


def _list(draws: Draws, field: T.StructField) -> Column:
    """One to three elements."""
    kind = field.dataType.elementType
    made = [_random(T.StructField(f"{draws.column}.{k}", kind), draws.seed) for k in range(3)]
    return F.slice(F.array(*made), 1, draws.below(3).cast("int") + 1)


def _record(draws: Draws, field: T.StructField) -> Column:
    made = (_random(T.StructField(f"{draws.column}.{f.name}", f.dataType), draws.seed).alias(f.name) for f in field.dataType.fields)
    return F.struct(*made)


def _text(draws: Draws, field: T.StructField) -> Column:
    if (field.metadata or {}).get("logical_type") == "JSON":
        return F.to_json(F.struct(draws.one_of(WORDS).alias("word"), draws.below(1_000, 1).alias("number")))
    shape = next((shape for hint, shape in SHAPES if re.search(hint, field.name.lower())), _phrase)
    return shape(draws)


def _phrase(draws: Draws) -> Column:
    """Two to six words."""
    words = F.array(*(draws.one_of(WORDS, use) for use in range(6)))
    return F.array_join(F.slice(words, 1, draws.below(5, 6).cast("int") + 2), " ")


def _title(draws: Draws) -> Column:
    return F.initcap(F.concat_ws(" ", draws.one_of(WORDS), draws.one_of(WORDS, 1)))


def _label(draws: Draws) -> Column:
    """A capital letter and two digits."""
    return F.concat(F.char(draws.below(26) + 65), draws.digits(2, 1))


def _address(before: str, after: str) -> Callable[[Draws], Column]:
    """A word and a number between fixed texts."""
    return lambda draws: F.concat(F.lit(before), draws.one_of(WORDS), draws.digits(5, 1), F.lit(after))


#: Texts by what the column's name holds; the first hint found counts.
SHAPES: tuple[tuple[str, Callable[[Draws], Column]], ...] = (
    ("mail", _address("", "@mail.example")),
    ("url|uri|link|site", _address("https://site.example/", "")),
    ("phone|mobile|fax", lambda draws: F.concat_ws("-", draws.digits(2), draws.digits(3, 1), draws.digits(4, 2))),
    ("status|state|phase", lambda draws: draws.one_of(STATES)),
    ("code|type|class|segment|priority", _label),
    ("name|title|city|nation|region", _title),
)

RANDOM: dict[type, Callable[[Draws, T.StructField], Column]] = {
    **dict.fromkeys(DIGITS, _whole),
    T.BooleanType: lambda draws, field: draws.below(2) == 0,
    T.FloatType: lambda draws, field: draws.below(10**6) / F.lit(64),
    T.DoubleType: lambda draws, field: draws.below(10**12) / F.lit(1024),
    T.DecimalType: _decimal,
    T.DateType: lambda draws, field: F.date_add(F.lit(FIRST_DAY).cast("date"), draws.below(DAYS).cast("int")),
    T.TimestampType: _moment,
    T.TimestampNTZType: _moment,
    T.BinaryType: lambda draws, field: F.unhex(F.sha2(draws.hashed().cast("string"), 256)),
    T.StringType: _text,
    T.ArrayType: _list,
    T.StructType: _record,
}


def _random(field: T.StructField, seed: int) -> Column:
    maker = RANDOM.get(type(field.dataType))
    if maker is None:
        raise TypeError(f"no random values for {field.name}: {field.dataType.simpleString()}")
    return maker(Draws(field.name, seed), field).cast(field.dataType)


def random_rows(spark: SparkSession, schema: T.StructType, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` typed, name-aware random rows; none for 0. Whole-number key columns are unique."""
    return spark.range(rows).select(*[_random(f, seed).alias(f.name) for f in schema.fields])


# What row i (from 0) holds, by type.
_COUNTED = "id + 1"
_SCALED = "(id + 1) * 1.5D"
_DAY = "concat('2025-01-', lpad(id % 28 + 1, 2, '0'))"
BY_NUMBER: dict[type, str] = {
    **dict.fromkeys(DIGITS, _COUNTED),
    **dict.fromkeys((T.FloatType, T.DoubleType, T.DecimalType), _SCALED),
    **dict.fromkeys((T.TimestampType, T.TimestampNTZType), f"concat({_DAY}, ' 10:00:00')"),
    T.DateType: _DAY,
    T.BooleanType: "id % 2 = 0",
}


def deterministic_rows(spark: SparkSession, schema: T.StructType, rows: int) -> DataFrame:
    """Row ``i`` (from 0) gets values that follow ``i``: sequence numbers, dates of one month, names."""

    def value(field: T.StructField) -> Column:
        if type(field.dataType) in BY_NUMBER:
            return F.expr(BY_NUMBER[type(field.dataType)])
        number = F.expr(_COUNTED).cast("string")
        if (field.metadata or {}).get("logical_type") == "JSON":
            return F.concat(F.lit('{"id": '), number, F.lit("}"))
        return F.concat(F.lit(f"sample_{field.name}_"), number)

    return spark.range(rows).select(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields])
