"""The metric cell: a value, or a typed reason why there is none.

A cell is ``STRUCT<state, value, reason, flags>``. Absent data never turns into
a bare NULL or a zero: a cell without a value names its state and reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five cell states.
OK = "OK"
MISSING_INPUT = "MISSING_INPUT"
ZERO_DENOMINATOR = "ZERO_DENOMINATOR"
NOT_MEANINGFUL = "NOT_MEANINGFUL"
NOT_COMPARABLE = "NOT_COMPARABLE"

CELL_TYPE = "struct<state:string,value:double,reason:string,flags:array<string>>"
DEPENDS = "DEPENDS_ON_UNDEFINED_INPUT"


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Constant parts are written as SQL text: one expression instead of many nested calls.
_NO_FLAGS = "CAST(array() AS array<string>)"


def flag_array(*flags) -> Column:
    """ARRAY<STRING> of the given flags; NULL flags are left out."""
    if not flags:
        return F.expr(_NO_FLAGS)
    return F.array_compact(F.array(*[as_column(f) for f in flags]))


def _text(x, name: str) -> Column:
    if isinstance(x, Column):
        return x.alias(name)
    return F.expr(f"CAST(NULL AS string) AS {name}" if x is None else f"'{x}' AS {name}")


def cell(state, value, reason, flags=None) -> Column:
    return F.struct(
        _text(state, "state"),
        F.expr("CAST(NULL AS double) AS value") if value is None else as_column(value).cast("double").alias("value"),
        _text(reason, "reason"),
        F.expr(f"{_NO_FLAGS} AS flags") if flags is None else flags.alias("flags"),
    )


def ok(value, flags=None) -> Column:
    return cell(OK, value, None, flags)


def absent(state, reason, flags=None) -> Column:
    if isinstance(state, str) and isinstance(reason, str) and flags is None:
        return F.expr(
            f"named_struct('state', '{state}', 'value', CAST(NULL AS double), 'reason', '{reason}', 'flags', {_NO_FLAGS})"
        )
    return cell(state, None, reason, flags)


def missing(reason, flags=None) -> Column:
    return absent(MISSING_INPUT, reason, flags)


def is_ok(c: Column) -> Column:
    return c["state"] == OK


def usable(x: Column) -> Column:
    """The number if it is finite, else NULL."""
    x = x.cast("double")
    return F.when(x - x == 0, x)  # NaN and infinities fail the test


def blocked_by(*cells: Column) -> Column:
    """A cell naming why a metric that depends on ``cells`` has no value, or NULL if all of them are OK.

    ``cells`` are meant to be columns, not expressions: each is referred to several times.
    """
    any_missing = reduce(lambda a, b: a | b, [c["state"] == MISSING_INPUT for c in cells])
    first_bad = F.coalesce(*[F.when(c["state"] != OK, c["state"]) for c in cells])
    return F.when(any_missing, missing(DEPENDS)).when(first_bad.isNotNull(), absent(first_bad, DEPENDS))


def with_flags(c: Column, *flags) -> Column:
    """The cell (a column) with more flags; order kept, repeats removed, NULL flags ignored."""
    return cell(c["state"], c["value"], c["reason"], F.array_distinct(F.concat(c["flags"], flag_array(*flags))))


def unpack(c: Column, prefix: str = "") -> list[Column]:
    """The four parts as flat columns, flags joined by ','; used by reports."""
    return [
        c["state"].alias(prefix + "state"),
        c["value"].alias(prefix + "value"),
        c["reason"].alias(prefix + "reason"),
        F.concat_ws(",", c["flags"]).alias(prefix + "flags"),
    ]
