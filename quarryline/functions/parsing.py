"""Tokens of text lines as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = r"^[+-]?[0-9]+$"


def lenient_ints(line: Column, separator: str = r"\s+") -> Column:
    """array<int>: the tokens that are 32-bit integers, in order, with repetitions; others are dropped."""
    tokens = F.filter(F.split(line, separator), lambda t: t.rlike(_INTEGER))
    return F.array_compact(F.transform(tokens, lambda t: t.try_cast("int")))


def dropped_tokens(line: Column, separator: str = r"\s+") -> Column:
    """How many tokens ``lenient_ints`` drops, empty ones aside."""
    tokens = F.filter(F.split(line, separator), lambda t: t != "")
    return F.size(tokens) - F.size(lenient_ints(line, separator))


def strict(tokens: Column, kind: str, line: Column) -> Column:
    """All tokens as numbers; a token that is none stops the job and shows the line."""
    bad = F.exists(tokens, lambda t: t.try_cast(kind).isNull() | t.rlike(r"^\s|\s$"))
    message = F.concat(F.lit(f"not a line of {kind} values: '"), line, F.lit("'"))
    return F.when(bad, F.raise_error(message).cast(f"array<{kind}>")).otherwise(F.transform(tokens, lambda t: t.try_cast(kind)))


def drop_trailing_empty(tokens: Column) -> Column:
    """Without the empty strings at the end."""
    kept = F.aggregate(F.transform(tokens, lambda t, i: F.when(t != "", i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(tokens, F.lit(1), F.greatest(kept, F.lit(1)))
