"""Comparisons, logic and integer arithmetic of scalar fields: results are fields of 0 and 1, or of whole numbers.

Comparisons look at real parts, as the ordering of complex numbers has no meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Number, Tensor, column

COMPARISONS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def _real(x: Tensor | Number) -> Column:
    return column(x[0, 0].re) if isinstance(x, Tensor) else F.lit(float(x))


def flag(condition: Column) -> Tensor:
    return Tensor([C(condition.cast("double"))])


def true(t: Tensor) -> Column:
    """Where a field of 0 and 1 is not 0."""
    return _real(t) != 0


def compare(a: Tensor | Number, how: str, b: Tensor | Number) -> Tensor:
    """1 where the comparison of two fields, or of a field and a number, holds."""
    return flag(COMPARISONS[how](_real(a), _real(b)))


def both(a: Tensor, b: Tensor) -> Tensor:
    return flag(true(a) & true(b))


def either(a: Tensor, b: Tensor) -> Tensor:
    return flag(true(a) | true(b))


def negated(a: Tensor) -> Tensor:
    return flag(~true(a))


def _whole(x: Tensor) -> Column:
    return _real(x).cast("long")


def bit_and(a: Tensor, b: Tensor) -> Tensor:
    return Tensor([C(_whole(a).bitwiseAND(_whole(b)).cast("double"))])


def bit_or(a: Tensor, b: Tensor) -> Tensor:
    return Tensor([C(_whole(a).bitwiseOR(_whole(b)).cast("double"))])


def mod(a: Tensor, n: int) -> Tensor:
    """The remainder of a whole-number field, from 0 to n - 1."""
    return Tensor([C(F.pmod(_whole(a), F.lit(n)).cast("double"))])


def div(a: Tensor, n: int) -> Tensor:
    """The whole quotient that belongs to mod."""
    return Tensor([C(((_whole(a) - F.pmod(_whole(a), F.lit(n))) / n).cast("double"))])
