"""One value for many uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    An expression that stands in several branches or lambdas is computed in each of them; as a lambda's
    argument it is computed before.
    """
    return F.transform(F.array(value), body)[0]
