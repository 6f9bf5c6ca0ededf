"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f uses it: nested copies grow with every use."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))
