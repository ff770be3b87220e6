"""Filtering rows by a costly value without computing it twice."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def only_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """An array of the value if it passes, else an empty one; to be exploded.

    A ``where`` on a computed column is pushed below it, so parsing or matching
    would run once for the filter and again for the column.
    """
    return F.filter(F.array(value), test)
