"""Costly expressions, evaluated once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add ``columns`` (aliased) such that the optimizer cannot repeat them.

    A filter on a projected expression is moved below the projection, which then evaluates the
    expression once per use. Filters on generated columns stay above the generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))
