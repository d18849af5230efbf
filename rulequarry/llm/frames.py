"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"


def whole_text(df: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a unique row number. Write the result before it is used twice: a recomputation may number rows anew."""
    return df.withColumn(name, F.monotonically_increasing_id())
