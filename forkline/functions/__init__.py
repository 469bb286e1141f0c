"""Column helpers that Spark has no single function for."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of_millis(ms: Column) -> Column:
    """``yyyy-MM`` in UTC of epoch milliseconds, whatever the session's time zone; null for null."""
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def wide_hash(*cols: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes, which together tell values apart like one of 128 bits."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2")]
