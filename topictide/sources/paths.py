"""Days taken from file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_IN_NAME = r"(\d{4}-\d{2}-\d{2})"


def day_of_file() -> Column:
    """Day in the name of the file a row was read from, null when there is none."""
    name = F.col("_metadata.file_name")
    return F.to_date(F.nullif(F.regexp_extract(name, DAY_IN_NAME, 1), F.lit("")))
