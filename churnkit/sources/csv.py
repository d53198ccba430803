"""CSV source of the raw layer.

Files have a header line, ``,`` separators, LF line ends and optionally
quoted fields. Every column is read as a string under a declared schema
(no inference, which would need an extra pass over the data); an empty
field becomes NULL and a row with too few or too many fields keeps what
parses rather than failing the load; on request its text is kept as well,
so that such rows can be counted (the quality log does). Files are split
across tasks, so the load scales with the number of files and their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MALFORMED = "_malformed"
#: How the exports are written, for batch and streaming reads.
CSV_FORMAT = {
    "header": True, "sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False,
                 malformed: str | None = None) -> DataFrame:
    """The rows of ``path``; ``malformed`` names a further column with the text of rows of the wrong shape.

    A quoted field that holds a line break becomes two malformed rows unless
    ``multi_line`` is set, which gives up splitting files.
    """
    reader = spark.read
    if malformed:
        schema = T.StructType([*schema.fields, T.StructField(malformed, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", malformed)
    return reader.schema(schema).options(**CSV_FORMAT, multiLine=multi_line).csv(path)


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write a raw table as CSV that ``read_raw_csv`` reads back unchanged.

    NULL is written as an empty field and leading and trailing blanks are
    kept. An empty string reads back as NULL, as every empty field does.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
