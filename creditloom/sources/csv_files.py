"""CSV files with types taken from the whole file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

UTF_8, WINDOWS, LATIN = "UTF-8", "windows-1252", "ISO-8859-1"

# Spark reads Latin-1 but not Windows-1252. The two differ in 32 code points only, so Windows text is read as
# Latin-1 and those are translated; five of them mean nothing in Windows-1252.
_C1 = [chr(b) for b in range(0x80, 0xA0)]
_AS_WINDOWS = {c: text for c in _C1 if (text := c.encode("latin-1").decode("cp1252", errors="ignore"))}
_NOT_WINDOWS = [c for c in _C1 if c not in _AS_WINDOWS]

_FIRST_ROWS = 1000


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    # Rows with too few fields are padded with NULL; a quote inside quotes is doubled.
    decoded_as = LATIN if encoding == WINDOWS else encoding
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", decoded_as)
    return reader.option("multiLine", multi_line).option("escape", '"')


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line's bytes are valid, else Windows-1252 if every byte means something there, else Latin-1.

    Lines are read as the bytes they are, and the search stops at the first one that decides.
    """
    lines = spark.read.text(path)
    if not lines.filter(~F.is_valid_utf8("value")).take(1):
        return UTF_8
    text = F.decode(F.col("value").cast("binary"), LATIN)
    meaningless = F.translate(text, "".join(_NOT_WINDOWS), "") != text
    return LATIN if lines.filter(meaningless).take(1) else WINDOWS


def _yes_no_columns(df: DataFrame) -> list[str]:
    """String columns that hold nothing but Yes and No.

    The first rows rule out most columns; only the others are read to the end.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    for rows in (df.limit(_FIRST_ROWS), df):
        if not columns:
            break
        found = rows.agg(*[F.bool_and(F.col(f"`{c}`").isin("Yes", "No")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        # NULL where there was no value yet.
        columns = [c for i, c in enumerate(columns) if found[i] or rows is not df and found[i] is None]
    return columns


def whole_number_columns_as_long(schema: StructType) -> StructType:
    """Ids and counts are 64-bit whatever their values in this particular file."""
    return StructType(
        [
            StructField(f.name, LongType() if isinstance(f.dataType, IntegerType) else f.dataType, True)
            for f in schema.fields
        ]
    )


def _windows_text(df: DataFrame) -> DataFrame:
    table = str.maketrans(_AS_WINDOWS)
    columns = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            value = F.translate(value, "".join(_AS_WINDOWS), "".join(_AS_WINDOWS.values()))
        columns.append(value.alias(f.name.translate(table)))
    return df.select(*columns)


def scan_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    schema: StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A table from a CSV file (or folder of files) with a header.

    Without a schema the types are inferred from every row and then pinned, so that later scans read with
    declared types; columns of Yes and No alone become booleans. Pass both encoding and schema to open a large file
    without any extra pass. ``multi_line`` lets quoted fields hold line breaks; such a file is read by one task.
    """
    encoding = encoding or detect_encoding(spark, path)
    booleans: list[str] = []
    if schema is None:
        reader = _reader(spark, encoding, multi_line)
        inferred = reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(path)
        schema = whole_number_columns_as_long(inferred.schema)
        booleans = _yes_no_columns(_reader(spark, encoding, multi_line).schema(schema).csv(path))
    table = _reader(spark, encoding, multi_line).schema(schema).csv(path)
    table = table.select(*[(F.col(f"`{c}`") == "Yes").alias(c) if c in booleans else F.col(f"`{c}`") for c in table.columns]) if booleans else table
    return _windows_text(table) if encoding == WINDOWS else table
