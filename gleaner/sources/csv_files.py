"""Review and product CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleaner import constants as K, schemas
from gleaner.sources import csv_split

FILE_COLUMN = "ingest_file"
ROW_COLUMN = "ingest_row"
#: Number of the append or micro-batch that brought a row; the name of its folder.
BATCH_COLUMN = "ingest_batch"
INGEST_ORDER = [BATCH_COLUMN, FILE_COLUMN, ROW_COLUMN]


def null_tokens(c: Column, tokens=K.NA_TOKENS) -> Column:
    """Cells that spell a missing value become null."""
    return F.when(~c.isin(list(tokens)), c)


def _as_declared(field: T.StructField) -> Column:
    cell = null_tokens(F.col(field.name))
    if isinstance(field.dataType, T.StringType):
        return cell.alias(field.name)
    return cell.try_cast(field.dataType).alias(field.name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True,
             file_order: bool = False, split: bool = False) -> DataFrame:
    """CSV with a header, quoted multi-line cells and doubled quotes, coerced to ``schema``.

    Cells are read as text first, so that a bad number gives null and never a failed row.
    ``multi_line=False`` lets Spark split big files, for producers that escape line breaks; ``split`` reads big
    files with quoted line breaks by many tasks each (twice, see ``csv_split``).
    ``file_order`` adds the position of each row: appends in the order of their numbers (0 for files
    written without one), files of one append by name, rows of one file as they stand.
    """
    if split:
        keep = []
        if file_order:
            batch = F.regexp_extract("file", BATCH_COLUMN + r"=(\d+)", 1).try_cast("bigint")
            keep = [F.coalesce(batch, F.lit(0)).cast("bigint").alias(BATCH_COLUMN), F.col("file").alias(FILE_COLUMN),
                    F.struct("block", "seq", "k").alias(ROW_COLUMN)]
        raw = csv_split.read_split(spark, path, schema, keep)
        return raw.select(*[_as_declared(f) for f in schema], *(INGEST_ORDER if file_order else []))
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = (spark.read.schema(text_schema).option("header", True).option("multiLine", multi_line)
           .option("quote", '"').option("escape", '"').csv(path))
    columns = [_as_declared(f) for f in schema]
    if file_order:
        batch = F.col(BATCH_COLUMN).cast("bigint") if BATCH_COLUMN in raw.columns else F.lit(0).cast("bigint")
        columns += [batch.alias(BATCH_COLUMN), F.col("_metadata.file_path").alias(FILE_COLUMN),
                    F.monotonically_increasing_id().alias(ROW_COLUMN)]
    return raw.select(*columns)


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.REVIEWS_RAW,
                     keep_personal: bool = False, multi_line: bool = True,
                     file_order: bool = False, split: bool = False) -> DataFrame:
    """Review files. Nickname and location are left out unless asked for."""
    df = read_csv(spark, path, schema, multi_line, file_order, split)
    return df if keep_personal else df.drop(*schemas.PERSONAL_COLUMNS)


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Product list; a review count that is missing or no number counts as 0."""
    df = read_csv(spark, path, schemas.PRODUCTS)
    return df.withColumn("review_count", F.coalesce("review_count", F.lit(0.0)))
