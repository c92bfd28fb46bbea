"""Writers. Parquet between stages, CSV at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleaner.sources.csv_files import BATCH_COLUMN


def _csv(writer):
    # emptyValue keeps '' and null apart from quoting rules: both are written as an empty cell.
    return (writer.option("header", True).option("quote", '"').option("escape", '"')
            .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False))


def write_csv(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``."""
    _csv(df.write.mode("overwrite")).csv(path)


def append_csv(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Add rows. Every part file has its own header, so none must be suppressed.

    ``batch`` numbers the appends of a table whose keep-first must follow their order: the rows go to a
    folder of that number, which a repeated append replaces.
    """
    if batch is None:
        _csv(df.write.mode("append")).csv(path)
    else:
        _csv(df.write.mode("overwrite")).csv(f"{path}/{BATCH_COLUMN}={batch}")


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write a stage as Parquet and return it as read back, which also cuts the lineage.

    With ``partition_by`` the rows of a partition value meet first, large values split by size, so that not
    every task writes a file for every value.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path, compression=compression)
    else:
        df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def project_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])
