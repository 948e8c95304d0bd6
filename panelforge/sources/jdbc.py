"""Relational databases through JDBC; the driver's jar must be on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, *, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table or `(query) alias`; with a numeric or date `column`, in `parts` ranges between `low` and `high`."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("sessionInitStatement", "SET TIME ZONE 'UTC'").options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def append_table(df: DataFrame, url: str, table: str, *, batch: int = 1000, **options: str) -> None:
    """Appends in batches of `batch` rows."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()
