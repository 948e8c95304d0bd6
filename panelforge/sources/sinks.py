"""Writers: partitioned Parquet, keyed tables that are rewritten as a whole, text for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import relational


def write_articles(df: DataFrame, root: str) -> None:
    """Articles, each once, under year/month/day/session folders; only the folders that the rows belong to are replaced."""
    day = F.col("trading_day")
    out = df.dropDuplicates(["article_id"]).select("*", F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day", "session").parquet(root)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Writes unless there is no row; says whether it wrote."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


class KeyedTable:
    """A Parquet table with a key, as numbered versions of a folder; the greatest complete one is current.

    Every change writes a new version, so a reader never sees half of one, and an interrupted job leaves the old one. Versions
    before the last `kept` are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, kept: int = 2) -> None:
        self.spark, self.root, self.keys, self.schema, self.kept = spark, root.rstrip("/"), keys, schema, kept

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{self.root}/{n}/_SUCCESS")[1]))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        found = self.versions()
        df.write.mode("overwrite").parquet(f"{self.root}/v{(found[-1] if found else 0) + 1}")
        for old in self.versions()[: -self.kept]:
            fs, path = self._fs(f"{self.root}/v{old}")
            fs.delete(path, True)

    def upsert(self, rows: DataFrame) -> None:
        """The rows replace those of their keys."""
        self._write(relational.upsert(self.read(), rows.dropDuplicates(self.keys), self.keys))

    def insert_new(self, rows: DataFrame) -> None:
        """Rows whose keys the table has already are left out."""
        self._write(relational.insert_new(self.read(), rows, self.keys))


def write_text(df: DataFrame, path: str, value: str = "value", partitions: list[str] | None = None) -> None:
    """Lines as text files, by partition folders if there are any."""
    writer = df.select(*(partitions or []), value).write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).text(path)
