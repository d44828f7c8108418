"""Versioned run tables as plain Parquet: events are appended, the present state is derived.

There is one folder for each table and a marker row with the schema's version. The driver is
the only writer; a reader refuses a newer version than it knows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.operators.runs import current
from stacklight.sources.shared import once

VERSION = 4


class RunTables:
    """assets, occurrences, items, decisions and moves under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        try:
            found = spark.read.parquet(f"{self.root}/_version").agg(F.max("version")).first()[0]
        except AnalysisException:
            found = VERSION
            spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.root}/_version")
        if found > VERSION:
            raise ValueError(f"the tables are of version {found}; this library knows {VERSION}")

    def append(self, table: str, rows: DataFrame, *partitions: str) -> None:
        rows.write.mode("append").partitionBy(*partitions).parquet(f"{self.root}/{table}")

    def replace(self, table: str, rows: DataFrame, *partitions: str) -> None:
        """Rewrites the partitions that rows have and no other; rows may come from them, as they are computed before anything is replaced."""
        once(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{self.root}/{table}")

    def events(self, table: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}")

    def current(self, table: str, key: str | list[str]) -> DataFrame:
        """The last event of each key."""
        return current(self.events(table), key)

    def missing(self, table: str) -> bool:
        try:
            self.events(table).limit(0).collect()
        except AnalysisException:
            return True
        return False
