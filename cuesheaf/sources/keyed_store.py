"""Lasting stores by key: bucketed, sorted tables that lookups join without moving them, replaced snapshot by snapshot.

A store is a folder. An upsert writes all files of the next snapshot, and only then creates that snapshot's pointer, one empty file whose name is its
number; the store is the snapshot of the highest pointer, so readers see the old or the new one, whole, and a failed upsert changes nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class KeyedStore:
    """One row a key in a folder that all executors share; `schema` is DDL with the column `key`, rows with a null key are not held.

    With `within`, a further column, a key has one row for each of its values; lookups still go by the key alone.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = BUCKETS, within: str | None = None):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.ids = [key, within] if within else [key]
        self.name = f"store_{hashlib.md5(self.root.encode()).hexdigest()[:12]}"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def version(self) -> int:
        """The number of the present snapshot, 0 for none."""
        system, place = self._files("pointers")
        return max((int(f.getPath().getName()) for f in system.listStatus(place)), default=0) if system.exists(place) else 0

    def current(self) -> DataFrame:
        """The rows, as a table that is bucketed and sorted by key."""
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], self.schema)
        table = f"{self.name}_v{n}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({', '.join(self.ids)}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/v{n}'")
        return self.spark.table(table)

    def upsert(self, rows: DataFrame) -> None:
        """Rows take the place of those of their key (and `within`); of several of one the greatest stays. Two snapshots are kept, so readers of the last one may finish."""
        columns = self.spark.createDataFrame([], self.schema).columns
        new = rows.filter(F.col(self.key).isNotNull()).select(*columns, F.lit(True).alias("_new"))
        n = self.version()
        both = self.current().withColumn("_new", F.lit(False)).unionByName(new).repartition(self.buckets, self.key)
        all_rows = both.groupBy(*self.ids).agg(F.max(F.struct("_new", *(c for c in columns if c not in self.ids))).alias("_row")).select(*self.ids, "_row.*")
        table = f"{self.name}_v{n + 1}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        all_rows.select(*columns).write.mode("overwrite").option("path", f"{self.root}/v{n + 1}").bucketBy(self.buckets, self.key).sortBy(*self.ids).saveAsTable(table)
        system, place = self._files(f"pointers/{n + 1}")
        system.mkdirs(place.getParent())
        if not system.createNewFile(place):
            raise RuntimeError(f"another upsert has made snapshot {n + 1} of {self.root}")
        if n > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{n - 1}")
            for path in (f"pointers/{n - 1}", f"v{n - 1}"):
                system, place = self._files(path)
                system.delete(place, True)


def page_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> KeyedStore:
    """Stored pages by the key of their address; pages that share an address all stay."""
    return KeyedStore(spark, root, "key STRING, page_id BIGINT, html STRING", "key", buckets, within="page_id")


def memory_store(spark: SparkSession, root: str, src: str, tgt: str, buckets: int = BUCKETS) -> KeyedStore:
    """The translation memory of a pair of languages by text."""
    return KeyedStore(spark, f"{root.rstrip('/')}/{src}_{tgt}", "text STRING, src STRING, tgt STRING, translation STRING", "text", buckets)
