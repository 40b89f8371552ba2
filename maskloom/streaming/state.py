"""Keyed tables that a stream changes batch by batch: hash buckets, and a manifest for each version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

#: Buckets of a table, and files that the rows of one bucket may be spread over when they are written.
BUCKETS, FILES = 256, 8
#: Bucket of rows that a version writes beside the table.
ASIDE = -1


@dataclass(frozen=True)
class BucketTable:
    """A table below ``path``, cut by the hash of ``key`` into ``buckets``.

    Version n is what ``manifest/version=n`` says: a row for each bucket that has rows, with the version that wrote it. A new
    version writes the buckets it touches and carries the other rows of the manifest over, so a batch reads and
    writes what it touches and no more. Versions are written whole and replaced whole: a repeated batch repeats its version.
    """
    spark: SparkSession
    path: str
    schema: StructType
    key: str
    spread: str
    buckets: int = BUCKETS

    @classmethod
    def opened(cls, spark: SparkSession, path: str, key: str, spread: str) -> BucketTable:
        """A table written before."""
        return cls(spark, path, spark.read.parquet(f"{path}/empty").schema, key, spread)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def place(self, spread: str) -> Column:
        """Number of the bucket and of the part of it that a row goes to; parts are dealt by the hash of ``spread``."""
        part = F.pmod(F.shiftright(F.xxhash64(spread), 32), F.lit(FILES))
        return (self.bucket() * FILES + part).cast("int")

    def sizes(self, rows: DataFrame) -> dict[int, int]:
        """Bucket to the number of its rows; at most ``buckets`` of them come to the driver."""
        return {r.b: r["count"] for r in rows.groupBy(self.bucket().alias("b")).count().collect()}

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that hold the keys of ``rows``; at most ``buckets`` numbers come to the driver."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket to the version that wrote it."""
        rows = self.spark.read.schema("bucket int, written int").parquet(f"{self.path}/manifest/version={version}").collect()
        return {r.bucket: r.written for r in rows}

    def versions(self) -> list[int]:
        found = self.spark.read.schema("bucket int, written int, version int").parquet(f"{self.path}/manifest")
        return sorted(r.version for r in found.select("version").distinct().collect())

    def read(self, version: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version, of some buckets or of all."""
        return self._held(version, buckets)

    def held(self, version: int, buckets: list[int]) -> dict[int, int]:
        """:meth:`sizes` of some buckets of a version."""
        return self.sizes(self._held(version, buckets))

    def _held(self, version: int, buckets: list[int] | None) -> DataFrame:
        held = self.manifest(version)
        wanted = sorted(held if buckets is None else held.keys() & set(buckets))
        paths = [f"{self.written(held[b])}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def written(self, version: int) -> str:
        """Folder of the rows that a version wrote."""
        return f"{self.path}/rows/version={version}"

    def write(self, version: int, rows: DataFrame, touched: list[int] | None = None) -> None:
        """Version ``version``: the ``touched`` buckets hold ``rows`` now (all buckets without ``touched``), the others what they held."""
        salt = F.pmod(F.xxhash64(self.spread), F.lit(FILES))
        spread = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        self.lay(version, spread.repartition("bucket", salt))
        self.settle(version, touched)

    def lay(self, version: int, rows: DataFrame, first: bool = True) -> None:
        """First part of :meth:`write`, for rows with their ``bucket`` that lie along it; unless they are the ``first`` they are added.

        Further columns, and rows of the bucket ``ASIDE``, are written with the version, but are no part of the table.
        """
        rows.write.mode("overwrite" if first else "append").partitionBy("bucket").parquet(self.written(version))

    def settle(self, version: int, touched: list[int] | None = None) -> None:
        """Second part of :meth:`write`: the manifest."""
        if touched is None:
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.path}/empty")
        new = StructType([*self.schema.fields]).add("bucket", IntegerType())
        found = self.spark.read.schema(new).parquet(self.written(version)).select("bucket").distinct().collect()
        there = [r.bucket for r in found if r.bucket != ASIDE]
        if touched is not None and not set(there) <= set(touched):
            raise RuntimeError("rows of buckets that the batch did not name: its input changed while it ran")
        held = {} if touched is None else {b: v for b, v in self.manifest(version - 1).items() if b not in set(touched)} if version else {}
        held |= {b: version for b in there}
        self.spark.createDataFrame(sorted(held.items()), "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/version={version}")
