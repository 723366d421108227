"""Typed tables in a folder, in whole versions: created, appended to, updated by key and made from queries.

A version is a Parquet folder that counts once its writer has committed it, so a
reader sees one version whole, and a writer that dies leaves the last one. A
uniqueness check stands where a database has a primary key. Mutations name the
version that they start from; of two from one version the second fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import keyed_update


class Conflict(RuntimeError):
    """Another writer was faster."""


class Table:
    """A table of versions. schema: DDL; NOT NULL columns are checked. key: columns whose values are unique."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType | None = None, key: list[str] | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key or []
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The last whole version; 0 where there is none."""
        fs, where = self._fs()
        if not fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=0)

    def read(self, version: int | None = None) -> DataFrame:
        v = version or self.version()
        if not v:
            raise FileNotFoundError(self.path)
        df = self.spark.read.parquet(f"{self.path}/v{v:06d}")
        return df if self.schema is None else df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def drop(self) -> None:
        fs, where = self._fs()
        fs.delete(where, True)

    def create(self) -> Table:
        """Drops what is there and makes an empty table of the schema."""
        self.drop()
        self._put(self.spark.createDataFrame([], self.schema), 0)
        return self

    def replace(self, df: DataFrame) -> Table:
        """The table made anew from a query, whose schema it takes where it has none."""
        self._put(self._checked(df, df), self.version())
        return self

    def insert(self, rows: DataFrame) -> Table:
        """Appends rows; they must have the table's columns and types, and new keys."""
        v = self.version()
        new = self._typed(rows)
        self._put(self._checked(self.read(v).unionByName(new), new), v)
        return self

    def add_column(self, name: str, kind: str) -> Table:
        """A nullable column; one that is there must have the type."""
        now = {f.name: f.dataType.simpleString() for f in self.read().schema.fields}
        if name in now and now[name] != kind:
            raise ValueError(f"column {name} is there as {now[name]}")
        if name not in now:
            v = self.version()
            df = self.read(v).withColumn(name, F.lit(None).cast(kind))
            self.schema = df.schema if self.schema is not None else None
            self._put(df, v)
        return self

    def update(self, changes: DataFrame, columns: list[str]) -> Table:
        """Sets columns of the rows whose key is among changes; keys that aren't there change nothing."""
        v = self.version()
        self._unique(changes)
        self._put(keyed_update(self.read(v), changes, self.key, columns), v)
        return self

    def mutate(self, change: Callable[[DataFrame], DataFrame], seen: int) -> Table:
        """The table as change makes it of version seen; Conflict where there is a newer one."""
        if self.version() != seen:
            raise Conflict(f"version {self.version()}, not {seen}")
        self._put(self._checked(*[change(self.read(seen))] * 2), seen)
        return self

    def _typed(self, rows: DataFrame) -> DataFrame:
        want = self.read().schema if self.schema is None else self.schema
        have = {f.name: f.dataType for f in rows.schema.fields}
        wrong = [f.name for f in want.fields if have.get(f.name) != f.dataType] + [n for n in have if n not in want.names]
        if wrong:
            raise TypeError(f"columns that don't fit: {', '.join(wrong)}")
        return rows.select(want.names)

    def _checked(self, df: DataFrame, new: DataFrame) -> DataFrame:
        need = [f.name for f in (self.schema.fields if self.schema is not None else []) if not f.nullable]
        for c in need:
            if not new.where(F.col(c).isNull()).isEmpty():
                raise ValueError(f"null in {c}")
        self._unique(df)
        return df

    def _unique(self, df: DataFrame) -> None:
        if self.key and not df.groupBy(*self.key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"several rows of one {', '.join(self.key)}")

    def _put(self, df: DataFrame, seen: int) -> None:
        try:
            df.write.mode("error").parquet(f"{self.path}/v{seen + 1:06d}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise Conflict(f"version {seen + 1} is there") from e
            raise


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What was written to path by an earlier run; else what make gives, written there first."""
    t = Table(spark, path)
    if not t.version():
        t.replace(make())
    return t.read()


def chunks(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """df with chunk: rows in order, size of them a chunk, from 0."""
    from ..operators.sequences import numbered

    return numbered(df, order, "__n", 0).withColumn(name, F.floor(F.col("__n") / size)).drop("__n")
