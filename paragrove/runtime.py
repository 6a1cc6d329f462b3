"""Session, table and storage helpers shared by every operator."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a side may have to be broadcast, whatever its width.
BROADCAST_ROWS = 200_000


def session(app: str = "paragrove", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir. Only a local session may leave it unset; a cluster without one raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{os.path.abspath(spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:'))}/shelf"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Shelf:
    """Tables that one operator run writes into the shared folder, to cut lineage in a way that survives lost executors.

    A table that no later result reads is dropped by its operator; what a returned result still reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/paragrove-{uuid.uuid4().hex}"
        self.fresh = True

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if self.fresh:
            folder, files = self._folder()
            files.deleteOnExit(folder)
            self.fresh = False
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later result reads; all of them without a name."""
        for name in names or ("",):
            path, files = self._folder(name)
            files.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size, counted first, is within the bound; else df for a shuffle join."""
    return F.broadcast(df) if small(df, rows) else df


#: Cells that are broadcast as heavy, at most; every other cell then holds less than this part of all rows.
HEAVY_CELLS = 4_096


def heaviest(cells: DataFrame, keys: list[str], weight: str, most: int = HEAVY_CELLS) -> DataFrame:
    """The `most` cells of the largest weight: a proven bound for a broadcast, and total / most for the weight of any other cell."""
    return cells.orderBy(F.col(weight).desc(), *keys).limit(most)


def split_join(rows: DataFrame, cells: DataFrame, keys: list[str], weight: str, shelf: Shelf, name: str, most: int = HEAVY_CELLS) -> DataFrame:
    """rows with the columns of their cell (inner join, null keys equal), split by weight so that no key makes a hot task.

    cells: keys, weight (how many rows have them), other columns; one row per cell, kept. The heaviest cells are broadcast,
    their rows stay where they are; the other rows go through a shuffle join, in which no key has more than total / most rows.
    """
    heavy = shelf.keep(heaviest(cells, keys, weight, most), name)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    extra = [c for c in cells.columns if c not in keys and c != weight]
    out = lambda j: j.select("r.*", *[F.col(f"c.{c}").alias(c) for c in extra])
    hot = out(rows.alias("r").join(F.broadcast(heavy).alias("c"), same("r", "c")))
    light = cells.alias("a").join(F.broadcast(heavy.select(*keys)).alias("h"), same("a", "h"), "left_anti")
    rest = rows.alias("a").join(F.broadcast(heavy.select(*keys)).alias("h"), same("a", "h"), "left_anti")
    return hot.unionByName(out(rest.alias("r").join(light.hint("merge").alias("c"), same("r", "c"))))


#: Input of a stage of Python that a core should get at least, before its rows are spread over more tasks.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is so small that its files would make fewer tasks; unchanged otherwise."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * SPREAD_BYTES else df
