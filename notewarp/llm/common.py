"""What the operators of this subpackage share: scratch tables, prefix sums and code shipping."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def by_value(name: str) -> None:
    """Ship the functions of module ``name`` inside the tasks, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def process_store(job: str | None = None) -> dict:
    """What a Python worker keeps from task to task. Functions shipped by value get new globals with each task.

    A worker that turns to another kind of ``job`` drops what it kept for the last one.
    """
    kept = sys.modules.setdefault("_notewarp_store", types.ModuleType("_notewarp_store")).__dict__
    if job and kept.get("job") != job:
        for name in [k for k in kept if not k.startswith("__")]:
            del kept[name]
        kept["job"] = job
    return kept


def give_back() -> None:
    """Drops what this Python worker keeps of the last job but models, and returns free memory to the system."""
    process_store().pop("powers", None)
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def thrifty(run):
    """The batch function ``run``, after which an idle Python worker holds little: the next step may be the JVM's."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where that is unset a local master gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="notewarp-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20):
    """Hands rows to Python workers in batches of about ``size`` bytes, so that long texts don't add up in memory.

    Holds for what is run inside; the setting is put back afterwards, so results that need it must be written inside.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables written once under the shared folder.

    They cut the lineage: a stage that is run again after an executor is lost rereads files instead of repeating
    what led to them. ``free`` deletes the tables that no later step reads.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.named: dict[str, str] = {}
        self.opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def buckets(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """A table dealt into files by ``keys``, so that joins on them leave its rows where they are."""
        n, own = shuffle_partitions(self.spark), f"{name}_{uuid.uuid4().hex}"
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", self.path(name)).saveAsTable(own)
        self.named[name] = own
        return self.spark.table(own)

    def free(self, *names: str) -> None:
        """Deletes the tables of these names, or without any the whole folder, and lets Spark drop the shuffles that made them."""
        jvm = self.spark.sparkContext._jvm
        for name in list(names or self.named):
            if name in self.named:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(name)}")
        for at in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()  # the driver drops the files of shuffles that nothing refers to


@contextmanager
def passing():
    """Deletes on leaving every scratch folder that was opened inside: for steps whose result has been written elsewhere."""
    first = len(Scratch.opened)
    yield
    for scratch in Scratch.opened[first:]:
        scratch.free()
    del Scratch.opened[first:]


class Plain:
    """A table under column names of our own, so that none of its own can clash with those that an operator adds."""

    def __init__(self, table: DataFrame):
        self.names, self.columns = table.columns, [f"c{i}" for i in range(len(table.columns))]
        self.df = table.toDF(*self.columns)

    def __getitem__(self, name: str):
        return F.col(self.columns[self.names.index(name)])

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for c, n in zip(self.columns, self.names)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that one join treats as hot at most.
HOT = 1024


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``count`` the rows of ``left`` with that key.

    Keys with more than a HOT-th of the ``total`` rows of ``left`` are HOT at most, so their rows of ``right`` are
    broadcast and their rows of ``left`` stay where they are; all other keys meet in a shuffle. ``count`` goes.
    """
    most = max(1, total // HOT)
    hot, cold = right.where(F.col(count) > most).drop(count), right.where(F.col(count) <= most).drop(count)
    some = left.join(F.broadcast(hot), keys)
    return some.unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, parts: int = 32) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, where rows of ``right`` may be wide.

    Keys with more than a HOT-th of the rows of ``left``, HOT at most, are dealt over ``parts`` by a hash of ``spread``, and
    their rows of ``right`` go to each part.
    """
    most = max(1, left.count() // HOT)
    hot = F.broadcast(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def running_total(scratch: Scratch, df: DataFrame, order: list, values: dict[str, str], name: str) -> DataFrame:
    """Adds for each (column, out) of ``values`` the sum of the column over all rows before this one in the global ``order``.

    The rows are dealt by range and written; the totals of the ranges, one row per partition, are summed; a window
    inside each range adds the rest. No task sees more than one range.
    """
    spark = df.sparkSession
    dealt = (
        df.repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    dealt = scratch.table(dealt, name)
    zero = {v: F.lit(0).cast(dealt.schema[v].dataType if dealt.schema[v].dataType.typeName() == "double" else "long") for v in values}
    parts = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_total_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_total_{v}").over(before), zero[v]).alias(f"_base_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(F.broadcast(parts), "_part")  # one row a partition
    summed = summed.withColumns({out: F.col(f"_base_{v}") + F.coalesce(F.sum(v).over(inside), zero[v]) for v, out in values.items()})
    return summed.drop("_part", "_seq", *[f"_base_{v}" for v in values])


by_value(__name__)
