"""Helpers that the operators of this subpackage share: words, let-binding, shared storage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java, RE2 and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id in join keys.
NO_ID = -(2**63)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text (null: none) in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def unkey(col: Column) -> Column:
    return F.nullif(col, F.lit(NO_ID))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets a new folder; elsewhere it must be set,
    since executors cannot read each other's own folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, and a lost executor costs no recomputation."""
    return _written(df, new_path(df.sparkSession, name), *partition_by)


def _written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run, in a folder of their own that is deleted at the end of the block: what leaves the block is `stored`."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._path, self._tables = spark, new_path(spark, name), []

    def __enter__(self):
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self._path}/{name}-{uuid.uuid4().hex}")

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``df`` in buckets of ``key``, for tables that many joins by this key read: they shuffle the other side only."""
        table = f"{name}_{uuid.uuid4().hex}"
        n = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables.append(table)
        df.write.option("compression", "zstd").option("path", f"{self._path}/{table}").bucketBy(n, key).saveAsTable(table)
        return self._spark.table(table)

    def __exit__(self, *_):
        for table in self._tables:
            self._spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int):
    """Inside the block, batches that go to Python have ``rows`` rows at most, fewer where the session asks for fewer. For tables that are written inside it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Deal:
    """Joins on ``keys`` of which some may hold a large part of all rows. A key with more than 1 / ``SHARES`` of the rows is dealt
    over as many salts as it has such shares, so no task gets much more than a share; there are at most ``SHARES`` such keys,
    which bounds the broadcast. ``sizes``: (keys, size), the rows of each key."""

    SHARES = 500

    def __init__(self, keys: list[str], sizes: DataFrame, total: int):
        share = max(1, total // self.SHARES)
        self.keys = keys
        self._hot = sizes.where(F.col("size") > share).select(*keys, F.ceil(F.col("size") / share).cast("int").alias("_salts"))

    def many(self, rows: DataFrame, *spread: str) -> DataFrame:
        """``rows``, of which a key may have any number, with `_salt` from the columns ``spread``."""
        salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts"))).cast("int")
        return rows.join(F.broadcast(self._hot), self.keys, "left").withColumn("_salt", salt).drop("_salts")

    def one(self, rows: DataFrame) -> DataFrame:
        """``rows``, of which a key has one or a few, for each `_salt`."""
        salts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
        return rows.join(F.broadcast(self._hot), self.keys, "left").withColumn("_salt", salts).drop("_salts")

    def join(self, many: DataFrame, one: DataFrame, how: str, *spread: str) -> DataFrame:
        return self.many(many, *spread).join(self.one(one), [*self.keys, "_salt"], how).drop("_salt")


#: A filter of keys has at most this many rows of 64 bits each: its size does not grow with the data.
FILTER_ROWS = 2**18


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``keys``, and with all whose key is: a bit for each hash, so that rows
    need not be shuffled only to be dropped. An exact join must follow; the more keys there are, the less is left to gain."""
    slot, bit = F.pmod(F.xxhash64(key), F.lit(FILTER_ROWS)).alias("_slot"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({key}, 1), 64) AS INT))").alias("_bit")
    bits = keys.select(slot, bit).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumns({"_slot": slot, "_bit": bit}).join(F.broadcast(bits), "_slot")
    return met.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_slot", "_bit", "_bits")
