"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stage import staged


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors; the files go when the application ends."""
    return staged(df, name)


def discard(*staged: DataFrame) -> None:
    """Delete tables that materialise wrote and nothing will read again, and let go of the shuffle files behind them."""
    for df in staged:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if staged:
        release(staged[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles that no plan holds any more removed: the cleaner does so once the driver's collector has met their handles."""
    spark._jvm.System.gc()


def shielded(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df with its columns under reserved names (__x0, __x1, ...), and the columns that give the old names back."""
    names = [f"__x{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession, floor: int = 1) -> int:
    """The session's number of shuffle partitions, which grows with the cluster and the job."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, *, groups: bool = False) -> DataFrame:
    """df with __at (place in its group by the order, from 0) and __of (rows of its group); groups: also __rank (place of the group) and __groups.

    Rows are ranged by group, order and, for equal ones, where they stood, so a group of any size
    spreads over tasks. Places within a range come from the written order; only a
    count for each range and group meets others, those of one group in one window. Nulls
    come first and form a group. The rows are written before they are ranged
    (ranging samples them first) and after (its bounds are random).
    """
    spark = df.sparkSession
    first = materialise(df, name)
    key = [*by, *order, "__t"]
    rows = first.withColumn("__t", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(spark, 2), *key).sortWithinPartitions(*key)
    rows = materialise(rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()).drop("__t"), name)
    discard(first)
    own = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("low"))
    starts = starts.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], (before - F.col("low")).alias("__shift"), F.sum("n").over(own).alias("__of"))
    if groups:  # one row for each range and group in one task: the groups are few
        keys = [f"__b{i}" for i in range(len(by))]
        starts = starts.withColumn("__rank", F.dense_rank().over(Window.orderBy(*keys)).cast("long") - 1)
        starts = starts.withColumn("__groups", F.max("__rank").over(Window.partitionBy()) + 1)
    same = [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)]
    found = rows.join(starts, [F.col("__p") == F.col("__q"), *same])
    extra = ["__of", "__rank", "__groups"] if groups else ["__of"]
    return found.select(*df.columns, (F.col("__i") + F.col("__shift")).alias("__at"), *extra)


#: A DuckDB expression for the unsigned crc32 of an ASCII string; {0} is the string.
CRC32_SQL = """xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i])::bigint), lambda a, b: xor(a >> 8,
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(a & 255, b))), 4294967295))"""
