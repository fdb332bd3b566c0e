"""What several operators share: tables, the shared folder, exact key ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line contract here: space and the five ASCII controls.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns (all, if none is named) of one table of ``sf_dir``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds, so that a worker stays small beside long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where a local session names none (tests), a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and survives a lost executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stash that nothing will read again."""
    spark = df.sparkSession
    remove(spark, df.stash_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parts_wanted(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values of ``key`` that deal its rows evenly; each occurs in the data."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(10 * parts)).alias("c")).first()["c"]
    return sorted(set(found or []))


def range_part(key: str, cuts: list[int]) -> F.Column:
    """How many cuts lie below ``key`` (0 for null): part p holds the keys in (cuts[p-1], cuts[p]].

    Two levels of about the square root of the cuts, so a row costs that many comparisons.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    below = lambda values: F.size(F.filter(values, lambda x: x < F.col(key)))
    whole = below(heads)
    inside = F.when(whole == 0, 0).otherwise((whole - 1) * step + below(F.element_at(nested, F.greatest(whole, F.lit(1)))))
    return F.coalesce(F.when(F.col(key).isNull(), 0).otherwise(inside), F.lit(0)).cast("int")


#: A key with this share of the rows is heavy; there are at most 1 / share.
HEAVY, HEAVY_LEAST = 1 / 4096, 512
#: So many short rows may meet in one task even if all have one key.
PLAIN = 1 << 20


def join_heavy(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", plain: int = 0) -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``side``, which has a row a key: heavy keys' rows are sent to every task, the others are joined by a shuffle.

    ``rows`` is read several times, so it should be a table. Up to ``plain`` rows are joined without that.
    """
    total = rows.count()
    if total <= plain:
        return rows.join(side, key, how)
    bound = max(HEAVY_LEAST, total * HEAVY)
    heavy = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= bound).select(key)
    sent = F.broadcast(heavy.join(side.withColumn("_found", F.lit(True)), key, "left").withColumn("_heavy", F.lit(True)))
    held = rows.join(sent, key, "left")
    rest = held.where("_heavy is null").select(*rows.columns).join(side, key, how)
    done = held.where("_heavy" if how == "left" else "_heavy and _found").drop("_heavy", "_found")
    return done.unionByName(rest)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of column ``text``; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(text)
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
