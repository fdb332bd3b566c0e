"""Readers and writers of the engine's file formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("contract", T.StringType()),
        T.StructField("params", T.StructType([T.StructField("barrier", T.StringType()), T.StructField("duration", T.IntegerType()), T.StructField("duration_unit", T.StringType())])),
        *[T.StructField(c, T.DoubleType()) for c in ("true_p", "payout", "breakeven_p", "ev_per_$1", "house_edge")],
        T.StructField("error", T.StringType()),
    ]
)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """symbol, i, epoch, price from files ``SYMBOL.json[.gz]``, each a list of [epoch, price]; times met twice count once."""
    text = spark.read.text(path, wholetext=True).withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    pairs = F.from_json("value", "array<array<string>>")
    rows = text.select("symbol", F.posexplode(pairs).alias("i", "p")).select("symbol", F.col("i").cast("long").alias("i"), F.col("p")[0].try_cast("double").cast("long").alias("epoch"), F.col("p")[1].try_cast("double").alias("price"))
    return rows.dropna(subset=["epoch", "price"])


def drop_repeated(ticks: DataFrame) -> DataFrame:
    """One tick for each symbol and time, the first of them."""
    return ticks.groupBy("symbol", "epoch").agg(F.min_by("price", "i").alias("price"), F.min("i").alias("i")).select("symbol", "i", "epoch", "price")


def write_ticks(ticks: DataFrame, path: str) -> None:
    """A folder a symbol of gzipped JSON lines, in order of time within a file."""
    rows = ticks.repartition("symbol").sortWithinPartitions("symbol", "epoch")
    rows.write.partitionBy("symbol").option("compression", "gzip").json(path)


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """symbol, contract, barrier, duration, true_p, payout, seq of a JSON array of quotes; quotes without payout are left out."""
    raw = spark.read.schema(QUOTE).option("multiLine", True).json(path)
    return raw.where("payout is not null").select("symbol", "contract", F.col("params.barrier").try_cast("int").alias("barrier"), F.col("params.duration").alias("duration"), "true_p", "payout", F.monotonically_increasing_id().alias("seq"))


def line_separator(line: str) -> str:
    """';' if a line has more of them than commas, else ','."""
    return ";" if line.count(";") > line.count(",") else ","


def by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of ``path`` by their first line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    heads = lines.where("start = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("head"))
    return {r["head"]: sorted(r["files"]) for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()}


def separator(spark: SparkSession, path: str) -> str:
    """The separator of a file's first line (of a folder's first header)."""
    return line_separator(min(by_header(spark, path), default=""))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """symbol, seq, time, open, high, low, close, volume as text, from CSV files named by symbol, for ``bars.clean``.

    Each file has its own separator and columns. Names are taken in lower case; the time is the first with
    "time" or "date" in it, else the first column, and the volume the first that starts with "vol". A missing
    price column is an error.
    """
    groups = by_header(spark, path)
    if not groups:
        raise ValueError(f"{path} has no line")
    return reduce(DataFrame.unionByName, [_bars_of(spark, head, files) for head, files in sorted(groups.items())])


def _bars_of(spark: SparkSession, head: str, files: list[str]) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", line_separator(head)).csv(files)
    names = {c.strip().strip("<>").lower(): c for c in raw.columns}
    absent = [c for c in ("open", "high", "low", "close") if c not in names]
    if absent:
        raise ValueError(f"{files[0]} has no column {', '.join(absent)}")
    time = next((c for n, c in names.items() if "time" in n or "date" in n), raw.columns[0])
    volume = next((c for n, c in names.items() if "vol" in n), None)
    price = [F.col(f"`{names[c]}`").alias(c) for c in ("open", "high", "low", "close")]
    symbol = F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    # Rows follow each other by the block they lie in and their place in it, whichever task reads them.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(symbol.alias("symbol"), place.alias("seq"), F.col(f"`{time}`").alias("time"), *price, (F.col(f"`{volume}`") if volume else F.lit("0")).alias("volume"))


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """symbol: the names of a folder's CSV files, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("symbol")).distinct().orderBy("symbol")


def read_cot(spark: SparkSession, path: str) -> DataFrame:
    """asset, date, comm_net, noncomm_net, open_interest from cached weekly CSV files named by asset."""
    raw = spark.read.option("header", True).csv(path).withColumn("asset", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return raw.select("asset", F.col("date").try_cast("date").alias("date"), number("comm_net"), number("noncomm_net"), number("open_interest"))


BIAS = "currencies array<struct<pair:string,bias:string>>, metals array<struct<pair:string,bias:string>>, as_of string"


def biases(payloads: DataFrame, column: str = "value") -> DataFrame:
    """pair, bias, as_of from JSON payloads of currencies and metals."""
    j = F.from_json(column, BIAS)
    both = F.concat(F.coalesce(F.col("_j.currencies"), F.array().cast("array<struct<pair:string,bias:string>>")), F.coalesce(F.col("_j.metals"), F.array().cast("array<struct<pair:string,bias:string>>")))
    return payloads.select(j.alias("_j")).select(F.inline(both), F.col("_j.as_of").alias("as_of"))


def write_report(rows: DataFrame, template: str, columns: list[str], path: str) -> None:
    """Rows as lines of text."""
    rows.select(F.format_string(template, *[F.col(c) for c in columns]).alias("value")).write.text(path)
