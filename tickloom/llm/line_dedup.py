"""Line dedup on levelled sorted runs of line hashes (DataFrame functions only).

Lines come in batches, those of the highest ids first. A run is a table of line hashes, bucketed
and sorted by hash. Each batch is merge-anti-joined with the runs that stand: a hash that none of
them holds enters with its keeper, the highest id of the batch; of a known hash only the count is
added. What comes of the batch is a run of level 0, and as soon as a level holds ``fan_in`` runs
they are merged into one run of the next level. So a batch meets few runs, and a hash is rewritten
about log(batches) times. Runs are dealt and sorted by hash on disk, so neither the anti-joins nor
the merges shuffle them.

Texts never travel with the hashes: a line is 16 bytes of hash and its place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, discard, new_path, parts_wanted, range_cuts, range_part, remove, stash

HASHES = ["_h1", "_h2"]
SENT = 4096
#: Documents of a batch, where no number of batches is asked for; four batches at least.
BATCH_DOCS, BATCHES = 1 << 22, 4


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hashes(key: Column) -> list[Column]:
    """128 bits: a second hash with another seed, so that two lines in 10^19 meet."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("second"), key).alias("_h2")]


class LineRuns:
    """The runs. ``add`` takes (_h1, _h2, n_docs, keeper), one row per hash of the batch; ``drop`` deletes all.

    Of a hash's rows in all runs exactly one has a keeper, that of the batch in which it was new.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets or parts_wanted(spark)
        # A run has one file a bucket, so its scan may be taken as sorted.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "line-run")
        rows.select(*HASHES, "n_docs", "keeper").write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def all(self) -> list[str]:
        """The runs' tables, the oldest first."""
        return [name for level in reversed(self.levels) for name in level]

    def entering(self, batch: DataFrame) -> DataFrame:
        """The batch, with a keeper only where no run holds the hash: one merge anti-join a run, which also leaves the known hashes' counts."""
        known = F.lit(False)
        for k, name in enumerate(self.all()):
            run = self.spark.table(name).select(*HASHES, F.lit(True).alias(f"_in{k}"))
            batch = batch.join(run.hint("merge"), HASHES, "left")
            known = known | F.col(f"_in{k}").isNotNull()
        return batch.withColumn("keeper", F.when(~known, F.col("keeper")))

    def add(self, batch: DataFrame) -> None:
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(self.entering(batch)))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k] = []
                self.levels[k + 1].append(self._merge(level))

    def _merge(self, names: list[str]) -> str:
        """One run of several, older first, pair by pair."""
        out = names[0]
        for name in names[1:]:
            newer = self.spark.table(name).select(*HASHES, F.col("n_docs").alias("_n"), F.col("keeper").alias("_keeper"))
            both = self.spark.table(out).join(newer.hint("merge"), HASHES, "full_outer")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))
            merged = self._write(both.select(*HASHES, n.alias("n_docs"), F.coalesce("_keeper", "keeper").alias("keeper")))
            for x in (out, name):
                self._drop(x)
            out = merged
        return out

    def merged(self) -> DataFrame:
        """One row per hash: in how many documents, and its keeper. Leaves a single run."""
        if not self.all():
            return self.spark.createDataFrame([], "_h1 long, _h2 long, n_docs long, keeper long")
        self.levels = [[self._merge(self.all())]]
        return self.spark.table(self.all()[0])

    def drop(self) -> None:
        for name in self.all():
            self._drop(name)
        self.levels = []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fan_in: int = 2) -> DataFrame:
    """``docs`` with ``kept`` (the text without dropped lines), ``n_lines`` and ``n_dropped``.

    A key is a line's text without ASCII white space at its ends and with A-Z lower-cased. Keys of
    ``min_chars`` code points or more in ``min_docs`` documents or more lose all their lines except
    in the largest id that holds them.

    * Null or empty text: one empty line, so ``kept`` is empty, ``n_lines`` 1.
    * Rows with a null id pass through whole and are counted nowhere.
    * Rows of one id count as one document; a row repeated is treated as often as it stands.
    * Empty table: empty result. Other columns pass through, but for those named like a result,
      which are replaced; internal names start with ``_ld_``.

    Lines come in ``batches``; unless given, as many as bound a batch's documents. Runs and lines
    are deleted at the end; the places to drop stay in the shared folder for the result to read.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept", "n_lines", "n_dropped")
    marked = docs.withColumn("_ld_id", F.col(id_col).cast("long")).withColumn("_ld_text", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    long_lines = (
        marked.where("_ld_id is not null")
        .select("_ld_id", "_ld_text", F.posexplode(lines).alias("_pos", "_line"))
        .withColumn("_line", F.btrim("_line", F.lit(BLANKS)))
        .where(F.char_length("_line") >= min_chars)
        .select("_ld_id", "_ld_text", "_pos", *key_hashes(F.translate("_line", UPPER, LOWER)))
    )
    if batches is None:
        batches = max(BATCHES, -(-docs.count() // BATCH_DOCS))
    cuts = range_cuts(marked, "_ld_id", batches)
    # Higher ids first: the batch in which a hash is new holds its keeper.
    keys = stash(long_lines.withColumn("_batch", F.lit(len(cuts)) - range_part("_ld_id", cuts)), "line-keys", "_batch")
    runs = LineRuns(spark, fan_in)
    for b in range(len(cuts) + 1):
        counted = keys.where(F.col("_batch") == b).groupBy(*HASHES).agg(F.countDistinct("_ld_id").alias("n_docs"), F.max("_ld_id").alias("keeper"))
        runs.add(counted)
    common = stash(runs.merged().where(F.col("n_docs") >= min_docs), "common-lines")
    # Lines with a share of 1 / SENT or more of all are at most SENT, so they are sent to every task.
    bound = keys.count() / SENT
    sent = common.where(F.col("n_docs") >= bound).select(*HASHES, F.col("keeper").alias("_sent"))
    held = keys.join(F.broadcast(sent), HASHES, "left")
    rest = held.where("_sent is null").drop("_sent").join(common.where(F.col("n_docs") < bound).select(*HASHES, "keeper"), HASHES)
    found = held.where("_sent is not null").withColumnRenamed("_sent", "keeper").unionByName(rest)
    drops = stash(found.where("_ld_id <> keeper").groupBy("_ld_id", "_ld_text").agg(F.collect_set("_pos").alias("_ld_drop")), "line-drops")
    runs.drop()
    discard(keys)
    discard(common)
    joined = marked.join(drops, ["_ld_id", "_ld_text"], "left").withColumn("_ld_lines", lines)
    n, drop = F.size("_ld_lines"), F.coalesce("_ld_drop", F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), n - 1), drop)
    kept = F.when(F.col("_ld_drop").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(F.transform(places, lambda p: F.col("_ld_lines")[p]), "\n"))
    return joined.select(*[F.col(c) for c in docs.columns], kept.alias("kept"), n.cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"))


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.pos, d.line, c.k IS NOT NULL AND d.doc_id <> c.keeper AS gone
  FROM keyed d LEFT JOIN common c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
