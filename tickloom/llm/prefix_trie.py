"""The trie of conversation prefixes, with what shared prefixes save, by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest that depends on the sequence only:
turns are chained within blocks of BLOCK, and the digests of whole blocks are chained in the same way
one level up, so one very long conversation is many tasks. Edges lead from a node's key to its
parent's. Sums over subtrees take logarithmically many rounds: in each, every node adds what lies up
to 2^k below the nodes that point at it, and its pointer jumps twice as far. Nodes of one conversation
save nothing and have one leaf, so the rounds hold shared nodes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_heavy, parts_wanted, stash

#: Turns that are chained in one go.
BLOCK = 64
#: Ids of a node's last members that make one row.
PIECE = 4096
#: A digest is the first bytes of a SHA-256.
WIDTH = 16
ROOT = bytes(WIDTH)

KEY = pa.binary()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place among those of its conversation in this task; the rows come in order."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        place = np.arange(len(conv)) - np.repeat(start, np.diff(np.r_[start, len(conv)]))
        if conv[0] == last:
            place[: start[1] if len(start) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(np.full(len(conv), part), pa.int32())], names=["conv_id", "digest", "bytes", "pos", "part"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, digest (of role and text), bytes (of text), pos (from 0 in the conversation), part.

    Rows are dealt by ranges of their order, so a conversation of any length is many tasks; its later
    tasks then add what the earlier ones hold. At most two rows a task are needed for that.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = rows.repartitionByRange(parts_wanted(spark), *order).sortWithinPartitions(*order).select("conv_id", "digest", "bytes")
    placed = stash(dealt.mapInArrow(_numbered, "conv_id long, digest binary, bytes long, pos long, part int"), "trie-turns")
    held = placed.groupBy("conv_id", "part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("conv_id")
    spread = held.withColumns({"_parts": F.count("*").over(w), "_before": F.sum("_n").over(w.orderBy("part")) - F.col("_n")}).where("_parts > 1")
    return placed.join(F.broadcast(spread.select("conv_id", "part", "_before")), ["conv_id", "part"], "left").withColumn("pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("_before", "part")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation of the contract takes from its group's first: 0 to 8."""
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(turns: DataFrame, sizes: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """conv_id, pos, digest, bytes of every conversation with its first turns taken from the first of its group.

    ``sizes`` has conv_id and n_turns. Of each first conversation ``most`` turns at most go to ``group`` others.
    """
    first = F.pmod("conv_id", F.lit(group)) == 0
    targets = F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda k: F.try_add("conv_id", k.cast("long")))
    heads = turns.where(first & (F.col("pos") < most)).withColumn("conv_id", F.explode(targets)).where(F.col("pos") < borrowed(F.col("conv_id"))).join(sizes.select("conv_id"), "conv_id", "left_semi")
    bases = sizes.where(first).select(F.col("conv_id").alias("_base"), F.col("n_turns").alias("_n"))
    joined = sizes.withColumns({"_base": F.col("conv_id") - F.pmod("conv_id", F.lit(group)), "_h": borrowed(F.col("conv_id"))}).join(bases, "_base", "left")
    lost = joined.select("conv_id", (F.col("_h") - F.least("_h", F.coalesce("_n", F.lit(0)))).alias("_lost"))
    tails = join_heavy(turns.where(F.col("pos") >= borrowed(F.col("conv_id"))), lost, "conv_id")
    names = ["conv_id", "pos", "digest", "bytes"]
    return heads.select(*names).unionByName(tails.withColumn("pos", F.col("pos") - F.col("_lost")).select(*names))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, block, pos, digest, bytes) in order, each with the digest of its block up to it, the one before (null at a block's start), and whether it ends its block."""
    sha, last, key = hashlib.sha256, None, None
    for batch in batches:
        conv, block, pos, digest, size = (c.to_pylist() for c in batch.columns)
        chain, before = [], []
        for c, b, d in zip(conv, block, digest):
            if (c, b) != last:
                last, key = (c, b), None
            before.append(key)
            key = sha((key or b"") + d).digest()[:WIDTH]
            chain.append(key)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(chain, KEY), pa.array(before, KEY)], names=["conv_id", "block", "pos", "bytes", "chain", "before"])


def with_keys(rows: DataFrame, longest: int) -> DataFrame:
    """conv_id, pos, bytes, key, parent: the digests of all first turns up to a row, and up to the one before it.

    ``rows`` has conv_id, pos, digest, bytes; ``longest`` is the number of turns of the longest conversation.
    """
    blocks = rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).select("conv_id", "block", "pos", "digest", "bytes")
    dealt = blocks.repartition(parts_wanted(rows.sparkSession), "conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    chained = dealt.mapInArrow(_chained, "conv_id long, block long, pos long, bytes long, chain binary, before binary")
    if longest <= BLOCK:
        return chained.select("conv_id", "pos", "bytes", F.col("chain").alias("key"), F.coalesce("before", F.lit(ROOT)).alias("parent"))
    chained = stash(chained, "trie-blocks")
    full = chained.where(F.col("pos") % BLOCK == BLOCK - 1).select("conv_id", F.col("block").alias("pos"), F.col("chain").alias("digest"), "bytes")
    whole = stash(with_keys(full, longest // BLOCK).select("conv_id", F.col("pos").alias("block"), F.col("key").alias("_whole")), "trie-whole")
    past = whole.select("conv_id", (F.col("block") + 1).alias("block"), F.col("_whole").alias("_past"))
    joined = chained.join(past, ["conv_id", "block"], "left").join(whole, ["conv_id", "block"], "left")
    on = lambda c: F.when(F.col("_past").isNull(), F.col(c)).when(F.col(c).isNull(), F.col("_past")).otherwise(F.substring(F.unhex(F.sha2(F.concat("_past", c), 256)), 1, WIDTH))
    # What ends with a whole block has the key that the next block builds on.
    key = F.when(F.col("pos") % BLOCK == BLOCK - 1, F.col("_whole")).otherwise(on("chain"))
    return joined.select("conv_id", "pos", "bytes", key.alias("key"), F.coalesce(on("before"), F.lit(ROOT)).alias("parent"))


def subtree_sums(nodes: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """``nodes`` (key, parent, depth and ``values``) with each value summed over the node and all below it.

    After k rounds ``values`` hold what lies less than 2^k below and ``parent`` is 2^k above, so as many
    rounds as the depth has binary digits do. Pointers at one node are summed before they meet it.
    """
    step, now = 1, stash(nodes.select("key", "parent", "depth", *values), "trie-round")
    while step <= deepest:
        below = now.where(F.col("depth") >= step).groupBy("parent").agg(*[F.sum(v).alias(f"_{v}") for v in values]).withColumnRenamed("parent", "key")
        far = now.where(F.col("depth") >= 2 * step).select("key", "parent")
        over = now.where(F.col("depth") >= step).select(F.col("key").alias("parent"), F.col("parent").alias("_next"))
        hops = join_heavy(far, over, "parent").select("key", "_next")
        met = now.join(below, "key", "left").join(hops, "key", "left")
        sums = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        last, now = now, stash(met.select("key", F.col("_next").alias("parent"), "depth", *sums), "trie-round")
        discard(last)
        step *= 2
    return now.select("key", *values)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order, PIECE or fewer of a key in one: key, its least conv_id, all of them with commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [0]
        for i in range(1, len(key)):
            if key[i] != key[i - 1] or i - starts[-1] == PIECE:
                starts.append(i)
        spans = list(zip(starts, [*starts[1:], len(key)]))
        yield pa.RecordBatch.from_arrays([pa.array([key[a] for a, _ in spans], KEY), pa.array([conv[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, conv[a:b])) for a, b in spans])], names=["key", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ids) in order of their ids: each key's SHA-256 of all ids, piece by piece."""
    last, state = None, None
    shape = lambda keys, shas: pa.RecordBatch.from_arrays([pa.array(keys, KEY), pa.array(shas, pa.string())], names=["key", "ends_sha256"])
    for batch in batches:
        keys, shas = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                keys.append(last)
                shas.append(state.hexdigest())
            last, state = key, hashlib.sha256(ids.encode())
        yield shape(keys, shas)
    if last is not None:
        yield shape([last], [state.hexdigest()])


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of rows (key, conv_id): the hash of a node's ids in ascending order, in bounded memory."""
    n = parts_wanted(ends.sparkSession)
    cut = ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    return cut.repartition(n, "key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and key and parent_key.

    ``turns`` has conv_id, pos (0, 1, ... in each conversation), digest and bytes; ``members`` has each
    conv_id once, those without turns included. Without members there is no node.

    * conv_id is a node's smallest member; saved_tokens sums (members - 1) * bytes of the last turn over its subtree.
    * ends_sha256 hashes the ids of the conversations that end at the node, ascending, joined by commas.
    """
    longest = turns.agg(F.max("pos")).first()[0]
    longest = 0 if longest is None else longest + 1
    placed = stash(with_keys(turns, longest), "trie-places")
    inner = placed.groupBy("key", "parent", (F.col("pos") + 1).alias("depth"), "bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    top = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "n_convs", "conv_id")
    nodes = stash(inner.unionByName(top), "trie-nodes")
    lone = F.when(F.col("n_convs") == 1, 1).otherwise(0)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.sum(lone).cast("long").alias("_lone"))
    known = stash(nodes.join(children, "key", "left").fillna(0, ["n_children", "_lone"]), "trie-children")
    # A node of one conversation has one leaf and saves nothing; what hangs off a shared node counts there.
    shared = known.where("n_convs > 1").select("key", "parent", "depth", (F.col("_lone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(shared, deepest, ["n_leaves", "saved_tokens"])
    last = placed.groupBy("conv_id").agg(F.max(F.struct("pos", "key")).alias("_l")).select("conv_id", F.col("_l.key").alias("key"))
    ends = members.select("conv_id").join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id")
    rows = known.join(sums, "key", "left").join(end_digests(ends), "key", "left").drop("_lone", "bytes")
    up = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = join_heavy(stash(rows, "trie-rows"), up, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.hex("key").alias("key"), F.hex("parent").alias("parent_key"))


def op11(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row a node.

    * Rows are ordered by turn (null first), then role, then the digest of role and text. A null role or text is empty.
    * Repeated rows count each. Rows without a conv_id take no part. Of a negative conv_id the remainder by 5 is not negative.
    * Texts of any length are hashed whole. Empty table: no node. Other columns are not carried.
    """
    turns = ordered_turns(conversations)
    sizes = stash(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "trie-sizes")
    return trie(stash(rebuilt(turns, sizes), "trie-rebuilt"), sizes.select("conv_id")).drop("key", "parent_key")


SQL = """
WITH given AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, count(*) AS m, conv_id - conv_id % 5 AS base,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
             lambda a, b: list_reduce([xor(a, b)] || [CAST(i AS BIGINT) FOR i IN range(8)], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM given GROUP BY conv_id),
known AS (SELECT s.*, least(s.h, coalesce(b.m, 0)) AS kept FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
turns AS (
  SELECT k.conv_id, g.pos, g.role, g.text FROM known k JOIN given g ON g.conv_id = k.base AND g.pos < k.h
  UNION ALL
  SELECT k.conv_id, g.pos - k.h + k.kept, g.role, g.text FROM known k JOIN given g ON g.conv_id = k.conv_id AND g.pos >= k.h),
paths AS (
  SELECT conv_id, pos + 1 AS depth, strlen(text) AS bytes,
         list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS path
  FROM turns),
keyed AS (SELECT conv_id, depth, bytes, array_to_string(path, '') AS key, array_to_string(path[:-2], '') AS parent FROM paths),
places AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS at_end FROM keyed),
placed AS (
  SELECT * FROM places
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM turns) FROM sizes),
nodes AS (
  SELECT key, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
  FROM placed GROUP BY key, parent, depth),
children AS (SELECT n.key, count(c.key) AS n_children FROM nodes n LEFT JOIN nodes c ON c.parent = n.key GROUP BY n.key),
above AS (
  SELECT key AS top, key, 0 AS up FROM nodes
  UNION ALL
  SELECT left(key, 64 * CAST(d AS BIGINT)), key, depth - d FROM (SELECT key, depth, unnest(range(depth)) AS d FROM nodes)),
sums AS (
  SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM above JOIN nodes USING (key) JOIN children USING (key) GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN children c ON c.key = n.key JOIN sums s ON s.top = n.key LEFT JOIN nodes p ON p.key = n.parent
"""
