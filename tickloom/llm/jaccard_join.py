"""N-gram Jaccard join by T-occurrence search.

Two texts link when their sets of word shingles have ``100 * both >= percent * either``. A partner
of a set of n shingles holds at least T = ceil(percent * n / 100) of them, so it stands in at least
T of the n inverted lists. DivideSkip leaves the L longest lists aside, asks for T - L occurrences
in the short ones, and probes the long ones by binary search for what is left.

On the cluster the same division is made in two places:

1. Across documents: shingles are ordered, those of very many documents last. Of each set only the
   first n - T + h go into the inverted index (the short lists); partners meet there at least h
   times. The long rest is never shuffled.
2. Within a task (``links_in_block``): documents that met in a list are searched among each other
   over all their shingles with DivideSkip.

Steps: equal sets are one node from the start. Rounds of (2) join what they can, each node in one
of its lists, blocks bounded in size. Where lists then still hold several components, nodes are
searched among those of every large component with which they share enough lists. Pairs of nodes of
small components are rows if their sizes fit: the lists they share and then their bitmaps bound
their overlap, and only pairs that both bounds leave open are searched by their texts, so no link is
lost. A task sends on at most one edge a node.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN, join_heavy, parts_wanted, pieces, small_batches, stash
from .components import components
from .shingles import Shingler, set_id

#: A shingle goes last if more than this share of all documents hold it (and this many at least).
#: That bounds the list of such shingles by the mean number of shingles a document times 5000.
HOT_SHARE, HOT_LEAST = 1 / 5000, 32
#: Of such shingles the most frequent are listed, 32 MB at most; the order of the others is as good, only their lists are longer.
HOT_MOST = 1 << 22
#: Short lists with more places together are counted in an array, which gives the same as the heap.
HEAP_MOST = 256
#: Of a set of n shingles n * MEET // 100 short lists must be shared with a partner, 1 at least.
MEET = 5
BLOCK_ROWS, BLOCK_BYTES, BLOCK_SHINGLES = 4096, 24 << 20, 3_000_000
#: Components of more open nodes are large.
SMALL_NODES = 64
#: Nodes of a list that one task pairs with the rest of it.
SLICE = 256


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with any partner."""
    return -(-n * percent // 100)


def meets(n: int) -> int:
    """h: the short lists that a set of n shingles shares with any partner as large."""
    return max(1, n * MEET // 100)


def least_meets(n: Column, percent: int) -> Column:
    """h for the smallest partner of a set of n shingles."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) * MEET / 100))


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """The short lists that linked sets of n and m shingles share at least.

    Of the two short prefixes one ends first in the common order. What its set shares beyond it lies among the
    T - h shingles that are not in its prefix.
    """
    both = F.ceil(percent * (n + m) / (100 + percent))
    beyond = [F.ceil(k * percent / 100) - F.greatest(F.lit(1), F.floor(k * MEET / 100)) for k in (n, m)]
    return both - F.greatest(*beyond)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bit by bit (of the least power of two that is 64 and the set's size at least) whether an odd number of the set's shingles falls on it."""
    size = 64
    while size < len(shingles):
        size *= 2
    return (np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)


def may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """False only if sets of n and m shingles with these bitmaps cannot link: every differing bit is a shingle that one of them lacks."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.count_nonzero(x != y))
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def prefix(shingles: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The shingles whose lists are short lists of this set: the first n - T + h, hot ones last."""
    n = len(shingles)
    k = n - needed(n, percent) + meets(n)
    if len(hot):
        place = np.searchsorted(hot, shingles)
        place[place == len(hot)] = 0
        is_hot = hot[place] == shingles
        if is_hot.any():
            shingles = np.concatenate([shingles[~is_hot], shingles[is_hot]])
    return shingles[:k]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def heap_merge(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, times) of all that stand in ``least`` or more of the ascending lists.

    The lists' heads wait in a heap. Where too few heads are equal, ``least`` - 1 of them move on to
    the next head at once, as nothing before it can be often enough.
    """
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapify(heap)
    out = []
    while len(heap) >= least:
        value, same = heap[0][0], []
        while heap and heap[0][0] == value:
            same.append(heappop(heap))
        if len(same) >= least:
            out.append((value, len(same)))
            to = value + 1
        else:
            while heap and len(same) < least - 1:
                same.append(heappop(heap))
            if not heap:
                break
            to = heap[0][0]
        for _, k, at in same:
            at = bisect_left(lists[k], to, at)
            if at < len(lists[k]):
                heappush(heap, (lists[k][at], k, at))
    return out


def links_in_block(sets: list[np.ndarray], percent: int, forest: Forest, begin: int = 1) -> None:
    """Join linked sets of the block in ``forest``, by DivideSkip for each set from ``begin`` on against those before it."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    flat, docs = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    token = np.empty(len(flat), np.int64)
    token[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(flat)]))
    ends = np.cumsum(sizes)
    roots = np.array([forest.root(i) for i in range(len(sets))])
    # A list's sets ascend: those before the present one are its first ``upto``.
    upto = np.zeros(len(starts), np.int64)
    for i in range(min(begin, len(sets))):
        upto[token[ends[i] - sizes[i] : ends[i]]] += 1
    for i in range(begin, len(sets)):
        n = int(sizes[i])
        t = needed(n, percent)
        every = token[ends[i] - n : ends[i]]
        mine = every[upto[every] > 0]
        size = upto[mine]
        upto[every] += 1
        if len(mine) < t:
            continue
        by = np.argsort(size, kind="stable")
        mine, size = mine[by], size[by]
        skip = min(t - 1, int(t / (0.5 * np.log2(int(size[-1]) + 1) + 1)))
        short = len(mine) - skip
        places = [docs[starts[x] : starts[x] + k] for x, k in zip(mine.tolist(), size.tolist())]
        if int(size[:short].sum()) <= HEAP_MOST:
            found = heap_merge([p.tolist() for p in places[:short]], t - skip)
            found, both = (np.array(found, np.int64).T if found else np.zeros((2, 0), np.int64))
        else:
            count = np.bincount(np.concatenate(places[:short]), minlength=i)
            found = np.flatnonzero(count >= t - skip)
            both = count[found]
        other = roots[found] != roots[i]
        found, both = found[other], both[other].copy()
        if not len(found):
            continue
        for members in places[short:]:
            at = np.searchsorted(members, found)
            at[at == len(members)] = 0
            both += members[at] == found
        hit = found[100 * both >= percent * (sizes[found] + n - both)]
        for r in np.unique(roots[hit]):
            forest.join(int(r), int(roots[i]))
            new = forest.root(i)
            roots[(roots == r) | (roots == roots[i])] = new


def _sets_and_hot(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, n, node) of each document. kind 1: (shingle, times) of those met often."""
    shingler, seen, held, docs, count = Shingler(size), set(), [], 0, 0

    def often() -> pa.RecordBatch:
        value, times = np.unique(np.concatenate(held), return_counts=True)
        keep = times >= max(4, docs * HOT_SHARE)
        k = int(keep.sum())
        return pa.record_batch({"kind": pa.array(np.ones(k, np.int32)), "a": pa.array(value[keep].view(np.int64)), "n": pa.array(times[keep]), "node": pa.nulls(k, pa.int64())})

    for batch in pieces(batches, 1, 2 << 20):
        sets = shingler.sets(batch.column(1).to_pylist())
        nodes = [set_id(s) for s in sets]
        sizes = [len(s) for s in sets]
        yield pa.record_batch({"kind": pa.array(np.zeros(len(sets), np.int32)), "a": batch.column(0), "n": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.int64())})
        for s, node in zip(sets, nodes):
            if node not in seen:
                seen.add(node)
                held.append(s)
                docs, count = docs + 1, count + len(s)
        if count > 2_000_000:
            yield often()
            held, docs, count = [], 0, 0
    if held:
        yield often()


def _short_lists(batches: Iterator[pa.RecordBatch], size: int, percent: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shingle, node, n) of each set's prefix, once a task."""
    shingler, seen = Shingler(size), set()
    for batch in pieces(batches, 1, 2 << 20):
        values, nodes, sizes = [], [], []
        for s in shingler.sets(batch.column(1).to_pylist()):
            node = set_id(s)
            if len(s) and node not in seen:
                seen.add(node)
                values.append(prefix(s, hot, percent))
                nodes.append(node)
                sizes.append(len(s))
        if values:
            each = [len(v) for v in values]
            yield pa.record_batch({"shingle": pa.array(np.concatenate(values).view(np.int64)), "node": pa.array(np.repeat(np.array(nodes, np.int64), each)), "n": pa.array(np.repeat(np.array(sizes, np.int64), each))})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, node): those whose shingle two nodes hold, each once."""
    rest: pa.Table | None = None
    names = ["shingle", "node", "n"]

    def keep(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
        s, node = table.column(0).to_numpy(), table.column(1).to_numpy()
        fresh = np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])]
        table, s = table.filter(pa.array(fresh)), s[fresh]
        head = np.r_[True, s[1:] != s[:-1]]
        tail = np.r_[s[1:] != s[:-1], True]
        several = ~(head & tail)
        if not last:
            # The last shingle may go on: two of its rows at least must wait, or one that is known to be shared.
            start = np.flatnonzero(head)[-1]
            wait = min(len(s) - start, 2)
            several[start:] = len(s) - start > 2
            several[len(s) - wait :] = False
            return table.filter(pa.array(several)), table.slice(len(s) - wait)
        return table.filter(pa.array(several)), None

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        out, rest = keep(table, False)
        yield from out.select(names).combine_chunks().to_batches()
    if rest is not None:
        yield from keep(rest, True)[0].select(names).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, node, label, text) sorted by (shingle, n): edges (u, v) that join labels."""
    shingler, key, rows, held = Shingler(size), None, [], 0

    def search() -> Iterator[pa.RecordBatch]:
        sets = shingler.sets([t for _, _, t in rows])
        good = [k for k, s in enumerate(sets) if len(s) and set_id(s) == rows[k][0]]
        if len(good) < 2:
            return
        forest, labels = Forest(len(good)), [rows[k][1] for k in good]
        first: dict[int, int] = {}
        for i, label in enumerate(labels):
            forest.join(first.setdefault(label, i), i)
        links_in_block([sets[k] for k in good], percent, forest)
        edges = {(label, labels[forest.root(i)]) for i, label in enumerate(labels)}
        edges = [e for e in edges if e[0] != e[1]]
        if edges:
            yield pa.record_batch({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    for batch in batches:
        for s, node, label, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if s != key or len(rows) >= BLOCK_ROWS or held > BLOCK_BYTES:
                yield from search()
                key, rows, held = s, [], 0
            rows.append((node, label, text))
            held += len(text)
    yield from search()


def _against(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (home, chunk, visitor, node, label, text) sorted so: edges that join labels of a chunk's members and visitors.

    The members of a chunk are bounded; its visitors come in turns, as many at a time.
    """
    shingler, key = Shingler(size), None
    sets: list[np.ndarray] = []
    labels: list[int] = []
    members = held = 0

    def search() -> Iterator[pa.RecordBatch]:
        if not members or len(sets) == members:
            return
        forest, first = Forest(len(sets)), {}
        for i, label in enumerate(labels):
            forest.join(first.setdefault(label, i), i)
        links_in_block(sets, percent, forest, begin=members)
        edges = {(label, labels[forest.root(i)]) for i, label in enumerate(labels)}
        edges = [e for e in edges if e[0] != e[1]]
        if edges:
            yield pa.record_batch({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    for batch in pieces(batches, 5, 1 << 20):
        found = shingler.sets(batch.column(5).to_pylist())
        for home, chunk, visitor, node, label, s in zip(*(batch.column(k).to_pylist() for k in range(5)), found):
            if key != (home, chunk):
                yield from search()
                key, sets, labels, members, held = (home, chunk), [], [], 0, 0
            if set_id(s) != node:
                continue  # the text of another row with this node's document id
            sets.append(s)
            labels.append(label)
            if not visitor:
                members += 1
                continue
            held += len(s)
            if held > BLOCK_SHINGLES or len(sets) - members >= BLOCK_ROWS:
                yield from search()
                sets, labels, held = sets[:members], labels[:members], 0
    yield from search()


def _bitmaps(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The bitmap of each node of rows (node, text)."""
    shingler = Shingler(words)
    for batch in pieces(batches, 1, 2 << 20):
        found = [(node, np.packbits(bitmap(s)).tobytes()) for node, s in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(1).to_pylist())) if set_id(s) == node]
        yield pa.record_batch({"node": pa.array([n for n, _ in found], pa.int64()), "bits": pa.array([b for _, b in found], pa.binary())})


def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (node, other, n, m, bits, other_bits) those that may link, as (node, other)."""
    for batch in batches:
        keep = [may_link(*(np.unpackbits(np.frombuffer(b, np.uint8)) for b in (x, y)), n, m, percent) for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _nodes_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The node and text of rows (id, text) that have a shingle."""
    shingler = Shingler(words)
    for batch in pieces(batches, 1):
        texts = batch.column(1).to_pylist()
        kept = [(set_id(s), t) for s, t in zip(shingler.sets(texts), texts) if len(s)]
        yield pa.record_batch({"node": pa.array([n for n, _ in kept], pa.int64()), "text": pa.array([t for _, t in kept], pa.string())})


def _relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, label) after the edges between labels; nodes without a row are labelled by themselves."""
    roots = components(edges)
    if labels is None:
        return stash(roots.select("node", F.col("root").alias("label")), "labels")
    moved = join_heavy(labels, roots.select(F.col("node").alias("label"), "root"), "label", "left", PLAIN).select("node", F.coalesce("root", "label").alias("label"))
    fresh = roots.join(labels.select("node"), "node", "left_anti").select("node", F.col("root").alias("label"))
    return stash(moved.unionByName(fresh), "labels")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists that hold several labels, with each node's label and the list's commonest."""
    if labels is None:
        rows = lists.withColumn("label", F.col("node"))
    else:
        rows = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle")
    return rows.join(spread, "shingle")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least id that links reach).

    * Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer than
      ``words`` words has its whole sequence as its one shingle.
    * Null, empty or blank texts have no shingle, link with nothing and are their own component.
    * Equal texts link. Rows of one id stand for themselves: each has its own text's component.
    * Rows with a null id link as others do; a component of such rows alone has a null id.
    * Empty table: empty result. Other columns are not carried.
    * Sets and shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stash(texts.mapInArrow(lambda b: _sets_and_hot(b, words), "kind int, a long, n long, node long"), "shingle-sets", "kind")
    members = found.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "node")
    total = members.count()
    often = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, total * HOT_SHARE)).orderBy(F.desc("n"), "a").limit(HOT_MOST).select("a")
    hot = np.sort(often.toArrow().column(0).to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast(hot)
    short = texts.mapInArrow(lambda b: _short_lists(b, words, percent, sent.value), "shingle long, node long, n long")
    sorted_lists = short.repartition(parts_wanted(spark), "shingle").sortWithinPartitions("shingle", "node")
    lists = stash(sorted_lists.mapInArrow(_shared, "shingle long, node long, n long"), "short-lists")

    # The texts of nodes that met others often enough, one text a node.
    met = lists.groupBy("node").agg(F.count("*").alias("met"), F.max("n").alias("n")).where(F.col("met") >= least_meets(F.col("n"), percent)).select("node")
    met = stash(met, "met-nodes")
    lists = stash(lists.join(met, "node", "left_semi"), "met-lists")
    holders = members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).join(met, "node")
    # Where all rows of a node have a null id, its text is found by the node itself.
    nameless = texts.where("doc_id is null").mapInArrow(lambda b: _nodes_of(b, words), "node long, text string")
    nameless = nameless.join(holders.where("doc_id is null"), "node").dropDuplicates(["node"])
    some = stash(texts.join(holders, "doc_id").select("node", "n", "text").unionByName(nameless.select("node", "n", "text")), "candidate-texts")

    labels: DataFrame | None = None
    for r in range(rounds):
        open_lists = _labelled(lists, labels)
        route = open_lists.groupBy("node").agg(F.min_by("shingle", F.xxhash64(F.lit(r), "shingle")).alias("shingle"), F.first("label").alias("label"))
        rows = route.join(some, "node").select("shingle", "node", "label", "text", "n")
        placed = rows.repartition(parts_wanted(spark), "shingle").sortWithinPartitions("shingle", "n", "node").drop("n")
        edges = stash(placed.mapInArrow(lambda b: _blocks(b, words, percent), "u long, v long"), "links")
        labels = _relabelled(labels, edges)

    labels = _relabelled(labels, _left_links(spark, lists, labels, some, words, percent))
    rooted = join_heavy(members.where("n > 0"), labels, "node", "left", PLAIN).withColumn("label", F.coalesce("label", "node"))
    rooted = stash(rooted.select("doc_id", "n", "label"), "rooted")
    least = rooted.groupBy("label").agg(F.min("doc_id").alias("least"))
    out = join_heavy(rooted, least, "label", plain=PLAIN).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _left_links(spark: SparkSession, lists: DataFrame, labels: DataFrame | None, some: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between labels that still share short lists, found among all their nodes that do.

    A large label is a home. Of two homes with open lists in common, the smaller one's nodes that share enough lists
    with the other's together visit it, and so do nodes of small labels; so rows grow with nodes and large labels, not
    with pairs. Of two nodes of small labels that may link the smaller one is the other's home. A home is searched
    in chunks of bounded size.
    """
    rows = _labelled(lists, labels).select("shingle", "node", "n", "label")
    rows = stash(rows, "open-lists")
    nodes = rows.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"))
    sizes = nodes.groupBy("label").agg(F.count("*").alias("nodes"), F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("chunks"))
    large = stash(sizes.where(F.col("nodes") > SMALL_NODES).withColumnRenamed("label", "home"), "homes")
    held = stash(rows.join(large.select(F.col("home").alias("label"), "nodes"), "label", "left"), "housed-lists")
    inside = held.where("nodes is not null")
    spans = inside.groupBy("shingle", F.col("label").alias("to"), F.col("nodes").alias("to_nodes")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    own = F.coalesce("nodes", F.lit(0))
    fewer = (own < F.col("to_nodes")) | ((own == F.col("to_nodes")) & (F.col("label") < F.col("to")))
    fits = (F.col("n") * percent <= F.col("hi") * 100) & (F.col("lo") * percent <= F.col("n") * 100)
    met = held.join(spans, "shingle").where(fewer & fits).groupBy("node", "to").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("label").alias("label"))
    visits = met.where(F.col("met") >= least_meets(F.col("n"), percent)).select("node", F.col("to").alias("home"), "label")
    visits = stash(visits, "visits")
    called = visits.select("home").distinct().join(large.select("home", "chunks"), "home")
    members = inside.select("node", F.col("label").alias("home")).distinct().join(called, "home").select("home", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), F.lit(0).alias("visitor"), "node", F.col("home").alias("label"))
    visitors = visits.join(called, "home").select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("visitor"), "node", "label")

    pairs = stash(_pairs(held.where("nodes is null").select("shingle", "node", "n", "label"), some, words, percent), "pairs")
    asked = pairs.select(F.col("other").alias("home"), F.lit(0).alias("visitor"), F.col("other").alias("node")).distinct()
    guests = pairs.select(F.col("other").alias("home"), F.lit(1).alias("visitor"), "node")
    paired = asked.unionByName(guests).join(nodes.select("node", "label"), "node").select("home", F.lit(0).cast("long").alias("chunk"), "visitor", "node", "label")
    dealt = members.unionByName(visitors).unionByName(paired).join(some, "node").select("home", "chunk", "visitor", "node", "label", "text")
    dealt = dealt.repartition(parts_wanted(spark), "home", "chunk").sortWithinPartitions("home", "chunk", "visitor")
    return stash(dealt.mapInArrow(lambda b: _against(b, words, percent), "u long, v long"), "links")


def _pairs(rows: DataFrame, some: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, other): nodes of different labels in rows (shingle, node, n, label) that may link, by the lists they share and by their bitmaps.

    A list is paired in slices, so a long one is many short groups.
    """
    slices = rows.groupBy("shingle").agg(F.ceil(F.count("*") / SLICE).alias("slices"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle", "slices")
    rows = stash(rows.join(slices, "shingle"), "paired-lists")
    others = rows.select("shingle", F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    rows = rows.select("shingle", "node", "n", "label", F.pmod(F.xxhash64("node"), F.col("slices")).alias("slice"))
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("other")))
    met = rows.join(others, ["shingle", "slice"]).where((F.col("label") != F.col("to")) & once & (F.col("n") * 100 >= F.col("m") * percent))
    found = met.groupBy("node", "other", "n", "m").agg(F.count("*").alias("met")).where(F.col("met") >= least_shared(F.col("n"), F.col("m"), percent))
    found = stash(found.select("node", "other", "n", "m"), "met-pairs")
    named = found.select("node").union(found.select("other")).distinct()
    bits = stash(some.join(named, "node").select("node", "text").mapInArrow(lambda b: _bitmaps(b, words), "node long, bits binary").dropDuplicates(["node"]), "bitmaps")
    both = found.join(bits, "node").join(bits.select(F.col("node").alias("other"), F.col("bits").alias("other_bits")), "other").select("node", "other", "n", "m", "bits", "other_bits")
    return both.mapInArrow(lambda b: _open_pairs(b, percent), "node long, other long")


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return jaccard_components(docs.select("doc_id", "text"), words=4, percent=85)
