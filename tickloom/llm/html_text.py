"""HTML extraction: an article's text, with boilerplate found by suffix arrays over a host's pages.

1. Each page becomes blocks of text in page order. A block is chrome if it stands in an element
   that says so (nav, aside, footer, a header outside the article, forms, or a class, id or role
   such as "ad", "cookie-banner", "comments"), body if it stands in the page's article or main
   element, and else open. Marks are needed for what never repeats: adverts and reader comments.
2. The words of open and body blocks of a host's pages are concatenated in shards of bounded size
   and sorted by suffix. Neighbours in that order that share ``RUN`` words or more are occurrences
   of a repeated substring; a longer one is a chain of such starts.
3. A run is boilerplate if enough of the host's distinct articles hold it: as open text 1 in 20
   (``OPEN_SHARE``), inside an article 9 in 10 (``BODY_SHARE``). Pages with the same article count
   once, so copies of an article are none of each other's boilerplate, and passages that some
   articles share stay.
4. Chrome goes, covered runs go, unique runs stay.

A host in several shards is counted whole, by partition: what 1 in 20 of a host's articles hold, 1
in 20 of some shard's hold, so each shard names its candidates and all shards count these. The
result does not depend on how pages are dealt.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_wanted, small_batches, stash
from .shingles import WordHasher

#: Words a run must have.
RUN = 8
#: The share of a host's distinct articles that hold boilerplate, and how many at least; in open text and in articles.
OPEN_SHARE, OPEN_LEAST = 0.05, 3
BODY_SHARE, BODY_LEAST = 0.9, 8
SHARD_PAGES, SHARD_BYTES = 256, 16 << 20
#: What is listed to every task: so many hosts with several shards, so many runs; beyond that they are joined by a shuffle.
SENT_HOSTS, SENT_RUNS, SALTS = 200_000, 4_000_000, 64
CHROME, BODY, OPEN = 0, 1, 2
#: Bytes of a word's hash. Runs are equal if all their words' hashes are, so few bytes tell them apart.
WIDTH = 3

# Names of HTML elements.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select", "button", "datalist", "canvas", "audio", "video", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CHROME_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset"}
# Words in class, id and role that mark chrome, if all words beside them in the same name are PLAIN.
AD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion"}
CHROME_WORDS = AD_WORDS | {
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pager", "pagination", "toolbar", "sidebar", "complementary", "widget", "related", "recommended", "share", "sharing", "social",
    "footer", "contentinfo", "masthead", "search", "form", "dialog", "comment", "comments", "respond", "replies", "disqus", "discussion",
}
HEADER_WORDS = {"header", "topbar"}
PLAIN = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "inner", "outer", "primary", "secondary", "box", "block", "bar", "area", "section", "container", "wrapper", "wrap", "content",
    "list", "item", "items", "link", "links", "row", "col", "column", "panel", "slot", "unit", "zone", "module", "region", "icon", "icons", "button", "buttons", "post", "posts", "article", "articles",
    "story", "stories", "entry", "user", "reader", "thread", "mobile", "desktop", "sticky", "fixed", "inline", "js",
}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}

MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
#: One attribute: a name, and a value in quotes or up to the next blank; of quotes only those right after "=" count.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+)?))?)?""")
CLOSING = re.compile(r"</([a-zA-Z][^\s/>]*)")
COMMENT_END = re.compile(r"--!?>")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of the tag whose name ends at ``at`` (the first of a name counts), and where the tag ends."""
    if page.startswith(">", at):
        return {}, at + 1
    out: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1] is None:
            return out, at + 1  # at ">", or at the end of the page
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")


def _says(names: str, words: set[str]) -> bool:
    """Is one of the blank-separated names made of these words and plain ones alone?"""
    for name in names.split():
        found = [w.lower() for w in WORD.findall(name)]
        if any(w in words for w in found) and all(w in words or w in PLAIN or w.isdigit() for w in found):
            return True
    return False


def _is_chrome(tag: str, attributes: dict[str, str], body: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag in CHROME_TAGS or tag == "header" and not body:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", ""):
        return True
    names = " ".join([attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", "")])
    if body and tag in INLINE:
        return _says(names, AD_WORDS)
    return _says(names, CHROME_WORDS) or not body and _says(names, HEADER_WORDS)


def _after(page: str, m: re.Match) -> int:
    """Where a comment, doctype or other declaration ends."""
    if not m[3]:
        at = page.find(">", m.end())
        return at + 1 if at >= 0 else len(page)
    for short in (">", "->"):
        if page.startswith(short, m.end()):
            return m.end() + len(short)
    end = COMMENT_END.search(page, m.end())
    return end.end() if end else len(page)


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the page's blocks in order; blocks are not empty. Linear in the page's length.

    Broken markup: a tag that ends with the page is dropped, a raw element that never closes takes
    the rest of the page, and an article or main element that opens ends chrome left open before it
    unless that is still closed later on.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    chrome: list[list] = []  # [tag, depth] of open chrome elements
    last: dict[str, int] | None = None  # where each element is closed last
    body = 0
    at, end = 0, len(page)
    any_body = False

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, CHROME if chrome else BODY if body else OPEN))

    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        if m[2] is None:
            at = _after(page, m)
            continue
        tag, closing = m[2].lower(), bool(m[1])
        attributes, at = _attributes(page, m.end())
        if at > end:
            break
        if tag in RAW and not closing:
            if page[at - 2] == "/":
                continue
            pattern = r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)"
            close = re.compile(pattern, re.I).search(page, at)
            flush() if tag in BREAKS else held.append(" ")
            at = close.end() if close else end
            continue
        if tag in BREAKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if closing:
            if chrome and chrome[-1][0] == tag:
                chrome[-1][1] -= 1
                if not chrome[-1][1]:
                    flush()
                    chrome.pop()
            elif tag in ("article", "main") and body:
                body -= 1
                chrome.clear()
            continue
        if chrome and chrome[-1][0] == tag:
            chrome[-1][1] += 1
            continue
        if _is_chrome(tag, attributes, bool(body)):
            flush()
            chrome.append([tag, 1])
        elif tag in ("article", "main"):
            if chrome:
                if last is None:
                    last = {c[1].lower(): c.start() for c in CLOSING.finditer(page)}
                if last.get(chrome[-1][0], -1) < at:
                    chrome.clear()
            if not chrome:
                body += 1
                any_body = True
    flush()
    if any_body:
        return out
    return [(t, OPEN if k == BODY else k) for t, k in out]


# ---- words of blocks and runs of words


class Words:
    """The words of several pages' blocks, as hashes, without chrome: page, kind and block of each."""

    def __init__(self, pages: list[list[tuple[str, int]]], hasher: WordHasher):
        self.pages = pages
        blocks = [(p, b, kind, text) for p, page in enumerate(pages) for b, (text, kind) in enumerate(page) if kind != CHROME]
        self.block = [(p, b) for p, b, _, _ in blocks]
        hashes, count = hasher.of([t for *_, t in blocks])
        self.hashes = (hashes >> np.uint64(64 - 8 * WIDTH)).astype(np.int64)
        self.bounds = np.r_[0, np.cumsum(count)].astype(int)
        self.page = np.repeat(np.array([p for p, *_ in blocks], np.int64), count)
        self.kind = np.repeat(np.array([k for _, _, k, _ in blocks], np.int64), count)

    def of_page(self) -> np.ndarray:
        """Where each page's words begin, and the end of all."""
        return np.searchsorted(self.page, np.arange(len(self.pages) + 1))


def run_keys(x: np.ndarray, stretch: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of every ``RUN`` words in one stretch: a page's open or body words in a row."""
    n = len(x) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = kind[:n].astype(np.uint64) + np.uint64(1)
    for k in range(RUN):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[k : k + n].astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    start = np.flatnonzero(stretch[:n] == stretch[RUN - 1 :])
    return start, key[start].view(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Word hashes in WIDTH bytes each."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :WIDTH].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 4), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view("<u4").ravel().astype(np.int64)


def lengths(kind: np.ndarray) -> bytes:
    """How long each row of equal kinds is, with the kind in the lowest bit: 1 for body."""
    ends = np.flatnonzero(np.r_[kind[1:] != kind[:-1], True])
    return (np.diff(np.r_[-1, ends]) * 2 + (kind[ends] == BODY)).astype("<u4").tobytes()


def kinds_of(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, "<u4").astype(np.int64)
    return np.repeat(np.where(x & 1, BODY, OPEN), x >> 1)


def stretches(page: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A number for each page's open or body words in a row."""
    return np.cumsum(np.r_[False, (page[1:] != page[:-1]) | (kind[1:] != kind[:-1])]) if len(page) else np.zeros(0, np.int64)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``x`` in order, by doubling; each round sorts only those still tied."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    head = np.r_[True, x[order][1:] != x[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1] if n else 0
    tied = np.flatnonzero(~head | np.r_[~head[1:], False]) if n else np.zeros(0, np.int64)
    step = 1
    while len(tied):
        i = order[tied]
        first = rank[i]
        then = np.where(i + step < n, rank[np.minimum(i + step, n - 1)] + 1, 0)
        by = np.argsort(first * (n + 2) + then, kind="stable")
        i, first, then = i[by], first[by], then[by]
        order[tied] = i
        head = np.r_[True, (first[1:] != first[:-1]) | (then[1:] != then[:-1])]
        rank[i] = tied[np.flatnonzero(head)[np.cumsum(head) - 1]]
        tied = tied[~head | np.r_[~head[1:], False]]
        step *= 2
    return order


def shared_starts(x: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, group): the starts of repeated runs of RUN words or more inside a stretch; equal runs have one group.

    A group is a maximal range of the suffix array whose neighbours have RUN words in common.
    """
    ends = np.flatnonzero(np.r_[stretch[1:] != stretch[:-1], True]) if len(x) else np.zeros(0, np.int64)
    # After each stretch comes a mark like no other, which ends its suffixes there.
    y = np.insert(x, ends + 1, -1 - np.arange(len(ends)))
    place = np.insert(np.arange(len(x)), ends + 1, -1)
    order = suffix_array(y)
    common = np.ones(max(len(order) - 1, 0), bool)
    for k in range(RUN):
        a, b = order[:-1] + k, order[1:] + k
        common &= (a < len(y)) & (b < len(y))
        common &= y[np.minimum(a, len(y) - 1)] == y[np.minimum(b, len(y) - 1)]
    member = np.r_[common, False] | np.r_[False, common] if len(order) else common
    group = np.cumsum(np.r_[True, ~common]) if len(order) else common
    return place[order[member]], group[member]


def shard_runs(x: np.ndarray, page: np.ndarray, kind: np.ndarray, alone: bool) -> tuple[np.ndarray, int]:
    """(keys, articles): the runs that may be boilerplate, and how many articles the shard has.

    Every page here is another article. With ``alone`` the shard is its whole host, and what is
    returned is boilerplate; else it is what has the share that some shard must see.
    """
    articles = len(np.unique(page))
    start, group = shared_starts(x, stretches(page, kind))
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, articles
    both = np.unique(group.astype(np.int64) * (page.max() + 1) + page[start], return_index=True)[1]
    value, first, count = np.unique(group[both], return_index=True, return_counts=True)
    at = start[both][first]
    body = kind[at] == BODY
    least = np.ceil(np.where(body, BODY_SHARE, OPEN_SHARE) * articles - 1e-9)
    if alone:
        least = np.maximum(least, np.where(body, BODY_LEAST, OPEN_LEAST))
    at = at[count >= least]
    if not len(at):
        return none, articles
    starts, keys = run_keys(x, stretches(page, kind), kind)
    return keys[np.searchsorted(starts, at)], articles


def held(x: np.ndarray, page: np.ndarray, kind: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, body, pages): how many pages hold each of the wanted runs, if any does."""
    start, key = run_keys(x, stretches(page, kind), kind)
    hit = np.isin(key, wanted)
    start, key = start[hit], key[hit]
    order = np.lexsort((page[start], key))
    start, key = start[order], key[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (page[start][1:] != page[start][:-1])][: len(key)]
    value, first, count = np.unique(key[fresh], return_index=True, return_counts=True)
    return value, kind[start[fresh][first]] == BODY, count.astype(np.int64)


def boilerplate(hit: np.ndarray) -> np.ndarray:
    """Of a block's covered words those to cut: all if the whole block is covered, else stretches of RUN words or more.

    A run may begin in the block before, so a block's first words can be covered by chance.
    """
    if hit.all():
        return hit
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    out = np.zeros_like(hit)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= RUN
    return out


def cut(page: list[tuple[str, int]], hasher: WordHasher, runs: np.ndarray) -> str:
    """The page's text without chrome and without what the host's runs cover."""
    if not len(runs):
        return "\n".join([t for t, k in page if k != CHROME])
    w = Words([page], hasher)
    start, key = run_keys(w.hashes, stretches(w.page, w.kind), w.kind)
    start = start[np.isin(key, runs)]
    mark = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + RUN, -1)
    covered = np.cumsum(mark)[:-1] > 0
    kept = []
    for (_, b), lo, hi in zip(w.block, w.bounds, w.bounds[1:]):
        hit = covered[lo:hi]
        text = page[b][0]
        if hit.any():
            text = " ".join([x for x, gone in zip(text.split(" "), boilerplate(hit)) if not gone])
        if text:
            kept.append(text)
    return "\n".join(kept)


# ---- on Spark

TOKENS = "host string, shard long, alone boolean, page_id long, article long, words binary, kinds binary"
SHARDS = "host string, alone boolean, articles long, runs array<long>, words binary, sizes array<long>, kinds binary"
LONGS = pa.list_(pa.int64())


def article_ids(w: Words) -> np.ndarray:
    """One number a page: a hash of its body words, of its open ones if it has none; 0 for no words."""
    out = np.zeros(len(w.pages), np.int64)
    bounds = w.of_page()
    for p in range(len(w.pages)):
        x, kind = w.hashes[bounds[p] : bounds[p + 1]], w.kind[bounds[p] : bounds[p + 1]]
        if len(x):
            own = x[kind == BODY] if (kind == BODY).any() else x
            out[p] = xxhash.xxh64_intdigest(own.astype(np.uint32).tobytes()) >> 1 | 1
    return out


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, host, shards, html): the words of each article's first page in this task."""
    hasher, seen = WordHasher(), set()
    for batch in batches:
        w = Words([blocks_of(h or "") for h in batch.column(3).to_pylist()], hasher)
        hosts, shards, ids = (batch.column(k).to_pylist() for k in (1, 2, 0))
        bounds, article = w.of_page(), article_ids(w)
        rows = []
        for p, host in enumerate(hosts):
            if article[p] and (host, int(article[p])) not in seen:
                seen.add((host, int(article[p])))
                z = slice(bounds[p], bounds[p + 1])
                rows.append((host, int(article[p]) % shards[p], shards[p] == 1, ids[p], int(article[p]), packed(w.hashes[z]), lengths(w.kind[z])))
        if rows:
            types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split(" ")[0] for c in TOKENS.split(", ")])


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (host, shard, article): one row a shard with its runs, and with its words if its host has others."""
    key, rows = None, []

    def out() -> pa.RecordBatch:
        words, kinds, sizes = b"".join([r[0] for r in rows]), b"".join([r[1] for r in rows]), [len(r[0]) // WIDTH for r in rows]
        x, kind, page = unpacked(words), kinds_of(kinds), np.repeat(np.arange(len(rows)), sizes)
        host, _, alone = key
        keys, articles = shard_runs(x, page, kind, alone)
        words, sizes, kinds = (None, None, None) if alone else (words, sizes, kinds)
        columns = [pa.array([host], pa.string()), pa.array([alone]), pa.array([articles], pa.int64()), pa.array([keys.tolist()], LONGS), pa.array([words], pa.binary()), pa.array([sizes], LONGS), pa.array([kinds], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SHARDS.split(", ")])

    last = None
    for batch in batches:
        for host, shard, alone, _, article, words, kinds in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, shard, alone) != key:
                if rows:
                    yield out()
                key, rows, last = (host, shard, alone), [], None
            if article != last:  # another task's page of the same article
                rows.append((words, kinds))
            last = article
    if rows:
        yield out()


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, words, sizes, kinds, wanted) of each shard: (host, run, body, n)."""
    for batch in batches:
        for host, words, sizes, kinds, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            key, body, n = held(unpacked(words), np.repeat(np.arange(len(sizes)), sizes), kinds_of(kinds), np.array(wanted, np.int64))
            yield pa.record_batch({"host": pa.array([host] * len(key), pa.string()), "run": pa.array(key), "body": pa.array(body), "n": pa.array(n)})


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, runs): the text of each page."""
    hasher = WordHasher()
    for batch in batches:
        runs = [np.array(r or [], np.int64) for r in batch.column(3).to_pylist()]
        texts = [cut(blocks_of(h or ""), hasher, r) for h, r in zip(batch.column(2).to_pylist(), runs)]
        yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def host_of(url: Column) -> Column:
    """The lower-cased host without user and port; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _by_host(rows: DataFrame, runs: DataFrame, salt: Column) -> DataFrame:
    """``rows`` with their host's ``runs`` (null for none): sent to every task, or if they are many joined with each host dealt over SALTS tasks."""
    if (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= SENT_RUNS:
        return rows.join(F.broadcast(runs), "host", "left")
    spread = runs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, ["host", "_salt"], "left").drop("_salt")


def host_runs(rows: DataFrame) -> DataFrame:
    """(host, runs) of all boilerplate in rows (page_id, url, host, html)."""
    spark = rows.sparkSession
    sizes = rows.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / SHARD_BYTES)).alias("shards"))
    large = stash(sizes.where("shards > 1"), "large-hosts")
    # Few hosts have several shards; their list is sent to every task unless it is long.
    listed = F.broadcast(large) if large.count() <= SENT_HOSTS else large
    dealt = rows.join(listed, "host", "left").select("page_id", "host", F.coalesce("shards", F.lit(1)).alias("shards"), "html")
    tokens = dealt.mapInArrow(_tokenised, TOKENS)
    placed = tokens.repartition(parts_wanted(spark), "host", "shard").sortWithinPartitions("host", "shard", "article", "page_id")
    shards = stash(placed.mapInArrow(_sharded, SHARDS), "host-shards")
    found = shards.where("alone").select("host", F.explode("runs").alias("run"))

    several = shards.where("not alone")
    wanted = several.select("host", F.explode("runs").alias("run")).distinct().groupBy("host").agg(F.collect_list("run").alias("runs"))
    asked = _by_host(several.select("host", "words", "sizes", "kinds"), stash(wanted, "candidate-runs"), F.xxhash64("words")).where("runs is not null")
    counts = asked.mapInArrow(_recounted, "host string, run long, body boolean, n long").groupBy("host", "run", "body").agg(F.sum("n").alias("n"))
    articles = several.groupBy("host").agg(F.sum("articles").alias("articles"))
    least = lambda share, n: F.greatest(F.lit(n), F.ceil(F.col("articles") * share - 1e-9))
    common = counts.join(articles, "host").where(F.col("n") >= F.when(F.col("body"), least(BODY_SHARE, BODY_LEAST)).otherwise(least(OPEN_SHARE, OPEN_LEAST)))
    return stash(found.unionByName(common.select("host", "run")).groupBy("host").agg(F.collect_list("run").alias("runs")), "host-runs")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    * Null or empty html: empty text. Pages without a url share the empty host.
    * Every page has the text of its article and main elements, without chrome inside them, and of
      what stands outside of them that is not chrome, in page order; of both, without the runs that
      are boilerplate of its host.
    * Repeated rows are pages of their own, but one article of their host. Of pages with the same
      article, one speaks for the open text around it.
    * Empty table: empty result. Other columns are not carried.

    Pages are parsed where they are read, twice, and only hashes of their words are shuffled. A
    host's articles are dealt over shards by a hash, as many as keep a shard at about 256 pages and
    16 MB, so a host of any size is spread and a shard fits in a task.
    """
    small_batches(pages.sparkSession, 200)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    ready = _by_host(rows, host_runs(rows), F.xxhash64("page_id", "url")).select("page_id", "url", "html", "runs")
    return ready.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract_text(pages)
