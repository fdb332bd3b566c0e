"""Operators on small tables, against brute force; nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import html
import inspect
import json
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, common, fingerprint, html_text, jaccard_join, line_dedup, lm_score, packing, token_files, topk, toxicity
from tickloom.llm.common import range_cuts, range_part
from tickloom.llm.components import components

DOCS = "doc_id long, text string"
LONG = "this very line is long enough to be counted as a key {}"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def texts(n=40, seed=1):
    """Prose of few words, with copies, near copies, shared lines and passages."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    out = [prose(rnd.randint(1, 80)) for _ in range(n)]
    base = prose(100).split(" ")
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append(" ".join(w))
    out += [out[0], out[1].upper(), LONG.format(1) + "\n" + prose(5), ""]
    out += [prose(10) + "\n  " + LONG.format(7).upper() + "\t\n" + prose(3) for _ in range(6)]
    return out


def tables(spark):
    """A mixed table, and it with odd rows."""
    plain = list(enumerate(texts()))
    odd = [(1000, None), (1001, ""), (1002, " \n\t "), (None, "no id " + LONG.format(7)), (1003, "word " * 5000), (1003, "word " * 5000), (1004, "\x1c\x85 ﬁ İ Σ 漢字 👍🏽 <|endoftext|>")]
    return plain, plain + odd


# ---- shared


def test_range_parts(spark):
    df = frame(spark, [(i, "") for i in range(100)] + [(None, "")])
    cuts = range_cuts(df, "doc_id", 7)
    got = {r.doc_id: r.p for r in df.select("doc_id", range_part("doc_id", cuts).alias("p")).collect()}
    assert len(cuts) == 6 and got == {i: sum(c < i for c in cuts) if i is not None else 0 for i in got}
    assert range_cuts(df.limit(0), "doc_id", 7) == []


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rnd.randrange(100, 150), rnd.randrange(100, 150)) for _ in range(30)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(frame(spark, links, "u long, v long")).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}
    assert components(frame(spark, [], "u long, v long")).count() == 0


def test_components_of_stars(spark):
    """Hubs hold most edges; they are split off from the join, and the result is the same."""
    links = [(0, i) for i in range(1, 400)] + [(1000, 1000 + i) for i in range(1, 200)] + [(1100, 2000), (2000, 2001), (7, 3000)]
    want = {i: 0 for i in [*range(400), 3000]} | {1000 + i: 1000 for i in range(200)} | {2000: 1000, 2001: 1000}
    assert {r.node: r.root for r in components(frame(spark, links, "u long, v long")).collect()} == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_join_like_others(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HEAVY_LEAST", 5)
    rows = [(k, i) for k, n in ((1, 50), (2, 3), (3, 20), (4, 1), (None, 9)) for i in range(n)]
    left, side = frame(spark, rows, "k long, i long"), frame(spark, [(1, 10), (2, 20), (5, 50)], "k long, v long")
    got = sorted((tuple(r) for r in common.join_heavy(left, side, "k", how).select("k", "i", "v").collect()), key=repr)
    v = {1: 10, 2: 20}
    assert got == sorted(((k, i, v.get(k)) for k, i in rows if how == "left" or k in v), key=repr)


def test_a_cluster_session_without_a_shared_folder_is_an_error():
    conf = type("C", (), {"get": lambda *_: None})()
    sc = type("S", (), {"getConf": lambda _: conf, "getCheckpointDir": lambda _: None, "master": "spark://host:7077"})()
    with pytest.raises(ValueError):
        common.shared_dir(type("Spark", (), {"sparkContext": sc})())


# ---- 1


def lines_by_hand(rows, least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders.get(key(x), ())) < least or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    for rows in tables(spark):
        rows = rows + [(2000 + k, "x\n" + LONG.format(k % 2) + "\n\n" + LONG.format(k % 2)) for k in range(12)]
        assert sorted((tuple(r) for r in line_dedup.op1(spark, frame(spark, rows)).collect()), key=repr) == lines_by_hand(rows)
    assert line_dedup.op1(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (5, 3)])
def test_line_runs_of_any_number(spark, batches, fan_in):
    rows = [(k, LONG.format(k % 3)) for k in range(20)]
    df = frame(spark, rows).withColumns({"kept": F.lit("x"), "keeper": F.lit(1), "_pos": F.lit(2)})
    got = line_dedup.dedup_lines(df, batches=batches, fan_in=fan_in)
    assert got.columns == ["doc_id", "text", "keeper", "_pos", "kept", "n_lines", "n_dropped"]
    assert sorted(r.doc_id for r in got.where("n_dropped = 0").collect()) == [17, 18, 19]


def test_a_known_hash_keeps_its_first_keeper(spark):
    """The anti-join decides: a later batch's keeper counts for new hashes only, through merges too."""
    runs = line_dedup.LineRuns(spark, fan_in=2)
    batch = lambda *rows: frame(spark, rows, "_h1 long, _h2 long, n_docs long, keeper long").repartition(runs.buckets, "_h1", "_h2")
    runs.add(batch((1, 1, 3, 50), (2, 2, 1, 51)))
    assert {(r._h1, r.keeper) for r in runs.entering(batch((1, 1, 2, 40), (3, 3, 1, 41))).collect()} == {(1, None), (3, 41)}
    runs.add(batch((1, 1, 2, 40), (3, 3, 1, 41)))
    runs.add(batch((1, 1, 1, 30), (3, 3, 5, 31), (4, 4, 1, 32)))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert sorted(tuple(r) for r in runs.merged().collect()) == [(1, 1, 6, 50), (2, 2, 1, 51), (3, 3, 6, 41), (4, 4, 1, 32)]
    runs.drop()


def test_line_dedup_needs_its_anti_join_and_leaves_no_run(spark, monkeypatch):
    rows = [(k, LONG.format(k % 3)) for k in range(40)]
    assert sorted((tuple(r) for r in line_dedup.op1(spark, frame(spark, rows)).collect()), key=repr) == lines_by_hand(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]
    monkeypatch.setattr(line_dedup.LineRuns, "entering", lambda self, batch: batch)
    assert sorted((tuple(r) for r in line_dedup.op1(spark, frame(spark, rows)).collect()), key=repr) != lines_by_hand(rows)


# ---- 2


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=20)]) for i in range(230)]
    rows += [(300, rows[7][1]), (350, rows[7][1]), (400, None), (450, [1.0, None] * 10), (500, [math.nan] * 20), (550, [1.0, 2.0]), (551, [3.0, 2.0]), (None, rows[3][1]), (600, [])]
    df = frame(spark, rows, "vec_id long, embedding array<float>")
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    want = []
    for q, x in fine:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in fine if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = sorted(tuple(r) for r in topk.op2(spark, df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)
    assert topk.op2(spark, df.limit(0)).count() == 0
    wide = df.withColumns({"id": F.lit(1), "v": F.lit(2), "rank": F.lit(3), "score": F.lit(4)})
    assert sorted(tuple(r) for r in topk.op2(spark, wide).collect()) == got


def test_partial_sums_of_long_vectors_and_several_query_blocks(spark, monkeypatch):
    """Three partial sums, and queries in more than one block: one table of results."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=300) * 0.9 ** np.arange(300)]) for i in range(300)]
    ints = np.floor(256 * np.array([np.array(v, np.float32).astype(float) for _, v in rows])).astype(int)
    want = []
    for q in range(0, 300, 50):
        scores = ints @ ints[q]
        want += [(q, k + 1, i, int(scores[i])) for k, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:5])]
    assert sorted(tuple(r) for r in topk.op2(spark, frame(spark, rows, "vec_id long, embedding array<float>")).collect()) == want


# ---- 3

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><header>Site</header><div class='ad'>buy <div>now</div></div>{}<footer>f &copy;</footer></body></html>"


def page_text(page):
    """A page's text by its marks alone."""
    return html_text.cut(html_text.blocks_of(page), html_text.WordHasher(), np.zeros(0, np.int64))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four</b><script>var x='</p>';</script></article>", "A & B\none two\nthree four"),
        ("<main><p>x</p><form><input>send</form><aside>s</aside><section id=comments><p>nice</p></section><p>y</main>", "x\ny"),
        ("<div class=cookie>never closed<article><p>real</p></article>", "real"),
        ("<article><p class=it's>Hello</p><p title=don't>Hello it's fine</p><p a='b>c' \"d>e</p></article>", "Hello\nHello it's fine\ne"),
        ("<article><p>a<!--> b <!-- c --!> d <!-- <p>x</p> --></p><?php 1 ?><!doctype x></article>", "a b d"),
        ("<article><p id='social-policy'>kept</p><section class='related-work'>too <span class='alert'>and this</span></section><div class='siteAd'>no</div><div class='ad-slot-3'>no</div></article>", "kept\ntoo and this"),
        ("<article><p>cut <!-- c", "cut"),
        ("<article><p>cut <b", "cut"),
        ("<article><p>cut <b title='x></b>y</p>", "cut"),
        ("a < b <3 c</ x>d", "a < b <3 cd"),
        ("", ""),
    ],
)
def test_page(page, want):
    assert page_text(PAGE.format(page) if "cut" not in page and "<3" not in page else page) == want


def test_hostile_pages_take_linear_time():
    for unit in ('<a "x', "<a b='x", "<p x=\"y", "<article><div class=ad>", "<!--", "<script>", "< / ", "<a b   ", "</"):
        page = unit * (1_000_000 // len(unit))
        start = time.perf_counter()
        html_text.blocks_of(page)
        assert time.perf_counter() - start < 5, unit


def pages_frame(spark, rows):
    return frame(spark, rows, "page_id long, url string, html string")


def test_shared_runs_go_and_unique_ones_stay(spark):
    menu = "<p>Home News Sport Weather Travel Culture Money Health Science</p>"
    rows = [(k, f"https://u@Host.example:80/{k}", f"{menu}<p>only page {k} has this text of its own, number {k * k}</p>") for k in range(5)]
    rows += [(9, "https://other.example/", menu), (10, None, None), (11, "x", "<p>text</p>"), (11, "x", "<p>text</p>")]
    df = pages_frame(spark, rows).withColumns({"host": F.lit("clash"), "shard": F.lit(1), "runs": F.lit(2), "text": F.lit("x")})
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.op3(spark, df).collect())
    want = [f"only page {k} has this text of its own, number {k * k}" for k in range(5)] + ["Home News Sport Weather Travel Culture Money Health Science", "", "text", "text"]
    assert got == [(i, t, len(t)) for (i, _, _), t in zip(rows, want)]
    assert html_text.op3(spark, pages_frame(spark, [])).count() == 0


def test_text_outside_of_an_article_is_judged_by_its_repeats(spark):
    """A small article does not take the rest of its page along: unique text stays in its place, shared runs go."""
    menu = "<p>Home News Sport Weather Travel Culture Money Health Science</p>"
    rows = [(k, "http://h/", f"{menu}<h1>headline {k}</h1><article><p>teaser {k}</p></article><div>the long story number {k} of this page</div>") for k in range(4)]
    got = {r.page_id: r.text for r in html_text.op3(spark, pages_frame(spark, rows)).collect()}
    assert got == {k: f"headline {k}\nteaser {k}\nthe long story number {k} of this page" for k in range(4)}


def texts_by_hand(rows):
    """Counts of all RUN words in a row, article by article, with dictionaries."""
    parsed = [(i, (u or '').split('//')[-1].split('/')[0], html_text.blocks_of(h or "")) for i, u, h in rows]
    holders, articles = {}, {}
    seen = set()

    def runs(page):
        streams = []
        for b, (text, kind) in enumerate(page):
            if kind != html_text.CHROME:
                if not streams or streams[-1][0] != kind:
                    streams.append((kind, []))
                streams[-1][1].extend((w.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)), b, k) for k, w in enumerate(text.split(" ")))
        for kind, words in streams:
            for a in range(len(words) - html_text.RUN + 1):
                yield kind, words[a : a + html_text.RUN]

    for i, host, page in parsed:
        own = [t.lower() for t, k in page if k == html_text.BODY] or [t.lower() for t, k in page if k == html_text.OPEN]
        article = " ".join(own)
        if own and (host, article) not in seen:
            seen.add((host, article))
            articles[host] = articles.get(host, 0) + 1
            for key in {(host, kind, *(w for w, _, _ in run)) for kind, run in runs(page)}:
                holders[key] = holders.get(key, 0) + 1
    out = {}
    for i, host, page in parsed:
        hit = {b: np.zeros(len(t.split(" ")), bool) for b, (t, _) in enumerate(page)}
        for kind, run in runs(page):
            share, least = (html_text.BODY_SHARE, html_text.BODY_LEAST) if kind == html_text.BODY else (html_text.OPEN_SHARE, html_text.OPEN_LEAST)
            n = holders[(host, kind, *(w for w, _, _ in run))]
            if n >= least and n >= share * articles[host] - 1e-9:
                for _, b, k in run:
                    hit[b][k] = True
        kept = []
        for b, (text, kind) in enumerate(page):
            left = " ".join([w for w, gone in zip(text.split(" "), html_text.boilerplate(hit[b])) if not gone])
            if kind != html_text.CHROME and left:
                kept.append(left)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("shard_pages, sent", [(256, 4_000_000), (5, 4_000_000), (5, 0)])
def test_boilerplate_of_a_host_against_plain_counts(spark, monkeypatch, shard_pages, sent):
    """Runs in articles and outside of them, copies of an article, passages of some: the same however pages are dealt.

    Without the suffix stage, every page with the plea inside its article would keep it.
    """
    monkeypatch.setattr(html_text, "SHARD_PAGES", shard_pages)
    monkeypatch.setattr(html_text, "SENT_RUNS", sent)
    rnd = random.Random(7)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    plea, passage, menu = "Please support our work with a small gift this month", prose(14), "one two three four five six seven eight nine"
    rows = []
    for k in range(40):
        shared = f"<p>{prose(4)} {passage} {prose(4)}</p>" if k % 3 == 0 else ""
        around = f"<div>{menu if k % 6 == 0 else prose(9)}</div>"
        rows.append((k, "http://big.example/x", f"{around}<article><h1>{prose(3)}</h1><p>{prose(30)}</p>{shared}<p>{plea}</p><p>{prose(5)}</p></article>"))
    copy = f"<article><p>{prose(40)}</p></article>"
    rows += [(100 + k, "http://copies.example/", copy) for k in range(12)] + [(200 + k, "http://small.example/", f"<article><p>{plea} {prose(5)}</p></article>") for k in range(5)]
    got = {r.page_id: r.text for r in html_text.op3(spark, pages_frame(spark, rows).repartition(3)).collect()}
    assert got == texts_by_hand(rows)
    plain = {i: page_text(h) for i, _, h in rows}
    assert all(plea in plain[k] and plea not in got[k] for k in range(40)) and all(passage in got[k] for k in range(0, 40, 3))
    assert all(got[k] == plain[k] for k in got if k >= 100) and not any(menu in got[k] for k in range(40))


def test_suffix_array():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 200):
        x = rnd.integers(0, 3, n)
        assert html_text.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
    x = np.tile(rnd.integers(0, 50, 40), 6)
    assert html_text.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_entities():
    assert html_text.blocks_of("<p>&#233;&lt;b&gt; &am</p>") == [(html.unescape("&#233;&lt;b&gt; &am"), html_text.OPEN)]


# ---- 4, 5


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("tokenizers")
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def test_bpe_equals_the_library(vocabulary, library):
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéñß'.,!0123 \nΣİ日ก́<|"
    cases = ["", " ", "aaaaaaaaaa", "I'LL don't 'S's", "x" * 3000, "ab" * 1000, "<|endoftext|><|startoftext|>a<|ENDOFTEXT|>", "\x1c z\x85w  ​", "½ Ⅷ ﬁ é"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    model, cache = bpe.coder(vocabulary)
    lib = token_files.Library(vocabulary)
    for t in cases:
        want = library.encode(t, add_special_tokens=False).ids
        (raw,) = cache.ids([t])
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == want == lib.encode([t])[0].tolist()
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_a_file_with_other_settings_is_an_error(tmp_path, vocabulary):
    spec = json.load(open(vocabulary))
    spec["normalizer"] = {"type": "NFKC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    for made in (bpe.WordBpe, token_files.Library):
        with pytest.raises(ValueError):
            made(str(path))


def test_unsafe_merges_go_one_at_a_time(tmp_path, vocabulary):
    """A later pair may make a token that an earlier rank merges; both libraries must then agree."""
    from tokenizers import Tokenizer

    spec = json.load(open(vocabulary))
    vocab = {c: i for i, c in enumerate([*bpe.byte_letters(), *[c + "</w>" for c in bpe.byte_letters()]])}
    merges = [["c", "ab"], ["b", "c"], ["a", "b"], ["ab", "bc"], ["a", "a"], ["aa", "a</w>"]]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec["model"] |= {"vocab": vocab, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    lib, own = Tokenizer.from_file(str(path)), bpe.WordBpe(str(path))
    rnd = random.Random(8)
    for _ in range(500):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        assert np.frombuffer(own.encode_chunks([t.encode()])[0], "<u4").tolist() == lib.encode(t).ids


def test_encode_decode(spark, vocabulary, library):
    _, rows = tables(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.decoded, bytes(r.ids)) for r in bpe.encode_decode(frame(spark, rows), vocabulary).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), library.decode(ids, skip_special_tokens=False), np.array(ids, "<u4").tobytes()))
    assert got == sorted(want)
    assert bpe.op5(spark, frame(spark, []), vocabulary).count() == 0


def test_token_files(spark, vocabulary, library, tmp_path):
    _, rows = tables(spark)
    df = frame(spark, rows)
    got = [tuple(r) for r in token_files.op4(spark, df, vocabulary).orderBy("start").collect()]
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    parts = token_files.write_token_files(df, f"file://{tmp_path}/set", vocabulary, 2, length=16, rows=4)
    stream = []
    for part, _ in parts:
        f = token_files.TokenFile(f"file://{tmp_path}/set", part)
        n = sum(f.seq.get_batch(k).num_rows for k in range(f.seq.num_record_batches))
        for k in range(n):
            ids, mask = f.sequence(k)
            assert len(ids) == len(mask) == 16 and (k == n - 1 or mask.all())
            stream += ids[mask].tolist()
    assert len(stream) == at and stream.count(2) >= len(rows)
    assert token_files.op4(spark, df.limit(0), vocabulary).count() == 0


def test_sequences_are_views(tmp_path, vocabulary, spark):
    token_files.write_token_files(frame(spark, [(1, "hello world " * 500)]), f"file://{tmp_path}/v", vocabulary, 2, length=16, rows=4)
    before = pa.total_allocated_bytes()
    f = token_files.TokenFile(f"file://{tmp_path}/v", 0)
    held = [f.sequence(k)[0] for k in range(40)]
    assert pa.total_allocated_bytes() - before < 4096 and not held[0].flags.owndata


# ---- 6


def toxic_table(n=400):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[rnd.randrange(40)] = "zonk" + "".join(rnd.choice("abcdefgh") for _ in range(3))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_table()
    odd = [(5000, None), (5001, ""), (None, rows[0][1]), rows[1], rows[1]]
    lab = frame(spark, labels + [(5002, 1, None), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.op6(spark, frame(spark, rows + odd), lab).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) and any(truth[r.doc_id] for r in held)


def test_toxicity_without_labels_or_documents(spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert toxicity.op6(spark, frame(spark, [(1, "a text")]), none).first()["score"] == 0.5
    assert toxicity.op6(spark, frame(spark, []), none).count() == 0
    model = toxicity.Model(np.full(1 << toxicity.BITS, -1, np.int16), np.zeros(0), 0.0)
    assert toxicity.score(frame(spark, [(1, "x", 9.0)], DOCS + ", score double"), model).columns == ["doc_id", "text", "score"]


def test_log_count_ratios_against_plain_counts(spark):
    """The counts and the kept n-grams' ratios, from sets of n-grams made one by one."""
    rows, labels = toxic_table(120)
    truth = {i: t for i, _, t in labels}
    plain = {0: Counter(), 1: Counter()}
    for i, t in rows:
        plain[truth[i]].update({t[a : a + n] for n in toxicity.ORDERS for a in range(len(t) - n + 1)})
    batch = pa.record_batch({"toxic": pa.array([truth[i] for i, _ in rows], pa.int32()), "text": pa.array([t for _, t in rows])})
    got = {h: (a, b) for out in toxicity._counts(iter([batch])) for h, a, b in zip(*(c.to_pylist() for c in out.columns))}
    code = lambda g: int([h for _, h in toxicity.grams([g])][-1][0])
    met = {}
    for g in set(plain[0]) | set(plain[1]):
        met.setdefault(code(g), []).append(g)
    alone = {h: g[0] for h, g in met.items() if len(g) == 1}
    assert len(alone) > 0.9 * len(met) and set(got) == set(met)
    assert all(got[h] == (plain[0][g], plain[1][g]) for h, g in alone.items())
    n1 = sum(truth.values())
    n0 = len(truth) - n1
    model = toxicity.fit(frame(spark, [(truth[i], t) for i, t in rows], "toxic int, text string"), keep=300)
    kept = [h for h in alone if model.slots[h] >= 0]
    ratio = {h: math.log((plain[1][alone[h]] + 1) / (n1 + 2) / ((plain[0][alone[h]] + 1) / (n0 + 2))) for h in alone}
    split = lambda h: abs((plain[1][alone[h]] + 1) / (n1 + 2) - (plain[0][alone[h]] + 1) / (n0 + 2)) * abs(ratio[h])
    left = [h for h in alone if model.slots[h] < 0 and plain[0][alone[h]] + plain[1][alone[h]] >= 2]
    assert kept and min(map(split, kept)) >= max(map(split, left)) - 1e-9
    zonk = code("zonk")
    assert ratio[zonk] > 2 and model.weight[model.slots[zonk]] > 0


# ---- 7


def test_fingerprints(spark):
    _, rows = tables(spark)
    got = fingerprint.op7(spark, frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        want[(i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprint.op7(spark, frame(spark, [])).count() == 0
    assert fingerprint.op7(spark, frame(spark, [(4, "abcdef")])).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_digest_against_plain_counts():
    t = "The quick brown fox, again and again é".encode()
    counts = Counter()
    for at in range(len(t)):
        for kind, (b, c) in enumerate(((1, 2), (1, 3), (2, 3)), 1):
            if at + c < len(t):
                v = (t[at] * 0x9E3779B1 + t[at + b] * 0x85EBCA77 + t[at + c] * 0xC2B2AE3D + kind * 0x27D4EB2F) % 2**32
                v ^= v >> 15
                counts[(v * 0x2C1B3C6D) % 2**32 >> 24] += 1
    assert fingerprint.bucket_counts([b"", b"ab", t])[2].tolist() == [counts[k] for k in range(256)]
    d = fingerprint.digests([t, t, b"", b"something else entirely, with other words in it"])
    assert fingerprint.likeness(d[:1], d[1:2])[0] == 1 and fingerprint.likeness(d[:1], d[3:])[0] < 0.5


# ---- 8


def components_by_hand(rows, size, percent):
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []) for w in words]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(spark, size, percent):
    _, rows = tables(spark)
    got = jaccard_join.jaccard_components(frame(spark, rows), words=size, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == components_by_hand(rows, size, percent)


def test_jaccard_of_a_chain_and_of_nothing(spark):
    """Each text is linked to its neighbours alone, so the component is a chain, found in one round or none."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 2, i * 2 + 60))) for i in range(60)]
    want = components_by_hand(rows, 4, 85)
    assert {c for _, _, c in want} == {0}
    for rounds in (0, 1, 3):
        assert sorted((tuple(r) for r in jaccard_join.jaccard_components(frame(spark, rows), words=4, percent=85, rounds=rounds).collect()), key=repr) == want
    assert jaccard_join.op8(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_heap_merge_against_counts(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 25))) for _ in range(rnd.randint(1, 9))]
        least = rnd.randint(1, len(lists))
        count = Counter(v for x in lists for v in x)
        assert jaccard_join.heap_merge(lists, least) == sorted((v, n) for v, n in count.items() if n >= least)


@pytest.mark.parametrize("heap_most", [0, 10**9])
def test_blocks_join_the_same_by_heap_and_by_array(monkeypatch, heap_most):
    monkeypatch.setattr(jaccard_join, "HEAP_MOST", heap_most)
    test_divide_skip_joins_what_all_pairs_join()


def test_one_component_of_many_texts_and_one_list_of_many(spark):
    """A chain of 1,500 texts, and 800 different texts that all hold the same eight words."""
    chain = [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(1500)]
    rnd = random.Random(12)
    common_words = "all of these hold the very same words"
    loose = [(5000 + i, common_words + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(30))) for i in range(800)]
    got = {r.doc_id: r.component_id for r in jaccard_join.op8(spark, frame(spark, chain + loose)).collect()}
    assert got == {i: 0 if i < 1500 else i for i, _ in chain + loose}


def test_divide_skip_joins_what_all_pairs_join():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = []
    for k in range(60):
        s = base.copy()
        s[rnd.integers(0, 80, k % 12)] = rnd.integers(0, 1 << 60, k % 12)
        sets.append(np.unique(s[: 80 - k % 3]))
    got, want = jaccard_join.Forest(60), jaccard_join.Forest(60)
    jaccard_join.links_in_block(sets, 85, got)
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [got.root(i) for i in range(60)] == [want.root(i) for i in range(60)]


# ---- 9


def bins_by_hand(rows, capacity):
    """Best fit by trying all bins."""
    least = sum(r[1] for r in rows) / capacity
    pieces = [(min(capacity, n - s), i, s, src, c) for i, n, src, c in rows for s in range(0, n, capacity)]
    count = Counter(p[3] for p in pieces if p[3] is not None)
    pieces.sort(key=lambda p: (not (p[3] is not None and 2 * count[p[3]] > least), -p[0], p[1], p[2]))
    bins = []
    for n, i, s, src, c in pieces:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and not (src is not None and src in b["src"]) and not (c is not None and c in b["dup"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "src": set(), "dup": set()})
        bins[k]["room"] -= n
        bins[k]["src"].add(src)
        bins[k]["dup"].add(c)
    return sorted(b["room"] for b in bins)


def test_best_fit():
    rnd = random.Random(9)
    rows = [(i, rnd.randint(1, 150), rnd.choice(["a", "a", "b", "c", None]), rnd.choice([None, 1, 2, *range(10, 90)])) for i in range(120)]
    got = packing.pack_shard(rows, 100)
    room = Counter()
    for _, _, _, n, b, _ in got:
        room[b] += n
    assert sorted(100 - v for v in room.values()) == bins_by_hand(rows, 100)


def test_packing_keeps_its_rules(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 250), rnd.choice(["a", "a", "b", "c", "d", None]), rnd.choice([None, 5, *range(100, 160)])) for i in range(300)]
    rows += [(None, 7, "a", 5), (1, None, "a", 5), rows[2], rows[2]]
    df = frame(spark, rows, "doc_id long, length long, source string, cluster long").withColumns({"shard": F.lit(1), "bin_id": F.lit(2), "n": F.lit(3)})
    got = packing.best_fit_pack(df, capacity=100, shard_rows=64).collect()
    pieces = Counter((i, s) for i, n, *_ in rows for s in range(0, n or 0, 100))
    assert Counter((r.doc_id, r.start) for r in got) == pieces
    assert sum(r.length for r in got) == sum(n or 0 for _, n, *_ in rows)
    info = {i: (src, c) for i, _, src, c in rows}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert all(a.offset + a.length == b.offset for a, b in zip(held, held[1:])) and held[-1].offset + held[-1].length <= 100
        for k in (0, 1):
            marks = [info[r.doc_id][k] for r in held if info[r.doc_id][k] is not None]
            assert len(marks) == len(set(marks))
    assert packing.best_fit_pack(df.limit(0)).count() == 0


def test_lengths(spark):
    got = packing.with_lengths(frame(spark, [(1, "a b\nc", "s"), (2, None, None), (3, "", "s")], DOCS + ", source string")).orderBy("doc_id").collect()
    assert [(r.length, r.source) for r in got] == [(4, "s"), (1, None), (1, "s")] and got[1].cluster == got[2].cluster


# ---- 10


def test_base_scores(spark):
    _, rows = tables(spark)
    got = lm_score.lm_scores(frame(spark, rows)).collect()
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if i is not None and not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
    want = sorted(((i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base(t), 6)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want


def test_counts_that_are_not_sent_are_joined(spark, monkeypatch):
    plain, rows = tables(spark)
    want = {(r.doc_id, r.base_score.__round__(6), r.n_known) for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    monkeypatch.setattr(lm_score, "SENT_SHARE", 1 / 50)
    assert {(r.doc_id, r.base_score.__round__(6), r.n_known) for r in lm_score.lm_scores(frame(spark, rows)).collect()} == want


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    return x ^ (x >> 29)


def plain_features(hashes, near, path, place, level):
    """The hash of each feature of one token at its node, number by number."""
    top = 4 * (lm_score.MOST_LEVELS - 1)
    see = lambda d: 7 if place < d else hashes[place - d] if hashes[place - d] in near else path[place - d] >> top
    node = (path[place] >> 4 * (lm_score.MOST_LEVELS - level)) + (level << 40)
    out = []
    for k, kind in enumerate(lm_score.KINDS):
        h = k + 1
        for d in kind:
            h = plain_mix((h * 0x9E3779B97F4A7C15 + see(d)) % 2**64)
        out.append(plain_mix((h + node * 0xBF58476D1CE4E5B9) % 2**64) >> 24)
    return out


@pytest.mark.parametrize("load", [8, 1e-3])
def test_scores_by_hand(spark, monkeypatch, load):
    """Table and scores token by token with dictionaries: with room for all words, and with few words as features."""
    monkeypatch.setattr(lm_score, "LOAD", load)
    plain, rows = tables(spark)
    df = frame(spark, rows)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    train = [t for i, t in rows if not held(i)]
    counts = lm_score.word_counts(frame(spark, [(0, t) for t in train]))
    model = lm_score.fit(frame(spark, [(0, t) for t in train]), counts)
    monkeypatch.setattr(lm_score, "fit", lambda *_: model)
    near, size = set(model.near.tolist()), len(model.table)
    assert model.levels >= 1 and (len(near) == model.distinct) == (load == 8)
    hasher = lm_score.WordHasher()
    digit = lambda path, level: path >> 4 * (lm_score.MOST_LEVELS - 1 - level) & 15
    met, words, tree = Counter(), Counter(), Counter()
    for text in train:
        t = lm_score.tokens_of([text], hasher)
        h, path = t.hashes.tolist(), t.path.tolist()
        words.update(h)
        for k in range(len(h)):
            for level in range(model.levels):
                tree[level, path[k] >> 4 * (lm_score.MOST_LEVELS - level), digit(path[k], level)] += 1
                for f in plain_features(h, near, path, k, level):
                    met[f % size, digit(path[k], level)] += 1
    code = lambda n: 0 if n == 0 else 1 + round(8 * math.log2(n))
    assert {(r, d): code(n) for (r, d), n in met.items()} == {(r, d): int(model.table[r, d]) for r, d in zip(*(z.tolist() for z in np.nonzero(model.table[:, :16])))}
    leaf = lambda path: path >> 4 * (lm_score.MOST_LEVELS - model.levels)
    paths = {w: int(lm_score.path_of(np.array([w], np.uint64))[0]) for w in words}
    mass, kinds = Counter(), Counter()
    for w, n in words.items():
        mass[leaf(paths[w])] += n
        kinds[leaf(paths[w])] += 1

    def score(text):
        t = lm_score.tokens_of([text], hasher)
        h, path, total, told = t.hashes.tolist(), t.path.tolist(), 0.0, []
        row_total = lambda f: int(model.table[f % size, 16])
        for k in range(len(h)):
            mode = min(sum(told[-4:]), 2)
            level = min(1, model.levels - 1)
            f = plain_features(h, near, path, k, level)[lm_score.TELLING]
            told.append(int(model.table[f % size, digit(path[k], level)] > 0 and row_total(f) <= lm_score.RARE))
            for level in range(model.levels):
                node = path[k] >> 4 * (lm_score.MOST_LEVELS - level)
                seen = [tree[level, node, d] + 0.5 for d in range(16)]
                z = [math.log(n / sum(seen)) for n in seen]
                logit = list(z)
                for kind, f in enumerate(plain_features(h, near, path, k, level)):
                    often = 0 if row_total(f) == 0 else min(7, 1 + (row_total(f) - 1 + 2) // 8)
                    for d in range(16):
                        c = int(model.table[f % size, d])
                        if c:
                            logit[d] += model.weights[level, kind, mode * 8 + often] * ((c - 1) * math.log(2) / 8 - z[d])
                total += logit[digit(path[k], level)] - math.log(sum(math.exp(v) for v in logit))
            total += math.log((words[h[k]] + 0.5) / (mass[leaf(path[k])] + 0.5 * (kinds[leaf(path[k])] + 1)))
        return total / math.log(10)

    got = sorted(((r.doc_id, r.score) for r in lm_score.lm_scores(df).collect()), key=repr)
    want = sorted(((i, score(t)) for i, t in rows), key=repr)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=2e-4, atol=1e-3)


def test_the_model_learns_at_the_production_values(spark):
    """Two kinds of texts with words of their own: a word tells what kind the next is of."""
    rnd = random.Random(1)
    kinds = [[w + e for w in "abcdefghij"] for e in ("xx", "yy", "zz")]
    rows = [(i, " ".join(rnd.choice(kinds[i % 3]) for _ in range(60))) for i in range(300)]
    got = [r for r in lm_score.lm_scores(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.3 * sum(r.n_tokens for r in got)


def test_every_position_is_learnt_from():
    """A round's task meets every token of every text, and its counts hold every feature of each, whatever a cell holds."""
    texts = ["a", "b c", "d e f", None, "a b c d e f g h i j k", "w " * 70_000]
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    t = lm_score.tokens_of(texts, lm_score.WordHasher())
    none = np.zeros(0, np.uint64)
    (row,) = lm_score._train_task(iter([batch]), none, np.zeros((2, 64, 17), np.uint8), lm_score.node_shares(t.path, np.ones(len(t.path)), 2), np.full((2, 4, lm_score.BUCKETS), 0.25), 0.03)
    assert row.column(0).to_pylist() == [len(t.path)] == [2 + 3 + 4 + 1 + 12 + 70_001]
    total = 0
    for out in lm_score._features_counted(iter([batch]), none, 2, 64):
        for width, raw in zip(out.column(2).to_pylist(), out.column(3).to_pylist()):
            total += int(np.frombuffer(lm_score.zstandard.ZstdDecompressor().decompress(raw), f"<u{width}").sum())
    assert total == len(t.path) * 2 * len(lm_score.KINDS)


def test_word_hashes_tell_words_apart():
    """Also those that break polynomials modulo 2^64, and words that differ in one byte of any place."""
    a, flip = "a", str.maketrans("ab", "ba")
    while len(a) < 1024:
        a += a.translate(flip)
    words = [a, a.translate(flip)] + ["x" * k + c + "x" * (n - k - 1) for n in (1, 7, 8, 9, 17, 300) for k in range(n) for c in "yz"] + ["x" * n for n in range(1, 400)]
    h, count = lm_score.WordHasher().of([" ".join(words), None, "A b", " a\tB "])
    assert count.tolist() == [len(words), 0, 2, 2] and len(set(h[: len(words)].tolist())) == len(set(words))
    assert h[-4:-2].tolist() == h[-2:].tolist()


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_score.lm_scores(frame(spark, [(held, "a b")])).first()
    assert (r.train_tokens, r.n_tokens, r.n_known, r.base_score) == (0, 3, 0, 0.0)
    assert lm_score.lm_scores(frame(spark, [])).count() == 0
